import random

import numpy as np
import pytest
from conftest_llm import CLASHING, WORDS, frame, prose, rows

from sieveline.llm import langid


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return langid.train([(k, prose(rng, k, 120)) for k in WORDS for _ in range(40)])


def test_chain_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (5, 3), (7, 2)):
        score, first, follow = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(k, k))
        begin = np.zeros(n, bool)
        begin[0] = True
        if n > 4:
            begin[3] = True
        want = np.zeros((n, k))
        for path in product(range(k), repeat=n):
            w = 1.0
            for i, y in enumerate(path):
                w *= np.exp(score[i, y] + (first[y] if begin[i] else follow[path[i - 1], y]))
            for i, y in enumerate(path):
                want[i, y] += w
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(langid.chain(score, first, follow, begin), want)


def test_long_chain_is_stable():
    rng = np.random.default_rng(5)
    got = langid.chain(rng.normal(size=(40000, 4)) * 30, np.zeros(4), rng.normal(size=(4, 4)), np.arange(40000) % 997 == 0)
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_held_out_code_switching(model):
    rng = random.Random(99)
    hit = total = 0
    for _ in range(60):
        words, gold = [], []
        for _ in range(4):
            k = rng.choice(sorted(WORDS))
            n = rng.randint(4, 10)
            words += [rng.choice(WORDS[k]) for _ in range(n)]
            gold += [k] * n
        raw = np.frombuffer((" ".join(words) + "\n").encode(), np.uint8)
        _, lab = langid.label(model, np.array([0, len(raw)]), raw)
        assert len(lab) == len(gold)
        hit += sum(model.labels[x] == y for x, y in zip(lab, gold))
        total += len(gold)
    assert hit / total > 0.95


def test_unseen_words_by_their_affixes(model):
    rng = random.Random(7)
    for k, tail in (("de", "straßenlichter bergmärkte"), ("fr", "fenêtres lumières"), ("es", "mañanas montañas")):
        raw = np.frombuffer(f"{prose(rng, k, 3)} {tail} {prose(rng, k, 3)}\n".encode(), np.uint8)
        _, lab = langid.label(model, np.array([0, len(raw)]), raw)
        assert [model.labels[x] for x in lab] == [k] * len(lab)


def test_spans(spark, model, odd, empty):
    rng = random.Random(2)
    docs = frame(spark, [(1, f"{prose(rng, 'de', 12)}, {prose(rng, 'fr', 9)}", None, "web"), (2, prose(rng, "es", 20), "en", "web")], CLASHING)
    got = {r.doc_id: r for r in langid.labelled(docs, model).collect()}
    assert (got[1].span_langs, got[1].n_switches, got[1].lang, got[1].n_words) == (["de", "fr"], 1, "de", 21) and abs(got[1].span_words[0] - 12) <= 1
    assert (got[2].lang, got[2].share) == ("es", 10000)
    for r in langid.labelled(odd, model).collect():
        assert sum(r.span_words) == r.n_words and len(r.span_langs) == len(r.span_words)
        assert (r.lang is None) == (r.n_words == 0) == (r.share is None)
    assert rows(langid.labelled(empty, model)) == []


def test_sample_bound_and_labels(spark, odd, empty):
    docs = frame(spark, [(i, f"text {i}", "en" if i % 2 else "de", "web") for i in range(800)])
    got = langid.sample(docs)
    assert [sum(x == k for x, _ in got) for k in ("de", "en")] == [langid.TRAIN_DOCS] * 2
    assert {x for x, _ in langid.sample(odd)} <= {"en", "de", "es", "fr"}
    none = langid.train(langid.sample(empty))
    assert none.labels == [] and {r.n_words for r in langid.labelled(odd, none).collect()} == {0}
    one = langid.train([("en", "some words here")])
    assert {r.lang for r in langid.labelled(docs, one).collect()} == {"en"}


def test_more_labels_than_bits(spark, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 300)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(8)] for k in range(70)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    model = langid.train([(lang, text(lang)) for lang in words for _ in range(3)])
    keys, sets = model.words, model.sets
    assert model.labels == sorted(words) and sets.shape == (len(keys), 2)
    for k, lang in enumerate(model.labels):
        raw = np.frombuffer((words[lang][0] + "\n").encode(), np.uint8)
        rows_, *_ = langid.features(raw, np.array([0]), np.array([6]), keys, sets, 70)
        assert (1 << langid.BITS) + k in rows_[0]
    docs = frame(spark, [(k, text(lang), None, "web") for k, lang in enumerate(model.labels)])
    got = {r.doc_id: r.lang for r in langid.labelled(docs, model).collect()}
    assert sum(got[k] == lang for k, lang in enumerate(model.labels)) >= 66
