import random

import numpy as np
import pytest
from conftest_llm import frame, prose, rows

from sieveline.llm import bpe, dac

TEXTS = ["", " ", "Hello world", "I'll can't  we've\n\n\tthey'd", "naïve café ☕ 𝒳   end", "1234 x5 ½ ² Ⅷ", "a" * 5000, "\x1c\x1d   　x", "__init__(self): # no", "日本語 текст ελληνικά", "<|endoftext|> ▁ ▁▁", "tab\tnew\r\nline ", "\x00\x01\x7f", "é combining", "  leading and trailing  "]


def plain():
    import tiktoken

    ranks = {t: r for r, t in enumerate(bpe.load_ranks(bpe.VOCABULARY)) if t}
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


def test_ids_agree_with_the_plain_encoder():
    ref, c = plain(), bpe.codec()
    rng = random.Random(3)
    alphabet = "abcXYZ 019.,'\n\t_-éß中☕½  "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t in texts:
        ids = np.frombuffer(c.encode(t), np.int32)
        assert c.decode(ids).decode() == t
        assert ids.tolist() == ref.encode_ordinary(t), t


def test_encoded_frame(spark, odd, empty, odd_rows):
    got = bpe.encoded(odd)
    assert got.columns == [c for c in odd.columns if c != "text"] + ["n_tokens", "token_ids", "round_trip"]
    ref = plain()
    by = sorted(((r.doc_id, r.n_tokens, r.token_ids, r.round_trip) for r in got.collect()), key=repr)
    want = sorted(((i, None, None, None) if t is None else (i, len(x := ref.encode_ordinary(t)), x, True) for i, t, *_ in odd_rows), key=repr)
    assert by == want
    assert rows(bpe.encoded(empty)) == []


def test_random_access():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1 << b, n) for b, n in ((8, 10), (16, 3000), (24, 1500), (32, 2000), (1, 0), (17, 1), (8, 600), (16, 512), (16, 513))]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for d, blob in zip(docs, dac.encode(np.concatenate(docs), at)):
        c = dac.Codes(blob)
        assert len(c) == len(d) and c.all().tolist() == d.tolist()
        assert [c[i] for i in range(len(d))] == d.tolist()
        with pytest.raises(IndexError):
            c[len(d)]


def test_codes_frame(spark, odd, empty, odd_rows):
    from pyspark.sql import functions as F

    got = dac.written_codes(odd)
    ref = plain()
    want = {i: t for i, t, *_ in odd_rows if i is not None}
    for r in got.collect():
        if r.doc_id is None:
            continue
        if want[r.doc_id] is None:
            assert r.codes is None and r.n_tokens is None
        else:
            assert dac.Codes(bytes(r.codes)).all().tolist() == ref.encode_ordinary(want[r.doc_id])
    one = got.where("doc_id = 12").select(*[dac.token_at(F.col("codes"), F.lit(k)).alias(str(k)) for k in (0, 1, 2, 9999)], dac.token_at(F.col("codes"), F.lit(None).cast("int")).alias("none")).first()
    assert list(one) == [*ref.encode_ordinary(want[12])[:3], None, None]
    assert rows(dac.written_codes(empty)) == []


def test_other_vocabulary(spark):
    docs = frame(spark, [(1, prose(random.Random(1), "de", 100), "de", "web")])
    got = bpe.encoded(docs, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").first()
    assert got.round_trip and got.n_tokens == len(got.token_ids) > 0


def test_words_of_scripts_without_spaces():
    from sieveline.llm.common import word_spans

    for text, want in (("中文，你好 abc", ["中", "文", "你", "好", "abc"]), ("a中b1", ["a", "中", "b1"]), ("ภาษา ไทย", list("ภาษาไทย")), ("naïve «café»—ok… ½", ["naïve", "café", "ok"]), ("カナabc。", ["カ", "ナ", "abc"]), ("привет, мир", ["привет", "мир"]), ("", [])):
        raw = text.encode() + b"\n"
        data = np.frombuffer(raw, np.uint8)
        start, end = word_spans(data)
        assert [raw[i:j].decode() for i, j in zip(start, end)] == want
