import random
from collections import Counter

import numpy as np
from conftest_llm import duck, frame, prose, rows

from sieveline.llm import lines, near


def corpus(seed=3):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(60):
        words = prose(rng, "en", rng.randint(60, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
            out.append((i, " ".join(w), "en", "web"))
            i += 1
    rng.shuffle(out)
    return out


def similarity(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def shingled(text):
    w = text.split()
    return Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))


def test_near_groups_against_brute_force(spark):
    docs = corpus()
    sets = {i: shingled(t) for i, t, *_ in docs}
    ids = sorted(sets)
    true = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if similarity(sets[a], sets[b]) >= near.THRESHOLD}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(true):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(i, find(i)) for i in ids if find(i) != i}
    got = {tuple(r) for r in near.duplicates(frame(spark, docs)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    kept = {r.doc_id for r in near.filtered(frame(spark, docs)).collect()}
    assert kept == set(ids) - {i for i, _ in got}


def test_verified_pairs_are_true(spark):
    docs = corpus(9)
    sets = {i: shingled(t) for i, t, *_ in docs}
    for r in near.pairs(frame(spark, docs)).collect():
        assert abs(r.similarity - similarity(sets[r.a], sets[r.b])) < 1e-9 and r.a < r.b


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    e = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    x, y = np.zeros(400), np.zeros(400)
    x[:300] = rng.integers(1, 9, 300)
    y[100:] = rng.integers(1, 9, 300)
    doc = np.concatenate([np.zeros(300, np.int64), np.ones(300, np.int64)])
    el = np.concatenate([e[:300], e[100:]])
    w = np.concatenate([x[:300], y[100:]]).astype(np.int64)
    seen = []
    for k in range(40):
        sig = near.registers(doc, near.mix(el + np.uint64(k)), w, 2)
        seen.append((sig[0] == sig[1]).mean())
    both = (x > 0) & (y > 0)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs(np.mean(seen) - want) < 0.03


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "a long, b long")
    got = {tuple(r) for r in near.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(301, 300)}


def test_near_odd_rows(odd, empty, odd_rows):
    got = near.filtered(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(None) == 2
    assert set(ids) == {i for i, *_ in odd_rows} - {7}
    assert rows(near.filtered(empty)) == [] and rows(near.duplicates(empty)) == []


def test_large_bucket_is_searched_whole(spark):
    text = prose(random.Random(8), "en", 80)
    docs = [(i, text + f" tail{i}", "en", "web") for i in range(600)]
    assert rows(near.duplicates(frame(spark, docs))) == sorted(((i, 0) for i in range(1, 600)), key=repr)


def test_large_bucket_of_rejected_pairs_keeps_true_ones(spark):
    """400 documents of one template (similarity 0.45, rejected) and 40 pairs of 0.51 among them,
    most of whose common bands are those of the template."""
    rng = random.Random(12)
    template = prose(rng, "en", 100)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs = [f"{template} {own(60)}" for _ in range(400)]
    twins = [f"{' '.join(docs[i].split()[:108])} {own(52)}" for i in range(0, 400, 10)]
    texts = dict(enumerate(docs + twins))
    near_ids = {400 + k: 10 * k for k in range(40)}
    some = [(i, j) for i in range(0, 440, 7) for j in range(i + 1, 440, 5)]
    sets = {i: shingled(t) for i, t in texts.items()}
    assert all(near.THRESHOLD < similarity(sets[a], sets[b]) < 0.52 for a, b in near_ids.items())
    assert all(near.SCREEN < similarity(sets[a], sets[b]) < near.THRESHOLD for a, b in some if near_ids.get(b) != a)
    got = {tuple(r) for r in near.duplicates(frame(spark, [(i, t, "en", "web") for i, t in texts.items()])).collect()}
    assert got <= set(near_ids.items()) and len(got) >= 39


def groups_of(sets):
    """(id, least id of its group) by all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if similarity(sets[a], sets[b]) >= near.THRESHOLD:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {(i, find(i)) for i in ids if find(i) != i}


def templated(n=300, twins=75, seed=12):
    """Documents of one template (0.42 alike) and pairs of them that are 0.51 alike, each text twice."""
    rng = random.Random(seed)
    template = prose(rng, "en", 100)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs = [f"{template} {own(66)}" for _ in range(n)]
    docs += [f"{' '.join(docs[i].split()[:114])} {own(52)}" for i in range(twins)]
    docs += docs[: n // 10]
    return dict(enumerate(docs))


def test_twins_in_a_template_are_all_found(spark):
    """Hundreds of rejected pairs for each true one in the same buckets: the answer is that of all pairs."""
    texts = templated()
    want = groups_of({i: shingled(t) for i, t in texts.items()})
    got = {tuple(r) for r in near.duplicates(frame(spark, [(i, t, "en", "web") for i, t in texts.items()])).collect()}
    assert got <= want and len(got) >= len(want) - 1


def test_salted_buckets_and_blocks_connect_the_same(spark, monkeypatch):
    """Heavy buckets split by a salt, residual ones cut into many blocks."""
    texts = templated(120, 30, 3)
    docs = frame(spark, [(i, t, "en", "web") for i, t in texts.items()] + [(1000 + i, t, "en", "web") for i, t, *_ in corpus(4)])
    want = rows(near.duplicates(docs))
    for name, value in (("SAMPLE", 1), ("HEAVY", 16), ("BLOCK", 20)):
        monkeypatch.setattr(near, name, value)
    assert near.buckets(near.written(near.signatures(near.identified(docs)).selectExpr("doc_id AS id", "sig"), "t"))[1] is not None
    assert rows(near.duplicates(docs)) == want


def test_tasks_of_many_pairs_settle_inside(spark):
    c = {"task": np.zeros(40, np.int64), "id": np.arange(40), "comp": np.arange(40)}
    raw = [np.full(near.REGISTERS, 7, np.uint32).tobytes()] * 40
    import pyarrow as pa

    a, b, task = near._cross(c | {"sig": pa.array(raw, pa.binary())})
    assert list(a) == list(range(40)) and list(b) == list(range(40)) and task.null_count == 0
    few = {k: v[:4] for k, v in c.items()}
    a, b, task = near._cross(few | {"sig": pa.array(raw[:4], pa.binary())})
    assert sorted(zip(a, b)) == [(i, j) for i in range(4) for j in range(i + 1, 4)] and task.null_count == 6
    el = [np.array([1, 2, 3 + i // 2], np.uint64).tobytes() for i in range(40)]
    a, b, sim = near._settle(c | {"sig": pa.array(raw, pa.binary()), "s": pa.array(el, pa.binary()), "n": pa.array([np.ones(3, np.uint32).tobytes()] * 40, pa.binary())})
    assert len(a) == 39 and set(sim) <= {0.5, 1.0}


def test_text_ids(spark):
    docs = frame(spark, corpus())
    named = docs.selectExpr("concat('https://x/', lpad(doc_id, 6, '0')) AS doc_id", "text", "lang", "source", "n_chars")
    want = {(f"https://x/{a:06d}", f"https://x/{b:06d}") for a, b in near.duplicates(docs).collect()}
    assert {tuple(r) for r in near.duplicates(named).collect()} == want
    assert near.filtered(named).count() == docs.count() - len(want)


def line_corpus():
    rng = random.Random(7)
    base = [prose(rng, "de", rng.randint(5, 15)) for _ in range(60)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 7)):
            s = rng.choice(base)
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(s))
                s = rng.choice([s[:p] + s[p + 1 :], s[:p] + rng.choice("abcxyz") + s[p:], s[:p] + rng.choice("abcxyz") + s[p + 1 :]])
            out.append(rng.choice([s, s.upper(), s]))
        docs.append((i, "\n".join(out), "de", "web"))
    return docs


def test_lines_against_brute_force(spark):
    # DuckDB's levenshtein counts bytes, as the operator does
    docs = frame(spark, line_corpus())
    got = lines.deduped(docs.select("doc_id", "text")).withColumnRenamed("__l_removed", "n_removed")
    names, want = duck(spark, lines.ORACLE, documents=docs)
    assert names == got.columns and rows(got) == want
    assert sum(r[2] for r in want) > 20


def test_large_key_groups_are_split(spark):
    """Groups of more lines than a task compares give the same result."""
    rng = random.Random(3)
    stamp = lambda: f"{rng.randrange(10)}{rng.randrange(10)}:{rng.randrange(10)}"
    logs = [(100 + i, "\n".join(f"2024-05-01T{stamp()} INFO worker started with state {rng.choice(['ok', 'up', 'go'])} and no more" for _ in range(12)), "en", "web") for i in range(25)]
    docs = frame(spark, [*line_corpus(), *logs])
    want = {(r.doc_id, *sorted(r["__l_numbers"])) for r in lines.removed(docs).collect()}
    for big in (3, 40):
        assert {(r.doc_id, *sorted(r["__l_numbers"])) for r in lines.removed(docs, big).collect()} == want
    names, sql = duck(spark, lines.ORACLE, documents=docs)
    got = lines.deduped(docs.select("doc_id", "text")).withColumnRenamed("__l_removed", "n_removed")
    assert names == got.columns and rows(got) == sql


def test_candidates_stream_whole_groups():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    group = np.sort(rng.choice(60, 4000, p=np.r_[0.4, np.full(59, 0.6 / 59)]))
    word = (group.astype(np.int64) << 20) | rng.integers(0, 4, 4000) << 18
    line = rng.integers(0, 900, 4000)
    order = np.lexsort((line, word))
    word, line = word[order], line[order]
    by = {}
    for w, x in zip(word.tolist(), line.tolist()):
        by.setdefault(w >> 20, {})[w, x] = None
    for batch, big in ((37, 50), (4000, 50), (100, 10**6), (1, 20)):
        got = [r for t in lines._candidates([pa.RecordBatch.from_arrays([pa.array(word[i : i + batch]), pa.array(line[i : i + batch])], names=["word", "line"]) for i in range(0, 4000, batch)], big) for r in t.to_pylist()]
        heavy: dict = {}
        for r in got:
            if r["heavy"] is not None:
                heavy.setdefault(r["heavy"], []).append((r["a"], r["b"], r["block"]))
        assert set(heavy) == {g for g, x in by.items() if len(x) > big}
        for g, x in heavy.items():
            assert sorted((a, b) for a, b, _ in x) == sorted(by[g])
            assert max(Counter(k for *_, k in x).values()) <= big
        pairs = {(r["a"], r["b"]) for r in got if r["heavy"] is None}
        want = set()
        for g, x in by.items():
            if len(x) <= big:
                xs = list(x)
                want |= {(min(p[1], q[1]), max(p[1], q[1])) for k, p in enumerate(xs) for q in xs[k + 1 :] if p[1] != q[1] and lines._possible(np.array([p[0]], np.int64).view(np.uint64), np.array([q[0]], np.int64).view(np.uint64))[0]}
        assert pairs == want


def test_second_hash_tells_slices():
    raw = np.frombuffer(b"abcabcabdcbaab", np.uint8)
    spans = [(i, j) for i in range(14) for j in range(i, 15)]
    h = lines.second(raw, np.array([i for i, _ in spans]), np.array([j for _, j in spans]))
    by: dict = {}
    for (i, j), v in zip(spans, h.tolist()):
        if j > i:
            by.setdefault(v, set()).add(raw[i:j].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({raw[i:j].tobytes() for i, j in spans if j > i})


def test_lines_text_ids(spark):
    docs = frame(spark, line_corpus())
    named = docs.selectExpr("concat('https://x/', lpad(doc_id, 6, '0')) AS doc_id", "text", "lang", "source", "n_chars")
    want = {(f"https://x/{i:06d}", t, n) for i, t, n in lines.deduped(docs.select("doc_id", "text")).collect()}
    assert {tuple(r) for r in lines.deduped(named.select("doc_id", "text")).collect()} == want


def test_lines_of_shared_passages(spark):
    """Thousands of copies of one line: no pair is built for exact copies."""
    line = "this very same sentence stands in every one of the documents of this table"
    docs = frame(spark, [(i, f"{line}\nown text of document number {i} that is long enough to count, {i * 7919 % 1000003}", "en", "web") for i in range(3000)])
    got = {r.doc_id: r.text for r in lines.filtered(docs).collect()}
    assert got[0].startswith(line) and sum(line in t for t in got.values()) == 1


def test_within_against_full_table():
    rng = random.Random(2)

    def full(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
        for k in (1, 2, 3):
            assert lines.within(a, bytes(b), k) == (full(a, bytes(b)) <= k)


def test_lines_odd_rows(odd, empty, odd_rows):
    got = lines.filtered(odd)
    assert got.columns == odd.columns
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    # the copies of document 6 are one document; 7 lost its only line and goes
    assert len(by[6]) == 2 and 7 not in by and by[1] == [None] and by[2] == [""] and len(by[None]) == 2
    assert rows(lines.filtered(empty)) == []
