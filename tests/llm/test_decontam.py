import random

from conftest_llm import frame, prose, rows

from sieveline.llm import decontam


def approximate(item: str, text: str) -> int:
    """Least edit distance of the item to any substring, by the full table."""
    d = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(d[j] + 1, new[j - 1] + 1, d[j - 1] + (x != y)))
        d = new
    return min(d)


def edited(rng, s, n):
    for _ in range(n):
        p = rng.randrange(len(s))
        s = rng.choice([s[:p] + s[p + 1 :], s[:p] + "q" + s[p:], s[:p] + "z" + s[p + 1 :]])
    return s


def case(seed=11):
    rng = random.Random(seed)
    items = [(i, prose(rng, "en", rng.randint(6, 14))) for i in range(12)] + [(12, "short one")]
    docs = []
    for i in range(80):
        text = prose(rng, "en", 40)
        if i % 2:
            x = rng.choice(items)[1]
            x = edited(rng, x, rng.randint(0, max(1, len(x) * 12 // 100)))
            p = rng.randint(0, len(text))
            text = f"{text[:p]}, {x.upper()}!\n{text[p:]}"
        docs.append((i, text, "en", "web"))
    return docs, items


def test_leaks_against_brute_force(spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, text, *_ in docs:
        t = decontam.clean(text)
        for n, x in items:
            k = decontam.budget(decontam.clean(x))
            d = approximate(decontam.clean(x), t) if k else (0 if f" {x} " in f" {t} " else 1)
            if d <= k:
                want.add((i, n, d, k))
    got = {tuple(r) for r in decontam.leaks(frame(spark, docs), bench).collect()}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontam.filtered(frame(spark, docs), bench).collect()}
    assert kept == set(range(80)) - {i for i, *_ in want}


def test_parts_give_the_same(spark, monkeypatch):
    docs, items = case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = rows(decontam.leaks(frame(spark, docs), bench))
    real = decontam.parts
    monkeypatch.setattr(decontam, "parts", lambda b: real(b, 200))
    assert rows(decontam.leaks(frame(spark, docs), bench)) == whole


def test_myers_against_full_table():
    rng = random.Random(6)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        k = rng.randint(0, len(a))
        d = approximate(a, t)
        assert decontam.Myers(a)(t, k) == min(d, k + 1)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the silver river"), (1, "the silver river"), (2, None), (3, ""), (None, "one two"), (4, "?!")], "item_id long, text string")
    got = decontam.filtered(odd, bench)
    assert got.columns == odd.columns
    assert {r.doc_id for r in odd.collect()} - {r.doc_id for r in got.collect()} <= {10, 8}
    assert (10, None, 0, 0) in {tuple(r) for r in decontam.leaks(odd, bench).collect()}
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontam.filtered(odd, none)) == rows(odd) and rows(decontam.leaks(odd, none)) == [] and rows(decontam.leaks(empty, bench)) == []


def test_very_long_item_and_text(spark):
    rng = random.Random(12)
    item = prose(rng, "de", 400)
    text = prose(rng, "de", 50000) + " " + edited(rng, item, 30) + " " + prose(rng, "de", 1000)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontam.leaks(frame(spark, [(1, text, "de", "web"), (2, prose(rng, "de", 500), "de", "web")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and 0 < got[0].distance <= 30


def test_text_ids_and_other_punctuation(spark):
    item = "the quick brown river stone market jumps over lazy yellow windows every single morning"
    docs = frame(spark, [(1, f"x {item.replace('river stone', 'river\u2014stone').replace('lazy ', '\u00ablazy\u00bb\u3000')} y", "en", "web"), (2, "nothing at all", "en", "web")]).selectExpr("concat('u', doc_id) AS doc_id", "text")
    bench = spark.createDataFrame([("q1", item), (None, item)], "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, bench).collect()}
    assert got == {("u1", "q1", 0), ("u1", None, 0)}
    assert [r.doc_id for r in decontam.filtered(docs, bench).collect()] == ["u2"]
