import random

import pytest
from conftest_llm import duck, frame, prose, rows

from sieveline.llm import quality, sharding


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    out = []
    for i in range(700):
        lang, source = rng.choice(["en", "de", "fr"]), rng.choice(["web", "books", None])
        text = ". ".join(prose(rng, lang, rng.randint(5, 30)).capitalize() for _ in range(rng.randint(1, 5)))
        if i % 50 == 0:
            text = "@@ ## $$ %% " * 40
        elif i % 50 == 1:
            text = text.upper()
        elif i % 50 == 2:
            text = "again again again again " * 20
        elif i % 50 == 3:
            text = "the same line\n" * 30
        out.append((i, text, lang, source))
    return frame(spark, out)


def test_rules_agree_with_sql(spark, corpus, odd):
    for docs in (corpus, odd.select("doc_id", "text", "lang", "source", "n_chars")):
        got = quality.judged(docs, ["doc_id", "lang", "source"])
        got = got.select("doc_id", "lang", "source", *[got[f"__q_{k}"].alias(k) for k in quality.SPREAD], *[f"cut_{k}" for k in quality.SPREAD])
        names, want = duck(spark, quality.oracle(), documents=docs)
        assert names == got.columns
        assert rows(got) == want


def test_junk_goes_and_clean_stays(corpus):
    kept = {r.doc_id for r in quality.filtered(corpus).collect()}
    assert not {i for i in range(700) if i % 50 < 4} & kept
    assert kept == {i for i in range(700) if i % 50 > 3}


def test_every_group_has_its_own_cutoff(spark):
    """Sources of different habits: what is junk in one is usual in another."""
    rng = random.Random(6)
    shout = lambda text, share: " ".join(w.upper() if rng.random() < share else w for w in text.split())
    docs = [(i, shout(prose(rng, "en", 80), 0.02 if i % 2 else 0.5), "en", "quiet" if i % 2 else "loud") for i in range(400)]
    docs += [(1000 + i, shout(prose(rng, "en", 80), 0.9), "en", "quiet") for i in range(20)]
    cut = {r["__q_source"]: r.cut_upper for r in quality.cutoffs(frame(spark, docs)).collect()}
    assert cut["loud"] > 2 * cut["quiet"]
    kept = {r.doc_id for r in quality.filtered(frame(spark, docs)).collect()}
    assert kept == set(range(400))


@pytest.mark.parametrize("junk", ["@@ ## $$ %% " * 40, "AGAIN THE SAME " * 30, "again again again again " * 20, "the same line\n" * 30], ids=["symbol", "upper", "repeat", "dupline"])
def test_sources_that_are_forty_percent_junk(spark, junk):
    rng = random.Random(9)
    docs = [(i, junk if i % 5 < 2 else ".\n".join(prose(rng, "de", rng.randint(8, 30)).capitalize() for _ in range(rng.randint(2, 5))), "de", "web") for i in range(300)]
    kept = {r.doc_id for r in quality.filtered(frame(spark, docs)).collect()}
    assert kept == {i for i in range(300) if i % 5 >= 2}


def test_sketch_error_and_merge(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 20001).select(F.col("id").cast("int").alias("v"), quality.bucket(F.col("id").cast("int")).alias("b"))
    for r in df.collect():
        assert r.b <= r.v <= r.b + r.b / 32


def test_odd_rows(odd, empty):
    got = quality.filtered(odd)
    assert got.columns == odd.columns and got.schema == odd.schema
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(6) == 2 and not {1, 2, 3, 11, 13} & set(kept)
    assert rows(quality.filtered(empty)) == []


def test_shards_agree_with_sql_and_weights(spark, odd, empty):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = sharding.assign(docs)
    names, want = duck(spark, sharding.oracle(), documents=docs)
    assert names == got.columns and rows(got) == want
    share = {r.region: r["count"] / 20000 for r in got.groupBy("region").count().collect()}
    for r, (w, _) in sharding.TREE.items():
        assert abs(share[r] - w / 10) < 0.02
    assert sharding.assign(odd).columns == odd.columns  # clashing names are replaced
    assert rows(sharding.assign(empty)) == []


def test_only_changed_subtrees_move(spark):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    changed = dict(sharding.TREE)
    changed["r1"] = (3.0, {**sharding.TREE["r1"][1], "k0": (2.0, sharding.TREE["r1"][1]["k0"][1])})
    a = {r.doc_id: r for r in sharding.assign(docs).collect()}
    b = {r.doc_id: r for r in sharding.assign(docs, tree=changed).collect()}
    moved = [i for i in a if a[i] != b[i]]
    assert moved
    assert all(a[i].region == "r1" == b[i].region and b[i].rack == "k0" for i in moved)
    changed["r0"] = (0.0, sharding.TREE["r0"][1])
    c = {r.doc_id: r for r in sharding.assign(docs, tree=changed).collect()}
    assert all(c[i] == b[i] for i in b if b[i].region != "r0") and all(r.region != "r0" for r in c.values())


def test_a_key_named_like_a_level(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    want = {r.doc_id: tuple(r)[1:] for r in sharding.assign(docs).collect()}
    for name in sharding.LEVELS:
        keyed = docs.withColumn(name, docs.doc_id)
        got = sharding.assign(keyed, name)
        assert got.columns == [*keyed.columns, *[c for c in sharding.LEVELS if c != name]]
        assert {r.doc_id: (r.region, r.rack, r.shard) for r in got.collect()} == want


def test_long_ties_and_repeated_keys(spark):
    keys = ["x" * 2_000_000, "", None, "same", "same"]
    got = [tuple(r)[1:] for r in sharding.assign(spark.createDataFrame([(k,) for k in keys], "doc_id string")).collect()]
    assert got[3] == got[4] and all(all(r) for r in got)


def test_no_positive_weight():
    with pytest.raises(ValueError):
        sharding._choose(None, "", {"x": 0.0})
