"""Plans that grow with the input and no faster, and that keep the results."""

import hashlib
import math
import re
from collections import Counter

from sieveline.functions import text as T
from sieveline.functions.dialect import SPARK
from sieveline.operators import matches, metrics, spans, zones
from sieveline.patterns import content_patterns
from sieveline.plans import catalogue
from sieveline.plans.sql import over
from sieveline.sources import columns as S


def test_collisions_join_each_type_of_a_column_once(spark):
    rows = [(f"c{k % 2}", "ABC"[k % 3]) for k in range(3000)] + [("d", "A"), ("d", None), (None, "A"), (None, "B")]
    given = spark.createDataFrame(rows, "column_id string, entity_type string")
    got = over(spark, lambda f: metrics.collision_matrix(SPARK, f), f=given)
    assert sorted(map(tuple, got.collect())) == [("A", "B", 2), ("A", "C", 2), ("B", "C", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sides = plan[plan.index("Join Inner") :]
    assert sides.count("Aggregate") == 2


def test_batches_of_values_match_as_single_values_do(spark, monkeypatch):
    monkeypatch.setattr(matches, "ROWS", 3)
    values = [None, "", "é", "078-05-1120", "user1@mail1.org and user2@mail2.org", "key ghp_" + "aB3d" * 9, "4111-1111-1111-1111", "Straße 10.20.30.40", "K\u212a 1950-03-14", "-----BEGIN RSA PRIVATE KEY-----", "https://a.example/x", "1EG4-TE5-MK73 " * 40] * 3
    ps = content_patterns()
    plain = [re.compile(("(?i)" if "(?i)" in p.regex else "") + p.regex.replace("(?i)", "").replace("%b", r"\b"), re.ASCII) for p in ps]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string").coalesce(1)
    got = matches.with_hits(df, ps)
    assert got.columns == ["id", "value", "p"]
    assert sorted((r.id, r.p) for r in got.collect()) == sorted((i, k) for i, v in enumerate(values) if v is not None for k, p in enumerate(plain) if p.search(v))
    assert matches.with_hits(df.where("false"), ps).collect() == []


def test_whole_tables_are_matched_in_batches(spark):
    plan = catalogue.run("content_match_whole")(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("] parquet") == 8  # four tables, for matches and for counts


def test_entropy_takes_one_pass_over_the_text(spark):
    texts = ["", "a", "aaaa", "ab\nab\n", "häß 😀😀é", "".join(chr(0x4E00 + k % 15000) for k in range(30000)), "x" * 50000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string").selectExpr("id", f"{T.entropy(SPARK, 'v')} AS h")
    for r in df.collect():
        n = len(texts[r.id])
        assert math.isclose(r.h, sum(-c / n * math.log2(c / n) for c in Counter(texts[r.id]).values()), abs_tol=1e-9)
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_what_a_score_is_made_of(spark):
    plan = catalogue.queries()["opaque_tokens_made"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("md5(" in line or "aggregate(" in line for line in filters)


def test_runs_of_equal_characters_are_placeholders(spark):
    chars = [chr(c) for c in range(32, 127)] + ["é"]
    df = spark.createDataFrame([(c, f"ä{c * n}ß", n) for c in chars for n in (7, 8) if c.lower() != "x"], "c string, v string, n int")
    got = {(r.c, r.n): r.hit for r in df.selectExpr("c", "n", f"{T.placeholder(SPARK, 'v')} AS hit").collect()}
    assert all(hit == (n == 8 and c not in "\\é") for (c, n), hit in got.items())


def test_rules_are_tried_once_for_each_distinct_token(spark, tmp_path):
    docs = [(1, "https://a.example/x 2020-01-01 2020-01-01 short"), (2, "2020-01-01\n<your-key-here>"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    df = catalogue.run("not_secret_rules")(spark, f"{tmp_path}/some")
    r = df.first()
    assert (r.tokens, r.url, r.date, r.placeholder) == (5, 1, 3, 2)
    assert "Aggregate [token" in df._jdf.queryExecution().optimizedPlan().toString()
    r = catalogue.run("not_secret_rules")(spark, f"{tmp_path}/none").first()
    assert (r.tokens, r.url) == (0, None)


def test_samples_rank_only_what_may_be_in_them(spark):
    values = {"few": ["a", "b", "c"] * 70, "many": [str(k) for k in range(5000)], "short": ["x", "y", "y"], "mixed": [str(k % 40) for k in range(150)] + ["z" * 9] * 3}
    long = spark.createDataFrame([(c, v) for c, vs in values.items() for v in vs], "column_id string, value string").repartition(3)
    got = S.samples(long, 100)
    want = {(c, k + 1, v) for c, vs in values.items() for k, v in enumerate(sorted(vs, key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v))[:100])}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [t for _, t in got.dtypes] == ["string", "int", "string"]
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString() and S.samples(long.limit(0)).count() == 0


def test_zones_and_secrets_take_one_pass_of_the_text(spark):
    texts = [None, "", "plain words", 'import os\nfor k in range(3):\n    print(k)\npassword = "hunter2Zq!7x"\n', "a,b;1 -2 $3.5 x4 ٣ +5% 6x\n" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    both = spans.detect(df)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and both.columns == ["id", "text", "zones", "findings", "redacted"]
    apart = spans.adjusted(spans.scan_text(zones.with_zones(df)))
    assert sorted(map(str, both.select("id", "zones", "findings").collect())) == sorted(map(str, apart.select("id", "zones", "findings").collect()))
    assert [zones.features(t.split("\n"))[k] for t in texts[4:] for k in ("numeric", "delimiter")] == [16 / 28, 0.0]
