import math

import pytest

from sieveline.functions import text as T
from sieveline.functions.dialect import SPARK
from sieveline.model import FINDING
from sieveline.operators import classify as C
from sieveline.operators import engines, passes, profile, rollup
from sieveline.operators.engines import FIELDS
from sieveline.plans.sql import chain, over
from sieveline.sources import columns as S


def columns(spark, *names, table="t", group=""):
    return spark.createDataFrame([(group, f"{table}.{n}", n, table, "STRING") for n in names], "group_id string, column_id string, column_name string, table_name string, data_type string")


def samples(spark, **values):
    rows = [(f"t.{c}", i, v) for c, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "column_id string, pos bigint, value string")


def test_profile_against_python(spark):
    vals = ["abc", "abc", "12345", "", "Zürich 9", "x" * 40, "password", "public service", None]
    df = spark.createDataFrame([("c", v) for v in vals], "column_id string, value string")
    r = profile.profile(df).first()
    got = [v for v in vals if v is not None]
    n = len(got)
    assert (r.n_values, r.n_distinct, r.min_length, r.max_length, r.uniform) == (n, len(set(got)), 0, 40, False)
    f1 = sum(got.count(v) == 1 for v in set(got))
    f2 = sum(got.count(v) == 2 for v in set(got))
    assert r.cardinality == min(1.0, (len(set(got)) + f1 * (f1 - 1) / (2 * (f2 + 1))) / n)
    mean = sum(map(len, got)) / n
    assert math.isclose(r.mean_length, mean) and math.isclose(r.std_length, math.sqrt(sum((len(v) - mean) ** 2 for v in got) / n))

    def h(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    full = [v for v in got if v]
    assert math.isclose(r.entropy, sum(map(h, full)) / len(full), abs_tol=1e-9)
    assert r.digit_ratio == 1 / n and r.word_ratio == 2 / n


@pytest.mark.parametrize(
    ("name", "entity", "conf"),
    [("ssn", "SSN", 0.95), ("customerSSN", "SSN", 0.95), ("dob", "DATE_OF_BIRTH", 0.9), ("home-email", "EMAIL", 0.9), ("cust_phone_x", "PHONE", 0.765), ("mob", "PHONE", 0.9 * 0.95), ("zip_x_y", "ADDRESS", 0.68), ("random_thing", None, 0), ("my_mob_x", "PHONE", 0.9 * 0.85 * 0.95)],
)
def test_column_names(spark, name, entity, conf):
    cols = columns(spark, name, table="things")
    got = over(spark, lambda c: chain(engines.by_name(SPARK, c), "SELECT * FROM by_name"), c=cols).collect()
    assert [(r.entity_type, round(r.confidence, 6)) for r in got] == ([(entity, round(conf, 6))] if entity else [])


def test_table_context(spark):
    got = over(spark, lambda c: chain(engines.by_name(SPARK, c), "SELECT * FROM by_name"), c=columns(spark, "email", table="UserProfiles")).first()
    assert got.confidence == pytest.approx(0.95)


def finding(spark, *rows):
    """Rows of (column, type, confidence, engine, authority, extra...)."""
    out = []
    for k, r in enumerate(rows):
        col, et, conf, eng, auth, *rest = r
        x = rest[0] if rest else {}
        out.append((col, et, x.get("category", "PII"), x.get("sensitivity", "HIGH"), conf, x.get("regulatory", []), eng, auth, k, "", x.get("detection", ""), x.get("matched"), x.get("validated"), x.get("scanned"), x.get("matches", [])))
    return spark.createDataFrame(out, FINDING).select(*FIELDS)


def apply(spark, build, df, **more):
    got = over(spark, lambda f, **v: build(f, **v), f=df, **more)
    return sorted((r.column_id, r.entity_type, round(r.confidence, 4)) for r in got.collect())


def test_calibration(spark):
    df = finding(spark, ("a", "X", 0.8, "regex", 5, {"matched": 2}), ("b", "X", 0.8, "regex", 5, {"matched": 5}), ("c", "X", 0.8, "regex", 5, {"matched": 6}), ("d", "X", 0.97, "column_name", 10), ("e", "X", 0.7, "column_name", 10), ("f", "X", 0.8, "heuristic_stats", 1), ("g", "X", 0.8, "secret_scanner", 1))
    assert apply(spark, lambda f: passes.calibrated(SPARK, f), df) == [("a", "X", 0.72), ("b", "X", 0.76), ("c", "X", 0.8), ("d", "X", 1.0), ("e", "X", 0.73), ("f", "X", 0.76), ("g", "X", 0.8)]


def test_merge_authority_then_confidence_then_first(spark):
    df = finding(spark, ("a", "X", 0.9, "regex", 5), ("a", "X", 0.6, "column_name", 10), ("b", "X", 0.6, "regex", 5), ("b", "X", 0.7, "regex", 5), ("c", "X", 0.6, "regex", 5, {"detection": "p"}), ("c", "X", 0.9, "regex", 5, {"detection": "q"}))
    assert apply(spark, lambda f: passes.merged(SPARK, f), df) == [("a", "X", 0.6), ("b", "X", 0.7), ("c", "X", 0.6), ("c", "X", 0.9)]


def test_weighting(spark):
    df = finding(spark, ("a", "SSN", 0.9, "column_name", 10), ("a", "ABA_ROUTING", 0.8, "regex", 5), ("a", "SSN", 0.5, "heuristic_stats", 1, {"detection": "d"}), ("b", "EMAIL", 0.9, "regex", 5), ("b", "PHONE", 0.6, "secret_scanner", 1))
    none = spark.createDataFrame([], "column_id string")
    got = apply(spark, lambda f, k: passes.weighted(SPARK, f, f, k), df, k=none)
    # the second SSN is of an engine that agrees too, and gains as well
    assert got == [("a", "SSN", 0.55), ("a", "SSN", 0.95), ("b", "EMAIL", 0.9), ("b", "PHONE", 0.6)]
    skip = spark.createDataFrame([("a",)], "column_id string")
    assert len(apply(spark, lambda f, k: passes.weighted(SPARK, f, f, k), df, k=skip)) == 5


def test_collisions(spark):
    df = finding(
        spark, ("gap", "SSN", 0.9, "regex", 5), ("gap", "ABA_ROUTING", 0.7, "regex", 5), ("near", "SSN", 0.8, "regex", 5), ("near", "ABA_ROUTING", 0.75, "regex", 5),
        ("sum", "SSN", 0.85, "regex", 5), ("sum", "ABA_ROUTING", 0.6, "regex", 5, {"matched": 10, "validated": 9}), ("weak", "SSN", 0.85, "regex", 5), ("weak", "ABA_ROUTING", 0.6, "regex", 5, {"matched": 10, "validated": 1}),
    )
    got = apply(spark, lambda f: passes.collision(SPARK, f, "SSN", "ABA_ROUTING"), df)
    assert got == [("gap", "SSN", 0.9), ("near", "ABA_ROUTING", 0.75), ("near", "SSN", 0.8), ("sum", "ABA_ROUTING", 0.6), ("weak", "SSN", 0.85)]


def test_phone_generic_urls_noise(spark):
    df = finding(spark, ("t.x", "PHONE", 0.9, "regex", 5), ("t.x", "DATE", 0.6, "regex", 5), ("t.mobile", "PHONE", 0.9, "regex", 5), ("t.mobile", "DATE", 0.6, "regex", 5))
    assert apply(spark, lambda f, c: passes.phone(SPARK, f, c), df, c=columns(spark, "x", "mobile")) == [("t.mobile", "DATE", 0.6), ("t.mobile", "PHONE", 0.9), ("t.x", "DATE", 0.6)]
    df = finding(spark, ("a", "CREDENTIAL", 0.8, "regex", 5), ("a", "EMAIL", 0.8, "regex", 5), ("b", "CREDENTIAL", 0.8, "regex", 5), ("b", "EMAIL", 0.7, "regex", 5), ("c", "CREDENTIAL", 0.8, "regex", 5))
    assert apply(spark, lambda f: passes.generic(SPARK, f), df) == [("a", "EMAIL", 0.8), ("b", "CREDENTIAL", 0.8), ("b", "EMAIL", 0.7), ("c", "CREDENTIAL", 0.8)]
    df = finding(spark, ("a", "IP_ADDRESS", 0.8, "regex", 5, {"matches": ["http://1.2.3.4/x", " HTTPS://y"]}), ("b", "IP_ADDRESS", 0.8, "regex", 5, {"matches": ["http://1.2.3.4", "1.2.3.4"]}), ("c", "IP_ADDRESS", 0.8, "regex", 5))
    assert apply(spark, lambda f: passes.in_urls(SPARK, f), df) == [("b", "IP_ADDRESS", 0.8), ("c", "IP_ADDRESS", 0.8)]
    df = finding(spark, ("a", "API_KEY", 0.8, "regex", 5, {"matches": ["changeme", "true"]}), ("b", "API_KEY", 0.8, "regex", 5, {"matches": ["changeme", "k3Jx9"]}), ("c", "EMAIL", 0.8, "regex", 5, {"matches": ["true"]}))
    assert apply(spark, lambda f: passes.noise(SPARK, f), df) == [("b", "API_KEY", 0.8), ("c", "EMAIL", 0.8)]


def test_siblings(spark):
    cols = spark.createDataFrame([("g", f"t.{i}", str(i), "t", "STRING") for i in range(4)], "group_id string, column_id string, column_name string, table_name string, data_type string")
    df = finding(spark, ("t.0", "NPI", 0.9, "regex", 5), ("t.1", "MRN", 0.9, "regex", 5), ("t.2", "DEA_NUMBER", 0.9, "regex", 5), ("t.3", "ABA_ROUTING", 0.6, "regex", 5), ("t.3", "SSN", 0.55, "regex", 5))
    got = apply(spark, lambda f, c: passes.siblings(SPARK, f, c, 0.55), df, c=cols)
    assert got == [("t.0", "NPI", 1.0), ("t.1", "MRN", 1.0), ("t.2", "DEA_NUMBER", 1.0), ("t.3", "SSN", 0.6)]


def test_ranking(spark):
    df = finding(spark, ("a", "PERSON_NAME", 0.96, "regex", 5), ("a", "ADDRESS", 0.7, "regex", 5), ("a", "SSN", 0.9, "regex", 5), ("a", "URL", 0.6, "regex", 5))
    got = over(spark, lambda f: passes.ranked(SPARK, f), f=df).orderBy("place").collect()
    assert [r.entity_type for r in got] == ["ADDRESS", "PERSON_NAME", "SSN"]
    assert [r.entity_type for r in over(spark, lambda f: passes.ranked(SPARK, f, 1), f=df).collect()] == ["ADDRESS"]
    assert {r.entity_type for r in over(spark, lambda f: passes.ranked(SPARK, f, aggressive=True), f=df).collect()} == {"PERSON_NAME", "SSN"}


def test_rollups(spark):
    df = finding(spark, ("c1", "SSN", 0.9, "regex", 5, {"sensitivity": "CRITICAL", "regulatory": ["HIPAA", "PII"]}), ("c1", "EMAIL", 0.9, "regex", 5, {"regulatory": ["GDPR", "PII"]}), ("c2", "EMAIL", 0.9, "regex", 5), ("lost", "URL", 0.9, "regex", 5))
    parents = spark.createDataFrame([("c1", "t1"), ("c2", "t2")], "column_id string, parent string")
    t = rollup.compute_rollups(df, parents)
    assert sorted(map(tuple, t.collect())) == [("t1", "CRITICAL", ["EMAIL", "SSN"], ["GDPR", "HIPAA", "PII"], 2), ("t2", "HIGH", ["EMAIL"], [], 1)]
    d = rollup.rollup_from_rollups(t, spark.createDataFrame([("t1", "d"), ("t2", "d")], "child string, parent string"))
    assert [tuple(r) for r in d.collect()] == [("d", "CRITICAL", ["EMAIL", "SSN"], ["GDPR", "HIPAA", "PII"], 3)]


def test_classify_from_end_to_end(spark):
    cols = columns(spark, "ssn", "contact_email", "blob", "note", "nothing", "stamp")
    vals = samples(
        spark, ssn=[f"{100 + i}-45-{6000 + i}" for i in range(20)], contact_email=[f"u{i}@mail.org" for i in range(20)], blob=[f"Zq{i:02d}xK9_vT3mN8pL-aW5cR7dY1fH4jQ2sE6" for i in range(20)],
        note=[f"the public service invoice {i}" for i in range(20)], nothing=[str(i % 3) for i in range(20)], stamp=[None, ""],
    )
    top = {r.column_id: r.entity_type for r in C.classify(cols, vals, max_findings=1).collect()}
    assert top["t.ssn"] == "SSN" and top["t.contact_email"] == "EMAIL" and top["t.blob"] == "OPAQUE_SECRET" and "t.nothing" not in top and "t.stamp" not in top
    assert C.health_check(spark)["healthy"]


def test_empty_input(spark):
    assert C.classify(columns(spark).limit(0) if False else columns(spark, "x").limit(0), samples(spark, x=["1"]).limit(0)).count() == 0


def test_sources(spark):
    df = spark.createDataFrame([(i, f"v{i % 5}", None if i % 2 else 1.5, [1]) for i in range(500)], "id bigint, s string, d double, a array<int>")
    cols, vals = S.sources(spark, {"tab": df}, n=50)
    assert sorted(r.column_id for r in cols.collect()) == ["tab.d", "tab.id", "tab.s"]
    assert {r.column_id: r["count"] for r in vals.groupBy("column_id").count().collect()} == {"tab.d": 50, "tab.id": 50, "tab.s": 50}
    assert S.samples(S.long_values(df, "tab"), 50).exceptAll(S.samples(S.long_values(df.orderBy("id", ascending=False), "tab"), 50)).isEmpty()
    st = {r.column_id: r for r in S.with_stats(df, "tab").collect()}
    assert (st["tab.s"].distinct_count, st["tab.s"].total_count, st["tab.d"].null_pct) == (5, 500, 0.5)


def test_masks_and_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("123-45-6789", "SSN"), ("anna@x.org", "EMAIL"), ("a@x", "EMAIL"), ("secret", "OTHER"), ("abc", "SSN")], "v string, e string")
    assert [r[0] for r in df.select(F.expr(T.mask(SPARK, "v", "e"))).collect()] == ["*******6789", "a***@x.org", "***", "s****t", "***"]
    keys = spark.createDataFrame([("dbPassword",), ("api_key",), ("userName",), ("xai",), ("maxaim",)], "k string")
    got = [r[0].split("|")[1:] for r in keys.select(F.expr(T.key_score(SPARK, "k"))).collect()]
    assert got[0] == ["definitive", "OPAQUE_SECRET"] and got[1] == ["definitive", "API_KEY"] and got[2][0] == "" and got[3] == ["contextual", "API_KEY"] and got[4][0] == ""


def test_own_profile_patterns_and_models(spark):
    """A profile, a pattern with known false positives and moved confidence, per-value findings and a second-stage model."""
    from sieveline.patterns import content_patterns
    from sieveline.sources.profiles import profile_from_dict

    rules = profile_from_dict({"profiles": {"standard": {"rules": [{"entity_type": "LOYALTY_ID", "category": "PII", "sensitivity": "LOW", "confidence": 0.6, "regulatory": ["GDPR"], "patterns": ["^club"]}]}}})
    base = next(p for p in content_patterns() if p.name == "email_address")
    own = (base._replace(name="code", entity_type="CODE", regex="[A-Z]{3}[0-9]{3}", validator="", confidence=0.6, allow=("^TST",), stop=("abc123",), boost=("code",), suppress=("not",)),)
    cols = columns(spark, "club_no", "alpha", "beta", "gamma")
    vals = samples(spark, club_no=["1", "2"], alpha=["my code XYZ777"] * 8, beta=["TST123", "ABC123", "QQQ111 not"] * 4, gamma=["TST001"] * 8)
    got = {r.column_id: (r.entity_type, round(r.confidence, 4), r.matched) for r in C.classify(cols, vals, 0.0, rules=rules, patterns=own).collect()}
    assert got["t.club_no"][0] == "LOYALTY_ID" and got["t.alpha"] == ("CODE", 0.9, 8) and got["t.beta"] == ("CODE", round(0.3 * 0.95, 4), 4) and "t.gamma" not in got
    said = spark.createDataFrame([("t.alpha", "SSN", 0.95), ("t.gamma", "SSN", 0.99)], "column_id string, entity_type string, confidence double")
    first = {r.column_id: (r.entity_type, r.engine) for r in C.classify(cols, vals, 0.0, patterns=own, predicted=said).where("place = 1").collect()}
    assert first["t.alpha"] == ("SSN", "second_stage") and "t.gamma" not in first


def test_only_needed_steps_are_stated():
    from sieveline.plans.sql import chain

    steps = [("a", "SELECT 1 AS x"), ("b", "SELECT * FROM a"), ("c", "SELECT * FROM b"), ("d", "SELECT * FROM c")]
    assert chain(steps, "SELECT * FROM b") == "WITH a AS (SELECT 1 AS x),\nb AS (SELECT * FROM a)\nSELECT * FROM b"
    assert chain(steps, "SELECT 2") == "SELECT 2"
