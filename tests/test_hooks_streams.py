import pytest
from pyspark.sql import functions as F

from sieveline.operators import hooks
from sieveline.streaming import jobs


def test_model_runs_on_text_columns(spark):
    cols = spark.createDataFrame([("c1", "note", "t", "STRING"), ("c2", "n", "t", "BIGINT")], "column_id string, column_name string, table_name string, data_type string")
    vals = spark.createDataFrame([("c1", i, f"Ann {i}" if i % 2 else "none") for i in range(100)] + [("c2", 0, "5"), ("c1", 200, None)], "column_id string, pos bigint, value string")
    seen = hooks.asked(cols, vals)
    assert {r.column_id for r in seen.collect()} == {"c1"} and seen.count() == 60
    assert hooks.prompt(cols, vals, limit=60).first().prompt.startswith("Column: note\nTable: t\nValues: ")

    def model():
        return lambda texts: [[("PERSON_NAME", "Ann", 0.8, 0, 3)] if t.startswith("Ann") else [] for t in texts]

    spans = hooks.spans_of(vals, model)
    got = hooks.per_value(spans, spark.createDataFrame([("c1", 101)], "column_id string, n long")).first()
    assert got.entity_type == "PERSON_NAME" and got.confidence == pytest.approx(0.8 * 50 / 101) and got.matches == ["Ann"] * 5
    assert hooks.per_column(spans).first().confidence == pytest.approx(0.84)


def test_evidence_and_union(spark):
    f = spark.createDataFrame([("a", "PERSON_NAME", 0.8, ["x", "y"]), ("a", "ADDRESS", 0.7, ["X", "y"]), ("b", "PERSON_NAME", 0.99, ["x"]), ("b", "ADDRESS", 0.5, ["x"]), ("c", "EMAIL", 0.5, ["q"]), ("c", "ADDRESS", 0.5, ["r"])], "column_id string, entity_type string, confidence double, matches array<string>")
    got = {(r.column_id, r.entity_type) for r in hooks.distinct_evidence(f).collect()}
    assert got == {("a", "ADDRESS"), ("b", "ADDRESS"), ("b", "PERSON_NAME"), ("c", "EMAIL"), ("c", "ADDRESS")}
    u = hooks.united(f.where("column_id = 'a'"), f.where("column_id = 'a'").withColumn("confidence", F.lit(0.75)))
    assert {(r.entity_type, r.confidence) for r in u.collect()} == {("PERSON_NAME", 0.8), ("ADDRESS", 0.75)}


def test_registry():
    r, loads = hooks.Registry(), []
    r.register("m", lambda: loads.append(1) or "model")
    r.register("x", lambda: None, ("no_such_module_here",))
    assert r.get("m") == r.get("m") == "model" and loads == [1]
    r.unload("m")
    r.get("m")
    assert loads == [1, 1]
    with pytest.raises(RuntimeError, match="no_such_module_here"):
        r.get("x")


def test_training_and_comparison(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 7), "a" if i % 2 else "b") for i in range(60)], "x double, y double, label string")
    m = hooks.train(df, "label", ["x", "y"], grid=(0.01,), folds=2)
    assert max(m.avgMetrics) > 0.95
    p = spark.createDataFrame([(True, True)] * 50 + [(True, False)] * 30 + [(False, True)] * 5, "a boolean, b boolean")
    assert hooks.mcnemar(p, "a", "b")[:2] == (30, 5) and hooks.bootstrap(p, "a", "b")[0] > 0


def test_streams(spark, tmp_path):
    ev = spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 60) AS ts, id % 3 AS user_id, 'view' AS event_type, 1D AS value FROM range(300)")
    ev.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/events")
    want = jobs.counts(ev)
    got = jobs.drained(jobs.counts(stream), "t")
    assert got.count() > 0 and got.exceptAll(want).isEmpty()
    turns = spark.createDataFrame([(1, 0, "user", "token = 'Zq7xK9vT3mN8pL!aW5c'"), (1, 1, "assistant", "x"), (2, 0, "user", "hello there")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/turns")
    out = jobs.drained(jobs.scan_stream(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns")).select("conv_id", F.size("findings").alias("n"), "redacted"), "t")
    assert {r.conv_id: r.n for r in out.collect()} == {1: 1, 2: 0}
    vals = ev.select(F.lit("c").alias("column_id"), F.col("event_id").cast("string").alias("value"), "ts")
    assert jobs.rolling_profile(vals, "ts").count() == 31 or jobs.rolling_profile(vals, "ts").count() == 30
    assert jobs.sessions(ev, gap="2 minutes").count() == 300 and jobs.sessions(ev).count() == 3
