"""Plugging in a model: what it is asked, and how its answers become findings. No model is shipped.

A model is a function from a list of texts (and labels) to a list of spans; it runs on Arrow batches in an
iterator, loaded once in a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import NON_TEXT_TYPES, SPECIFICITY

SPANS = "column_id string, pos bigint, entity_type string, text string, score double, start int, end int"


class Registry:
    """Named models, loaded when first used; a missing dependency is told by name."""

    def __init__(self) -> None:
        self._loaders: dict[str, tuple[Callable[[], object], tuple[str, ...]]] = {}
        self._loaded: dict[str, object] = {}

    def register(self, name: str, loader: Callable[[], object], needs: tuple[str, ...] = ()) -> None:
        self._loaders[name] = (loader, needs)

    def get(self, name: str):
        if name not in self._loaded:
            from importlib.util import find_spec

            loader, needs = self._loaders[name]
            missing = [m for m in needs if find_spec(m) is None]
            if missing:
                raise RuntimeError(f"model {name!r} needs {', '.join(missing)}")
            self._loaded[name] = loader()
        return self._loaded[name]

    def unload(self, name: str) -> None:
        self._loaded.pop(name, None)


def asked(columns: DataFrame, samples: DataFrame, n: int = 60) -> DataFrame:
    """Samples of text columns a model sees: the ``n`` values of least SHA-1 of each column."""
    text = columns.where(~F.upper(F.coalesce("data_type", F.lit(""))).isin(NON_TEXT_TYPES)).select("column_id")
    w = W.partitionBy("column_id").orderBy(F.sha1("value"), "pos")
    return samples.where("value IS NOT NULL").join(text, "column_id", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def prompt(columns: DataFrame, samples: DataFrame, n: int = 30, limit: int = 2000) -> DataFrame:
    """(column_id, prompt): name, table, description and distinct values, within ``limit`` characters."""
    seen = asked(columns, samples, n).groupBy("column_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])).alias("vs"))
    head = F.concat(F.lit("Column: "), "column_name", F.lit("\nTable: "), F.coalesce("table_name", F.lit("")), F.lit("\nValues: "))
    whole = F.concat(head, F.array_join("vs", "; "))
    return columns.join(seen, "column_id").select("column_id", F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit - 3), F.lit("..."))).otherwise(whole).alias("prompt"))


def spans_of(samples: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple[str, str, float, int, int]]]]]) -> DataFrame:
    """``model()`` loads and returns f(texts) -> for each text (entity type, text, score, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or model()
            got = f(b.column(2).to_pylist())
            at = [i for i, spans in enumerate(got) for _ in spans]
            flat = [s for spans in got for s in spans]
            cols = [list(x) for x in zip(*flat)] or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["column_id", "pos", "entity_type", "text", "score", "start", "end"])

    return samples.select("column_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("value", F.lit("")).alias("value")).mapInArrow(run, SPANS)


def _first(n: int = 5) -> Column:
    return F.slice(F.transform(F.sort_array(F.collect_list(F.struct("pos", "start", "text"))), lambda x: x["text"]), 1, n)


def per_value(spans: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Spans of heterogeneous columns as findings: the share of rows with the type (a tenth at least) times the
    best score. ``n_rows``: (column_id, n)."""
    g = spans.groupBy("column_id", "entity_type").agg(F.count_distinct("pos").alias("rows"), F.max("score").alias("best"), _first().alias("matches"))
    return g.join(n_rows, "column_id").select("column_id", "entity_type", (F.greatest(F.lit(0.1), F.col("rows") / F.col("n")) * F.col("best")).alias("confidence"), F.col("rows").cast("bigint").alias("matched"), "matches")


def per_column(spans: DataFrame) -> DataFrame:
    """Spans of a homogeneous column as findings: the mean score, less for few hits, more for many."""
    g = spans.groupBy("column_id", "entity_type").agg(F.avg("score").alias("mean"), F.count("*").alias("hits"), _first().alias("matches"))
    factor = F.when(F.col("hits") == 1, 0.85).when(F.col("hits") <= 3, 0.95).otherwise(1.05)
    return g.select("column_id", "entity_type", F.least(F.lit(1.0), F.col("mean") * factor).alias("confidence"), F.col("hits").alias("matched"), "matches")


def distinct_evidence(findings: DataFrame, overlap: float = 0.5, gap: float = 0.3) -> DataFrame:
    """Of findings of a column on much the same values, the more specific type stays, unless the other is
    surer by ``gap``. Findings have (column_id, entity_type, confidence, matches)."""
    spec = F.coalesce(F.create_map(*[x for k, v in SPECIFICITY.items() for x in (F.lit(k), F.lit(v))])[F.col("entity_type")], F.lit(0))
    packed = findings.withColumn("x", F.struct((-spec).alias("s"), (-F.col("confidence")).alias("c"), "entity_type", "confidence", F.transform("matches", F.lower).alias("m"))).groupBy("column_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kept = f"aggregate(xs, slice(xs, 1, 0), (k, f) -> CASE WHEN exists(k, o -> size(array_intersect(o.m, f.m)) >= {overlap} * size(array_union(o.m, f.m)) AND size(array_union(o.m, f.m)) > 0 AND f.confidence - o.confidence < {gap}) THEN k ELSE concat(k, array(f)) END)"
    keys = packed.select("column_id", F.explode(F.expr(kept)).alias("f")).select("column_id", "f.entity_type")
    return findings.join(keys, ["column_id", "entity_type"], "left_semi")


def united(cascade: DataFrame, extra: DataFrame) -> DataFrame:
    """Findings of both, of one type in a column the surer one (the cascade's of equal ones)."""
    w = W.partitionBy("column_id", "entity_type").orderBy(F.desc("confidence"), "o_")
    both = cascade.withColumn("o_", F.lit(0)).unionByName(extra.withColumn("o_", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("o_", "r_")


def train(features: DataFrame, label: str, columns: list[str], grid: tuple[float, ...] = (0.01, 0.1, 1.0), folds: int = 3, seed: int = 7):
    """A second-stage classifier of feature vectors: scaled multinomial logistic regression, its penalty by
    cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(featuresCol="scaled_", labelCol="label_", family="multinomial", maxIter=60)
    stages = [StringIndexer(inputCol=label, outputCol="label_", handleInvalid="keep"), VectorAssembler(inputCols=columns, outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True), lr]
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(grid)).build(), evaluator=MulticlassClassificationEvaluator(labelCol="label_", metricName="f1"), numFolds=folds, seed=seed)
    return cv.fit(features)


def mcnemar(pairs: DataFrame, ours: str, theirs: str) -> tuple[int, int, float]:
    """(only ours right, only theirs right, chi-square with continuity correction) of two boolean columns."""
    r = pairs.agg(F.count_if(F.col(ours) & ~F.col(theirs)).alias("a"), F.count_if(~F.col(ours) & F.col(theirs)).alias("b")).first()
    return r.a, r.b, (abs(r.a - r.b) - 1) ** 2 / (r.a + r.b) if r.a + r.b else 0.0


def bootstrap(pairs: DataFrame, ours: str, theirs: str, rounds: int = 500, seed: int = 7) -> tuple[float, float]:
    """95 % interval of the difference of two accuracies; resampled from the four counts, not from rows."""
    import numpy as np

    n = np.array([r for r in pairs.agg(*[F.count_if((F.col(ours) == a) & (F.col(theirs) == b)) for a in (True, False) for b in (True, False)]).first()], float)
    if not n.sum():
        return 0.0, 0.0
    draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), rounds)
    low, high = np.quantile((draws[:, 1] - draws[:, 2]) / n.sum(), [0.025, 0.975])
    return float(low), float(high)
