"""Column classification: engines, passes and ranking as one query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Dialect
from ..plans.sql import chain, staged
from ..sources.columns import sources
from . import engines, passes
from .engines import FIELDS
from .profile import profile_steps


def raw_steps(q: Dialect, columns: str, samples: str, least: float = 0.5, extra: str | None = None, rules=None, patterns=None) -> list[tuple[str, str]]:
    """Steps ending in ``raw``: all engines' findings. ``extra``: a relation of further findings, as of a model."""
    parts = ["by_name", "by_rule", "by_content", "by_stats", "by_secret"]
    out = [*profile_steps(q, samples), *engines.by_name(q, columns, least), *engines.by_profile_rule(q, columns, rules), *engines.by_content(q, columns, samples, patterns), *engines.by_statistics(q, least), *engines.by_secret(q, columns, samples, least), *engines.by_entropy(q)]
    union = " UNION ALL ".join(f"SELECT {', '.join(FIELDS)} FROM {p}" for p in [*parts, *([extra] if extra else [])])
    return [*out, ("raw", union)]


def classify_sql(q: Dialect, columns: str, samples: str, least: float = 0.5, categories: list[str] | None = None, most: int | None = None, gap: float = 0.3, aggressive: bool = False, extra: str | None = None) -> str:
    all_steps = raw_steps(q, columns, samples, least, extra) + passes.steps(q, "raw", columns, least, categories)
    return chain(all_steps, passes.ranked(q, "final", most, gap, aggressive))


def classify(columns: DataFrame, samples: DataFrame, min_confidence: float = 0.5, categories: list[str] | None = None, max_findings: int | None = None, confidence_gap: float = 0.3, aggressive: bool = False, model: DataFrame | None = None, per_value: DataFrame | None = None, predicted: DataFrame | None = None, rules=None, patterns=None) -> DataFrame:
    """Labels of columns, best first. ``model``: findings of a plugged-in model, joined like an engine's; ``per_value``: those of
    a model on the values of free-text columns; ``predicted``: (column_id, entity_type, confidence) of a second-stage model;
    ``rules`` and ``patterns``: of a profile of one's own (``sources.profiles``), and patterns of one's own."""
    return _staged(columns, samples, passes.ranked(SPARK, "final", max_findings, confidence_gap, aggressive), min_confidence, categories, model, per_value, predicted, rules, patterns)


def _staged(columns: DataFrame, samples: DataFrame, last: str, least: float = 0.5, categories: list[str] | None = None, model: DataFrame | None = None, per_value: DataFrame | None = None, predicted: DataFrame | None = None, rules=None, patterns=None) -> DataFrame:
    tables = {"columns_": columns, "samples_": samples} | {k: v for k, v in (("model_", model), ("per_value_", per_value), ("predicted_", predicted)) if v is not None}
    given = lambda n: n if n in tables else None
    steps = raw_steps(SPARK, "columns_", "samples_", least, given("model_"), rules, patterns) + passes.steps(SPARK, "raw", "columns_", least, categories, given("per_value_"), given("predicted_"), rules)
    return staged(columns.sparkSession, steps, last, passes.CUTS, **tables)


def classify_tables(spark: SparkSession, tables: Mapping[str, DataFrame], group: str = "", n: int = 100, **options) -> DataFrame:
    """Labels of all columns of some tables."""
    columns, values = sources(spark, tables, group, n)
    return classify(columns, values, **options)


def tier_gate(columns: DataFrame, samples: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """The observed-only gate of credential columns."""
    return _staged(columns, samples, passes.gate(SPARK, "f18", "f2"), min_confidence)


def column_shapes(columns: DataFrame, samples: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(column_id, shape, n_types, hinted)."""
    return _staged(columns, samples, "SELECT * FROM shape", min_confidence)


def health_check(spark: SparkSession) -> dict:
    """Whether one known column is labelled; never raises."""
    try:
        c = spark.createDataFrame([("", "t.ssn", "ssn", "t", "STRING")], "group_id string, column_id string, column_name string, table_name string, data_type string")
        s = spark.createDataFrame([("t.ssn", 1, "123-45-6789")], "column_id string, pos bigint, value string")
        got = classify(c, s).where("entity_type = 'SSN'").count()
        return {"healthy": got > 0, "findings": got, "error": None}
    except Exception as e:  # noqa: BLE001
        return {"healthy": False, "findings": 0, "error": str(e)[:500]}
