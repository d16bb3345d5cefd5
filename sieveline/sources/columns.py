"""Columns of tables as rows: what the engines read.

The sample of a column is the ``n`` values of least md5, a sample that does not depend on row order. Nothing is sorted
for it but what may be in it: the values of each column are counted by the leading zeros of their md5, and only those with
as many zeros as ``n`` values have, equal ones counted, are ranked; they are some 16 ``n`` different values at most, however large the table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect
from ..model import COLUMNS


def long_sql(q: Dialect, table: str, relation: str, names: list[str]) -> str:
    """(column_id, value) of the columns ``names``, null values left out."""
    pairs = [(f"{table}.{n}", n) for n in names]
    if q.spark:
        stacked = f"stack({len(pairs)}, " + ", ".join(f"'{i}', CAST({n} AS STRING)" for i, n in pairs) + ") AS (column_id, value)"
        return f"SELECT * FROM (SELECT {stacked} FROM {relation}) WHERE value IS NOT NULL"
    return " UNION ALL ".join(f"SELECT '{i}' AS column_id, CAST({n} AS VARCHAR) AS value FROM {relation} WHERE {n} IS NOT NULL" for i, n in pairs)


def sample_sql(q: Dialect, long: str, n: int = 100) -> str:
    if not q.spark:
        return f"SELECT column_id, pos, value FROM (SELECT column_id, value, row_number() OVER (PARTITION BY column_id ORDER BY md5(value), value) AS pos FROM {long}) s_ WHERE pos <= {n}"
    zeros = "coalesce(32 - length(ltrim('0', h_)), 33)"
    hashed = f"(SELECT column_id, value, md5(value) AS h_ FROM {long})"
    return f"""SELECT * FROM (WITH zeros_ AS (SELECT column_id, {zeros} AS zeros, count(*) AS c FROM {hashed} GROUP BY 1, 2),
cut_ AS (SELECT column_id, max(CASE WHEN upto >= {n} THEN zeros ELSE 0 END) AS cut FROM (SELECT column_id, zeros, sum(c) OVER (PARTITION BY column_id ORDER BY zeros DESC) AS upto FROM zeros_) GROUP BY column_id),
kept_ AS (SELECT /*+ BROADCAST(cut_) */ v_.column_id, h_, value, count(*) AS c FROM {hashed} v_ JOIN cut_ ON v_.column_id = cut_.column_id AND {zeros} >= cut GROUP BY v_.column_id, h_, value),
placed_ AS (SELECT column_id, value, c, sum(c) OVER (PARTITION BY column_id ORDER BY h_, value ROWS UNBOUNDED PRECEDING) - c AS before FROM kept_)
SELECT column_id, explode(sequence(CAST(before + 1 AS INT), CAST(least(before + c, {n}) AS INT))) AS pos, value FROM placed_ WHERE before < {n}) s_"""


def simple_types(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]


def long_values(df: DataFrame, table: str, names: list[str] | None = None) -> DataFrame:
    """Long form of a DataFrame; nested columns are left out. One scan whatever the number of columns."""
    names = simple_types(df) if names is None else names
    pairs = [x for n in names for x in (F.lit(f"{table}.{n}"), F.col(f"`{n}`").cast("string"))]
    return df.select(F.stack(F.lit(len(names)), *pairs).alias("column_id", "value")).where("value IS NOT NULL")


def samples(long: DataFrame, n: int = 100) -> DataFrame:
    from ..plans.sql import over

    return over(long.sparkSession, lambda v: sample_sql(SPARK, v, n), v=long)


def described(spark: SparkSession, tables: Mapping[str, DataFrame], group: str = "") -> DataFrame:
    """The ``columns`` relation of some tables."""
    rows = [(group, f"{t}.{f.name}", f.name, t, f.dataType.simpleString().upper()) for t, df in tables.items() for f in df.schema.fields if f.name in simple_types(df)]
    return spark.createDataFrame(rows, COLUMNS)


def sources(spark: SparkSession, tables: Mapping[str, DataFrame], group: str = "", n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(columns, samples) of whole tables."""
    parts = [samples(long_values(df, t), n) for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return described(spark, tables, group), out


def with_stats(df: DataFrame, table: str) -> DataFrame:
    """(column_id, total_count, distinct_count, null_pct, min_length, max_length, avg_length) by one
    aggregation; distinct counts are exact."""
    long = df.select(F.stack(F.lit(len(simple_types(df))), *[x for n in simple_types(df) for x in (F.lit(f"{table}.{n}"), F.col(f"`{n}`").cast("string"))]).alias("column_id", "value"))
    counted = long.groupBy("column_id", "value").agg(F.count("*").alias("c"))
    size = F.length("value")
    return counted.groupBy("column_id").agg(
        F.sum("c").alias("total_count"), F.count("value").alias("distinct_count"), (F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)) / F.sum("c")).alias("null_pct"),
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), (F.sum(size * F.col("c")) / F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("avg_length"),
    )
