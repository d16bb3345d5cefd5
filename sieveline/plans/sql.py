"""Running a statement over DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def over(spark: SparkSession, statement, **tables: DataFrame) -> DataFrame:
    """The DataFrame of ``statement(**names)``, each table under a view name of its own. The plan is
    analysed here, so the views are dropped again."""
    names = {k: f"v_{k}_{uuid.uuid4().hex[:12]}" for k in tables}
    try:
        for k, df in tables.items():
            df.createOrReplaceTempView(names[k])
        return spark.sql(statement(**names))
    finally:
        for n in names.values():
            spark.catalog.dropTempView(n)


def needed(steps: list[tuple[str, str]], last: str) -> list[tuple[str, str]]:
    """The steps that ``last`` refers to, directly or through others: the analyser takes time for every step it is given."""
    by, found, todo = dict(steps), set(), [last]
    while todo:
        more = {w for w in re.findall(r"\w+", todo.pop()) if w in by} - found
        found |= more
        todo += [by[w] for w in more]
    return [x for x in steps if x[0] in found]


def chain(steps: list[tuple[str, str]], last: str) -> str:
    """``WITH`` the named steps that ``last`` needs, then ``last``."""
    steps = needed(steps, last)
    return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps) + "\n" if steps else "") + last


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local one is made only for a
    single-machine session that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, an executor may be lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, steps: list[tuple[str, str]], last: str, cuts: tuple[str, ...], **tables: DataFrame) -> DataFrame:
    """``chain(steps, last)``, the steps named in ``cuts`` written as tables where later ones start from, so
    that a step many others refer to is computed once. The steps refer to ``tables`` by their names."""
    steps, held = list(steps), dict(tables)

    def run(text: str) -> DataFrame:
        def statement(**views: str) -> str:
            own = [(k, f"SELECT * FROM {v}") for k, v in views.items()]
            return chain(own + [s for s in steps if s[0] not in views], text)

        return over(spark, statement, **held)

    for cut in cuts:
        at = [n for n, _ in steps].index(cut)
        rest, steps[at + 1 :] = steps[at + 1 :], []
        held[cut] = written(run(f"SELECT * FROM {cut}"), cut.replace("_", "-"))
        steps += rest
    return run(last)
