"""Prompts of conversations in, findings out: the parts of a batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans, zones


def prompt_id(conversation, turn):
    return F.substring(F.sha2(F.concat_ws(":", conversation.cast("string"), turn.cast("string")), 256), 1, 16)


def user_prompts(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """(prompt_id, conv_hash, turn_idx, text) of non-blank user turns of nested conversations:
    (conversation_hash, conversation array<struct<role, content>>). ``limit`` is the caller's."""
    turns = conversations.select(F.col("conversation_hash").alias("conv_hash"), F.posexplode("conversation").alias("turn_idx", "t"))
    out = turns.where("t.role = 'user' AND trim(t.content) <> ''").select(prompt_id(F.col("conv_hash"), F.col("turn_idx")).alias("prompt_id"), "conv_hash", "turn_idx", F.col("t.content").alias("text"))
    return out if limit is None else out.limit(limit)


def remaining(prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts that an earlier run has not handled."""
    return prompts.join(done.select("prompt_id").distinct(), "prompt_id", "left_anti")


def scanned(prompts: DataFrame, strategy: str = "type-label") -> DataFrame:
    """One record for each prompt: zones, their summary, findings and counts."""
    found = spans.detect(prompts, "text", strategy=strategy)
    return found.withColumns({
        "prompt_length": F.length("text"), "total_lines": F.size(F.split("text", "\n")), "num_zones": F.size("zones"), "num_secrets": F.size("findings"),
        "dominant_zone": zones.dominant("zones"), "max_secret_confidence": F.expr("coalesce(array_max(transform(findings, f -> f.confidence)), 0D)"),
    })


def is_candidate():
    """A prompt with a secret or any zone other than prose."""
    return (F.col("num_secrets") > 0) | F.exists("zones", lambda z: z["zone_type"] != "natural_language")


def write_split(records: DataFrame, candidates: str, archive: str, fmt: str = "json") -> None:
    """Candidates and the rest as two tables, from one written table."""
    from ..plans.sql import written

    kept = written(records, "scan")
    kept.where(is_candidate()).write.mode("append").format(fmt).save(candidates)
    kept.where(~is_candidate()).write.mode("append").format(fmt).save(archive)


def counters(records: DataFrame) -> DataFrame:
    """(what, name, n): findings by type, engine and confidence, zones by type, prompts by dominant zone."""
    f = records.select(F.explode("findings").alias("f"))
    bucket = F.when(F.col("f.confidence") >= 0.85, "high").when(F.col("f.confidence") >= 0.5, "mid").otherwise("low")
    parts = [f.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("name")) for k, v in (("entity", F.col("f.entity_type")), ("engine", F.col("f.engine")), ("confidence", bucket))])).alias("x")).select("x.*"),
             records.select(F.lit("zone").alias("what"), F.explode(F.transform("zones", lambda z: z["zone_type"])).alias("name")), records.select(F.lit("dominant").alias("what"), F.col("dominant_zone").alias("name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("what", "name").agg(F.count("*").alias("n"))


def labelled_columns(records: DataFrame, label: str, value: str, most: int = 100) -> DataFrame:
    """(column_id, samples) of a corpus of labelled values: one column for each label, the values of least SHA-1."""
    from pyspark.sql import Window as W

    w = W.partitionBy(label).orderBy(F.sha1(value), value)
    return records.where(F.col(value).isNotNull()).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select(F.col(label).alias("column_id"), F.col("pos").cast("bigint").alias("pos"), F.col(value).alias("value"))
