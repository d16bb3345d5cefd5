"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, dac, decontam, langid, licences, lines, near, pii, quality, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.query,
        "op2_sharding": sharding.query,
        "op3_licences": licences.query,
        "op4_decontamination": decontam.query,
        "op5_pii_surrogates": pii.query,
        "op6_language_id": langid.query,
        "op7_line_dedup": lines.query,
        "op8_token_codes": dac.query,
        "op9_minhash": near.query,
        "op10_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.oracle(),
        "op2_sharding": sharding.oracle(),
        "op7_line_dedup": lines.ORACLE,
    }
