"""Findings rolled up to tables and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dialect import SPARK, Dialect
from ..model import SENSITIVITY, case
from ..plans.sql import over

_NAME = {v: k for k, v in SENSITIVITY.items()}


def rollup_sql(q: Dialect, findings: str, parents: str) -> str:
    """Findings to parents by (column_id, parent): greatest sensitivity, sorted types and regulations, count.
    Findings without a parent are left out."""
    return f"""SELECT p.parent, {case(f"max({case('f.sensitivity', SENSITIVITY, '1')})", _NAME, "'LOW'")} AS sensitivity, {q.sorted_set('f.entity_type')} AS classifications, {q.flat_set('f.regulatory')} AS frameworks, count(*) AS findings_count
FROM {findings} f JOIN {parents} p ON f.column_id = p.column_id GROUP BY p.parent"""


def again_sql(q: Dialect, rollups: str, parents: str) -> str:
    """Roll-ups (keyed ``parent``) to their own parents; counts add up."""
    return f"""SELECT p.parent, {case(f"max({case('r.sensitivity', SENSITIVITY, '1')})", _NAME, "'LOW'")} AS sensitivity, {q.flat_set('r.classifications')} AS classifications, {q.flat_set('r.frameworks')} AS frameworks, CAST(sum(r.findings_count) AS BIGINT) AS findings_count
FROM {rollups} r JOIN {parents} p ON r.parent = p.child GROUP BY p.parent"""


def compute_rollups(findings: DataFrame, parents: DataFrame) -> DataFrame:
    """``parents``: (column_id, parent)."""
    return over(findings.sparkSession, lambda f, p: rollup_sql(SPARK, f, p), f=findings, p=parents)


def rollup_from_rollups(rollups: DataFrame, parents: DataFrame) -> DataFrame:
    """``parents``: (child, parent)."""
    return over(rollups.sparkSession, lambda r, p: again_sql(SPARK, r, p), r=rollups, p=parents)
