"""Accuracy of labels against a truth, and counts over findings."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..model import FAMILY, case


def family_steps(q: Dialect, predicted: str, truth: str) -> list[tuple[str, str]]:
    """Steps ending in ``by_family`` and ``overall``; both relations are (column_id, entity_type), one row a column."""
    fam = lambda c: case(c, FAMILY, c)
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE CAST(0 AS DOUBLE) END)"
    return [
        ("pairs_", f"SELECT t.column_id, {fam('t.entity_type')} AS real, coalesce({fam('p.entity_type')}, 'NEGATIVE') AS said, t.entity_type AS real_type, p.entity_type AS said_type FROM {truth} t LEFT JOIN {predicted} p ON t.column_id = p.column_id"),
        ("counts_", "SELECT family, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT real AS family, CASE WHEN real = said THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN real <> said THEN 1 ELSE 0 END AS fn FROM pairs_ UNION ALL SELECT said, 0, 1, 0 FROM pairs_ WHERE real <> said) u_ GROUP BY family"),
        ("pr_", f"SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r FROM counts_"),
        ("by_family", f"SELECT family, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision_, round(r, 6) AS recall, round({ratio('2 * p * r', 'p + r')}, 6) AS f1 FROM pr_"),
        ("overall", f"SELECT count(*) AS n_columns, round(avg(CAST(CASE WHEN real <> said THEN 1 ELSE 0 END AS DOUBLE)), 6) AS cross_family_rate, round(avg(CAST(CASE WHEN real = said AND real_type <> said_type THEN 1 ELSE 0 END AS DOUBLE)), 6) AS within_family_rate, (SELECT round(avg(f1), 6) FROM by_family) AS macro_f1 FROM pairs_"),
    ]


def collision_matrix(q: Dialect, findings: str) -> str:
    """How often two types are given to one column. The engine joins the types of a column, each once: rows grow with
    the kinds of findings, not with the square of their number."""
    if q.spark:
        kinds = f"(SELECT DISTINCT column_id, entity_type FROM {findings} WHERE column_id IS NOT NULL AND entity_type IS NOT NULL)"
        return f"SELECT a.entity_type AS one, b.entity_type AS other, count(*) AS n FROM {kinds} a JOIN {kinds} b ON a.column_id = b.column_id AND a.entity_type < b.entity_type GROUP BY a.entity_type, b.entity_type"
    return f"SELECT a.entity_type AS one, b.entity_type AS other, count(DISTINCT a.column_id) AS n FROM {findings} a JOIN {findings} b ON a.column_id = b.column_id AND a.entity_type < b.entity_type GROUP BY a.entity_type, b.entity_type"


def confidence_buckets(findings: str) -> str:
    return f"SELECT entity_type, sum(CASE WHEN confidence >= 0.85 THEN 1 ELSE 0 END) AS high, sum(CASE WHEN confidence >= 0.5 AND confidence < 0.85 THEN 1 ELSE 0 END) AS mid, sum(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS low FROM {findings} GROUP BY entity_type"


def agreement(ours: str, theirs: str) -> str:
    """Two engines' label of each column, compared, with the number of columns of each outcome."""
    return f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o.entity_type IS NULL AND t.entity_type IS NULL THEN 'both_silent' WHEN o.entity_type IS NULL THEN 'only_theirs' WHEN t.entity_type IS NULL THEN 'only_ours' WHEN o.entity_type = t.entity_type THEN 'same_type'
WHEN {case('o.entity_type', FAMILY, 'o.entity_type')} = {case('t.entity_type', FAMILY, 't.entity_type')} THEN 'same_family' ELSE 'disagree' END AS outcome FROM {ours} o FULL JOIN {theirs} t ON o.column_id = t.column_id) c_ GROUP BY outcome"""


def recent(history: str, order: str, value: str, n: int) -> str:
    """The latest ``n`` runs of a benchmark and what each changed."""
    return f"SELECT {order}, {value}, delta FROM (SELECT {order}, {value}, {value} - lag({value}) OVER (ORDER BY {order}) AS delta, row_number() OVER (ORDER BY {order} DESC) AS r_ FROM {history}) h_ WHERE r_ <= {n}"


def label_sets(predicted: str, truth: str) -> str:
    """Several labels a column, (column_id, entity_type) on both sides: exact sets, labels hit, missed and made up."""
    return f"""SELECT count(*) AS n_columns, sum(CASE WHEN missed = 0 AND extra = 0 THEN 1 ELSE 0 END) AS exact, sum(hit) AS hit, sum(missed) AS missed, sum(extra) AS extra, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) AS all_missed FROM
(SELECT column_id, sum(CASE WHEN p AND t THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS missed, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS extra FROM
(SELECT column_id, entity_type, max(CASE WHEN side = 'p' THEN 1 ELSE 0 END) = 1 AS p, max(CASE WHEN side = 't' THEN 1 ELSE 0 END) = 1 AS t FROM (SELECT column_id, entity_type, 'p' AS side FROM {predicted} UNION ALL SELECT column_id, entity_type, 't' FROM {truth}) u_ GROUP BY column_id, entity_type) l_ GROUP BY column_id) c_"""
