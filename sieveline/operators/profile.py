"""Column profiles: every statistic the engines use, from (column, value, count).

Values are grouped before anything is computed on them, so a column of few distinct values costs few
expressions, and partial aggregation keeps the shuffle to distinct values. Statistics of a column
are functions of its multiset of non-null values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions import validators
from ..functions.dialect import SPARK, Dialect
from ..patterns import content_words
from ..plans.sql import chain, over


def word_tokens(q: Dialect, v: str) -> str:
    return q.all(f"lower({v})", "[a-z]+")


def has_word(q: Dialect, v: str, words: tuple[str, ...] | list[str], least: int) -> str:
    """Whether a word of the list, of at least so many letters, is a token of the value."""
    return q.overlap(word_tokens(q, v), q.texts([w for w in words if len(w) >= least])) if words else "false"


def profile_steps(q: Dialect, source: str, names: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Steps ending in ``profile``; ``source`` has (column_id, value)."""
    return [
        ("pv", f"SELECT column_id, value, count(*) AS c FROM {source} WHERE value IS NOT NULL GROUP BY column_id, value"),
        (
            "pm",
            f"""SELECT column_id, value, c, length(value) AS n, {T.entropy(q, 'value')} AS h, {T.diversity(q, 'value')} AS div,
{q.like('value', '^[0-9]+$')} AS digits, {q.like('value', '^[A-Za-z]+$')} AS alpha, {q.like('value', '^[0-9A-Za-z]+$')} AS alnum, {q.like('value', '[^0-9A-Za-z]')} AS special,
{has_word(q, 'value', content_words(), 5)} AS word, {has_word(q, 'value', names, 4)} AS person,
NOT {validators.VALIDATORS['not_placeholder_credential'](q, 'value')} AS placeholder,
trim(value) <> '' AS solid, length(value) >= 20 AND length(value) - length(replace(value, ' ', '')) <= 0.05 * length(value) AS dense, length(value) >= 32 AND {q.like('value', '^[0-9A-Fa-f]+$')} AS hex FROM pv""",
        ),
        (
            "ps",
            """SELECT column_id, sum(c) AS n_values, count(*) AS n_distinct, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS f1, sum(CASE WHEN c = 2 THEN 1 ELSE 0 END) AS f2,
sum(c * n) AS chars, sum(c * n * n) AS chars2, min(n) AS min_length, max(n) AS max_length, sum(CASE WHEN n > 0 THEN c * h ELSE 0.0 END) AS h, sum(CASE WHEN n > 0 THEN c ELSE 0 END) AS filled, sum(c * div) AS div,
sum(CASE WHEN digits THEN c ELSE 0 END) AS digits, sum(CASE WHEN alpha THEN c ELSE 0 END) AS alpha, sum(CASE WHEN alnum THEN c ELSE 0 END) AS alnum, sum(CASE WHEN special THEN c ELSE 0 END) AS special,
sum(CASE WHEN word THEN c ELSE 0 END) AS word, sum(CASE WHEN person THEN c ELSE 0 END) AS person, sum(CASE WHEN placeholder THEN c ELSE 0 END) AS placeholder,
sum(CASE WHEN solid THEN c ELSE 0 END) AS solid, sum(CASE WHEN solid AND dense AND (hex OR h >= 4.2) THEN c ELSE 0 END) AS opaque, sum(CASE WHEN solid THEN c * h ELSE 0.0 END) AS solid_h FROM pm GROUP BY column_id""",
        ),
        (
            "profile",
            """SELECT column_id, n_values, n_distinct, least(1.0D, (n_distinct + f1 * (f1 - 1) / (2.0D * (f2 + 1))) / n_values) AS cardinality, least(1.0D, chars / (100.0D * n_values)) AS length_norm,
CAST(chars AS DOUBLE) / n_values AS mean_length, sqrt(greatest(0.0D, CAST(chars2 AS DOUBLE) / n_values - (CAST(chars AS DOUBLE) / n_values) * (CAST(chars AS DOUBLE) / n_values))) AS std_length, min_length, max_length, min_length = max_length AS uniform,
CASE WHEN filled > 0 THEN h / filled ELSE 0.0D END AS entropy, CAST(div AS DOUBLE) / n_values AS diversity, CAST(digits AS DOUBLE) / n_values AS digit_ratio, CAST(alpha AS DOUBLE) / n_values AS alpha_ratio, CAST(alnum AS DOUBLE) / n_values AS alnum_ratio, CAST(special AS DOUBLE) / n_values AS special_ratio,
CAST(word AS DOUBLE) / n_values AS word_ratio, CAST(person AS DOUBLE) / n_values AS name_ratio, CAST(placeholder AS DOUBLE) / n_values AS placeholder_ratio, solid, opaque, CASE WHEN solid > 0 THEN CAST(opaque AS DOUBLE) / solid ELSE 0.0D END AS opaque_ratio, CASE WHEN solid > 0 THEN solid_h / solid ELSE 0.0D END AS solid_entropy FROM ps""".replace("0D", "0D" if q.spark else "0"),
        ),
    ]


MEASURES = "cardinality length_norm mean_length std_length entropy diversity digit_ratio alpha_ratio alnum_ratio special_ratio word_ratio name_ratio placeholder_ratio opaque_ratio solid_entropy".split()


def rounded(source: str = "profile") -> str:
    return f"SELECT column_id, CAST(n_values AS BIGINT) AS n_values, CAST(n_distinct AS BIGINT) AS n_distinct, CAST(min_length AS INT) AS min_length, CAST(max_length AS INT) AS max_length, uniform, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM {source}"


def profile(values: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Profile of every column of a long (column_id, value) table, over all its values."""
    return over(values.sparkSession, lambda v: chain(profile_steps(SPARK, v, names), "SELECT * FROM profile"), v=values)
