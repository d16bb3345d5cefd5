"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets four integer measures in parts per 10,000: symbol characters, upper-case letters,
words equal to the word before, lines that repeat a line of the same document. For every
(language, source) a sketch of each measure is a sparse histogram whose bucket width doubles with
every power of two (relative error at most 1/32). Sketches merge by adding counts, so they are
built by one map-side combined aggregation, and those of a language and of the whole table are
sums of the finer ones. A second sketch of each measure holds its unit, what one event (a symbol, a
capital, a repeat) weighs in a document of that size. The cutoff of a measure is

    median + SPREAD * max(median - first quartile, third quartile of the unit)

from the sketches of the document's (language, source), or of its language, or of all documents, the
first that saw at least MIN_DOCS documents: so many times the spread of the better half of the group, or
so many events above what is usual there. Neither side moves unless half of a group is junk of one kind.
Documents above any cutoff are rejected by a join with
the cutoffs.

The measures come from numpy over the code points of whole Arrow batches (the same as built-in
regular-expression functions cost about fifteen times the CPU). Only the small sketch is shuffled. Texts are read twice and never moved: the table of cutoffs
(languages x sources rows) is broadcast if its counted size allows, else joined by shuffle.

Defined cases: a null or blank text is rejected; a null language or source counts as an empty one; texts are
measured whole whatever their length; a document at the cutoff stays, ties with it too; repeated rows are each
judged; an empty table gives an empty result; extra columns pass through ``filtered`` unchanged, whatever their
names, but names starting with ``__q_`` are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, NUMBER, SPACE, UPPER, Slices, added, code_points, flags, read, small, sums, written

SPREAD = {"symbol": 48, "upper": 48, "repeat": 16, "dupline": 2}
MIN_DOCS = 30
#: Added to the characters, letters, words and lines of a document, so that one event of a very short one weighs less.
ADDED = {"symbol": 40, "upper": 20, "repeat": 5, "dupline": 3}
SKETCHED = [*SPREAD, *[f"{k}_unit" for k in SPREAD]]
#: Taken out of words before they are compared.
PUNCTUATION = np.array([ord(c) for c in ".,!?;:"], np.uint32)


def measure(off: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The integer measures of consecutive texts, in the order of SPREAD, then their units."""
    at, cp = code_points(off, data)
    kind = flags()[cp]
    chars, letters = np.diff(at), sums(kind & LETTER > 0, at)
    plain = (kind & (LETTER | NUMBER | SPACE) > 0) | (cp == 46) | (cp == 44)
    # words: punctuation taken out, then runs without white space
    kept = ~np.isin(cp, PUNCTUATION)
    wat = np.concatenate([[0], np.cumsum(kept)])[at]
    wcp = cp[kept]
    inside = (kind[kept] & SPACE) == 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[wat[:-1][wat[:-1] < len(edge)]] = inside[wat[:-1][wat[:-1] < len(edge)]]
    start = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = wat[1:][wat[1:] > 0] - 1
    last[tails] = inside[tails]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(wat, start, "right") - 1
    h = Slices(wcp)(start, end)
    same = np.zeros(len(at) - 1, np.int64)
    if len(h) > 1:
        np.add.at(same, doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], 1)
    words = np.bincount(doc, minlength=len(at) - 1)
    # lines
    cut = np.flatnonzero(cp == 10)
    ldoc = np.concatenate([np.searchsorted(at, cut, "right") - 1, np.arange(len(at) - 1)])
    lend = np.concatenate([cut, at[1:]])
    order = np.lexsort((lend, ldoc))
    ldoc, lend = ldoc[order], lend[order]
    lstart = np.empty_like(lend)
    lstart[1:] = lend[:-1] + 1
    first = np.ones(len(ldoc), bool)
    first[1:] = ldoc[1:] != ldoc[:-1]
    lstart[first] = at[:-1][ldoc[first]]
    lh = Slices(cp)(lstart, lend)
    o = np.lexsort((lh, ldoc))
    again = (lh[o][1:] == lh[o][:-1]) & (ldoc[o][1:] == ldoc[o][:-1])
    dup = np.bincount(ldoc[o][1:][again], minlength=len(at) - 1)
    lines = np.bincount(ldoc, minlength=len(at) - 1)
    part = lambda a, b: (a * 10000 // b).astype(np.int32)
    seen = [sums(~plain, at), sums(kind & UPPER > 0, at), same, dup]
    size = [n + more for n, more in zip((chars, letters, words, lines), ADDED.values())]
    return [*map(part, seen, size), *[part(1, n) for n in size]]


def measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the documents with text, their group, and the measures and units as ``__q_*``."""
    some = _groups(df.where(F.col("text").rlike(r"\S")))
    out = added(some, "text", ", ".join(f"__q_{k} int" for k in SKETCHED), measure)
    return out.select(*keep, "__q_lang", "__q_source", *[f"__q_{k}" for k in SKETCHED])


def bucket(v: Column) -> Column:
    """Least value of the bucket of a non-negative integer: the five bits after its highest stay."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift)
    return F.floor(v / width).cast("int") * width.cast("int")


def _groups(df: DataFrame) -> DataFrame:
    return df.withColumn("__q_lang", F.coalesce("lang", F.lit(""))).withColumn("__q_source", F.coalesce("source", F.lit("")))


def sketches(df: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of every group."""
    long = measured(df.select("text", "lang", "source"), [])
    stacked = long.select("__q_lang", "__q_source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(f"__q_{k}")).alias("bucket")) for k in SKETCHED])).alias("x"))
    return stacked.groupBy(F.col("__q_lang").alias("lang"), F.col("__q_source").alias("source"), F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _cutoffs(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``keys``: documents seen and the cutoff of each measure."""
    from pyspark.sql import Window as W

    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    run = merged.withColumn("total", F.sum("n").over(by)).withColumn("below", F.sum("n").over(by.orderBy("bucket")))
    q = {k: F.min(F.when(F.col("below") * 4 >= F.col("total") * i, F.col("bucket"))).alias(f"q{i}") for i, k in ((1, "q1"), (2, "q2"), (3, "q3"))}
    quart = run.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), *q.values())
    of = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(q)))
    cut = lambda k: of(k, "q2") + SPREAD[k] * F.greatest(of(k, "q2") - of(k, "q1"), of(f"{k}_unit", "q3"))
    return quart.groupBy(*keys).agg(F.max("docs").alias("docs"), *[cut(k).alias(f"cut_{k}") for k in SPREAD])


def cutoffs(df: DataFrame) -> DataFrame:
    """Cutoffs of every (language, source), taken from the finest sketch with enough documents."""
    sketch = written(sketches(df), "quality-sketch")
    fine, lang, whole = (_cutoffs(sketch, k) for k in (["lang", "source"], ["lang"], []))
    rename = lambda d, p: d.select(*[F.col(c).alias(c if c == "lang" else f"{p}{c}") for c in d.columns])
    j = fine.join(rename(lang, "l_"), "lang").crossJoin(rename(whole, "w_"))
    pick = lambda c: F.when(F.col("docs") >= MIN_DOCS, F.col(c)).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    return j.select(F.col("lang").alias("__q_lang"), F.col("source").alias("__q_source"), *[pick(f"cut_{k}").alias(f"cut_{k}") for k in SPREAD])


def judged(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with their measures and cutoffs, only those within every cutoff."""
    cut = small(cutoffs(df), "quality-cutoffs")
    found = measured(df, df.columns if keep is None else keep)
    ok = F.lit(True)
    for k in SPREAD:
        ok &= F.col(f"__q_{k}") <= F.col(f"cut_{k}")
    return found.join(cut.select("__q_lang", "__q_source", *[F.col(f"cut_{k}") for k in SPREAD]), ["__q_lang", "__q_source"]).where(ok)


def filtered(df: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``df``."""
    extra = [c for c in df.columns if c.startswith("cut_")]
    plain = df.withColumnsRenamed({c: f"__q_x_{c}" for c in extra})
    return judged(plain).select(*[F.col(f"__q_x_{c}").alias(c) if c in extra else F.col(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that passes, with its measures and the cutoffs it was held against."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judged(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", *[F.col(f"__q_{k}").alias(k) for k in SPREAD], *[f"cut_{k}" for k in SPREAD])


def oracle_ctes(table: str = "documents") -> str:
    """CTEs ending in ``q_pass``: rows of ``table`` that pass, with measures and cutoffs."""
    left = lambda keep: f"length(regexp_replace(text, '{keep}', '', 'g'))"
    part = lambda a, b: f"floor(({a}) * 10000 / ({b}))::INT"
    buck = lambda v: f"(floor({v} / pow(2.0, greatest(length(bin({v})) - 6, 0)))::INT * pow(2.0, greatest(length(bin({v})) - 6, 0))::INT)"
    of = lambda k, q: f"max({q}) FILTER (measure = '{k}')"
    cut = lambda name, keys: f"""
{name}_c AS (SELECT {keys} measure, bucket, sum(n) AS n FROM q_sketch GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys} measure) AS total, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS below FROM {name}_c),
{name}_q AS (SELECT {keys} measure, max(total) AS docs, min(bucket) FILTER (below * 4 >= total) AS q1, min(bucket) FILTER (below * 4 >= total * 2) AS q2, min(bucket) FILTER (below * 4 >= total * 3) AS q3 FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {keys} max(docs) AS docs, {', '.join(f"{of(k, 'q2')} + {n} * greatest({of(k, 'q2')} - {of(k, 'q1')}, {of(f'{k}_unit', 'q3')}) AS cut_{k}" for k, n in SPREAD.items())} FROM {name}_q {'GROUP BY ' + keys.rstrip(', ') if keys else ''})"""  # noqa: E731
    pick = lambda k: f"CASE WHEN f.docs >= {MIN_DOCS} THEN f.cut_{k} WHEN l.docs >= {MIN_DOCS} THEN l.cut_{k} ELSE w.cut_{k} END::INT AS cut_{k}"
    return f"""
q_words AS (SELECT *, coalesce(lang, '') AS q_lang, coalesce(source, '') AS q_source,
  list_filter(string_split(regexp_replace(regexp_replace(text, '[.,!?;:]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS words, string_split(text, chr(10)) AS lines
  FROM {table} WHERE regexp_matches(text, '\\S')),
q_m AS (SELECT * EXCLUDE (words, lines),
  {part(left('[\\p{L}\\p{N}\\s.,]+'), 'length(text) + 40')} AS symbol,
  {part(left('\\P{Lu}+'), left('\\P{L}+') + ' + 20')} AS upper,
  {part("len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1]))", 'len(words) + 5')} AS repeat,
  {part('len(lines) - len(list_distinct(lines))', 'len(lines) + 3')} AS dupline,
  {part('1', 'length(text) + 40')} AS symbol_unit, {part('1', left('\\P{L}+') + ' + 20')} AS upper_unit, {part('1', 'len(words) + 5')} AS repeat_unit, {part('1', 'len(lines) + 3')} AS dupline_unit FROM q_words),
q_sketch AS ({' UNION ALL '.join(f"SELECT q_lang, q_source, '{k}' AS measure, {buck(k)} AS bucket, count(*) AS n FROM q_m GROUP BY ALL" for k in SKETCHED)}),
{cut('q_fine', 'q_lang, q_source, ')},
{cut('q_byl', 'q_lang, ')},
{cut('q_all', '')},
q_cut AS (SELECT f.q_lang, f.q_source, {', '.join(pick(k) for k in SPREAD)} FROM q_fine f JOIN q_byl l USING (q_lang) CROSS JOIN q_all w),
q_pass AS (SELECT q_m.*, {', '.join(f'cut_{k}' for k in SPREAD)} FROM q_m JOIN q_cut USING (q_lang, q_source) WHERE {' AND '.join(f'{k} <= cut_{k}' for k in SPREAD)})"""


def oracle() -> str:
    return f"WITH {oracle_ctes()} SELECT doc_id, lang, source, {', '.join(SPREAD)}, {', '.join(f'cut_{k}' for k in SPREAD)} FROM q_pass"
