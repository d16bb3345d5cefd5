"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its weighted set of word 3-shingles (lower case, letters and digits only; the weight
is the count). Every shingle runs a Poisson process whose rate is its weight, seeded by the shingle;
each arrival falls into one of REGISTERS registers and the earliest arrival there wins. A process
stops as soon as its next arrival is later than the latest register of its document (early
termination). Two documents agree in a register with their probability Jaccard similarity.

Documents of equal shingles and counts (a 128-bit hash of them) are one: only the first of such copies goes on.
Its signature is cut into bands of BAND_ROWS registers; documents sharing a band are candidates. Pairs
whose signatures agree in SCREEN of the registers are verified with the exact weighted Jaccard of their
shingles (sum of lesser weights / sum of greater) against THRESHOLD, in two rounds:

1. Each member of a bucket with the bucket's first. A group of near copies, however large, is linked by as many
   pairs as it has members, the same ones in most bands.
2. Buckets whose members are not yet one group: all pairs of different groups. Small buckets give the pairs;
   large ones are cut into blocks, and each pair of blocks is a task that compares signatures. It gives its
   screened pairs if they are few, else (documents of one template, below THRESHOLD) its members, to be
   verified in the task, where groups that get linked are compared no further.

So every pair of a bucket at THRESHOLD is found or its documents are connected; nothing is capped. Round 2
is quadratic only in documents of one bucket that stay different groups, and then in tasks of at most
2 * BLOCK documents. Buckets that are heavy in a sample of the documents are split for round 1 by a salt, with
the firsts of the splits compared; that changes the plan, not which documents are connected. Groups are the
connected components, found by alternating large-star and small-star steps (least neighbours by partial
aggregation and join, so that hubs are no single task), each cut by a table in the shared folder.

Shuffles: (band, id) rows, signatures of candidates, texts of candidates to their ids if these are too many to
broadcast, their shingles. Ids inside are row numbers of the table of signatures, so doc_id may be of any type.

Defined cases: rows without doc_id or without a word take no part and are kept; rows repeating a
doc_id count as one document (its first text in text order) and ``filtered`` keeps one of them;
documents of fewer than three words are one shingle of all their words; of documents that tie the least doc_id
stays; texts are taken whole whatever their length; an empty table gives an empty result; extra columns
pass through, whatever their names, but names starting with ``__n_`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Slices, added, grouped, lean, lowered, mix, read, small, word_spans, written

SHINGLE = 3
BAND_ROWS = 3
BANDS = 40
REGISTERS = BAND_ROWS * BANDS
THRESHOLD = 0.5
SCREEN = 0.38
#: Buckets of round 2 up to this size give their pairs.
SMALL_BUCKET = 12
#: Larger ones are cut into blocks of about this many.
BLOCK = 512
#: Screened pairs for each member of a task, up to which it gives the pairs.
FEW = 8
#: One document in SAMPLE tells heavy buckets: those it shows HEAVY times. At most HEAVY_KEYS of them, the heaviest, are salted.
SAMPLE, HEAVY, HEAVY_KEYS = 64, 64, 1_000_000


def shingles(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), ordered by both, of consecutive lowered texts."""
    base, part = off[0], data[off[0] : off[-1]]
    at = off - base
    start, end = word_spans(part)
    doc = np.searchsorted(at, start, "right") - 1
    h = Slices(part)(start, end)
    n = len(at) - 1
    if len(h) >= SHINGLE:
        with np.errstate(over="ignore"):
            s = h[: len(h) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k])
        ok = doc[: len(s)] == doc[SHINGLE - 1 :]
        s, d = s[ok], doc[: len(s)][ok]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n)
    few = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(few):
        first = np.searchsorted(doc, few, "left")
        t = h[first] + np.uint64(1)
        two = words[few] == 2
        t[two] = mix(t[two]) + h[first[two] + 1]
        s, d = np.concatenate([s, mix(t)]), np.concatenate([d, few])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(at, append=len(s))


def registers(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Signatures (docs x REGISTERS, uint32): the winning element of each register."""
    m = REGISTERS
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(docs * m, none, np.uint64)
    latest = np.full(docs, np.inf)
    name = (element >> np.uint64(32)).astype(np.uint64)
    seed, rate, at = element, weight.astype(np.float64), np.zeros(len(element))
    d, step, width = doc, 0, 1
    while len(d):
        k = np.arange(step, step + width, dtype=np.uint64)
        r = mix(seed[:, None] + (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        u = ((r >> np.uint64(20)).astype(np.float64) + 1.0) * 2.0**-44
        t = at[:, None] + np.cumsum(-np.log(u), axis=1) / rate[:, None]
        reg = ((r & np.uint64(0xFFFFF)) * np.uint64(m)) >> np.uint64(20)
        live = t <= latest[d][:, None]
        tt = t[live].astype(np.float32).view(np.uint32).astype(np.uint64)
        row = np.repeat(d, width) if width > 1 else d
        cell = row.reshape(live.shape)[live] * m + reg[live].astype(np.int64)
        np.minimum.at(best, cell, (tt << np.uint64(32)) | np.broadcast_to(name[:, None], live.shape)[live])
        q = best.reshape(docs, m).max(axis=1)
        full = q != none
        latest[full] = np.nextafter((q[full] >> np.uint64(32)).astype(np.uint32).view(np.float32), np.float32(np.inf))
        at = t[:, -1]
        go = at <= latest[d]
        d, seed, rate, at, name = d[go], seed[go], rate[go], at[go], name[go]
        step += width
        width = 1 if step < 3 else max(1, min(64, 200_000 // max(1, len(d))))
    sig = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(docs, m)
    return sig


def _signed(off: np.ndarray, data: np.ndarray) -> list:
    """Signature and the two halves of the content hash of each document that has a word."""
    d, s, n = shingles(off, data)
    docs = len(off) - 1
    sig = registers(d, s, n, docs)
    has = np.bincount(d, minlength=docs) > 0
    raw = np.ascontiguousarray(sig).view(np.uint8).tobytes()
    size = REGISTERS * 4
    content = []
    for k in (1, 2):
        total = np.zeros(docs, np.uint64)
        np.add.at(total, d, mix(mix(s + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        content.append(pa.array(total.view(np.int64)))
    return [pa.array([raw[i * size : (i + 1) * size] if has[i] else None for i in range(docs)], pa.binary()), *content]


def _shingled(off: np.ndarray, data: np.ndarray) -> list:
    d, s, n = shingles(off, data)
    at = np.searchsorted(d, np.arange(len(off)))
    return [pa.array([s[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()), pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())]


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, __n_text) with one row for each doc_id."""
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", lowered(F.col("text")).alias("__n_text"))
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("__n_n")).where("__n_n > 1").select("doc_id")
    again = written(again, "near-again")
    if again.isEmpty():
        return named
    again = small(again, "near-again")
    repeated = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("__n_text").alias("__n_text"))
    return named.join(again, "doc_id", "left_anti").unionByName(repeated)


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, sig, c1, c2) of every document that has a word."""
    return added(texts, "__n_text", "sig binary, c1 bigint, c2 bigint", _signed).select("doc_id", "sig", "c1", "c2").where("sig IS NOT NULL")


def band_keys(sig: list[bytes]) -> np.ndarray:
    """Keys (documents x BANDS) of signatures."""
    cut = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return key.view(np.int64)


def _banded(heavy, salted: bool):
    """Rows (band, id) of all but the heavy bands, or (key, band, id) of those, the key salted. ``heavy``: broadcast (sorted bands,
    parts of each), or none."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            band = band_keys(b.column(1).to_pylist()).ravel()
            ids = np.repeat(b.column(0).to_numpy(), BANDS)
            if heavy is not None:
                bands, parts = heavy.value
                at = np.minimum(np.searchsorted(bands, band), len(bands) - 1)
                ok = (bands[at] == band) == salted
                band, ids, parts = band[ok], ids[ok], parts[at[ok]]
            if not salted:
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(ids)], names=["band", "id"])
            else:
                salt = mix(ids.astype(np.uint64)) % parts
                key = mix(band.view(np.uint64) + (salt + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(band), pa.array(ids)], names=["key", "band", "id"])

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(start, append=len(key))


def _firsts(key: str, alone: bool):
    """(band, id, first) of the members of each group, the first being its least id; ``alone``: of groups of one too."""

    def run(c: dict) -> list:
        start, size = _runs(c[key])
        if not len(start):
            return [np.zeros(0, np.int64)] * 3
        first = np.repeat(np.minimum.reduceat(c["id"], start), size)
        ok = np.repeat(size > (0 if alone else 1), size)
        return [c["band"][ok], c["id"][ok], first[ok]]

    return run


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((band, id, first) of buckets of two or more, pairs (a, b) of the firsts of salted ones)."""
    spark = reps.sparkSession
    seen = reps.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(lean(_banded(None, False)), "band bigint, id bigint")
    top = seen.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).orderBy(F.desc("n"), "band").limit(HEAVY_KEYS).toPandas().sort_values("band")
    out = "band bigint, id bigint, first bigint"
    if not len(top):
        return written(grouped(reps.mapInArrow(lean(_banded(None, False)), "band bigint, id bigint"), "band", out, _firsts("band", False)), "near-buckets"), None
    parts = -(-top["n"].to_numpy(np.int64) // HEAVY)
    heavy = spark.sparkContext.broadcast((top["band"].to_numpy(np.int64), parts.astype(np.uint64)))
    light = grouped(reps.mapInArrow(lean(_banded(heavy, False)), "band bigint, id bigint"), "band", out, _firsts("band", False))
    salted = grouped(reps.mapInArrow(lean(_banded(heavy, True)), "key bigint, band bigint, id bigint"), "key", out, _firsts("key", True))
    salted = written(salted, "near-salted")
    heads = salted.select("band", "first").distinct()
    cross = heads.join(heads.groupBy("band").agg(F.min("first").alias("a")), "band").where("a <> first").select("a", F.col("first").alias("b")).distinct()
    return written(light.unionByName(salted), "near-buckets"), cross


def _pairs(c: dict) -> list:
    """Pairs of different groups in whole small buckets."""
    start, size = _runs(c["band"])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[size > 1]):
        at = start[size == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        x, y = at[:, i].ravel(), at[:, j].ravel()
        ok = c["comp"][x] != c["comp"][y]
        x, y = c["id"][x[ok]], c["id"][y[ok]]
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
    got = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return [got[0], got[1]]


def _agreeing(sig: np.ndarray, at: int, left: np.ndarray, need: int) -> np.ndarray:
    """Which of ``left`` agree with ``at`` in at least ``need`` registers."""
    return np.concatenate([(sig[left[i : i + 4096]] == sig[at]).sum(axis=1) >= need for i in range(0, len(left), 4096)]) if len(left) else np.zeros(0, bool)


NEED = int(np.ceil(SCREEN * REGISTERS))


def _cross(c: dict) -> list:
    """Of each task, the screened pairs of different groups (task null), or, of more than FEW for a member, (member, group, task)."""
    a, b, task, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for s, n in zip(*_runs(c["task"])):
        ids, comp = c["id"][s : s + n], c["comp"][s : s + n]
        sig = np.frombuffer(b"".join(c["sig"].slice(s, n).to_pylist()), np.uint32).reshape(n, REGISTERS)
        x, y, many = [ids[:0]], [ids[:0]], 0
        for at in range(n - 1):
            left = at + 1 + np.flatnonzero(comp[at + 1 :] != comp[at])
            hit = left[_agreeing(sig, at, left, NEED)]
            many += len(hit)
            if many > FEW * n:
                break
            x.append(np.full(len(hit), ids[at]))
            y.append(ids[hit])
        full = many > FEW * n
        x, y = (ids, comp) if full else (np.concatenate(x), np.concatenate(y))
        a.append(x if full else np.minimum(x, y))
        b.append(y if full else np.maximum(x, y))
        task.append(np.full(len(x), c["task"][s]))
        dense.append(np.full(len(x), full))
    return [np.concatenate(a), np.concatenate(b), pa.array(np.concatenate(task), mask=~np.concatenate(dense))]


def _settle(c: dict) -> list:
    """Verified pairs (a, b, similarity) that link groups of each task; groups linked are compared no further."""
    a, b, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for s, n in zip(*_runs(c["task"])):
        order = np.argsort(c["id"][s : s + n], kind="stable") + s
        ids, group = c["id"][order], np.unique(c["comp"][order], return_inverse=True)[1]
        sig, element, count = (c[k].take(pa.array(order)).to_pylist() for k in ("sig", "s", "n"))
        sig = np.frombuffer(b"".join(sig), np.uint32).reshape(n, REGISTERS)
        size = np.array([len(x) // 8 for x in element])
        start = np.cumsum(size) - size
        names, place = np.unique(np.frombuffer(b"".join(element), np.uint64), return_inverse=True)
        count = np.frombuffer(b"".join(count), np.uint32).astype(np.int64)
        total = np.add.reduceat(count, start)
        own = np.zeros(len(names), np.int64)
        for at in range(n - 1):
            left = at + 1 + np.flatnonzero(group[at + 1 :] != group[at])
            left = left[_agreeing(sig, at, left, NEED)]
            mine = slice(start[at], start[at] + size[at])
            own[place[mine]] = count[mine]
            for i in range(0, len(left), 1024):
                x = left[i : i + 1024]
                begin = np.cumsum(size[x]) - size[x]
                row = np.arange(size[x].sum()) + np.repeat(start[x] - begin, size[x])
                low = np.add.reduceat(np.minimum(own[place[row]], count[row]), begin)
                got = low / (total[at] + total[x] - low)
                for y, v in zip(x[got >= THRESHOLD], got[got >= THRESHOLD]):
                    if group[y] != group[at]:
                        a.append(ids[at : at + 1])
                        b.append(ids[y : y + 1])
                        sim.append(np.array([v]))
                        group[group == group[y]] = group[at]
            own[place[mine]] = 0
    a, b = np.concatenate(a), np.concatenate(b)
    return [np.minimum(a, b), np.maximum(a, b), np.concatenate(sim)]


def _agree(batches):
    for t in batches:
        n = t.num_rows
        x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint32).reshape(n, REGISTERS) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= NEED))


def weighted_jaccard(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray) -> float:
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (int(n.sum()) + int(m.sum()) - low)


def _verify(batches):
    for b in batches:
        # shingles of long texts are large: few rows are unpacked at once
        for at in range(0, b.num_rows, 128):
            t = b.slice(at, 128)
            s, n, u, m = (t.column(k).to_pylist() for k in range(2, 6))
            sim = [weighted_jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint32)) for a, b, c, d in zip(s, n, u, m)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])


def _judged(pairs: DataFrame, reps: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs that pass the screen."""
    left, right = reps.select(F.col("id").alias("a"), F.col("sig").alias("x")), reps.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    edges = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(_agree), "a bigint, b bigint"), "near-edges")
    sets = shingled(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, named)
    sides = [sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab"]
    both = edges.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "na", "sb", "nb")
    return written(both.mapInArrow(lean(_verify), "a bigint, b bigint, similarity double"), "near-judged")


def shingled(ids: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """(id, s, n): the shingles of these documents."""
    want = small(ids.join(named, "id").select("id", "doc_id"), "near-candidates")
    return written(added(texts.join(want, "doc_id").select("id", "__n_text"), "__n_text", "s binary, n binary", _shingled).select("id", "s", "n"), "near-shingles")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, doc_id), (id, rep) of exact copies, verified (a, b, similarity) that connect the others)."""
    texts = identified(docs)
    sig = written(signatures(texts).withColumn("id", F.monotonically_increasing_id()), "near-signatures")
    named = sig.select("id", "doc_id")
    kin = sig.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = small(sig.select("id", "c1", "c2").join(kin, ["c1", "c2"]).where("id <> rep").select("id", "rep"), "near-copies")
    reps = written(sig.select("id", "sig").join(copies, "id", "left_anti"), "near-firsts")
    found, cross = buckets(reps)
    first = found.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    first = written((first if cross is None else first.unionByName(cross)).distinct(), "near-pairs")
    judged = _judged(first, reps, texts, named)
    near = judged.where(F.col("similarity") >= THRESHOLD)
    label = components(near)
    # buckets of more than one group
    rows = found.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high").select("band", "m")
    rows = written(rows.join(open_, "band"), "near-open")
    few = grouped(rows.where(F.col("m") <= SMALL_BUCKET).select("band", "id", "comp"), "band", "a bigint, b bigint", _pairs)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = rows.where(F.col("m") > SMALL_BUCKET).withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = own.withColumn("other", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own")))))
    tasks = other.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "comp").join(reps, "id")
    crossed = written(grouped(tasks.select("task", "id", "comp", "sig"), "task", "a bigint, b bigint, task bigint", _cross), "near-crossed")
    more = few.unionByName(crossed.where("task IS NULL").select("a", "b")).distinct().join(first, ["a", "b"], "left_anti")
    near = near.unionByName(_judged(written(more, "near-pairs"), reps, texts, named).where(F.col("similarity") >= THRESHOLD))
    dense = crossed.where("task IS NOT NULL").select("task", F.col("a").alias("id"), F.col("b").alias("comp"))
    if not dense.isEmpty():
        sets = shingled(dense.select("id").distinct(), texts, named)
        near = near.unionByName(grouped(dense.join(reps, "id").join(sets, "id").select("task", "id", "comp", "sig", "s", "n"), "task", "a bigint, b bigint, similarity double", _settle))
    return named, copies, written(near.distinct(), "near-links")


def pairs(docs: DataFrame) -> DataFrame:
    """Verified pairs (a, b, similarity) of doc_ids, a < b, that connect every group of near duplicates."""
    named, copies, near = links(docs)
    both = near.unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    x, y = (named.select(F.col("id").alias(k), F.col("doc_id").alias(f"d{k}")) for k in "ab")
    return both.join(x, "a").join(y, "b").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all but the least member of each connected component of (a, b)."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-star")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = written(low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct(), "near-star")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        seen = now


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): every document that has an earlier near duplicate, and the least of its group."""
    named, copies, near = links(docs)
    label = components(near)
    group = label.unionByName(copies.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp")))
    group = written(group.unionByName(group.select(F.col("comp").alias("id"), "comp").distinct()).join(named, "id").select("doc_id", "comp"), "near-groups")
    least = group.groupBy("comp").agg(F.min("doc_id").alias("keep_id"))
    return group.join(least, "comp").where(F.col("doc_id") != F.col("keep_id")).select("doc_id", "keep_id")


def filtered(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least doc_id; columns as in ``docs``."""
    dup = small(duplicates(docs).select("doc_id"), "near-dropped")
    kept = docs.join(dup, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n_n")).where("__n_n > 1").select("doc_id")
    again = small(again, "near-again")
    if again.isEmpty():
        return kept
    first = kept.join(again, "doc_id", "left_semi").withColumn("__n_r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.lower("text")))).where("__n_r = 1").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
