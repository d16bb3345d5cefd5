"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case UTF-8 with every run of other characters than
letters and digits as one space. An item of m bytes has an error budget k = m * ERRORS // 100 and is
split into k + 1 pieces, so a passage within k edits of the item holds one piece unchanged. All
pieces of all items go into one Aho-Corasick automaton; every hit puts the item in its place in the
text, and the window around it is verified with Myers' bit-parallel distance, start and end free.

One pass over the texts, no shuffle. The items are broadcast in parts of at most PART_BYTES (their
size is summed first); a larger benchmark takes one pass for each part, with the same result.

Defined cases: null or wordless texts hold nothing, null or wordless items are never found; items
too short for an edit (less than 100 / ERRORS bytes) match exactly as whole words; items that repeat
are each reported; rows that repeat a doc_id give one row for each item; rows without doc_id are
judged like all others; doc_id and item_id may be of any type; passages that tie for the least distance are one row;
texts are searched whole whatever their length; empty tables give an empty result (or leave documents as they are);
extra columns pass through, whatever their names, but names starting with ``__d_`` are reserved.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, lowered, read, string_buffer, word_mask

ERRORS = 8
PART_BYTES = 32 << 20


def squeeze(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, str]:
    """(offsets, text) of consecutive lowered texts; each is " words of the text " between spaces, one
    character for each byte."""
    part = data[off[0] : off[-1]]
    word = word_mask(part)
    ends = off[1:] - off[0] - 1
    keep = word.copy()
    keep[1:] |= ~word[1:] & word[:-1]
    keep[ends] = True
    out = np.where(word, part, np.uint8(32))
    out[ends] = 10
    at = np.concatenate([[0], np.cumsum(keep)])[off - off[0]]
    return at, out[keep].tobytes().decode("latin-1")


def clean(text: str | None) -> str:
    raw = np.frombuffer((text or "").lower().encode() + b"\n", np.uint8)
    return squeeze(np.array([0, len(raw)]), raw)[1].strip(" \n")


def budget(item: str) -> int:
    return len(item) * ERRORS // 100


def pieces(item: str) -> list[tuple[int, str]]:
    """(start, piece) of the budget-plus-one pieces."""
    n = budget(item) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Myers:
    """Least edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.full = (1 << self.m) - 1
        self.top = self.m - 1
        self.place: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.place[c] = self.place.get(c, 0) | 1 << i

    def __call__(self, text: str, most: int) -> int:
        """The distance, or ``most + 1`` if it is greater."""
        pv, mv, score, best = self.full, 0, self.m, self.m
        get, full, top = self.place.get, self.full, self.top
        left = len(text)
        for c in text:
            left -= 1
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            score += (ph >> top & 1) - (mh >> top & 1)
            if score < best:
                best = score
                if not best:
                    return 0
            elif score - left > most and best > most:
                break
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return min(best, most + 1)


class Finder:
    """All items, ready to be found in texts."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.items = items
        self.verify = [None if budget(x) == 0 else Myers(x) for _, x in items]
        self.auto = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x) in enumerate(items):
            for s, p in pieces(x) if budget(x) else [(-1, f" {x} ")]:
                at.setdefault(p, []).append((n, s))
        for p, where in at.items():
            self.auto.add_word(p, (len(p), where))
        if at:
            self.auto.make_automaton()
        self.any = bool(at)

    def __call__(self, off: np.ndarray, data: np.ndarray) -> dict[tuple[int, int], int]:
        """(text, item) -> distance, for consecutive lowered texts."""
        at, s = squeeze(off, data)
        found: dict[tuple[int, int], int] = {}
        if not self.any:
            return found
        s = s.replace("\n", " \n ")
        at = at + 2 * np.arange(len(at))  # three characters now end each text
        places: dict[tuple[int, int], list[int]] = {}
        ends, hits = [], []
        for end, hit in self.auto.iter(" " + s):
            ends.append(end)
            hits.append(hit)
        docs = np.searchsorted(at, np.array(ends, np.int64) - 1, "right") - 1 if ends else []
        for end, d, (n, where) in zip(ends, docs, hits):
            for item, start in where:
                places.setdefault((int(d), item), []).append(end - n - start)
        for (d, item), starts in places.items():
            x, k = self.items[item][1], budget(self.items[item][1])
            if k == 0:
                found[d, item] = 0
                continue
            low, high, best, done = int(at[d]), int(at[d + 1]) - 2, k + 1, -1
            for b in sorted(set(starts)):
                if b + k <= done:
                    continue
                done = b + 2 * k
                best = min(best, self.verify[item](s[max(low, b - k) : min(high, done + len(x) + k)], k))
                if not best:
                    break
            if best <= k:
                found[d, item] = best
        return found


_FINDERS: dict[str, Finder] = {}


def _finder(name: str, items) -> Finder:
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(items.value)
    return _FINDERS[name]


def parts(benchmark: DataFrame, limit: int = PART_BYTES) -> list:
    """(name, broadcast items) of parts whose text is about ``limit`` bytes at most."""
    spark = benchmark.sparkSession
    some = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    out = []
    for i in range(n):
        rows = some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect() if n > 1 else some.collect()
        items = sorted([(r[0], clean(r[1])) for r in rows], key=lambda x: (x[0] is None, x[1] if x[0] is None else x[0], x[1]))
        items = [x for x in items if x[1]]
        b = spark.sparkContext.broadcast(items)
        out.append((uuid.uuid4().hex, b))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, budget): every item found in every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    names = ["doc_id", "item_id", "distance", "budget"]
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    kind = to_arrow_type(kinds[1])
    out = None
    for name, items in parts(benchmark):

        def run(batches, name=name, items=items):
            find = _finder(name, items)
            for b in batches:
                off, data = string_buffer(b.column(1))
                rows = []
                for i, j in chunks(off):
                    for (d, n), far in find(off[i : j + 1], data).items():
                        rows.append((i + d, find.items[n][0], far, budget(find.items[n][1])))
                at, item, far, most = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind), pa.array(far, pa.int32()), pa.array(most, pa.int32())], names=names)

        one = texts.mapInArrow(lean(run), f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance int, budget int")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("budget").alias("budget"))


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``."""
    for name, items in parts(benchmark):
        names = docs.columns
        given = docs.select(*names, lowered(F.col("text")).alias("__d_low"))

        def run(batches, name=name, items=items, n=len(names)):
            find = _finder(name, items)
            for b in batches:
                off, data = string_buffer(b.column(n))
                keep = np.ones(b.num_rows, bool)
                for i, j in chunks(off):
                    for d, _ in find(off[i : j + 1], data):
                        keep[i + d] = False
                yield pa.RecordBatch.from_arrays(b.columns[:n], names=b.schema.names[:n]).filter(pa.array(keep))

        docs = given.mapInArrow(lean(run), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
