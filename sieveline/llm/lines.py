"""Line deduplication by a segment-partition edit join.

A line of at least MIN_BYTES UTF-8 bytes (lower case) is removed if the same line, or one within
EDITS byte edits whose first occurrence comes earlier, stands elsewhere; the first occurrence, in
order of (doc_id, line number), stays. Shorter lines are never touched.

The join: every line is split into EDITS + 1 segments. Of two lines within EDITS edits the shorter
has a segment that is a substring of the longer near the same place, so each line is indexed by
(its length, segment number, segment) and probes, for every length down to EDITS below its own,
only the substrings whose start a multi-match-aware window allows. Index entries and probes are
rows of one table, partitioned and sorted once by a 44-bit hash; the other 20 bits of the same word
hold the kind, the length and counts of letter classes, one edit of which changes two counts by one
at most, so most accidental pairs go without seeing a text. Pairs left over are verified with a
banded bit-parallel edit distance. Nothing is capped.

Hot lines and keys: a map task indexes a line once as long as it remembers it (SEEN lines). Key rows are read
in order, in memory for one group at a time; a group beyond BIG lines (lines of one template and length) is passed
on in blocks, and each pair of blocks is a task of its own that verifies inside, with counts of 32 letter
classes before any distance, and gives at most one earlier line for each line. Occurrences of a line meet its
first one by partial aggregation and a join that splits skewed keys. Exact copies are told by 128 bits of hash.

Shuffles: 16-byte key rows, line occurrences (hashes, doc_id, line number), the texts of lines in
candidate pairs, and once the documents, to meet their removed lines.

Defined cases: a null text stays null, a row without doc_id stays as it is; doc_id may be of any type that has an
order; rows that repeat a doc_id are one document, whose lines do not duplicate each other across those rows at
the same line number; lines that tie for the first place go by doc_id and line number; texts are taken whole
whatever their length; an empty table gives an empty result; extra columns pass through, whatever their names,
but names starting with ``__l_`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Slices, chunks, lean, lowered, mix, read, small, string_buffer, written

EDITS = 2
MIN_BYTES = 40
#: Hashes of lines whose texts are wanted are broadcast up to this many.
WANTED_ROWS = 1_000_000
#: Lines of a key group that one task compares; a larger group is passed on in blocks of so many.
BIG = 4096
#: Lines a map task remembers as indexed.
SEEN = 100_000

#: Four classes of letters, counted two at a time in the halves of a word.
_CLASSES = np.zeros((2, 256), np.uint64)
for _c in range(97, 123):
    _CLASSES[_c * 7 % 2, _c] = 1 << (32 * (_c * 7 // 2 % 2))


def line_spans(off: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number, start, end) of the long lines of texts that end in a line feed."""
    at = off - off[0]
    end = np.flatnonzero(part == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    doc = np.searchsorted(at, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(at) - 1), "left")
    number = np.arange(len(end)) - first[doc]
    ok = end - start >= MIN_BYTES
    return doc[ok], number[ok], start[ok], end[ok]


def segments(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of these lengths; the longer ones come last."""
    k = EDITS + 1
    size, longer = length // k, length % k
    return i * size + np.maximum(0, i - (k - longer)), size + (i >= k - longer)


def keys(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line row, key word): 44 bits of hash, index bit, probe bit, length mod 4, four nibbles."""
    sl = Slices(part)
    n = end - start
    low = np.zeros(len(n), np.uint64)
    total = np.zeros(len(part) + 1, np.uint64)
    for k in range(2):
        np.cumsum(_CLASSES[k][part], out=total[1:])
        both = total[end] - total[start]
        low |= (both & np.uint64(15)) << np.uint64(8 * k)
        low |= (both >> np.uint64(32) & np.uint64(15)) << np.uint64(8 * k + 4)
    low |= (n.astype(np.uint64) & np.uint64(3)) << np.uint64(16)
    rows, words = [], []
    for less in range(EDITS + 1):
        length = n - less
        for i in range(EDITS + 1):
            p, size = segments(length, i)
            right = EDITS - i
            for shift in range(max(-i, less - right), min(i, less + right) + 1):
                own = less == 0 and shift == 0
                s = p + shift
                ok = np.flatnonzero((s >= 0) & (s + size <= n) & (length >= MIN_BYTES))
                h = sl(start[ok] + s[ok], start[ok] + s[ok] + size[ok])
                h = mix(h + length[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
                kind = np.uint64((3 if own else 2) << 18)
                rows.append(ok)
                words.append((h & ~np.uint64(0xFFFFF)) | kind | low[ok])
    return np.concatenate(rows), np.concatenate(words)


def second(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another 64 bits of hash of slices: of the slices of a keyed permutation of byte values and of neighbouring bytes."""
    pair = part.astype(np.uint32) * np.uint32(0x9E3779B1)
    pair[1:] ^= part[:-1].astype(np.uint32) << np.uint32(8)
    first = mix(part[np.minimum(start, max(len(part) - 1, 0))].astype(np.uint64) + np.uint64(77))
    return mix(Slices(pair)(np.minimum(start + 1, end), end) ^ first)


def _lines(batches):
    for b in batches:
        off, data = string_buffer(b.column(1))
        for i, j in chunks(off):
            part = data[off[i] : off[j]]
            doc, number, start, end = line_spans(off[i : j + 1], part)
            h, g = Slices(part)(start, end).view(np.int64), second(part, start, end).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), b.column(0).take(pa.array(doc + i)), pa.array(number.astype(np.int32))], names=["line", "line2", "doc_id", "number"])


def _keys(batches):
    seen: set[int] = set()
    for b in batches:
        off, data = string_buffer(b.column(1))
        for i, j in chunks(off):
            part = data[off[i] : off[j]]
            _, _, start, end = line_spans(off[i : j + 1], part)
            h = Slices(part)(start, end)
            h, one = np.unique(h, return_index=True)
            if len(seen) > SEEN:
                seen.clear()
            new = np.array([x not in seen for x in h.tolist()], bool)
            h, one = h[new], one[new]
            seen.update(h.tolist())
            row, word = keys(part, start[one], end[one])
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(h[row].view(np.int64))], names=["word", "line"])


def _texts(wanted):
    """Lines of the texts with their bytes; only those whose hash is in ``wanted``, if given."""

    def run(batches):
        for b in batches:
            off, data = string_buffer(b.column(1))
            for i, j in chunks(off):
                part = data[off[i] : off[j]]
                _, _, start, end = line_spans(off[i : j + 1], part)
                h, one = np.unique(Slices(part)(start, end).view(np.int64), return_index=True)
                if wanted is not None:
                    w = wanted.value
                    at = np.minimum(np.searchsorted(w, h), max(len(w) - 1, 0))
                    ok = w[at] == h if len(w) else np.zeros(len(h), bool)
                    h, one = h[ok], one[ok]
                raw = part.tobytes()
                g = second(part, start[one], end[one]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([raw[s:e] for s, e in zip(start[one].tolist(), end[one].tolist())], pa.binary()), pa.array(g)], names=["line", "bytes", "line2"])

    return run


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an index word and a probe word with one hash may be within EDITS edits."""
    ix, px, iy, py = ((w >> np.uint64(b)) & np.uint64(1) > 0 for w in (x, y) for b in (18, 19))
    ok = (ix & py) | (iy & px)
    far = np.zeros(ok.shape, np.int8)
    for k in range(4):
        d = ((x >> np.uint64(4 * k)) - (y >> np.uint64(4 * k))) & np.uint64(15)
        far += np.minimum(d, np.uint64(16) - d).astype(np.int8)
    return ok & (far <= 2 * EDITS)


def _grouped_pairs(word: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Candidate pairs (2 x n) of whole groups, rows ordered by the word, then line."""
    word = word.view(np.uint64)
    group = word >> np.uint64(20)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(start, append=len(group))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        ok = (line[i] != line[j]) & _possible(word[i], word[j])
        a.append(np.minimum(line[i[ok]], line[j[ok]]))
        b.append(np.maximum(line[i[ok]], line[j[ok]]))

    for n in np.unique(size[(size > 1) & (size <= 16)]):
        at = start[size == n]
        for x in range(n):
            for y in range(x + 1, n):
                pair(at + x, at + y)
    for s, n in zip(start[size > 16], size[size > 16]):
        for k in range(n - 1):
            pair(np.full(n - k - 1, s + k), np.arange(s + k + 1, s + n))
    return np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)


_FOUND = "a bigint, b bigint, heavy bigint, block int"


def _candidates(batches, big: int = BIG):
    """From rows (word, line) in order: candidate pairs (a, b) of groups of up to ``big`` lines; the rows (a: word, b: line) of
    larger ones with the group and a block number. Holds one group of ``big`` rows at most besides a batch."""
    none = np.zeros(0, np.int64)

    def batch(a, b, heavy=None, block=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int64()) if heavy is None else pa.array(np.full(n, heavy)), pa.nulls(n, pa.int32()) if block is None else pa.array(block.astype(np.int32))], names=["a", "b", "heavy", "block"])

    # the open group: its rows, how many of its rows were passed on, the last of those
    word, line, group, passed, last = none, none, None, 0, None
    for b in batches:
        w, x = np.concatenate([word, b.column(0).to_numpy()]), np.concatenate([line, b.column(1).to_numpy()])
        if not b.num_rows:
            continue
        ok = np.ones(len(w), bool)
        ok[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1])
        ok[0] = last != (w[0], x[0])
        w, x = w[ok], x[ok]
        g = w >> 20
        if passed:
            e = int(np.searchsorted(g, group, "right"))
            if e:
                yield batch(w[:e], x[:e], group, (passed + np.arange(e)) // big)
                passed, last = passed + e, (w[e - 1], x[e - 1])
            w, x, g = w[e:], x[e:], g[e:]
        if not len(w):
            word, line = none, none
            continue
        cut = int(np.searchsorted(g, g[-1], "left"))
        if cut:
            start = np.flatnonzero(np.concatenate([[True], g[1:cut] != g[: cut - 1]]))
            size = np.diff(start, append=cut)
            for s, n in zip(start[size > big], size[size > big]):
                yield batch(w[s : s + n], x[s : s + n], g[s], np.arange(n) // big)
            fit = np.repeat(size <= big, size)
            yield batch(*_grouped_pairs(w[:cut][fit], x[:cut][fit]))
        word, line, group, passed, last = w[cut:], x[cut:], g[-1], 0, None
        if len(word) > big:
            yield batch(word, line, group, np.arange(len(word)) // big)
            passed, last = len(word), (word[-1], line[-1])
            word, line = none, none
    if len(word):
        yield batch(*_grouped_pairs(word, line))


def within(a: bytes, b: bytes, k: int = EDITS) -> bool:
    """Whether the edit distance is at most ``k``: a window of 2k+1 rows slides down the diagonal,
    one machine word of vertical differences per column."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > k:
        return False
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[m - 1 - q] == b[n - 1 - q]:
        q += 1
    a, b = a[p : m - q], b[p : n - q]
    m, n = len(a), len(b)
    width = 2 * k + 1
    full = (1 << width) - 1
    place: dict[int, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << (i + k)
    vp, vn = full & (full << k), 0
    last, far = k + m - n, m - n
    for j, c in enumerate(b):
        x = (place.get(c, 0) >> j) & full
        d = ((((x & vp) + vp) ^ vp) | x | vn) & full
        far += 1 - (d >> last & 1)
        if far > k:
            return False
        hp, hn = (vn | ~(d | vp)) & full, d & vp
        d >>= 1
        vp, vn = (hn | ~(d | hp)) & full, d & hp
    return far <= k


def _verified(batches):
    for t in batches:
        ok = [within(x, y) for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([t.column(k) for k in range(4)], names=["a", "a2", "b", "b2"]).filter(pa.array(ok, pa.bool_()))


def earlier(texts: list[bytes], blocks: np.ndarray) -> list[tuple[int, int]]:
    """(i, j): for each text j an earlier one i within EDITS edits, if there is one; only of different blocks, if there are two."""
    n = len(texts)
    size = np.array([len(x) for x in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    count = np.zeros((n, 32), np.uint8)
    np.add.at(count, (np.repeat(np.arange(n), size), raw & 31), 1)
    two = len(np.unique(blocks)) > 1
    out = []
    for j in range(1, n):
        far = count[:j] - count[j]
        far = np.minimum(far, np.uint8(0) - far).sum(axis=1, dtype=np.int32)
        ok = (far <= 2 * EDITS) & (np.abs(size[:j] - size[j]) <= EDITS)
        if two:
            ok &= blocks[:j] != blocks[j]
        for i in np.flatnonzero(ok).tolist():
            if texts[i] != texts[j] and within(texts[i], texts[j]):
                out.append((i, j))
                break
    return out


def _settled(batches):
    """Rows (task, block, line, line2, bytes) in order of the task and of first occurrences."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table):
        got = earlier(t.column(4).to_pylist(), t.column(1).to_numpy())
        i, j = (pa.array([x[k] for x in got], pa.int64()) for k in (0, 1))
        cols = [t.column(k).take(x).combine_chunks() for x, k in ((i, 2), (i, 3), (j, 2), (j, 3))]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c if isinstance(c, pa.Array) else pa.array([], pa.int64()) for c in cols], names=["a", "a2", "b", "b2"])

    for b in batches:
        task = b.column(0).to_numpy()
        cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(task)]):
            if held and held[0].column(0)[0].as_py() != task[s]:
                yield done(pa.Table.from_batches(held))
                held = []
            if e > s:
                held.append(b.slice(s, e - s))
    if held:
        yield done(pa.Table.from_batches(held))


def near_lines(texts: DataFrame, firsts: DataFrame, big: int = BIG) -> DataFrame:
    """(a, a2, b, b2): hashes of different lines within EDITS edits; of lines that have such an earlier one, one pair at least.
    ``firsts``: (line, line2, first, n)."""
    rows = texts.mapInArrow(lean(_keys), "word bigint, line bigint")
    rows = rows.repartition(F.shiftright("word", 20)).sortWithinPartitions("word", "line")
    found = written(rows.mapInArrow(lean(lambda batches: _candidates(batches, big)), _FOUND), "lines-found")
    cand = written(found.where("heavy IS NULL").select("a", "b").distinct(), "lines-candidates")
    heavy = found.where("heavy IS NOT NULL").select("heavy", "block", F.col("b").alias("line")).distinct()
    wanted = written(cand.select(F.explode(F.array("a", "b")).alias("line")).unionByName(heavy.select("line")).distinct(), "lines-wanted")
    if wanted.count() <= WANTED_ROWS:
        near = texts.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["line"].to_numpy(np.int64)))
        lines = texts.mapInArrow(lean(_texts(near)), "line bigint, bytes binary, line2 bigint")
    else:
        lines = texts.mapInArrow(lean(_texts(None)), "line bigint, bytes binary, line2 bigint").join(wanted, "line", "left_semi")
    held = written(lines.groupBy("line").agg(F.min(F.struct("bytes", "line2")).alias("x")).select("line", "x.bytes", "x.line2"), "lines-texts")
    left, right = (held.select(F.col("line").alias(k), F.col("line2").alias(f"{k}2"), F.col("bytes").alias(f"t{k}")) for k in "ab")
    out = cand.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "ta", "tb").mapInArrow(lean(_verified), "a bigint, a2 bigint, b bigint, b2 bigint")
    if heavy.isEmpty():
        return out
    parts = heavy.groupBy("heavy").agg((F.max("block") + 1).alias("k"))
    known = written(held.join(firsts, ["line", "line2"]).select("line", "line2", "bytes", "first"), "lines-heavy")
    tasks = heavy.join(parts, "heavy").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tasks = tasks.select(F.xxhash64("heavy", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "block", "line").join(known, "line")
    inside = tasks.select("task", "block", "line", "line2", "bytes", "first").repartition("task").sortWithinPartitions("task", "first", "line").drop("first")
    return out.unionByName(inside.mapInArrow(lean(_settled), "a bigint, a2 bigint, b bigint, b2 bigint"))


def removed(docs: DataFrame, big: int = BIG) -> DataFrame:
    """(doc_id, numbers, lines): the removed lines of every document that loses one."""
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", lowered(F.col("text")).alias("__l_text"))
    at = written(texts.mapInArrow(lean(_lines), f"line bigint, line2 bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, number int"), "lines-at")
    firsts = written(at.groupBy("line", "line2").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n")), "lines-firsts")
    near = written(near_lines(texts, firsts, big), "lines-near")
    involved = small(near.select(F.explode(F.array(F.struct(F.col("a").alias("line"), F.col("a2").alias("line2")), F.struct(F.col("b").alias("line"), F.col("b2").alias("line2")))).alias("x")).select("x.*").distinct(), "lines-involved", WANTED_ROWS)
    known = written(firsts.join(involved, ["line", "line2"], "left_semi").select("line", "line2", "first"), "lines-known")
    fa, fb = (known.select(F.col("line").alias(k), F.col("line2").alias(f"{k}2"), F.col("first").alias(f"f{k}")) for k in "ab")
    b_later = (F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b")))
    later = near.join(fa, ["a", "a2"]).join(fb, ["b", "b2"]).select(F.when(b_later, F.struct(F.col("b").alias("line"), F.col("b2").alias("line2"))).otherwise(F.struct(F.col("a").alias("line"), F.col("a2").alias("line2"))).alias("x")).select("x.*").distinct()
    later = small(later.withColumn("near", F.lit(True)), "lines-later", WANTED_ROWS)
    dead = written(firsts.join(later, ["line", "line2"], "left").where("n > 1 OR near").select("line", "line2", "first", "near"), "lines-dead")
    gone = at.join(dead, ["line", "line2"]).where(F.col("near") | (F.struct("doc_id", "number") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("number", "line")).alias("x")).select("doc_id", F.col("x.number").alias("__l_numbers"), F.col("x.line").alias("__l_lines"))


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` without removed lines, plus ``__l_removed``, how many went."""
    names = docs.columns
    at = names.index("text")
    low = F.when(F.col("__l_numbers").isNotNull(), lowered(F.col("text")))
    plain = docs.join(removed(docs), "doc_id", "left").select(*names, low.alias("__l_low"), "__l_numbers", "__l_lines")
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("__l_removed", IntegerType())])

    def run(batches):
        for b in batches:
            hit = np.flatnonzero(b.column(len(names) + 1).is_valid().to_numpy(zero_copy_only=False) & b.column(at).is_valid().to_numpy(zero_copy_only=False))
            gone = np.zeros(b.num_rows, np.int32)
            new = []
            for r, text, low, x, h in zip(hit, *[b.column(k).take(pa.array(hit)).to_pylist() for k in (at, len(names), len(names) + 1, len(names) + 2)]):
                raw = np.frombuffer(low.encode(), np.uint8)
                _, number, s, e = line_spans(np.array([0, len(raw)]), raw)
                now = dict(zip(number.tolist(), Slices(raw)(s, e).view(np.int64).tolist()))
                out = {n for n, v in zip(x, h) if now.get(n) == v}
                new.append("\n".join(y for n, y in enumerate(text.split("\n")) if n not in out))
                gone[r] = len(out)
            cols = b.columns[: len(names)]
            if len(hit):
                mask = np.zeros(b.num_rows, bool)
                mask[hit] = True
                cols[at] = pa.compute.replace_with_mask(cols[at], pa.array(mask), pa.array(new, cols[at].type))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone)], names=[f.name for f in schema.fields])

    return plain.mapInArrow(lean(run), schema)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents without their duplicate lines and with ``n_chars`` as it is now; a document that
    lost all it had goes."""
    out = deduped(docs).where((F.col("__l_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__l_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it stands afterwards, and the number of lines it lost."""
    return deduped(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("__l_removed", "n_removed")


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(string_split(text, chr(10))) AS own, unnest(range(len(string_split(text, chr(10))))) AS number FROM documents),
long AS (SELECT * FROM l WHERE strlen(line) >= {MIN_BYTES}),
f AS (SELECT line, min(row(doc_id, number)) AS first, strlen(line) AS n FROM long GROUP BY line),
near AS (SELECT DISTINCT b.line FROM f a JOIN f b ON a.n BETWEEN b.n - {EDITS} AND b.n + {EDITS} AND a.first < b.first WHERE levenshtein(a.line, b.line) <= {EDITS}),
gone AS (SELECT long.doc_id, long.number FROM long JOIN f USING (line) WHERE row(long.doc_id, long.number) <> f.first OR line IN (SELECT line FROM near)),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(own, chr(10) ORDER BY l.number) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.number = gone.number GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(t.text, '') AS text, coalesce(g.n, 0)::INT AS n_removed
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)"""
