"""Helpers shared by the training-data operators.

Text-heavy operators work on whole Arrow batches: the UTF-8 buffer of a batch is viewed as one
numpy byte array (no per-row Python objects) and handled in chunks of a few MB, so a worker's
memory does not depend on the batch or table size, only on the longest single text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000
#: Bytes of text handled at once in a worker.
CHUNK_BYTES = 1 << 20

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lean(fn):
    """A function of batches that gives memory back to the system at the end of a task: workers are used again, and an
    executor's memory would hold what each of them needed at most."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                return

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; documents of fewer input splits than the session has cores are dealt out to all of them,
    a larger table stays as it is read, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if table == "documents" and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one is made only
    where that is unset (a single-machine session, as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by a table in the shared folder; survives executor loss."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df``, count it, and mark it for broadcast only if it has at most ``rows`` rows;
    a larger one is left to a shuffle join."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying its text; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    return off, np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most ``limit`` bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("_POW", _BASE), ("_INV", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Slices:
    """Polynomial hashes of any slices of ``codes`` from one prefix sum, modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.pow, self.inv = _powers(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_SPREAD[codes] * self.pow[:n] if codes.dtype == np.uint8 else mix(codes.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sum[end] - self.sum[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64))


#: First bytes of punctuation outside ASCII, and of scripts written without spaces.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE2, 0xE3, 0xEF]] = True
_DENSE = np.zeros(256, bool)
_DENSE[[0xE0, *range(0xE3, 0xEA)]] = True
_WIDE = np.zeros((2, 256), bool)
_WIDE[0, [*range(0x81, 0x90), *range(0x9A, 0xA1), *range(0xBB, 0xC0)]] = True
_WIDE[1, [0x80, *range(0x9B, 0xA6)]] = True


def word_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of letters and digits: those of ASCII, and those of other characters but Latin-1 signs, general and CJK
    punctuation, and wide forms of ASCII punctuation."""
    ok = _WORD[data]
    at = np.flatnonzero(_MAYBE[data])
    if len(at):
        last = len(data) - 1
        one, two, three = data[at], data[np.minimum(at + 1, last)], data[np.minimum(at + 2, last)]
        sign = (one == 0xC2) & ~np.isin(two, (0xAA, 0xB5, 0xBA)) | (one == 0xE2) & (two <= 0x81) | (one == 0xE3) & (two == 0x80)
        sign |= (one == 0xEF) & ((two == 0xBC) & _WIDE[0, three] | (two == 0xBD) & _WIDE[1, three])
        at, size = at[sign], np.where(one[sign] == 0xC2, 2, 3)
        for k in range(3):
            ok[at[size > k] + k] = False
    return ok


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of letters and digits; in scripts without spaces (Han, kana, Hangul syllables, Thai,
    Lao) every character is a word."""
    ok = word_mask(data)
    edge = np.diff(ok.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(_DENSE[data])
    if len(at):
        two = data[np.minimum(at + 1, len(data) - 1)]
        at = at[ok[at] & ((data[at] != 0xE0) | (two >= 0xB8) & (two <= 0xBB))]
        cut = np.union1d(at, at + 3)
        start = np.union1d(start, cut[(cut < len(data)) & ok[np.minimum(cut, len(data) - 1)]])
        end = np.union1d(end, cut[(cut > 0) & ok[cut - 1]])
    return start, end


#: Flags of every code point, built once in a worker.
LETTER, UPPER, NUMBER, SPACE, DIGIT, ODD = 1, 2, 4, 8, 16, 32
_FLAGS: np.ndarray | None = None


def flags() -> np.ndarray:
    """uint8 flags by code point: letter, upper-case letter, number, ASCII white space, decimal digit, and
    odd: numbers that are no decimal digits, and ASCII information separators."""
    global _FLAGS
    if _FLAGS is None:
        import sys
        import unicodedata

        cat = {"L": LETTER, "N": NUMBER}
        a = np.array([cat.get(c[0], 0) | (UPPER if c == "Lu" else 0) | (DIGIT if c == "Nd" else 0) | (ODD if c in ("No", "Nl") else 0) for c in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))], np.uint8)
        a[[9, 10, 12, 13, 32]] |= SPACE
        a[28:32] |= ODD
        _FLAGS = a
    return _FLAGS


def code_points(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of consecutive texts given as UTF-8."""
    part = data[off[0] : off[-1]]
    starts = (part & 0xC0) != 0x80
    if starts.all():
        return off - off[0], part.astype(np.uint32)
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[off - off[0]], np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many are set in each slice."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def added(df: DataFrame, text: str, new: str, fn) -> DataFrame:
    """Append columns computed from a text column, batch by batch. ``fn(offsets, bytes)`` gets the
    texts of a chunk and returns one Arrow array (or numpy array) for each field of the DDL ``new``."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(new).fields
    schema = StructType(df.schema.fields + fields)
    at = df.columns.index(text)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = string_buffer(b.column(at))
            got = [fn(off[i : j + 1], data) for i, j in chunks(off)]
            cols = [pa.chunked_array([x[k] if isinstance(x[k], pa.Array) else pa.array(x[k], kinds[k]) for x in got], kinds[k]).combine_chunks() for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*b.columns, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]], names=[f.name for f in schema.fields])

    return df.mapInArrow(lean(run), schema)


def lowered(text) -> F.Column:
    """Lower-case text ending in a line feed, so that words of two texts never touch."""
    return F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"))


def grouped(df: DataFrame, key: str, new: str, fn, bits: int = 0) -> DataFrame:
    """Rows brought together by a 64-bit key, less its lowest ``bits``, and handled in whole groups: ``fn(columns)`` gets numpy
    or Arrow columns of rows ordered by the key, every group complete, and returns arrays for the
    DDL ``new``. Spark sorts (and spills) the partitions; a worker holds one batch and the last group."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(new)
    arrow = to_arrow_schema(schema)
    names = df.columns
    at = names.index(key)

    def done(t: pa.Table) -> pa.RecordBatch:
        cols = {}
        for n in names:
            c = t.column(n).combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            cols[n] = c.to_numpy(zero_copy_only=False) if pa.types.is_primitive(c.type) else c
        got = fn(cols)
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at).to_numpy(zero_copy_only=False) >> bits
            cut = int(np.searchsorted(k, k[-1], "left"))
            if held and held[-1].column(at)[0].as_py() >> bits != k[0] and cut == 0:
                yield done(pa.Table.from_batches(held))
                held = []
            if cut:
                yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    return df.repartition(F.shiftright(key, bits) if bits else F.col(key)).sortWithinPartitions(key).mapInArrow(lean(run), schema)
