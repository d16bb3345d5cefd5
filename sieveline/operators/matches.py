"""Content patterns over whole columns: which values hold a match of which pattern.

The expression of all patterns over one value is too long a method for the JVM to compile, so over whole tables it
costs many times what the patterns do. Here a pattern is one vectorised call for a batch of values, by the linear-time
engine whose syntax the pattern tables keep to, and only for the values that pass its ``screen``. Every value is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..patterns import Pattern, screen

#: Values, and bytes, that are handled at once: a call compiles its pattern anew.
ROWS, BYTES = 1 << 16, 1 << 25


def _any(low: pa.Array, parts: Iterable[str]) -> pa.Array:
    """Which of the values hold one of the texts."""
    parts = list(parts)
    return pc.match_substring(low, parts[0]) if len(parts) == 1 else pc.match_substring_regex(low, "|".join(map(re.escape, parts)))


def hits(values: pa.Array, patterns: Iterable[Pattern]):
    """(rows, patterns) as two arrays: the places of values that hold a match, and of what."""
    import numpy as np

    # screens hold of any match, so what they drop has none
    tests = sorted((*screen(p.regex), k, p.regex.replace("%b", r"\b")) for k, p in enumerate(patterns))
    telling = [t for t in tests if t[2] and min(map(len, t[2])) > 2]
    low = pc.utf8_lower(values)
    every = (values, low, pc.fill_null(pc.utf8_length(values), -1).to_numpy(zero_copy_only=False), pc.fill_null(pc.count_substring_regex(values, "[0-9]"), 0).to_numpy(zero_copy_only=False), np.arange(len(values)))
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]

    def narrowed(of, mask):
        keep = np.flatnonzero(mask)
        return (of[0].take(pa.array(keep)), of[1].take(pa.array(keep)), *(x[keep] for x in of[2:]))

    def search(of, tests) -> None:
        for least, n, parts, k, regex in tests:
            if (fit := of[2] >= least).sum() < len(fit):  # as the least length grows, values drop out for good
                of = narrowed(of, fit)
            if not len(of[4]):
                break
            mask = of[3] >= n
            if parts and mask.any():
                mask &= _any(of[1], parts).to_numpy(zero_copy_only=False)
            left = np.flatnonzero(mask)
            if len(left):
                left = left[pc.match_substring_regex(of[0] if len(left) == len(mask) else of[0].take(pa.array(left)), regex).to_numpy(zero_copy_only=False)]
                rows.append(of[4][left])
                found.append(np.full(len(left), k, np.int32))

    search(every, [t for t in tests if t not in telling])
    if telling:  # few values hold any of their texts
        search(narrowed(every, pc.fill_null(_any(low, sorted({x for t in telling for x in t[2]})), False).to_numpy(zero_copy_only=False)), telling)
    return np.concatenate(rows), np.concatenate(found)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def with_hits(df: DataFrame, patterns: tuple[Pattern, ...], value: str = "value", new: str = "p") -> DataFrame:
    """A row of ``df`` for each pattern that its value holds a match of, with the pattern's place."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    at = df.columns.index(value)
    schema = StructType([*df.schema.fields, StructField(new, IntegerType())])

    def run(batches):
        for t in _gathered(batches):
            rows, found = hits(t.column(at).combine_chunks(), patterns)
            for k in range(0, len(rows), ROWS):
                got = t.take(pa.array(rows[k : k + ROWS])).combine_chunks()
                yield from got.append_column(new, pa.array(found[k : k + ROWS])).rename_columns(schema.names).to_batches()

    return df.mapInArrow(run, schema)
