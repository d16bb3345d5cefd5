"""Sharding by a hierarchical weighted hash tree.

Each level (region, rack, shard) is one independent weighted hash draw among the children of the
node chosen above: child ``c`` with weight ``w`` draws ``-ln(u) / w`` with ``u`` uniform from
``md5(key | path of c)``, and the least draw wins. A child is chosen with probability in proportion
to its weight. A change of one child's weight moves keys only into or out of that child, and the
draws inside every subtree whose weights are unchanged stay what they were.

A pure column expression: no shuffle, no UDF, only the key column is read.

Defined cases: a null key is drawn as the text ``<null>``; repeated rows and equal keys go to the
same shard, whatever the length of a text key; an empty table gives an empty result; equal draws go to the child
listed first; a node without a child of positive weight gives null below it; other columns of the table are not
touched, clashing ones named region, rack, shard are replaced, also if one of them is the key; names starting
with ``__s_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: region -> (weight, rack -> (weight, shard -> weight))
TREE: Mapping = {
    "r0": (5.0, {"k0": (2.0, {"s0": 1.0, "s1": 1.0, "s2": 2.0}), "k1": (3.0, {"s0": 2.0, "s1": 1.0})}),
    "r1": (3.0, {"k0": (1.0, {"s0": 1.0, "s1": 1.0}), "k1": (1.0, {"s0": 1.0, "s1": 3.0}), "k2": (1.0, {"s0": 1.0})}),
    "r2": (2.0, {"k0": (1.0, {"s0": 3.0, "s1": 2.0, "s2": 1.0})}),
}
LEVELS = ("region", "rack", "shard")


def _weight(node) -> float:
    return node[0] if isinstance(node, tuple) else node


def _choose(key: Column, path: str, children: Mapping) -> Column:
    """Name of the child with the least draw."""
    draws = []
    for name, node in children.items():
        if _weight(node) <= 0:
            continue
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}/{name}"))), 1, 12), 16, 10).cast("double")
        draws.append((name, -F.log((bits + 1.0) / 281474976710657.0) / F.lit(_weight(node))))
    if not draws:
        raise ValueError(f"no child of {path or 'the root'} has a positive weight")
    if len(draws) == 1:
        return F.lit(draws[0][0])
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, d) in enumerate(draws)]))["n"]


def assign(df: DataFrame, key: str = "doc_id", tree: Mapping = TREE) -> DataFrame:
    """Add region, rack and shard. Each level's choice is one column of its own, taken from a map by the path above, so
    that a key named like a level is read before it is replaced and no level repeats another's draws."""
    k = F.coalesce(F.col(key).cast("string").cast("binary"), F.lit("<null>").cast("binary"))
    out = df.withColumns({"__s_key": k})
    out = out.withColumn("__s_region", _choose(F.col("__s_key"), "", tree))
    rack = shard = None
    for r, (_, racks) in tree.items():
        if not any(_weight(x) > 0 for x in racks.values()):
            continue
        at = F.col("__s_region") == r
        c = _choose(F.col("__s_key"), r, racks)
        rack = F.when(at, c) if rack is None else rack.when(at, c)
    out = out.withColumn("__s_rack", F.lit(None).cast("string") if rack is None else rack)
    for r, (_, racks) in tree.items():
        inner = None
        for a, (_, shards) in racks.items():
            if any(w > 0 for w in shards.values()):
                at = F.col("__s_rack") == a
                c = _choose(F.col("__s_key"), f"{r}/{a}", shards)
                inner = F.when(at, c) if inner is None else inner.when(at, c)
        if inner is not None:
            at = F.col("__s_region") == r
            shard = F.when(at, inner) if shard is None else shard.when(at, inner)
    out = out.withColumn("__s_shard", F.lit(None).cast("string") if shard is None else shard)
    names = [c for c in df.columns if c not in LEVELS]
    return out.select(*[F.col(f"`{c}`") if c in names else F.col(f"__s_{c}").alias(c) for c in df.columns], *[F.col(f"__s_{c}").alias(c) for c in LEVELS if c not in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents").select("doc_id"))


def _sql_choose(path: str, children: Mapping) -> str:
    draws = [
        (n, f"-ln((('0x' || substr(md5(key || '|{path}/{n}'), 1, 12))::BIGINT::DOUBLE + 1.0) / 281474976710657.0) / {_weight(c)}::DOUBLE")
        for n, c in children.items()
        if _weight(c) > 0
    ]
    if len(draws) == 1:
        return f"'{draws[0][0]}'"
    return "list_sort([" + ", ".join(f"{{'d': {d}, 'i': {i}, 'n': '{n}'}}" for i, (n, d) in enumerate(draws)) + "])[1].n"


def oracle(tree: Mapping = TREE) -> str:
    rack = " ".join(f"WHEN region = '{r}' THEN {_sql_choose(r, racks)}" for r, (_, racks) in tree.items())
    shard = " ".join(f"WHEN region = '{r}' AND rack = '{a}' THEN {_sql_choose(f'{r}/{a}', s)}" for r, (_, racks) in tree.items() for a, (_, s) in racks.items())
    return f"""
WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '<null>') AS key FROM documents),
a AS (SELECT *, {_sql_choose('', tree)} AS region FROM k),
b AS (SELECT *, CASE {rack} END AS rack FROM a)
SELECT doc_id, region, rack, CASE {shard} END AS shard FROM b"""
