"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A row descends from the root: at each level every child draws -ln(u) / weight, u from a hash of the row's
key and the child's path, and the smallest draw wins. A child's draw depends on nothing but key, path
and weight, so a change of weights moves rows only within or between the subtrees whose weights change.

A null key is the key ''. Equal keys go to one shard, whatever their number. An empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets of a shard within which slots are numbered; a bucket is one group of the shuffle.
BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    """One shard with its place in the tree."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def tree_of(shards: int, base: int = 8) -> list[Leaf]:
    """``shards`` shards of weight 1: the first ``base`` by twos in racks, by fours in regions; each further
    one is a region of its own, so growing by one shard moves rows into that shard only."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    old = [Leaf(i, f"r{i // 4}", f"k{i // 2 % 2}") for i in range(min(shards, base))]
    return old + [Leaf(i, f"r{base // 4 + 1 + i - base}", "k0") for i in range(base, shards)]


def levels_of(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level, a parent's path to its children's paths and weights (sums of their leaves)."""
    if len({leaf.shard for leaf in tree}) != len(tree):
        raise ValueError("a shard is named twice")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in tree:
        path = ""
        for level, step in zip(levels, (leaf.region, leaf.rack, str(leaf.shard))):
            child = f"{path}/{step}"
            children = level.setdefault(path, {})
            children[child] = children.get(child, 0.0) + leaf.weight
            path = child
    return levels


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard (int) that ``key`` descends to."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def descend(path: Column, level: dict[str, dict[str, float]]) -> Column:
        choice = None
        for parent, children in level.items():
            drawn = F.array_min(F.array(*[
                F.struct((-F.log((_hash(key, child) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)).alias("d"), F.lit(child).alias("p"))
                for child, weight in children.items() if weight > 0
            ]))["p"]
            choice = F.when(path == parent, drawn) if choice is None else choice.when(path == parent, drawn)
        return choice

    path: Column = F.lit("")
    for level in levels_of(tree):
        path = descend(path, level)
    return F.element_at(F.split(path, "/"), -1).cast("int")


def _hash(key: Column, path: str) -> Column:
    """52 bits of the MD5 of key and path, as a double."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(path)).cast("binary")), 1, 13), 16, 10).cast("double")


def placed(df: DataFrame, tree: list[Leaf], key: str = "doc_id") -> DataFrame:
    """``df`` with its ``shard``."""
    return df.withColumn("shard", shard_of(F.col(key), tree))


def with_slots(df: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df``, which has a shard, with ``slot``: gapless from 0 in each shard, by hash bucket of the key and then
    ``order``. Rows are numbered within their bucket; a bucket's offset comes from the counts of the ones before."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    df = df.withColumn("_bucket", bucket.cast("int"))
    counts = df.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    numbered = df.withColumn("_place", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "_bucket"]).withColumn("slot", F.col("_offset") + F.col("_place")).drop("_bucket", "_offset", "_place")
