"""Helpers of this subpackage: tables in the shared folder, Arrow stages, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from studylake.session import checkpoint_dir

#: Rows that one Arrow stage works on at a time; bounds the memory for outputs of long texts.
ROWS = 256


def settings(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts may be long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and every executor can read it.

    The folder's owner clears it; the tables hold ids, hashes and short features, not texts.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/studylake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(shared: Broadcast, make: Callable):
    """``make(*shared.value)``, kept beside the value for the later tasks of a Python worker that runs several."""
    if not hasattr(shared, "made"):
        shared.made = make(*shared.value)
    return shared.made


def append(
    df: DataFrame,
    new: str | StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[list]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` plus the columns ``new``, computed batch by batch in one narrow stage.

    ``make()`` runs once a task and returns the function from a batch to the new columns. Columns
    of ``df`` named like a new one are replaced; ``drop`` names input columns not carried on.
    """
    fields = new.fields if isinstance(new, StructType) else StructType.fromDDL(new).fields
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    types = [to_arrow_type(f.dataType) for f in fields]
    labels = names + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = [values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind) for values, kind in zip(work(batch), types)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=labels)

    return df.mapInArrow(run, StructType(kept + fields))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps until every part is a star; each step is aggregated before
    its shuffle and written to the shared folder, so a node may touch any share of the edges.
    Nodes without an edge are not listed.
    """

    def smallest(e: DataFrame, node: str, other: str) -> DataFrame:
        return written(e.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("low")))

    def unfinished(e: DataFrame) -> bool:
        """Whether some node is not yet either a smallest one or linked with one smallest node only."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("low")), F.struct(F.col("b").alias("node"), F.lit(0).alias("low"))))
        roles = e.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("low").alias("up"), F.min("low").alias("is_low"))
        return not roles.where("up > 1 OR (up = 1 AND is_low = 0)").isEmpty()

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while unfinished(edges):
        both = edges.union(edges.select("b", "a"))
        low = smallest(both, "a", "b")
        large = both.where("b > a").join(low, both.a == low.node).select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = written(large.where("a <> b").distinct())
        low = smallest(large, "a", "b")
        small = large.join(low, large.a == low.node)
        pairs = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("low").alias("y")), F.struct(F.col("b").alias("x"), F.col("low").alias("y"))))
        small = small.select(pairs.alias("e")).where("e.x <> e.y").select(F.greatest("e.x", "e.y").alias("a"), F.least("e.x", "e.y").alias("b"))
        edges = written(small.distinct())
    star = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return star.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def by_group(df: DataFrame, keys: list[str], new: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of ``df`` dealt and sorted by ``keys``, handed over as many whole groups at a time.

    ``work(table, starts)`` gets a table of whole groups and the row at which each begins, and yields batches of
    the columns ``new``. A group must fit in memory; a partition need not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def starts_of(table: pa.Table) -> np.ndarray:
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for k in keys:
                values = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
                change |= values[1:] != values[:-1]
            return np.concatenate(([0], np.flatnonzero(change) + 1))

        for batch in batches:
            rest.append(batch)
            table = pa.Table.from_batches(rest).combine_chunks()
            starts = starts_of(table)
            last = int(starts[-1])
            if last:  # the last group may go on in the next batch
                yield from work(table.slice(0, last), starts[:-1])
                rest = table.slice(last).to_batches()
        if rest and (table := pa.Table.from_batches(rest).combine_chunks()).num_rows:
            yield from work(table, starts_of(table))

    # As many tasks as a shuffle has, however few bytes they read: the work is in the comparisons.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, new)


def paired_blocks(members: DataFrame, key: list[str], member: str, size: str, block: int) -> DataFrame:
    """``members`` of groups of ``size`` rows, dealt to pairs of blocks of about ``block`` rows.

    Adds i <= j, the block pair, and own, the row's block: any two members of a group meet in one pair of blocks, so
    no task needs a whole group.
    """
    dealt = members.withColumn("_blocks", F.ceil(F.col(size) / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_blocks", "_other", size)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often and wherever ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _prefixes(values: Column, start: Column, step: Callable[[Column, Column], Column], chunk: int) -> Column:
    """For an array of integers, ``start`` and the elements before each combined by ``step`` (array<bigint>); '[]' for an empty one.

    Works in two levels, so an array of n elements costs about n * chunk steps, not n * n.
    """

    def running(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("o"))
        add = lambda acc, x: F.struct(step(acc["s"], x).cast("bigint").alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o"))
        return F.aggregate(values, zero, add, lambda acc: acc["o"])

    def chunked(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / chunk).cast("int") - 1), lambda c: F.slice(a, c * chunk + 1, chunk))
        total = lambda part: F.aggregate(part, start.cast("bigint"), lambda acc, x: step(acc, x).cast("bigint"))
        return bound(parts, lambda p: F.flatten(F.zip_with(p, running(F.transform(p, total), start), running)))

    return bound(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(chunked(a)))


def prefix_sums(lengths: Column, chunk: int = 256) -> Column:
    """The sum of the elements before each."""
    return _prefixes(lengths, F.lit(0), lambda acc, x: acc + x, chunk)


def prefix_maxima(values: Column, chunk: int = 256) -> Column:
    """The largest of 0 and the elements before each."""
    return _prefixes(values, F.lit(0), lambda acc, x: F.greatest(acc, x), chunk)


#: Characters of a segment.
SEGMENT = 256


def segments(text: Column) -> Column:
    """``text`` in one pass as an array of segments, of which ``cut`` takes parts without walking the text again."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text given as ``segments``; empty if there are none."""
    first = F.floor(start / SEGMENT).cast("int")
    some = F.slice(parts, first + 1, F.greatest(F.floor((end - 1) / SEGMENT).cast("int") - first + 1, F.lit(0)))
    inside = F.substr(F.array_join(some, ""), (start - first * SEGMENT + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, inside).otherwise("")
