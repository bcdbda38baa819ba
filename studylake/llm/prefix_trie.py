"""Conversation prefix trie: a z-fast trie whose compacted nodes stand in one table, hashed at two-fattest depth handles.

A conversation is a sequence of turns. The key of a prefix is a 128-bit sum of one hash for each (depth, role, text), so keys come
from running sums and the key at any depth of a conversation is one row. A compacted node is a prefix where conversations end or part;
its edge holds the depths after its parent (``low``) down to its own (``high``). It is filed under the key at its handle: of these depths the one
divisible by the largest power of two. Conversations are inserted in batches. A fat binary search looks up one handle a round, all
conversations of the batch at once, and so finds in about log2(length) rounds the node at which each leaves the trie; its edge is cut
there and what is left of the batch is hung on. In the end the edges are expanded to one row for each depth.

Null role and text are empty; turns are ordered by turn (null first), then by a digest of role and text. Rows without conv_id belong to
no conversation. Repeated rows are turns of their own. An empty table gives an empty result. Other columns are not read.
Two prefixes share a key by chance with probability 2e-38 a pair.

A conversation of any length and a prefix of any number of conversations are many rows, summed within tasks before they
are shuffled; equal conversations are one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from studylake.llm.common import written

#: Key of the root.
ROOT = bytes(16)
BATCHES = 2
#: Rounds of a search between two written tables.
ROUNDS = 3
#: Conversations whose ids are hashed as one piece, and depths of an edge expanded as one piece.
PIECE = 1 << 14


def running(df: DataFrame, key: str, order: list[Column], lanes: int) -> DataFrame:
    """``df`` (written) with ``total`` and ``before`` in place of ``part`` of its rows: sums of the big-endian 64-bit numbers in column ``lanes``,
    modulo 2**64, over the rows of a ``key`` up to and before each row.

    Rows are sorted by ranges, so a key may go over any number of tasks; each task sums up its own rows, and what the last key of a
    task has summed up, one row a task, is carried to the tasks after it.
    """
    kept = [f for f in df.schema.fields if f.name != "lanes"]
    names = [f.name for f in kept]
    local = StructType([*kept, StructField("lanes", BinaryType()), StructField("total", BinaryType()), StructField("part", IntegerType()), StructField("last", BooleanType())])

    def numbers(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, lanes).astype(np.uint64)

    def packed(rows: np.ndarray) -> list[bytes]:
        raw, width = rows.astype(">u8").tobytes(), 8 * lanes
        return [raw[i : i + width] for i in range(0, len(raw), width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), to_arrow_schema(local)
        current, carried, held = None, np.zeros(lanes, np.uint64), None

        def made(batch: pa.RecordBatch, totals: list[bytes], end: bool) -> pa.RecordBatch:
            last = [False] * (len(totals) - end) + [True] * end
            columns = [*(batch.column(n) for n in [*names, "lanes"]), pa.array(totals), pa.array([part] * len(totals), pa.int32()), pa.array(last)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield made(*held, False)
            keys, each = batch.column(key).to_numpy(zero_copy_only=False), numbers(batch.column("lanes"))
            total = np.cumsum(each, axis=0, dtype=np.uint64)
            starts = np.flatnonzero(np.concatenate(([keys[0] != current], keys[1:] != keys[:-1])))
            # What to take off: the sum before the row's key began here; the first key may go on from the batch before.
            off = np.concatenate((np.zeros((1, lanes), np.uint64) - carried, total[starts] - each[starts]))
            total -= off[np.searchsorted(starts, np.arange(len(keys)), side="right")]
            current, carried = keys[-1], total[-1]
            held = batch, packed(total)
        if held:
            yield made(*held, True)

    table = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(sums, local))
    carry: dict[int, tuple] = {}
    current, carried = None, np.zeros(lanes, np.uint64)
    for row in sorted(table.where("last").select("part", F.col(key).alias("key"), "total").collect()):
        carry[row["part"]] = current, carried
        total = np.frombuffer(bytes(row["total"]), ">u8").astype(np.uint64)
        current, carried = row["key"], carried + total if row["key"] == current else total
    shared = df.sparkSession.sparkContext.broadcast(carry)
    done = StructType([*kept, StructField("total", BinaryType()), StructField("before", BinaryType())])

    def carried_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(done)
        for batch in batches:
            keys, parts = batch.column(key).to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
            total, each = numbers(batch.column("total")), numbers(batch.column("lanes"))
            for part in np.unique(parts).tolist():
                current, more = shared.value[part]
                total[(parts == part) & (keys == current)] += more
            columns = [*(batch.column(n) for n in names), pa.array(packed(total)), pa.array(packed(total - each))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return table.drop("last").mapInArrow(carried_on, done)


def _number(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, digest, size) of the turns (conv_id, turn, role, text): place from 1, digest of role and text, bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"), F.unhex(F.lit("0000000000000001")).alias("lanes"),
    )
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], 1).select("conv_id", _number(F.col("total")).alias("place"), "digest", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """The prefixes (conv_id, n, depth, size, key, prev, through) of conversations, given as (conv_id, n, depth, digest, size) with their length ``n``.

    ``prev`` is the key of the prefix before, ``through`` counts the bytes of all texts up to ``depth``.
    """
    lanes = F.unhex(F.concat(F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest")), F.lpad(F.hex("size"), 16, "0")))
    sums = running(turns.withColumn("lanes", lanes).drop("digest"), "conv_id", [F.col("depth")], 3)
    key = lambda total: F.substring(total, 1, 16)
    return sums.select("conv_id", "n", "depth", "size", key("total").alias("key"), key("before").alias("prev"), _number(F.substring("total", 17, 8)).alias("through"))


def fattest(low: Column, high: Column) -> Column:
    """The depth in (low, high] that the largest power of two divides."""
    bits = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


class Paths:
    """The prefixes of distinct conversations, dealt once by (seq, depth), so that reading keys by depth moves the questions only."""

    def __init__(self, table: DataFrame, sequences: DataFrame) -> None:
        rows = table.join(sequences.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "seq")
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = rows.repartition(tasks, "seq", "depth").persist(StorageLevel.DISK_ONLY)

    def read(self, df: DataFrame, seq: str, depth: Column, **named: str) -> DataFrame:
        """``df`` with columns of the prefix at ``depth`` of sequence ``seq`` under new names; null where there is none."""
        there = self.rows.select(F.col("seq").alias("_seq"), F.col("depth").alias("_depth"), *(F.col(c).alias(new) for new, c in named.items()))
        # Rows that ask nothing ask for depths below zero, so that they do not meet in one task.
        nowhere, asks = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)), F.col(seq).isNotNull() & depth.isNotNull()
        asked = df.withColumns({"_of": F.when(asks, F.col(seq)).otherwise(nowhere), "_at": F.when(asks, depth).otherwise(nowhere)})
        return asked.join(there, (F.col("_of") == F.col("_seq")) & (F.col("_at") == F.col("_depth")), "left").drop("_seq", "_depth", "_of", "_at")


NODE = "key binary, low long, high long, rep long, first binary, parent binary, handle binary"


def _filed(nodes: DataFrame, paths: Paths) -> DataFrame:
    """Nodes (key, low, high, rep) with the first key of the edge, the parent's key and the key at the handle."""
    nodes = paths.read(nodes, "rep", F.col("low") + 1, first="key", parent="prev")
    return paths.read(nodes, "rep", fattest(F.col("low"), F.col("high")), handle="key").select(*StructType.fromDDL(NODE).names)


def exits(nodes: DataFrame, batch: DataFrame, paths: Paths) -> DataFrame:
    """Where each sequence (seq, n) of ``batch`` leaves the trie: ``match``, how far it follows, and the node on whose edge it leaves, if it does so within one."""
    longest = batch.agg(F.max("n")).first()[0] or 0
    found = nodes.select(F.col("handle").alias("_handle"), *(F.col(c).alias(f"_{c}") for c in ("key", "low", "high", "rep")))
    at = batch.select("seq", "n").withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("n"), "x_key": F.lit(ROOT), "x_low": F.lit(0).cast("long"), "x_high": F.lit(0).cast("long"), "x_rep": F.lit(None).cast("long")})
    open_ = F.col("lo") < F.col("hi")
    for turn in range(int(longest).bit_length() + 1):
        f = F.when(open_, fattest(F.col("lo"), F.col("hi")))
        asked = paths.read(at, "seq", f, asked="key").withColumn("_f", f).join(found, F.col("asked") == F.col("_handle"), "left")
        hit = F.col("_handle").isNotNull()
        # A handle that is there leads to the end of its node; whether the conversation follows so far is seen afterwards.
        at = asked.select(
            "seq", "n", F.when(hit, F.col("_high")).otherwise(F.col("lo")).alias("lo"), F.when(open_ & ~hit, F.col("_f") - 1).otherwise(F.col("hi")).alias("hi"),
            *(F.when(hit, F.col(f"_{c}")).otherwise(F.col(f"x_{c}")).alias(f"x_{c}") for c in ("key", "low", "high", "rep")),
        )
        if turn % ROUNDS == ROUNDS - 1:
            at = written(at)
    # Followed to the node's end, the conversation goes on with the edge of a child, or with none.
    at = paths.read(at, "seq", F.col("x_high"), _end="key")
    whole = (F.col("x_high") == 0) | (F.coalesce(F.col("_end"), F.lit(b"")) == F.col("x_key"))
    at = paths.read(at.withColumn("whole", whole), "seq", F.col("x_high") + 1, _next="key")
    child = nodes.select(F.col("first").alias("_first"), *(F.col(c).alias(f"c_{c}") for c in ("key", "low", "high", "rep")))
    at = at.join(child, F.col("whole") & (F.col("_next") == F.col("_first")), "left")
    edge = {c: F.when(F.col("whole"), F.col(f"c_{c}")).otherwise(F.col(f"x_{c}")).alias(c) for c in ("key", "low", "high", "rep")}
    start = F.when(F.col("_first").isNotNull(), F.col("x_high") + 1).when(F.col("whole"), F.col("x_high")).otherwise(F.col("x_low") + 1)
    at = written(at.select("seq", "n", start.alias("match"), *edge.values()))
    at = at.withColumn("hi", F.when(F.col("rep").isNull(), F.col("match")).otherwise(F.least("n", "high")))
    for turn in range(int(longest).bit_length()):
        middle = F.when(F.col("match") < F.col("hi"), F.floor((F.col("match") + F.col("hi") + 1) / 2).cast("long"))
        both = paths.read(paths.read(at, "seq", middle, _mine="key"), "rep", middle, _theirs="key").withColumn("_m", middle)
        same = F.col("_mine") == F.col("_theirs")
        at = both.select(
            "seq", "n", F.when(same, F.col("_m")).otherwise(F.col("match")).alias("match"), F.when(same | F.col("_m").isNull(), F.col("hi")).otherwise(F.col("_m") - 1).alias("hi"),
            "key", "low", "high", "rep",
        )
        if turn % ROUNDS == ROUNDS - 1:
            at = written(at)
    return written(at.drop("hi"))


def insert(nodes: DataFrame | None, batch: DataFrame, paths: Paths) -> DataFrame:
    """The nodes after the sequences (seq, n) of ``batch`` are inserted."""
    if nodes is None:
        left = batch.select("seq", "n", F.lit(0).cast("long").alias("match"))
        cut = None
    else:
        left = exits(nodes, batch, paths)
        cut = left.where((F.col("match") > F.col("low")) & (F.col("match") < F.col("high"))).select("key", "low", "high", "rep", "match").distinct()
    # What is left of the conversations: prefixes that end or part are nodes.
    rest = paths.rows.join(left.select("seq", "match"), "seq").where(F.col("depth") > F.col("match")).select("seq", "depth", "key", "prev", "n", "match")
    ends = rest.where(F.col("depth") == F.col("n")).select("key")
    steps = rest.where(F.col("depth") > F.col("match") + 1).select("prev", "key").distinct()
    parting = steps.groupBy("prev").count().where("count > 1").select(F.col("prev").alias("key"))
    explicit = rest.join(ends.union(parting).distinct(), "key", "left_semi")
    low = F.coalesce(F.lag("depth").over(Window.partitionBy("seq").orderBy("depth")), F.col("match"))
    new = explicit.withColumn("low", low).groupBy("key").agg(F.max("low").alias("low"), F.max("depth").alias("high"), F.min("seq").alias("rep"))
    if cut is None:
        return written(_filed(new, paths))
    before = F.coalesce(F.lag("match").over(Window.partitionBy("key").orderBy("match")), F.col("low"))
    upper = paths.read(cut.select("rep", before.alias("low"), F.col("match").alias("high")), "rep", F.col("high"), key="key")
    lower = cut.groupBy("key").agg(F.max("match").alias("low"), F.first("high").alias("high"), F.first("rep").alias("rep"))
    changed = new.unionByName(upper).unionByName(lower)
    return written(nodes.join(lower.select("key"), "key", "left_anti").unionByName(_filed(changed, paths)))


def _digests(ends: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256) of (key, conv_id): ids in order, comma-joined, hashed piece by piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), list(map(str, batch.column("conv_id").to_pylist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            rows = [(keys[i], part, nth + n, ",".join(ids[i:j])) for n, (i, j) in enumerate(zip(starts, [*starts[1:], len(keys)]))]
            nth += len(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64(), pa.string()))], names=["key", "part", "nth", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if key == current:
                    digest.update(b"," + piece.encode())
                    continue
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = key, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["key", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    ids = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, part int, nth long, piece string")
    return ids.repartition("key").sortWithinPartitions("key", "part", "nth").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, without: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each distinct prefix of the conversations (conv_id, n, depth, digest, size), and the root; ``without``: ids of conversations without turns.

    conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves, childless nodes in the subtree; saved_tokens, over the
    subtree the bytes of the last text for each member but one; ends_sha256, of the ids of the members that end there.
    """
    root, long = F.lit(ROOT), lambda v: F.lit(v).cast("long")
    table = written(prefixes(turns))
    ends = table.where(F.col("depth") == F.col("n")).select("conv_id", "key", "n", "through")
    ends = ends.unionByName(without.select("conv_id", root.alias("key"), long(0).alias("n"), long(0).alias("through")))
    sequences = written(ends.groupBy("key").agg(F.min("conv_id").alias("seq"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("through").alias("total")))
    paths = Paths(table, sequences)
    nodes = None
    for i in range(batches):
        batch = sequences.where((F.col("n") > 0) & (F.pmod(F.xxhash64("key"), F.lit(batches)) == i)).select("seq", "n")
        nodes = insert(nodes, batch, paths)

    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    known = sequences.join(children, "key", "left").select("seq", "copies", "total", F.col("n_children").isNull().cast("long").alias("leaf"))
    # The nodes that each sequence passes.
    passed = written(paths.rows.select("seq", "key", "through").join(nodes.select("key"), "key", "left_semi").join(known, "seq"))
    members = [F.sum("copies").alias("n_convs"), F.min("seq").alias("conv_id"), F.sum("leaf").alias("n_leaves")]
    stats = written(passed.groupBy("key").agg(*members))
    # A sequence has in common with smaller ids what leads to the last node that is not first its own; copies have all in common.
    common = passed.join(stats.select("key", "conv_id"), "key").where(F.col("conv_id") < F.col("seq")).groupBy("seq").agg(F.max("through").alias("common"))
    common = written(known.join(common, "seq", "left").withColumn("common", F.coalesce("common", long(0))))
    saved = (F.sum((F.col("copies") - 1) * F.col("total") + F.col("common"))).alias("saved")
    weights = passed.select("seq", "key").join(common, "seq").groupBy("key").agg(saved)
    first = common.select(F.col("seq").alias("conv_id"), F.col("common").alias("own"))
    top = common.agg(*members, saved).where("n_convs > 0").withColumns({"key": root, "own": long(0)})
    stats = written(stats.join(weights, "key").join(first, "conv_id").unionByName(top).withColumn("saved", F.col("saved") - F.col("own")).drop("own"))
    stats = written(stats.join(children, "key", "left").join(_digests(ends.select("key", "conv_id")), "key", "left"))

    # Edges to depths, piece by piece.
    above = stats.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    edges = nodes.select("key", "low", "high", "rep", "parent").join(stats, "key").join(above, "parent")
    pieces = F.explode(F.sequence(F.col("low") + 1, F.col("high"), long(PIECE)))
    edges = edges.withColumn("_from", pieces).withColumn("depth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + PIECE - 1, F.col("high")))))
    rows = paths.read(edges, "rep", F.col("depth"), through="through", size="size")
    last = F.col("depth") == F.col("high")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("low") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("n_children", long(0))).otherwise(long(1)).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("through") - F.col("size"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
    roots = stats.where(F.col("key") == root).select(
        "conv_id", long(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", long(0)).alias("n_children"),
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return rows.unionByName(roots)
