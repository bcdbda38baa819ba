"""Stored posting table for BM25: per term and segment of documents, the places of the documents that have the term and its counts there.
A row of the segment itself has the ids and lengths of its documents by place.

Documents are indexed where they are read: a segment is up to ``PART_DOCS`` documents of one scan task, ordered by id, and a block ``BLOCK`` of them
that follow each other, as the chunks of a text do. ``search`` adds up what each term can add to a score in a block (query, block), scores the most
promising blocks first, takes the k-th score as a threshold and scores only blocks whose bound reaches it. Results are
those of scoring everything; no text is read, and documents become rows as the k best of their segment only.

Texts are not moved. Postings are, as packs of a segment and bucket when the index is made, and those of the asked terms, by segment, when it is searched.

Null ids and null texts are left out. An id that comes twice is two documents that share it, as in ``bm25_topk``.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.operators.retrieval import RANK_DIGITS, tokens

#: Consecutive documents of a block.
BLOCK = 64
#: Folders of the posting table; a search reads those of its terms. The one after them has the rows of the segments.
BUCKETS = 64
#: Documents of a segment, and words from which it is full; blocks of a segment are numbered within so many numbers.
PART_DOCS = 4096
PART_WORDS = 2_000_000
#: Scan tasks whose postings share the files of a bucket, and tasks that sort and write the postings of one scan task.
TOGETHER = 8
WRITERS = 4
#: (query, document) pairs of a segment that are held at once.
PART_PAIRS = 1_000_000
#: Query words (query, term) that are sent to the tasks; more are searched in blocks of queries.
SENT = 1_000_000
#: Blocks of each query that are scored before the threshold is known.
FIRST = 8
_WORDS = pa.schema([("term", pa.string()), ("places", pa.list_(pa.int16())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
POSTING = "bucket int, term string, segment long, n int, places array<smallint>, tfs array<int>, ids array<bigint>"
_COLUMNS = [c.split()[0] for c in POSTING.split(", ")]


def build(docs: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write the postings of ``docs`` (chunk_id, text) and their statistics to ``path``."""
    spark = docs.sparkSession
    named = docs.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").filter("chunk_id IS NOT NULL AND text IS NOT NULL")
    scans = max(1, named.rdd.getNumPartitions())
    packs = named.select("chunk_id", tokens(F.col("text")).alias("ts")).mapInArrow(_packs, "bucket int, segment long, pack binary")
    # A bucket is written by as many tasks as there are groups of scan tasks, so what a task sorts does not grow and stays in memory.
    group = F.pmod(F.shiftright("segment", 20), F.lit(-(-scans // TOGETHER)))
    dealt = packs.repartition(max(spark.sparkContext.defaultParallelism, WRITERS * scans), "bucket", group)
    rows = dealt.mapInArrow(_unpacked, POSTING).sortWithinPartitions("bucket", "term", "segment")
    stored = os.path.join(path, "postings")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(stored)
    sizes = spark.read.schema(POSTING).parquet(stored).filter(F.col("bucket") == BUCKETS)
    length = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(length).alias("length"))
    totals = totals.select("n", (F.col("length") / F.col("n")).alias("mean"), F.lit(block).alias("block"))
    totals.write.mode("overwrite").parquet(os.path.join(path, "totals"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows (chunk_id, ts) in tables of a segment."""
    held, docs, words = [], 0, 0
    step = min(BLOCK, PART_DOCS)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            n = pc.sum(pc.list_value_length(piece.column("ts"))).as_py() or 0
            if held and (docs + piece.num_rows > PART_DOCS or words + n > PART_WORDS):
                yield pa.Table.from_batches(held)
                held, docs, words = [], 0, 0
            held.append(piece)
            docs, words = docs + piece.num_rows, words + n
    if held:
        yield pa.Table.from_batches(held)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each segment, a pack for each bucket."""
    task = TaskContext.get().partitionId()
    for number, table in enumerate(_segments(batches)):
        segment = (task << 20) + number
        ids = table.column("chunk_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = table.column("ts").combine_chunks()
        dls = pc.list_value_length(lists).to_numpy()
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        coded = lists.flatten().dictionary_encode()
        terms = coded.dictionary
        # Terms by bucket and then in their order; a posting is a number of its term and place.
        bucket = np.array([zlib.crc32(t) % BUCKETS for t in terms.cast(pa.binary()).to_pylist()], np.int64)
        by = np.lexsort((np.argsort(pc.array_sort_indices(terms).to_numpy()), bucket)) if len(terms) else np.zeros(0, np.int64)
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by))
        all_ = np.sort(nth[coded.indices.to_numpy()] * PART_DOCS + np.repeat(place, dls))
        at = np.flatnonzero(np.diff(all_, prepend=-1))
        tfs = np.diff(at, append=len(all_)).astype(np.int32)
        starts = np.searchsorted(all_[at], np.arange(len(by) + 1) * PART_DOCS).astype(np.int32)
        places = pa.ListArray.from_arrays(starts, (all_[at] % PART_DOCS).astype(np.int16))
        rows = pa.table([terms.take(pa.array(by)), places, pa.ListArray.from_arrays(starts, tfs), pa.nulls(len(by), pa.list_(pa.int64()))], schema=_WORDS)
        ends = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
        out = [(i, _pack(rows.slice(a, b - a))) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        own = pa.table([[""], pa.nulls(1, pa.list_(pa.int16())), [dls[order].tolist()], [ids[order].tolist()]], schema=_WORDS)
        out.append((BUCKETS, _pack(own)))
        names, data = zip(*out)
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array([segment] * len(out), pa.int64()), pa.array(data, pa.binary())], ["bucket", "segment", "pack"])


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, segment, pack in zip(batch.column("bucket").to_pylist(), batch.column("segment").to_pylist(), batch.column("pack")):
            for rows in pa.ipc.open_stream(pack.as_buffer()):
                n = rows.num_rows
                count = pc.list_value_length(rows.column("tfs"))
                named = [pa.repeat(pa.scalar(bucket, pa.int32()), n), rows.column("term"), pa.repeat(pa.scalar(segment, pa.int64()), n), count]
                yield pa.record_batch([*named, *(rows.column(c) for c in _COLUMNS[4:])], _COLUMNS)


def search(queries: DataFrame, path: str, k: int = 10, k1: float = 1.5, b: float = 0.75, first: int = FIRST) -> DataFrame:
    """Lexical top-k (query_id, chunk_id, score, rank) of ``queries`` (query_id, text)."""
    spark = queries.sparkSession
    totals = spark.read.schema("n long, mean double, block int").parquet(os.path.join(path, "totals")).first()
    if not totals or not totals["n"]:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank long")
    words = queries.select(F.col("query_id").cast("long"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).filter("query_id IS NOT NULL")
    words = words.distinct().withColumn("bucket", F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int"))
    used = {r["bucket"]: r["n"] for r in words.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    rounds = max(1, -(-sum(used.values()) // SENT))
    part = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    found = [_found(words.filter(part == i) if rounds > 1 else words, list(used), path, totals, k, k1, b, first) for i in range(rounds)]
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def _found(words: DataFrame, used: list[int], path: str, totals: dict, k: int, k1: float, b: float, first: int) -> DataFrame:
    """(query_id, chunk_id, score) among which are the k best of each query of ``words`` (query_id, bucket, term), which are sent to the tasks."""
    spark = words.sparkSession
    key = ["bucket", "term"]
    postings = spark.read.schema(POSTING).parquet(os.path.join(path, "postings")).filter(F.col("bucket").isin([*used, BUCKETS]))
    # The rows of the segments come with those of the terms.
    terms = words.select(*key).distinct().union(spark.range(1).select(F.lit(BUCKETS), F.lit("")))
    asked_rows = postings.join(F.broadcast(terms), key, "left_semi")
    df = asked_rows.groupBy(*key).agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(totals["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = df.join(F.broadcast(words), key, "left").groupBy(*key).agg(F.collect_list(F.struct("query_id", idf.alias("idf"))).alias("asked"))
    kept_at = os.path.join(path, f"asked-{uuid.uuid4().hex}")
    asked.write.parquet(kept_at)
    asked = spark.read.schema("bucket int, term string, asked array<struct<query_id: bigint, idf: double>>").parquet(kept_at)
    parts = max(spark.sparkContext.defaultParallelism, -(-totals["n"] // PART_DOCS))
    dealt = asked_rows.select(*key, "segment", "places", "tfs", "ids").repartition(parts, "segment")
    dealt = dealt.join(F.broadcast(asked), key).select("segment", "places", "tfs", "ids", "asked")

    block, mean = totals["block"], max(totals["mean"], 1e-9)

    def bounds(rows: pa.Table) -> pa.Table:
        return _bounds(_Segment(rows, k1, b, mean), rows.column("segment")[0].as_py(), block)

    blocks = dealt.groupBy("segment").applyInArrow(bounds, "query_id long, block long, bound double")
    # Bounds are kept with their order: what follows asks for them several times.
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    kept_at = os.path.join(path, f"bounds-{uuid.uuid4().hex}")
    blocks.withColumn("nth", F.row_number().over(best)).write.parquet(kept_at)
    blocks = spark.read.schema("query_id long, block long, bound double, nth int").parquet(kept_at)
    start = blocks.filter(F.col("nth") <= first)
    kept = _scored(start, dealt, k, k1, b, mean, block)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kept = kept.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k)
    # The k-th score so far; with fewer documents nothing is ruled out. Bounds are sums in another order: leave room for that.
    floor_ = kept.filter(F.col("_n") == k).select("query_id", F.col("score").alias("_floor"))
    later = blocks.filter(F.col("nth") > first).join(F.broadcast(floor_), "query_id", "left")
    later = later.filter(F.col("_floor").isNull() | (F.col("bound") + 1e-6 >= F.col("_floor")))
    return kept.drop("_n").unionByName(_scored(later, dealt, k, k1, b, mean, block))


def _scored(blocks: DataFrame, postings: DataFrame, k: int, k1: float, b: float, mean: float, block: int) -> DataFrame:
    """(query_id, chunk_id, score) of the k best documents of each query in each segment, among the blocks of the (query, block) rows."""
    wanted = blocks.groupBy("block").agg(F.collect_list("query_id").alias("queries")).withColumn("segment", F.expr(f"block div {PART_DOCS}"))

    def hits(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return _hits(_Segment(rows, k1, b, mean) if rows.num_rows and wanted.num_rows else None, wanted, k, block)

    return postings.groupBy("segment").cogroup(wanted.groupBy("segment")).applyInArrow(hits, "query_id long, chunk_id long, score double")


class _Segment:
    """The asked postings of a segment: of each (row = term) where it starts, of each posting its place and gain, of each (row, query) the idf."""

    def __init__(self, rows: pa.Table, k1: float, b: float, mean: float):
        own = rows.filter(pc.is_valid(rows.column("ids")))
        self.ids, dls = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "tfs"))
        rows = rows.filter(pc.is_null(rows.column("ids"))).combine_chunks()
        flat = {c: pa.concat_arrays(x.chunks) if (x := rows.column(c)).num_chunks else pa.array([], x.type) for c in ("places", "tfs", "asked")}
        sizes = {c: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for c, x in flat.items()}
        self.starts = np.concatenate([[0], np.cumsum(sizes["places"])])
        self.places = flat["places"].flatten().to_numpy().astype(np.int64)
        tfs = flat["tfs"].flatten().to_numpy()
        self.gains = tfs / (tfs + k1 * (1 - b + b * dls[self.places] / mean))
        asked = flat["asked"].flatten()
        query, self.idf = (asked.field(c).to_numpy() for c in ("query_id", "idf"))
        self.queries, self.who = np.unique(query, return_inverse=True)
        self.row = np.repeat(np.arange(len(rows)), sizes["asked"])

    def sums(self, starts: np.ndarray, at: np.ndarray, gains: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of some queries at once, from one number on: their sums of idf x gain, by query and what ``at`` says."""
        size = max(1, PART_PAIRS // width)
        for low in range(0, len(self.queries), size):
            mine = np.flatnonzero((self.who >= low) & (self.who < low + size))
            total = np.zeros((min(size, len(self.queries) - low), width))
            cut = np.flatnonzero(np.diff(self.row[mine], prepend=-1))
            for s, e in zip(cut, np.append(cut[1:], len(mine))):
                x = slice(starts[self.row[mine[s]]], starts[self.row[mine[s]] + 1])
                if e == s + 1:
                    total[self.who[mine[s]] - low, at[x]] += self.idf[mine[s]] * gains[x]
                else:
                    total[np.ix_(self.who[mine[s:e]] - low, at[x])] += np.outer(self.idf[mine[s:e]], gains[x])
            yield low, total


def _bounds(own: _Segment, segment: int, block: int) -> pa.Table:
    """What the documents of each block can reach at most: a term adds its largest gain there."""
    width = -(-len(own.ids) // block)
    row = np.repeat(np.arange(len(own.starts) - 1), np.diff(own.starts))
    cell = row * width + own.places // block
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    most = np.maximum.reduceat(own.gains, at) if len(at) else own.gains
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low, total in own.sums(np.searchsorted(row[at], np.arange(len(own.starts))), cell[at] % width, most, width):
        who, where = np.nonzero(total)
        out.append((own.queries[low + who], segment * PART_DOCS + where, total[who, where]))
    return pa.table([np.concatenate(x) for x in zip(*out)], ["query_id", "block", "bound"])


def _hits(own: _Segment | None, wanted: pa.Table, k: int, block: int) -> pa.Table:
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if own is not None:
        # By query and block: whether it is wanted. Postings of other blocks are left out.
        lists = wanted.column("queries").combine_chunks()
        asks = np.zeros((len(own.queries), -(-len(own.ids) // block)), bool)
        where = np.repeat(wanted.column("block").to_numpy() % PART_DOCS, pc.list_value_length(lists).to_numpy())
        asks[np.searchsorted(own.queries, lists.flatten().to_numpy()), where] = True
        use = asks.any(0)[own.places // block]
        starts = np.concatenate([[0], np.cumsum(use)])[own.starts]
        of = np.arange(len(own.ids)) // block
        for low, total in own.sums(starts, own.places[use], own.gains[use], len(own.ids)):
            for i, scores in enumerate(total):
                near = np.flatnonzero((scores > 0) & asks[low + i][of])
                score = np.round(scores[near], RANK_DIGITS)
                if len(near) > k:
                    top = score >= np.partition(score, len(near) - k)[len(near) - k]
                    near, score = near[top], score[top]
                order = np.lexsort((own.ids[near], -score))[:k]
                out.append((np.full(len(order), own.queries[low + i]), own.ids[near[order]], score[order]))
    return pa.table([np.concatenate(x) for x in zip(*out)], ["query_id", "chunk_id", "score"])
