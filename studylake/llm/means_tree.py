"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of at most ``SAMPLE`` distinct vectors (and ``SAMPLE_BYTES``), chosen by hash; every distinct vector
is then put into the leaf it descends to. A query keeps the branches it has passed in a priority queue by distance to their centres and
visits leaf after leaf, the nearest open branch first. How many leaves is calibrated: ``CALIBRATION`` queries, compared exactly with all
vectors, widen the visits until ``TARGET`` of their true neighbours are in visited leaves. All rows of visited leaves are compared.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without id take no part. A row is an id and a vector:
repeated rows are one; a query is compared with every row but itself, so rows of the same id with another vector are candidates.
Only vectors of equal dimension are compared; dimensions the sample lacks have one leaf. Distances are Euclidean in double
precision on the original vectors, ties go to the smaller id. With fewer candidates than asked for, all are returned. Empty
tables give an empty result. Other columns are not read.

Identical vectors are one entry with its ``k + 1`` smallest ids, as no others can be among the nearest; identical queries are
searched once. Leaves are packed into groups of about ``BLOCK`` rows, larger ones are cut into blocks and many queries of a
group into parts, so no task holds more than a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from studylake.llm.common import append, written

SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
BRANCH, LEAF, ROUNDS, DEPTH = 16, 64, 8, 24
CALIBRATION, TARGET = 128, 0.96
#: Rows of a block, and queries of a part, that meet in one task.
BLOCK, PART = 4096, 8192
#: Components are cut to this for the tree, so that squares stay finite; distances are those of the vectors themselves.
_LARGE = 1e150


class Tree:
    """Centres of the nodes, the children of each node (none: a leaf), and the leaves' numbers in depth-first order."""

    def __init__(self, rows: np.ndarray) -> None:
        rows, random = np.clip(rows, -_LARGE, _LARGE), np.random.default_rng(0)
        self.centres: list[np.ndarray] = [np.zeros(rows.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf: dict[int, int] = {}
        todo = [(0, np.arange(len(rows)), 0)]
        while todo:
            node, members, depth = todo.pop()
            parts = _split(rows[members], random) if len(members) > LEAF and depth < DEPTH else []
            if not parts:
                self.leaf[node] = len(self.leaf)
            for centre, part in parts:
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.children.append([])
            todo += [(child, members[part], depth + 1) for child, (_, part) in zip(self.children[node][::-1], parts[::-1])]
        self.blocks = {n: np.array([self.centres[c] for c in cs]) for n, cs in enumerate(self.children) if cs}

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        rows, out = np.clip(rows, -_LARGE, _LARGE), np.empty(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            if node in self.leaf:
                out[members] = self.leaf[node]
                continue
            to = _nearest(rows[members], self.blocks[node])
            todo += [(child, members[to == i]) for i, child in enumerate(self.children[node]) if (to == i).any()]
        return out

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """The leaves in the order in which ``query`` visits them."""
        query, queue = np.clip(query, -_LARGE, _LARGE), [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while node not in self.leaf:
                away = self.blocks[node] - query
                near = sorted(zip(np.einsum("ij,ij->i", away, away).tolist(), self.children[node]))
                node = near[0][1]
                for branch in near[1:]:
                    heapq.heappush(queue, branch)
            yield self.leaf[node]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (rows @ centres.T), axis=1)


def _split(rows: np.ndarray, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, members) of the clusters of ``rows``; none if they do not come apart."""
    centres = rows[random.choice(len(rows), min(BRANCH, -(-len(rows) // LEAF)), replace=False)]
    for _ in range(ROUNDS):
        to = _nearest(rows, centres)
        used = np.unique(to)
        centres = np.array([rows[to == i].mean(axis=0) for i in used])
    to = _nearest(rows, centres)
    parts = [(centres[i], np.flatnonzero(to == i)) for i in np.unique(to)]
    return parts if len(parts) > 1 else []


def _matrix(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1)


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    away = rows - query
    with np.errstate(over="ignore"):
        out = np.sqrt(np.einsum("ij,ij->i", away, away))
    for i in np.flatnonzero(~np.isfinite(out)):
        most = np.abs(away[i] / 2).max()
        out[i] = 2 * most * np.sqrt(((away[i] / 2 / most) ** 2).sum())
    return out


def _smallest(scores: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The ``k`` first (score, id) of entries that hold lists of ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        near = np.arange(len(scores))
    return sorted((float(scores[i]), v) for i in near.tolist() for v in ids[i])[:k]


def rows_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, size, raw, digest) of the valid vectors of ``df``."""
    df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            raws = []
            for v in batch.column("vector").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], "<f8")
                raws.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            return [[r and len(r) // 8 for r in raws], raws, [r and xxhash.xxh3_128_digest(r) for r in raws]]

        return work

    rows = append(df.where("id IS NOT NULL AND vector IS NOT NULL"), "size int, raw binary, digest binary", make, drop=("vector",))
    return rows.where("raw IS NOT NULL")


def _entries(rows: DataFrame, k: int | None = None) -> DataFrame:
    """One row (digest, size, raw, ids) for each distinct vector, with its ``k`` smallest ids if a number is given."""
    vectors = rows.groupBy("digest").agg(F.first("size").alias("size"), F.first("raw").alias("raw"))
    if k is None:
        return vectors
    ids = rows.select("digest", "id").distinct()
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("_n") <= k)
    return vectors.join(ids.groupBy("digest").agg(F.collect_list("id").alias("ids")), "digest")


@dataclass
class Leaves:
    """Trees by dimension, how many ids each leaf (dimension, number) holds, its group, and the blocks of each group."""

    trees: dict[int, Tree]
    ids: dict[tuple[int, int], int]
    group: dict[tuple[int, int], int]
    blocks: list[int]

    def visited(self, raw: bytes, least: int, ids: int) -> list[int]:
        """The first ``least`` leaves with rows that a query visits, more until they hold ``ids`` ids."""
        size, seen, out = len(raw) // 8, 0, []
        for leaf in self.trees[size].best_first(np.frombuffer(raw, "<f8")) if size in self.trees else [0]:
            if here := self.ids.get((size, leaf), 0):
                out.append(leaf)
                seen += here
            if len(out) >= least and seen >= ids:
                break
        return out


def fit(entries: DataFrame) -> dict[int, Tree]:
    """A tree for each dimension in the sample."""
    widest = entries.agg(F.max("size")).first()[0] or 1
    sample = entries.orderBy(F.xxhash64("digest")).select("raw").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * widest)))).collect()
    raws: dict[int, list[bytes]] = {}
    for row in sample:
        raws.setdefault(len(row["raw"]) // 8, []).append(bytes(row["raw"]))
    return {size: Tree(_matrix(of)) for size, of in raws.items()}


def indexed(rows: DataFrame, k: int) -> tuple[DataFrame, Leaves]:
    """Every distinct vector of ``rows`` (digest, size, raw, ids) in a leaf, as a written table, and the leaves."""
    entries = written(_entries(rows, k + 1))
    trees = fit(entries)
    shared = entries.sparkSession.sparkContext.broadcast(trees)

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            raws = batch.column("raw").to_pylist()
            sizes, out = np.array([len(r) // 8 for r in raws]), np.zeros(len(raws), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size in shared.value:
                    out[at] = shared.value[size].leaves_of(_matrix([raws[i] for i in at]))
            return [out]

        return work

    entries = written(append(entries, "leaf int", make))
    # A row for each leaf of the trees, and for each dimension without one.
    found = entries.groupBy("size", "leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    group: dict[tuple[int, int], int] = {}
    blocks: list[int] = []
    room, last = 0, None
    for r in sorted(found, key=lambda r: (r["size"], r["leaf"])):
        if r["size"] != last or r["n"] > room:
            blocks.append(-(-r["n"] // BLOCK))
            room, last = BLOCK, r["size"]
        room -= r["n"]
        group[r["size"], r["leaf"]] = len(blocks) - 1
    return entries, Leaves(trees, {(r["size"], r["leaf"]): r["ids"] for r in found}, group, blocks)


def calibrated(entries: DataFrame, leaves: Leaves, queries: DataFrame, k: int, target: float = TARGET) -> tuple[int, float]:
    """How many leaves to visit, and which share of the true neighbours of ``CALIBRATION`` queries is in these."""
    asked = [bytes(r["raw"]) for r in queries.orderBy(F.xxhash64("digest", F.lit(1))).select("raw").limit(CALIBRATION).collect()]
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in shared.value]
        for batch in batches:
            raws, of_leaf, sizes = (batch.column(c).to_pylist() for c in ("raw", "leaf", "size"))
            for size in set(sizes):
                at = [i for i, s in enumerate(sizes) if s == size]
                rows = _matrix([raws[i] for i in at])
                for q, raw in enumerate(shared.value):
                    if len(raw) == 8 * size:
                        scores = _distances(rows, np.frombuffer(raw, "<f8"))
                        cut = np.argpartition(scores, k)[: k + 1].tolist() if len(scores) > k + 1 else range(len(scores))
                        # The query's own vector is no neighbour to look for: it is in the first leaf.
                        best[q] = sorted(best[q] + [(float(scores[i]), of_leaf[at[i]], size) for i in cut if raws[at[i]] != raw])[:k]
        flat = [(q, *b) for q, of in enumerate(best) for b in of]
        columns = list(zip(*flat)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int32(), pa.int32()))], names=["q", "score", "leaf", "size"]
        )

    near = entries.select("raw", "leaf", "size").mapInArrow(nearest, "q int, score double, leaf int, size int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score"))
    true = near.withColumn("_n", place).where(F.col("_n") <= k).select("q", "leaf").collect()
    everywhere = len(leaves.ids) + 1
    order = [{leaf: n for n, leaf in enumerate(leaves.visited(raw, everywhere, k + 1), 1)} for raw in asked]
    needed = sorted(order[r["q"]][r["leaf"]] for r in true)
    visits, recall = 1, 1.0
    while needed and (recall := sum(n <= visits for n in needed) / len(needed)) < target:
        visits = next(n for n in needed if n > visits)
    return visits, recall


_MEETING = "size int, grp int, part int, block int, kind int, raw binary, leaves array<int>, ids array<bigint>, digest binary"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries`` among the rows of ``vectors``."""
    entries, leaves = indexed(rows_of(vectors, key, vector), k)
    asking = written(rows_of(queries, key, vector).distinct())
    asked = written(_entries(asking))
    visits, _ = calibrated(entries, leaves, asked, k, target)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(leaves)

    def visiting():
        known = shared.value

        def work(batch: pa.RecordBatch) -> list[list]:
            out = []
            for raw in batch.column("raw").to_pylist():
                groups: dict[int, list[int]] = {}
                for leaf in known.visited(raw, visits, k + 1):
                    groups.setdefault(known.group[len(raw) // 8, leaf], []).append(leaf)
                out.append([{"grp": g, "leaves": leaves} for g, leaves in groups.items()])
            return [out]

        return work

    met = append(asked, "met array<struct<grp: int, leaves: array<int>>>", visiting)
    met = written(met.select("digest", "size", "raw", F.explode("met").alias("m")).select("digest", "size", "raw", "m.grp", "m.leaves"))
    parts = {r["grp"]: -(-r["count"] // PART) for r in met.groupBy("grp").count().collect()}
    shared_parts = spark.sparkContext.broadcast(parts)

    def placing(kind: int):
        """Blocks and parts of a row: an index row is in one block and in all parts of its group, a query the other way round."""

        def make():
            known, parts = shared.value, shared_parts.value

            def work(batch: pa.RecordBatch) -> list[list]:
                groups = batch.column("grp").to_pylist() if kind else [known.group[s, n] for s, n in zip(*(batch.column(c).to_pylist() for c in ("size", "leaf")))]
                places = []
                for g, digest in zip(groups, batch.column("digest").to_pylist()):
                    at, n_blocks, n_parts = xxhash.xxh3_64_intdigest(digest), known.blocks[g], parts.get(g, 0)
                    pairs = [(at % n_parts, b) for b in range(n_blocks)] if kind else [(p, at % n_blocks) for p in range(n_parts)]
                    places.append([{"part": p, "block": b} for p, b in pairs])
                return [groups, places]

            return work

        return make

    place = "grp int, places array<struct<part: int, block: int>>"
    rows = append(entries, place, placing(0)).select("*", F.explode("places").alias("p"))
    rows = rows.select("size", "grp", "p.part", "p.block", F.lit(0).alias("kind"), "raw", F.array("leaf").alias("leaves"), "ids", F.lit(None).cast("binary").alias("digest"))
    asks = append(met, place, placing(1)).select("*", F.explode("places").alias("p"))
    asks = asks.select("size", "grp", "p.part", "p.block", F.lit(1).alias("kind"), "raw", "leaves", F.lit(None).cast("array<bigint>").alias("ids"), "digest")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each (grp, part, block), sorted: first the rows of the block, then the queries, one after another."""
        at, raws, in_leaf, ids, block = None, [], [], [], None
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "part", "block", "kind", "raw", "leaves", "ids", "digest")]
            for grp, part, number, kind, raw, of, row_ids, digest in zip(*columns):
                if (grp, part, number) != at:
                    at, raws, in_leaf, ids, block = (grp, part, number), [], [], [], None
                if kind == 0:
                    raws.append(raw)
                    in_leaf.append(of[0])
                    ids.append(row_ids)
                elif raws:
                    if block is None:
                        block, in_leaf = _matrix(raws), np.array(in_leaf)
                    here = np.flatnonzero(np.isin(in_leaf, of))
                    if len(here):
                        near = _smallest(_distances(block[here], np.frombuffer(raw, "<f8")), [ids[i] for i in here.tolist()], k + 1)
                        found += [(digest, v, s) for s, v in near]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.float64()))], names=["digest", "vec_id", "score"]
                )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met_rows = rows.unionByName(asks).select(*StructType.fromDDL(_MEETING).names).repartition(tasks, "grp", "part", "block")
    found = met_rows.sortWithinPartitions("grp", "part", "block", "kind").mapInArrow(compare, "digest binary, vec_id long, score double")
    best = Window.partitionBy("digest").orderBy("score", "vec_id")
    # One more than asked for, as the query itself may be among them.
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    found = asking.select(F.col("id").alias("query_id"), "digest").join(found, "digest").where(~own)
    rank = F.row_number().over(Window.partitionBy("query_id", "digest").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
