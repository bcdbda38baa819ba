"""Stored inverted file of vectors: every vector in the cell of its nearest centroid, cells as partitions of a table.

``build`` fits the centroids on a bounded sample, writes the vectors partitioned by cell and, beside them, a table of cells
(centroid, rows, radius) and the number of cells that reaches the wanted recall on sample queries. ``search`` sends each query to
its nearest cells: only these are scanned, and queries meet vectors by cell, in blocks, so neither side is held whole. ``nearest``
is exact: the k-th distance found in the first cells rules out every cell that lies farther than its radius.

Vectors that are null, or hold null or non-finite components, are not stored and not searched for; neither are those of another
dimension than most have (on a tie, the larger). Null ids are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the sample that centroids and the number of probes are fitted on.
SAMPLE = 20_000
#: Most cells; their centroids are sent to the tasks.
MAX_CELLS = 4096
#: Rows of a cell, and queries of a cell, that meet in one task.
BLOCK = 4096
ROUNDS = 8
#: Digits that decide rank; equal distances are ordered by id.
RANK_DIGITS = 9
_HIT = "query_id long, chunk_id long, distance double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _valid(vector: str = "embedding") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    dist = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2.0 * (rows @ centres.T)
    return np.maximum(dist, 0.0)


def _fit(rows: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct random rows; cells that lose all rows are dropped."""
    rows = np.unique(rows, axis=0)
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        to = _squares(rows, centres).argmin(1)
        centres = np.stack([rows[to == c].mean(0) for c in np.unique(to)])
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray, k: int, recall: float, sure: float, seed: int) -> int:
    """Least number of cells that hold ``recall`` of the k nearest rows of the share ``sure`` of sample queries.

    Those are up to 200 of the rows and as many means of 50 rows, for queries that are profiles; the harder kind decides.
    """
    random = np.random.default_rng(seed)
    home = _squares(rows, centres).argmin(1)
    least = 1
    for own, asked in ((True, rows[:200]), (False, np.stack([rows[random.integers(0, len(rows), 50)].mean(0) for _ in range(200)]))):
        near, needed = _squares(asked, centres), []
        for i, query in enumerate(asked):
            place = np.empty(len(centres), int)
            place[np.argsort(near[i], kind="stable")] = np.arange(1, len(centres) + 1)
            others = np.argsort(_squares(query[None], rows)[0], kind="stable")[own : k + own]
            if len(others):
                needed.append(sorted(place[home[others]])[int(np.ceil(recall * len(others))) - 1])
        if needed:
            least = max(least, int(np.quantile(needed, sure, method="higher")))
    return least


def build(vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, recall: float = 0.9, sure: float = 0.98, seed: int = 7) -> None:
    """Write the index of ``vectors`` (chunk_id, embedding) to ``path``.

    ``cells`` is by default the square root of the number of vectors, ``MAX_CELLS`` at most; the stored number of
    probes finds ``recall`` of the k nearest for the share ``sure`` of queries like those of the sample.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("chunk_id").isNotNull() & _valid())
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count()
    most = sizes.agg(F.max(F.struct("count", "dims")).alias("m")).select("m.*").first()
    total, dims = most["count"] or 0, most["dims"]
    rows = rows.filter(F.size("embedding") == F.lit(dims))
    sample = _matrix(rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toPandas()["embedding"]) if total else np.zeros((0, 1))
    centres = _fit(sample, min(MAX_CELLS, cells or max(1, int(total**0.5))), seed) if total else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                near = _squares(_matrix(pdf["embedding"]), shared.value)
                yield pdf.assign(cell=near.argmin(1).astype(np.int32), away=np.sqrt(near.min(1)))

    placed = rows.mapInPandas(assign, "chunk_id long, embedding array<double>, cell int, away double")
    # Sorted by cell over the whole table: a cell is some files of one folder, a large one is written by several tasks.
    data = os.path.join(path, "vectors")
    placed.repartitionByRange("cell", F.xxhash64("chunk_id")).write.mode("overwrite").partitionBy("cell").parquet(data)
    probes = _probes(sample, centres, k, recall, sure, seed) if total else 1
    stored = spark.read.schema("chunk_id long, away double, cell int").parquet(data) if total else placed
    known = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    known.join(sizes, "cell").write.mode("overwrite").parquet(os.path.join(path, "cells"))


def _cells(spark: SparkSession, path: str) -> pd.DataFrame:
    """The table of cells, ``MAX_CELLS`` rows at most."""
    return spark.read.schema("cell int, centre array<double>, probes int, n long, radius double").parquet(os.path.join(path, "cells")).toPandas().sort_values("cell")


def _asked(queries: DataFrame, cells: pd.DataFrame) -> DataFrame:
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.filter(F.col("query_id").isNotNull() & _valid() & (F.size("embedding") == len(cells["centre"].iloc[0])))


def _route(asked: DataFrame, cells: pd.DataFrame, probes: int | None) -> DataFrame:
    """(query_id, cell, gap) for the cells a query is sent to: the ``probes`` nearest, or all but these with the least distance (gap) that a
    row of theirs can have."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast((cells["cell"].to_numpy(), _matrix(cells["centre"]), cells["radius"].to_numpy()))
    most, rest = (probes, False) if probes else (int(cells["probes"].iloc[0]), True)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, radius = shared.value
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                away = np.sqrt(_squares(_matrix(part["embedding"]), centres))
                order = np.argsort(away, axis=1, kind="stable")
                order = order[:, most:] if rest else order[:, :most]
                row = np.repeat(np.arange(len(part)), order.shape[1])
                cell = order.ravel()
                columns = {"query_id": part["query_id"].to_numpy()[row], "cell": names[cell], "gap": np.maximum(away[row, cell] - radius[cell], 0.0)}
                yield pd.DataFrame(columns)

    return asked.mapInPandas(route, "query_id long, cell int, gap double")


def _measured(ways: DataFrame, asked: DataFrame, spark: SparkSession, path: str, cells: pd.DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in each block of the cells it was sent to."""
    used = ways.select("cell").distinct().toPandas()["cell"].tolist()
    blocks = spark.createDataFrame([(int(c), int(-(-n // BLOCK))) for c, n in zip(cells["cell"], cells["n"])], "cell int, blocks int")
    parts = ways.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).join(F.broadcast(blocks), "cell")
    stored = spark.read.schema("chunk_id long, embedding array<double>, cell int").parquet(os.path.join(path, "vectors"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # As many rows as cells in use: at most MAX_CELLS.
    rows = stored.filter(F.col("cell").isin(used)).join(F.broadcast(parts), "cell")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"), "part": each("parts")})
    sent = ways.join(F.broadcast(parts), "cell").withColumns({"part": F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"), "block": each("blocks")})
    sent = sent.select("query_id", "cell", "block", "part").join(asked, "query_id")

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        ids = right["chunk_id"].to_numpy()
        dist = np.round(_squares(_matrix(left["embedding"]), _matrix(right["embedding"])), RANK_DIGITS)
        found = []
        for query, d in zip(left["query_id"], dist):
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.lexsort((ids[near], d[near]))][:k]
            found.append(pd.DataFrame({"query_id": query, "chunk_id": ids[near], "distance": d[near]}))
        return pd.concat(found)

    key = ["cell", "block", "part"]
    return sent.groupBy(*key).cogroup(rows.select("chunk_id", "embedding", *key).groupBy(*key)).applyInPandas(measure, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """Approximate nearest vectors (query_id, chunk_id, distance, rank), distance squared L2, from the ``probes`` nearest cells.

    The number is that stored with the index unless given, so an answer does not depend on what is asked beside it.
    """
    spark, cells = queries.sparkSession, _cells(queries.sparkSession, path)
    if cells.empty:
        return spark.createDataFrame([], _HIT + ", rank long")
    asked = _asked(queries, cells)
    ways = _route(asked, cells, probes or int(cells["probes"].iloc[0]))
    return _ranked(_measured(ways, asked, spark, path, cells, k), k)


def nearest(queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """The same, exact: after the nearest cells, those that may hold something nearer than the k-th found, if any, are read too."""
    spark, cells = queries.sparkSession, _cells(queries.sparkSession, path)
    if cells.empty:
        return spark.createDataFrame([], _HIT + ", rank long")
    asked = _asked(queries, cells)
    first = _ranked(_measured(_route(asked, cells, int(cells["probes"].iloc[0])), asked, spark, path, cells, k), k)
    bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("worst"))
    rest = _route(asked, cells, None).join(bound, "query_id", "left")
    # A little room for rounding: the bound is the square root of a rounded square.
    open_ = F.col("found").isNull() | (F.col("found") < k) | (F.col("gap") <= F.sqrt("worst") + 1e-6)
    more = _measured(rest.filter(open_).select("query_id", "cell", "gap"), asked, spark, path, cells, k)
    return _ranked(first.select("query_id", "chunk_id", "distance").unionByName(more), k)
