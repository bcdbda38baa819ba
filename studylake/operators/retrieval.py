"""Vector, lexical and fused top-k retrieval for whole batches of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.operators.containment import contained

# Queries sent to every task at once; more are joined block by block.
MAX_QUERIES = 4096
# Rows of one vector block: with MAX_QUERIES queries, a matrix of 128 MB.
BLOCK_ROWS = 4096
# Digits that decide rank; equal distances are ordered by id.
RANK_DIGITS = 9


def profile_vectors(vectors: DataFrame, key: str = "label") -> DataFrame:
    """Mean vector per key.  Sums are combined map-side per (key, dimension)."""
    cells = vectors.select(F.col(key).alias("query_id"), F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("query_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("embedding")
    )


def _distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """(queries, vectors) matrix of distances; smaller is nearer."""
    dots = queries @ vectors.T
    if metric == "ip":
        return 1.0 - dots
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
        return 1.0 - dots / np.where(norms == 0, 1.0, norms)
    squares = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2.0 * dots
    return np.maximum(squares, 0.0)


def _best(query_ids: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest per query: ties on the rounded distance go to the smaller id."""
    dist = np.round(dist, RANK_DIGITS)
    rows = []
    for i, query in enumerate(query_ids):
        d = dist[i]
        if len(d) > 4 * k:
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        else:
            near = np.arange(len(d))
        near = near[np.isfinite(d[near])]
        near = near[np.lexsort((ids[near], d[near]))][:k]
        rows.append(pd.DataFrame({"query_id": query, "chunk_id": ids[near], "distance": d[near]}))
    return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    both = pd.concat(parts).sort_values(["query_id", "distance", "chunk_id"])
    return both.groupby("query_id", sort=False).head(k)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _apart(queries: pd.Series, vectors: pd.Series, dist: np.ndarray) -> np.ndarray:
    """Distances with pairs of unequal label put out of reach."""
    return np.where(queries.to_numpy()[:, None] == vectors.to_numpy()[None, :], dist, np.inf)


def _short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in pieces of at most ``BLOCK_ROWS``."""
    for pdf in frames:
        for at in range(0, len(pdf), BLOCK_ROWS):
            yield pdf.iloc[at : at + BLOCK_ROWS]


_HIT = "query_id long, chunk_id long, distance double"


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2sq", max_queries: int = MAX_QUERIES,
    within: str | None = None,
) -> DataFrame:
    """Exact k nearest vectors of each query: (query_id, chunk_id, distance, rank).

    ``queries`` is (query_id, embedding), ``vectors`` (chunk_id, embedding).  Up to
    ``max_queries`` queries are sent to the tasks, which multiply them with each batch and keep k
    rows per query, so vectors are never shuffled.  More queries than that are never collected:
    see ``blocked_topk``.  ``within`` names a column of both sides that must be equal, such as the
    subject.
    """
    label = [within] if within else []
    q = queries.select(F.col("query_id").cast("long"), "embedding", *label)
    v = vectors.select(F.col("chunk_id").cast("long"), "embedding", *label)
    sample = q.limit(max_queries + 1).toPandas()
    if len(sample) > max_queries:
        return blocked_topk(q, v, k, metric, max_queries, within=within)
    if sample.empty:
        return v.sparkSession.createDataFrame([], _HIT + ", rank long")
    sample = sample.sort_values("query_id")
    ids, matrix = sample["query_id"].to_numpy(), _stack(sample["embedding"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in _short(frames):
            dist = _distances(matrix, _stack(pdf["embedding"]), metric)
            if within:
                dist = _apart(sample[within], pdf[within], dist)
            found = _best(ids, pdf["chunk_id"].to_numpy(), dist, k)
            kept = found if kept is None else _merge([kept, found], k)
        if kept is not None:
            yield kept

    return _rank(v.mapInPandas(scan, _HIT), k)


def blocked_topk(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", query_block: int = MAX_QUERIES,
    vector_block: int = BLOCK_ROWS, within: str | None = None,
) -> DataFrame:
    """The same for any number of queries: both sides are cut into hashed blocks of bounded size,
    and each pair of blocks is one task."""
    n_q = max(1, -(-queries.count() // query_block))
    n_v = max(1, -(-vectors.count() // vector_block))
    all_q, all_v = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (n_q, n_v))
    q = queries.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"), F.explode(all_v).alias("vb")
    )
    v = vectors.select(
        "*", F.pmod(F.xxhash64("chunk_id"), F.lit(n_v)).cast("int").alias("vb"), F.explode(all_q).alias("qb")
    )

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        dist = _distances(_stack(left["embedding"]), _stack(right["embedding"]), metric)
        if within:
            dist = _apart(left[within], right[within], dist)
        return _best(left["query_id"].to_numpy(), right["chunk_id"].to_numpy(), dist, k)

    hits = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(pair, _HIT)
    return _rank(hits, k)


def hyperplanes(dims: int, number: int, seed: int) -> np.ndarray:
    """Random planes, one a column."""
    return np.random.default_rng(seed).normal(size=(dims, number))


def vector_topk_ann(
    queries: DataFrame, vectors: DataFrame, k: int = 5, bits: int = 4, tables: int = 8, seed: int = 7,
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Approximate nearest vectors: only vectors sharing a random-hyperplane signature with the
    query in one of ``tables`` tables are measured.  Planes come from the seed, so reruns agree.
    Queries are sent to the tasks in blocks of about ``max_queries``, so an answer does not depend
    on how many are asked together.
    """
    v = vectors.select(F.col("chunk_id").cast("long"), "embedding")
    asked = queries.select(F.col("query_id").cast("long"), "embedding")
    blocks = 1 + asked.count() // max_queries
    hits = None
    for block in range(blocks):
        q = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if len(q):
            found = _ann_block(q, v, k, bits, tables, seed)
            hits = found if hits is None else hits.unionByName(found)
    return v.sparkSession.createDataFrame([], _HIT + ", rank long") if hits is None else _rank(hits, k)


def _ann_block(q: pd.DataFrame, v: DataFrame, k: int, bits: int, tables: int, seed: int) -> DataFrame:
    q = q.sort_values("query_id")
    ids, matrix = q["query_id"].to_numpy(), _stack(q["embedding"])
    planes = hyperplanes(matrix.shape[1], tables * bits, seed)
    weights = 1 << np.arange(bits)

    def signature(x: np.ndarray) -> np.ndarray:
        return ((x @ planes) > 0).reshape(len(x), tables, bits) @ weights

    wanted = signature(matrix)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for pdf in _short(frames):
            vecs, cids = _stack(pdf["embedding"]), pdf["chunk_id"].to_numpy()
            have = signature(vecs)
            for i, query in enumerate(ids):
                near = np.flatnonzero((have == wanted[i]).any(axis=1))
                if len(near):
                    dist = _distances(matrix[i : i + 1], vecs[near], "l2sq")
                    kept.append(_best(np.array([query]), cids[near], dist, k))
            if kept:
                kept = [_merge(kept, k)]
        yield from kept

    return v.mapInPandas(scan, _HIT)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: exact hits and how many of them the approximate search found."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("found"))
    )


def figure_sidecar_topk(
    queries: DataFrame, vectors: DataFrame, figures: DataFrame, k: int = 5, limit: float = 1.3, attach: int = 3
) -> DataFrame:
    """Text hits, each with the nearest figures of its query that are near enough."""
    near = vector_topk(queries, figures, max(3, k // 2)).filter(F.col("distance") < limit).filter(F.col("rank") <= attach)
    listed = near.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda f: f["chunk_id"]).alias("figures")
    )
    hits = vector_topk(queries, vectors, k)
    return hits.join(listed, "query_id", "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<long>")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# Cells of the (term, query) matrix sent to every task; larger batches of queries are joined.
MAX_TERM_CELLS = 5_000_000
# Query words (query, term) sent to the tasks that join them with documents; more are joined in blocks of queries.
MAX_WORDS = 1_000_000
# Documents, and (query, document) pairs, of one task of that join: what it groups stays in memory.
JOIN_DOCS = 4096
JOIN_PAIRS = 1_000_000
# Stands for the document itself in the term statistics; cannot be a token.
_SELF = "\x00"


def _term_stats(docs: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """(term, df, length): documents per asked term, and under ``_SELF`` their number and total
    length, from one scan combined map-side."""
    rows = docs.select(tokens(F.col("text")).alias("ts")).select(
        F.size("ts").cast("long").alias("dl"), F.explode(F.array_append(F.array_distinct("ts"), F.lit(_SELF))).alias("term")
    )
    wanted = asked.union(asked.sparkSession.range(1).select(F.lit(_SELF).alias("term")))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length"))


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, max_cells: int = MAX_TERM_CELLS
) -> DataFrame:
    """Lexical top-k: (query_id, chunk_id, score, rank).

    One scan counts the asked terms, a second one scores.  While (asked terms x queries) is within
    ``max_cells`` the query terms are sent to the tasks, each of which scores its documents and
    keeps k per query: documents are never shuffled.  Larger batches of queries are joined by term, in blocks
    of about ``MAX_WORDS`` words; texts are dealt out by id once, and no posting leaves its document's task.
    """
    words = queries.select(
        F.col("query_id").cast("long"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")
    )
    shape = words.agg(F.countDistinct("term"), F.countDistinct("query_id"), F.count(F.lit(1))).first()
    few = shape[0] * shape[1] <= max_cells
    asked = words.select("term").distinct()
    stats = _term_stats(docs, asked, shape[0] <= MAX_WORDS)
    whole = stats.filter(F.col("term") == _SELF).first()
    if whole is None:
        return docs.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank long")
    n_docs, mean_len = float(whole["df"]), max(whole["length"] / whole["df"], 1e-9)
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = words.join(stats, "term").select("query_id", "term", idf.alias("idf"))
    rows = docs.select(F.col("chunk_id").cast("long"), "text")
    if few:
        scored = _bm25_scan(weights, rows, k, k1, b, mean_len)
    else:
        blocks = max(1, -(-shape[2] // MAX_WORDS))
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(n_docs) // JOIN_DOCS), -(-int(n_docs) * shape[1] // (blocks * JOIN_PAIRS)))
        scored = _bm25_join(weights, rows, k1, b, mean_len, blocks, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def _bm25_join(weights: DataFrame, docs: DataFrame, k1: float, b: float, mean_len: float, blocks: int, parts: int) -> DataFrame:
    """Scores of every (query, document) sharing a term, query block by query block.

    Documents are dealt out by id, so their words are counted, joined and added up where they are; a rank that is
    asked for is cut to k rows per query and task before anything is moved.
    """
    split = docs.repartition(parts, "chunk_id").select("chunk_id", tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))
    words = split.select("chunk_id", "dl", F.explode("ts").alias("term"))
    gain = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean_len)))
    scores = None
    for block in range(blocks):
        own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else weights
        found = words.join(F.broadcast(own.select("term").distinct()), "term", "left_semi")
        tf = found.groupBy("chunk_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
        part = tf.join(F.broadcast(own), "term").groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    return scores.withColumn("score", F.round("score", RANK_DIGITS))


def _bm25_scan(weights: DataFrame, docs: DataFrame, k: int, k1: float, b: float, mean_len: float) -> DataFrame:
    """Best k documents per query of each partition, scored against the collected weights."""
    table = weights.toPandas()
    terms = {t: i for i, t in enumerate(sorted(table["term"].unique()))}
    ids = np.sort(table["query_id"].unique())
    matrix = np.zeros((len(terms), len(ids)))
    matrix[table["term"].map(terms).to_numpy(dtype=np.int64), np.searchsorted(ids, table["query_id"])] = table["idf"]
    word = re.compile(r"[^\W_]+")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_score = np.zeros((0, len(ids)))
        best_id = np.zeros((0, len(ids)), dtype=np.int64)
        for pdf in frames:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                block = np.zeros((len(part), len(ids)))
                for row, text in enumerate(part["low"]):
                    found = word.findall(text or "")
                    hits = [terms[t] for t in found if t in terms]
                    if not hits:
                        continue
                    at, tf = np.unique(np.array(hits), return_counts=True)
                    block[row] = (tf / (tf + k1 * (1 - b + b * len(found) / mean_len))) @ matrix[at]
                score = np.vstack([best_score, np.round(block, RANK_DIGITS)])
                cid = np.vstack([best_id, np.repeat(part["chunk_id"].to_numpy()[:, None], len(ids), axis=1)])
                order = np.lexsort((cid, -score), axis=0)[:k]
                best_score = np.take_along_axis(score, order, axis=0)
                best_id = np.take_along_axis(cid, order, axis=0)
        row, col = np.nonzero(best_score > 0)
        yield pd.DataFrame({"query_id": ids[col], "chunk_id": best_id[row, col], "score": best_score[row, col]})

    low = docs.select("chunk_id", F.lower("text").alias("low"))
    return low.mapInPandas(scan, "query_id long, chunk_id long, score double")


def rrf_fuse(lists: list[DataFrame], k: int = 5, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, chunk_id, rank)."""
    union = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def staged_context(hits: DataFrame, keep: int = 3, far: float = 0.6) -> DataFrame:
    """Context of a query in three passes: summaries of its subject, else other texts of its
    subject, else anything not a near-duplicate.  Only the first pass with hits is used.

    ``hits`` is (query_id, query_subject, rank, distance, type, subject, text).
    """
    same = F.col("subject") == F.col("query_subject")
    summary = F.col("type") == "teaching_summary"
    stage = F.when(summary & same, 1).when(same, 2).when(F.col("distance") >= far, 3)
    # A hit of pass 1 or 2 also qualifies for pass 3, which runs only where those found nothing.
    rows = hits.filter(F.trim("text") != "").withColumn("pass", stage).filter("pass IS NOT NULL")
    first = rows.withColumn("_first", F.min("pass").over(Window.partitionBy("query_id"))).filter("pass = _first")
    order = Window.partitionBy("query_id").orderBy("rank")
    shown = F.substring(F.trim("text"), 1, 500)
    return (
        first.withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= keep)
        .select(
            "query_id", F.col("pass").cast("long").alias("pass"), F.col("pos").cast("long").alias("pos"), "chunk_id",
            F.when(F.col("pass") == 1, shown).otherwise(F.substring(F.trim("text"), 1, 200)).alias("text"),
        )
    )


def search_results(hits: DataFrame) -> DataFrame:
    """Display form: first 500 characters and a score from the distance."""
    score = F.round(1.0 - F.least(F.col("distance"), F.lit(1.0)), 3)
    return hits.withColumns({"text": F.substring("text", 1, 500), "score": score})


def filename_hits(queries: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """Files whose name contains the query or one of its words: first ``2 k`` names per query.

    Words are looked up in the names by their rarest gram. ``2 k`` are enough, since at most k can repeat a vector hit.
    """
    low = F.lower("text")
    words = queries.select("query_id", F.explode(F.array_distinct(F.array_append(F.split(low, r"\s+"), low))).alias("word"))
    names = files.select("filename", F.lower("filename").alias("_name")).distinct()
    found = contained(words, names, "word", "_name", []).select("query_id", "filename").distinct()
    order = Window.partitionBy("query_id").orderBy("filename")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * k)


def federated_search(hits: DataFrame, by_name: DataFrame, k: int = 5) -> DataFrame:
    """Vector hits, then file name hits (score 0.9), one entry per file or text, first k."""
    named = F.nullif(F.col("filename"), F.lit(""))
    first = hits.select(
        "query_id", F.lit("vector").alias("origin"), F.col("rank").alias("place"), "filename", F.substring("text", 1, 500).alias("text"), "score",
        F.coalesce(named, F.sha2(F.col("text").cast("binary"), 256)).alias("_key"),  # of the whole text
    )
    second = by_name.select(
        "query_id", F.lit("filename").alias("origin"), (F.col("place") + 1_000_000).cast("long").alias("place"), "filename",
        F.concat(F.lit("文件: "), "filename").alias("text"), F.lit(0.9).alias("score"), F.coalesce(named, F.lit("")).alias("_key"),
    )
    rows = first.unionByName(second)
    one = Window.partitionBy("query_id", "_key").orderBy("place")
    best = Window.partitionBy("query_id").orderBy("place")
    return (
        rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
        .withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k)
        .select("query_id", F.col("pos").cast("long").alias("pos"), "origin", "filename", "text", "score")
    )
