"""Whole jobs put together from the operators: ingest of documents, context of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.functions import text as T
from studylake.operators import corpus as K
from studylake.operators import lexical_index, vector_index
from studylake.operators import retrieval as V

#: Hits of a batch of queries that are sent to the chunks; more are joined by shuffle.
SENT_HITS = 1_000_000


def ingest(docs: DataFrame, registered: DataFrame, separator: str = K.PARAGRAPH, require_cjk: bool = True) -> DataFrame:
    """Chunks of admitted documents, ready for ``upsert_chunks``.

    ``docs`` is (doc_id, filename, size, kb_name, text), with ``summary`` where a teaching summary may be
    indexed in place of the text, and ``learner_id``, ``source`` and ``trace_id`` where chunks are to carry
    them.  Admission, cleaning, classification and
    chunking are narrow.  Dedup moves hashes and ids; what then meets the texts is the list of
    redundant copies, which Spark sends to the texts while it is small and joins by id otherwise.
    """
    admitted = docs.filter(
        (T.admission_reject(F.col("filename"), F.col("size")) == "") & ~T.is_sidecar(F.col("filename"))
    )
    admitted, _ = K.require_kb(admitted, registered)
    # Cleaned and judged in one generator, so a text is cleaned once and not again for the filter.
    usable = F.filter(F.array(T.strip_ole(F.col("text"))), lambda t: ~T.is_garbled(t, require_cjk))
    extra = [c for c in ("learner_id", "source", "trace_id", "summary") if c in admitted.columns]
    clean = admitted.select("doc_id", "filename", "kb_name", *extra, F.explode(usable).alias("text"))
    clean = clean.join(K.redundant_copies(clean, ["kb_name"]), "doc_id", "left_anti")
    subject = T.detect_subject(F.col("text"), F.col("filename"))
    clean = clean.withColumn("subject", subject)
    summary = F.col("summary") if "summary" in extra else F.lit(None).cast("string")
    described = clean.withColumns(K.ingest_metadata(F.col("text"), summary, F.col("subject"))).drop("summary")
    return K.chunk_rows(described, separator=separator)


def context(
    queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, words: str | None = None, near: str | None = None
) -> DataFrame:
    """Fused vector and lexical hits of a batch of queries, with their chunks.

    ``words`` and ``near`` are the paths of stored indexes of the chunks and vectors; without one, the table is scanned.
    """
    by_vector = vector_index.nearest(query_vectors, near, 2 * k) if near else V.vector_topk(query_vectors, vectors, 2 * k)
    by_words = lexical_index.search(queries, words, 2 * k) if words else V.bm25_topk(queries, chunks, 2 * k)
    hits = V.rrf_fuse([by_vector, by_words], k)
    asked = queries.select("query_id").union(query_vectors.select("query_id")).distinct().count()
    # Hits are sent to the texts, which are not moved.
    return chunks.join(F.broadcast(hits) if asked * k <= SENT_HITS else hits, "chunk_id").select(*hits.columns, *[c for c in chunks.columns if c != "chunk_id"])
