"""What users plug in or call by name: SQL functions of the rules, the chunking table function, a caller's encoder."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.corpus import PACK
from studylake.catalog.text import GRADE_BAND_SQL, docs, first_sql, matches_sql
from studylake.functions import rules as R
from studylake.functions.register import register
from studylake.operators import corpus as K
from studylake.sources.tables import load, oracle, spread


@query(
    "r01_sql_functions",
    oracle(["docs"], f"""SELECT doc_id, {first_sql('filename', R.FILENAME_SUBJECTS, '')} AS by_name, {GRADE_BAND_SQL} AS grade,
      {matches_sql('lower(filename)', R.SIDECAR_NAME)} AS sidecar FROM docs"""),
)
def _(spark, sf):
    register(spark)
    return spark.sql(
        "SELECT doc_id, subject_from_filename(filename) AS by_name, infer_grade(text) AS grade, is_sidecar(filename) AS sidecar FROM {docs}",
        docs=docs(spark, sf),
    )


_SPACED = "replace(text, chr(10), concat(chr(10), chr(10)))"


@query(
    "r02_chunk_table_function",
    "WITH RECURSIVE dd AS (SELECT doc_id, " + _SPACED + " AS text FROM documents), "
    + PACK.replace("FROM documents", "FROM dd").replace("JOIN documents d", "JOIN dd d").replace("string_split(text, chr(10))", "string_split(text, concat(chr(10), chr(10)))")
    + " SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM ids",
)
def _(spark, sf):
    register(spark)
    rows = spread(load(spark, sf, "documents")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.text FROM {rows} AS d, LATERAL chunk(d.text, 800) AS c", rows=rows)


def _letters():
    """A stand-in for a model: length and counts of four letters, for a list of texts."""
    return lambda texts: [[len(t), *(t.count(c) for c in "aeio")] for t in texts]


@query(
    "r03_embed",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, "
    + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in "aeio")
    + " FROM documents",
)
def _(spark, sf):
    rows = K.embed(spread(load(spark, sf, "documents")).select("doc_id", "text"), _letters)
    return rows.select("doc_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(["n", *"aeio"])))
