"""The SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from studylake.functions import grading as G
from studylake.functions import text as T
from studylake.functions.register import register
from studylake.operators import corpus as K
from studylake.operators import mastery as M
from studylake.sources.tables import load, view
from tests.conftest import rows


def same(df, sql, column):
    a, b = df.select(F.expr(sql).alias("v")), df.select(column.alias("v"))
    assert rows(a) == rows(b)


def test_sql_names(spark, sf):
    names = register(spark)
    assert {"match_answers", "pack_chunks", "chunk", "review_interval"} <= set(names)
    levels = spark.range(101).select((F.col("id") / 100).alias("l"), (F.col("id") % 5).alias("n"))
    same(levels, "review_interval(l)", M.review_interval(F.col("l")))
    same(levels, "mastery_band(l)", M.mastery_band(F.col("l")))
    same(levels, "mastery_guidance(l, n)", M.mastery_guidance(F.col("l"), F.col("n")))
    study, docs = view(spark, sf, "study_docs"), view(spark, sf, "docs")
    same(study, "infer_grade(text)", T.infer_grade(F.col("text")))
    same(study, "subject_from_text(text)", T.subject_from_text(F.col("text")))
    same(docs, "subject_from_filename(filename)", T.subject_from_filename(F.col("filename")))
    same(docs, "is_sidecar(filename)", T.is_sidecar(F.col("filename")))
    pairs = view(spark, sf, "grading_pairs")
    same(pairs, "match_answers(student, correct)", G.match_answers(F.col("student"), F.col("correct")))
    same(load(spark, sf, "part"), "normalize_qtype(p_type)", G.normalize_qtype(F.col("p_type")))
    paged = study.select(F.regexp_replace("text", "\n", "\n\n").alias("text"))
    same(paged, "pack_chunks(text, 300)", K.pack_chunks(F.col("text"), 300))


def test_chunk_table_function(spark):
    register(spark)
    got = spark.sql("SELECT d.id, c.* FROM VALUES (1, 'a\n\nb'), (2, repeat('x', 25)) AS d(id, t), LATERAL chunk(d.t, 10) AS c")
    assert sorted((r.id, r.chunk_index, r.text) for r in got.collect()) == [
        (1, 0, "a\n\nb"), (2, 0, "x" * 10), (2, 1, "x" * 10), (2, 2, "x" * 5)
    ]
