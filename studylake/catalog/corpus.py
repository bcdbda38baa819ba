"""Intake, chunking, dedup, curriculum."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.mastery import C_CTE, answers, levels
from studylake.catalog.text import docs, q, study
from studylake.operators import corpus as K
from studylake.operators import curriculum as U
from studylake.operators import mastery as M
from studylake.operators import progress as P
from studylake.sources import readers
from studylake.sources.sinks import rewrite_partitions
from studylake.sources.tables import AS_OF, KP_EDGES_ORACLE, kp_edges, load, oracle, spread, view
from studylake.streaming.runs import scratch
from studylake.functions import rules as R
from studylake.functions.rounding import level_oracle

WS = q(R.WHITE)

# --- reading -------------------------------------------------------------------------------

_KP = "CASE WHEN kp_id <> '' THEN kp_id WHEN domain <> '' THEN concat(domain, CASE WHEN topic <> '' THEN concat('/', topic) ELSE '' END) END"
_SCORE = "coalesce(greatest(0, least(1, raw_score)), CASE WHEN is_correct THEN 1 ELSE 0 END)"


@query("a01_read_answers", oracle(["quiz_raw"], f"SELECT answer_id, learner_id, {_KP} AS kp_id, CAST({_SCORE} AS DOUBLE) AS score FROM quiz_raw WHERE {_KP} IS NOT NULL"))
def _(spark, sf):
    return readers.read_answers(view(spark, sf, "quiz_raw"))[0]


@query("a01_rejected_answers", oracle(["quiz_raw"], f"SELECT answer_id, learner_id, 'empty kp_id' AS reason FROM quiz_raw WHERE {_KP} IS NULL"))
def _(spark, sf):
    return readers.read_answers(view(spark, sf, "quiz_raw"))[1].select("answer_id", "learner_id", "reason")


_DUE_DAYS = "CASE WHEN level < 0.3 THEN 1 WHEN level < 0.6 THEN 3 WHEN level < 0.8 THEN 7 WHEN level < 0.9 THEN 14 ELSE 30 END"


# All four tables of the documents, one under the other.
@query(
    "a02_explode_learner_docs",
    oracle(["answers"], f""", {C_CTE}, ld AS (SELECT learner_id, kp_id, max(day) AS d FROM answers GROUP BY 1, 2)
      SELECT 'mastery' AS name, CAST(learner_id AS VARCHAR) AS learner_id, kp_id AS key, total, correct, partial, wrong, level, NULL AS detail FROM m
      UNION ALL SELECT 'daily', CAST(learner_id AS VARCHAR), CAST(day AS VARCHAR), count(*), count(*) FILTER (score >= 1), count(*) FILTER (score > 0 AND score < 1),
        count(*) FILTER (score <= 0), NULL, coalesce(string_agg(DISTINCT kp_id, ',' ORDER BY kp_id) FILTER (score <= 0), '') FROM answers GROUP BY learner_id, day
      UNION ALL SELECT 'wrong_answers', CAST(learner_id AS VARCHAR), kp_id, 0, 0, 0, 0, NULL, concat(question, ' ', CAST(epoch_us(ts) // 1000 AS VARCHAR)) FROM answers WHERE score < 0.5
      UNION ALL SELECT 'reviews', CAST(learner_id AS VARCHAR), kp_id, 0, 0, 0, 0, NULL, CAST(d + ({_DUE_DAYS}) AS VARCHAR) FROM m JOIN ld USING (learner_id, kp_id)"""),
)
def _(spark, sf):
    a = answers(spark, sf)
    as_map = lambda df, key, *value: df.groupBy("learner_id").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*value) if len(value) > 1 else value[0]))).alias("v"))
    counts = ("total", "correct", "partial", "wrong")
    parts = {
        "mastery": as_map(levels(spark, sf), "kp_id", "level", *counts),
        "daily_stats": as_map(M.daily_stats(a).withColumn("day", F.col("day").cast("string")), "day", *counts, "weak_points"),
        "wrong_answers": a.filter("score < 0.5").groupBy("learner_id").agg(
            F.collect_list(F.struct("kp_id", "question", (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("ts"))).alias("v")
        ),
        "review_schedule": as_map(M.review_schedule(a).withColumn("due", F.col("due").cast("string")), "kp_id", "due"),
    }
    whole = None
    for name, part in parts.items():
        part = part.withColumnRenamed("v", name)
        whole = part if whole is None else whole.join(part, "learner_id", "full")
    stored = whole.select(F.to_json(F.struct(F.col("learner_id").cast("string").alias("learner_id"), *parts)).alias("doc"))
    tables = readers.explode_learner_docs(stored)
    none = [F.lit(0).cast("long").alias(c) for c in counts]
    level = F.lit(None).cast("double").alias("level")
    wrong = F.concat_ws(" ", "question", F.round(F.col("ts") * 1000).cast("long").cast("string"))
    shown = [
        tables["mastery"].select(F.lit("mastery").alias("name"), "learner_id", F.col("kp_id").alias("key"), *counts, "level", F.lit(None).cast("string").alias("detail")),
        tables["daily"].select(F.lit("daily").alias("name"), "learner_id", F.col("day").cast("string").alias("key"), *counts, level, F.array_join("weak_points", ",").alias("detail")),
        tables["wrong_answers"].select(F.lit("wrong_answers").alias("name"), "learner_id", F.col("kp_id").alias("key"), *none, level, wrong.alias("detail")),
        tables["reviews"].select(F.lit("reviews").alias("name"), "learner_id", F.col("kp_id").alias("key"), *none, level, F.col("due").cast("string").alias("detail")),
    ]
    return functools.reduce(DataFrame.unionByName, shown)


def trees(spark, sf):
    """One small curriculum tree per part: two points, the second building on the first."""
    return load(spark, sf, "part").selectExpr(
        f"""from_json(to_json(named_struct('domain', CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END,
          'grades', array(named_struct('id', CAST(7 + p_partkey % 3 AS STRING), 'name', p_type, 'semesters', array(named_struct(
            'id', 's1', 'name', 'first', 'chapters', array(named_struct('id', concat('ch', CAST(p_size AS STRING)), 'number',
              CAST(p_size AS STRING), 'title', p_brand, 'knowledge_points', array(
                named_struct('id', concat('kp', CAST(p_partkey AS STRING)), 'name', p_name, 'description', p_type,
                  'prerequisites', CAST(array() AS array<string>), 'importance', 'basic'),
                named_struct('id', concat('kp', CAST(p_partkey AS STRING), 'b'), 'name', concat(p_name, ' b'), 'description', p_brand,
                  'prerequisites', array(concat('kp', CAST(p_partkey AS STRING))), 'importance', 'core')))))))))), '{readers.CURRICULUM}') AS tree"""
    )


_TREE = """t AS (SELECT p_partkey, p_name, p_type, p_brand, CAST(p_size AS VARCHAR) AS size,
    CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END AS subject,
    concat('kp', CAST(p_partkey AS VARCHAR)) AS id FROM part),
  k AS (SELECT *, concat(subject, '/g', CAST(7 + p_partkey % 3 AS VARCHAR), 's1/ch', size, '/', id) AS kp_id FROM t)"""


@query(
    "a03_load_curriculum",
    f"""WITH {_TREE} SELECT kp_id, subject, p_type AS grade_name, size AS chapter_no, p_brand AS chapter_title, p_name AS name,
      'basic' AS importance FROM k UNION ALL
      SELECT concat(kp_id, 'b'), subject, p_type, size, p_brand, concat(p_name, ' b'), 'core' FROM k""",
)
def _(spark, sf):
    kps, _ = readers.load_curriculum(trees(spark, sf))
    return kps.select("kp_id", "subject", "grade_name", "chapter_no", "chapter_title", "name", "importance")


@query("a03_curriculum_edges", f"WITH {_TREE} SELECT id AS pre, concat(kp_id, 'b') AS kp FROM k")
def _(spark, sf):
    return readers.load_curriculum(trees(spark, sf))[1]


@query(
    "x07_kp_documents",
    f"""WITH {_TREE}, a AS (SELECT *, kp_id AS full_id, p_name AS n, p_type AS d, 'basic' AS i, '无' AS pre FROM k UNION ALL
        SELECT *, concat(kp_id, 'b'), concat(p_name, ' b'), p_brand, 'core', id FROM k)
      SELECT concat('kp/', full_id) AS doc_id, concat('## 知识点：', n, chr(10), chr(10), d, chr(10), chr(10), '**所属**：', p_type, ' first 第', size,
        '章 ', p_brand, chr(10), '**重要性**：', i, chr(10), '**前置知识**：', pre, chr(10)) AS text, 'kp' AS type, subject, p_type AS grade,
        'first' AS semester, p_brand AS chapter, full_id AS kp_id, n AS kp_name, i AS importance FROM a""",
)
def _(spark, sf):
    return U.kp_documents(readers.load_curriculum(trees(spark, sf))[0])


@query("a04_scan_documents")
def _(spark, sf):
    return readers.scan_documents(spark, sf, "*.parquet").select("filename", "ext", "size")


@query("a05_decode_text")
def _(spark, sf):
    raw = spread(load(spark, sf, "documents")).select("doc_id", F.expr(
        "CASE WHEN doc_id % 3 = 0 THEN encode(text, 'ISO-8859-1') ELSE encode(text, 'UTF-8') END").alias("content"))
    return readers.decode_text(raw).select("doc_id", "text")


# --- chunks --------------------------------------------------------------------------------

PACK = f"""ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents),
  w AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS cur, CAST(NULL AS VARCHAR) AS out FROM ls WHERE length(text) > 800
    UNION ALL
    SELECT doc_id, i + 1, CASE WHEN i >= len(ps) THEN '' WHEN fits THEN trim(concat(cur, chr(10), chr(10), p), {WS}) ELSE p END,
      CASE WHEN (i >= len(ps) OR NOT fits) AND cur <> '' THEN cur END
    FROM (SELECT w.doc_id, w.i, w.cur, l.ps, l.ps[w.i + 1] AS p, length(w.cur) + length(l.ps[w.i + 1]) + 2 < 800 AS fits
          FROM w JOIN ls l USING (doc_id) WHERE w.i <= len(l.ps)) z),
  big AS (SELECT doc_id, i, unnest(regexp_extract_all(out, '(?s).{{1,800}}')) AS text, generate_subscripts(regexp_extract_all(out, '(?s).{{1,800}}'), 1) AS j
          FROM w WHERE out IS NOT NULL),
  ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, text FROM big
    UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 800),
  ids AS (SELECT ch.doc_id, concat(sha256(d.text), '_', CAST(chunk_index AS VARCHAR)) AS chunk_id, chunk_index, ch.text
          FROM ch JOIN documents d USING (doc_id))"""


def chunks(spark, sf):
    return K.chunk_rows(spread(load(spark, sf, "documents")).select("doc_id", "text"), separator="\n")


@query("x01_pack_chunks", f"WITH RECURSIVE {PACK} SELECT doc_id, chunk_id, chunk_index, text FROM ids")
def _(spark, sf):
    return chunks(spark, sf)


@query(
    "a06_upsert_chunks",
    f"""WITH RECURSIVE {PACK},
      kb AS (SELECT ids.doc_id, concat('kb', CAST(ids.doc_id % 3 AS VARCHAR)) AS kb_name, chunk_index, ids.text, d.text AS whole
             FROM ids JOIN documents d USING (doc_id)),
      own AS (SELECT *, concat(sha256(concat(kb_name, chr(31), whole)), '_', CAST(chunk_index AS VARCHAR)) AS chunk_id FROM kb),
      e AS (SELECT chunk_id FROM own WHERE doc_id IN (SELECT doc_id FROM labels))
      SELECT chunk_id, kb_name, min(doc_id) AS doc_id, any_value(chunk_index) AS chunk_index, any_value(text) AS text FROM own
      WHERE chunk_id NOT IN (SELECT chunk_id FROM e) GROUP BY 1, 2""",
)
def _(spark, sf):
    """The same text in two knowledge bases is stored in both."""
    kb = F.concat(F.lit("kb"), (F.col("doc_id") % 3).cast("string")).alias("kb_name")
    every = K.chunk_rows(spread(load(spark, sf, "documents")).select("doc_id", kb, "text"), separator="\n")
    stored = every.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return K.new_chunks(every, stored)


def headed(spark, sf):
    """Documents with every tenth line made a heading, levels in turn."""
    line = "CASE WHEN i % 10 = 0 THEN concat(repeat('#', CAST(2 + (i div 10) % 3 AS INT)), ' ', l) ELSE l END"
    return spread(load(spark, sf, "documents")).selectExpr("doc_id", f"array_join(transform(split(text, '\\n'), (l, i) -> {line}), '\\n') AS text")


_SECTIONS = f"""ln AS (SELECT doc_id, i - 1 AS i, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) x),
  hd AS (SELECT *, i % 10 = 0 AND trim(l, {WS}) <> '' AS h, CASE WHEN i % 10 = 0 THEN concat(repeat('#', CAST(2 + (i // 10) % 3 AS INT)), ' ', l) ELSE l END AS t,
      2 + (i // 10) % 3 AS lv FROM ln),
  sz AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS whole FROM hd GROUP BY 1),
  sc AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hd),
  he AS (SELECT doc_id, s, lv, trim(l, {WS}) AS title FROM sc WHERE h),
  p1 AS (SELECT a.doc_id, a.s, max(b.s) AS up FROM he a JOIN he b ON b.doc_id = a.doc_id AND b.s < a.s AND b.lv < a.lv GROUP BY 1, 2),
  pa AS (SELECT a.doc_id, a.s, concat_ws(' > ', c.title, b.title, a.title) AS path FROM he a
    LEFT JOIN p1 x ON x.doc_id = a.doc_id AND x.s = a.s LEFT JOIN he b ON b.doc_id = a.doc_id AND b.s = x.up
    LEFT JOIN p1 y ON y.doc_id = a.doc_id AND y.s = x.up LEFT JOIN he c ON c.doc_id = a.doc_id AND c.s = y.up),
  bd AS (SELECT doc_id, s, trim(string_agg(t, chr(10) ORDER BY i), {WS}) AS own FROM sc WHERE NOT h GROUP BY 1, 2),
  ow AS (SELECT bd.doc_id, coalesce(path, '') AS heading_path, own, row_number() OVER (PARTITION BY bd.doc_id ORDER BY bd.s) - 1 AS k
    FROM bd JOIN sz USING (doc_id) LEFT JOIN pa ON pa.doc_id = bd.doc_id AND pa.s = bd.s WHERE own <> '' AND length(whole) > 800),
  ov AS (SELECT doc_id, k, own AS text FROM ow WHERE k = 0
    UNION ALL
    SELECT n.doc_id, n.k, CASE WHEN length(v.text) > 100 THEN concat(CASE WHEN strpos(right(v.text, 100), chr(10)) - 1 > 50
        THEN substr(right(v.text, 100), strpos(right(v.text, 100), chr(10)) + 1) ELSE right(v.text, 100) END, chr(10), n.own) ELSE n.own END
    FROM ov v JOIN ow n ON n.doc_id = v.doc_id AND n.k = v.k + 1)"""


@query(
    "x02_semantic_chunk",
    f"""WITH RECURSIVE {_SECTIONS} SELECT doc_id, text, heading_path, CAST(k AS INT) AS chunk_index, CAST(length(own) AS INT) AS char_count
      FROM ov JOIN ow USING (doc_id, k) UNION ALL SELECT doc_id, whole, '', 0, CAST(length(whole) AS INT) FROM sz WHERE length(whole) <= 800""",
)
def _(spark, sf):
    return headed(spark, sf).select("doc_id", F.inline(K.semantic_chunks(F.col("text"))))


def _last(mark: str) -> str:
    n = len(mark)
    return f"CASE WHEN contains(w, {q(mark)}) THEN length(w) - strpos(reverse(w), {q(mark[::-1])}) - {n - 2} - 1 ELSE -1 END"


_NL = chr(10)


@query(
    "x03_sliding_chunk",
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
      s AS (SELECT doc_id, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS e FROM d WHERE FALSE
        UNION ALL SELECT doc_id, 0, 0 FROM d WHERE FALSE),
      r AS (SELECT doc_id, n, text, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS e FROM d
        UNION ALL
        SELECT doc_id, n, text, CASE WHEN cut < n THEN cut - 64 ELSE n END, cut FROM (
          SELECT doc_id, n, text, CASE WHEN least(b + 512, n) < n AND stop > 256 THEN b + stop + 1 ELSE least(b + 512, n) END AS cut FROM (
            SELECT *, greatest({_last('。')}, {_last(_NL)}, {_last('. ')}) AS stop FROM (
              SELECT doc_id, n, text, b, substr(text, b + 1, 512) AS w FROM r WHERE b < n) x) y) z)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS BIGINT) AS pos, chunk FROM (
        SELECT doc_id, e, trim(substr(text, lag_b + 1, e - lag_b), {WS}) AS chunk FROM (
          SELECT doc_id, text, e, lag(b) OVER (PARTITION BY doc_id ORDER BY coalesce(e, -1)) AS lag_b FROM r) q1 WHERE e IS NOT NULL) q2
      WHERE chunk <> ''""",
)
def _(spark, sf):
    rows = spread(load(spark, sf, "documents")).select("doc_id", F.posexplode(K.sliding_chunk()(F.col("text"))).alias("pos", "chunk"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


_MARK = K.QUESTION_MARK
_LEAD = K.LEADING_MARK


@query(
    "x04_split_questions",
    oracle(["replies"], f""", p AS (SELECT conv_id, string_agg(concat(CAST((turn * 7) % 5 + 1 AS VARCHAR), '. ', reply), chr(10) ORDER BY turn) AS text
        FROM replies GROUP BY 1),
      a AS (SELECT conv_id, text, string_split(regexp_replace(concat(chr(10), text), {q(chr(10) + '(\\s*' + _MARK + ')')}, concat(chr(1), '\\1'), 'g'), chr(1)) AS ps FROM p),
      e AS (SELECT conv_id, generate_subscripts(ps, 1) AS i, trim(unnest(ps), {WS}) AS part FROM a),
      f AS (SELECT conv_id, i, CAST(regexp_extract(part, '^\\D*?([0-9]+)', 1) AS INT) AS number,
              trim(regexp_replace(part, {q(_LEAD)}, ''), {WS}) AS content FROM e WHERE i > 1),
      g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, number ORDER BY i DESC) AS rn FROM f WHERE content <> '')
      SELECT conv_id, number, content FROM g WHERE rn = 1"""),
)
def _(spark, sf):
    line = F.concat(((F.col("turn") * 7) % 5 + 1).cast("string"), F.lit(". "), F.col("reply"))
    papers = K.assemble(view(spark, sf, "replies"), "conv_id", "turn", line, "\n")
    return papers.select("conv_id", F.inline(K.split_questions(F.col("text"))))


@query(
    "x06_headings",
    f"""WITH h AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 10 = 0
          THEN concat(repeat('#', CAST(2 + ((i - 1) // 10) % 3 AS INT)), ' ', l) ELSE l END) AS ls FROM documents),
      x AS (SELECT doc_id, list_filter(ls, lambda l: regexp_matches(l, '^#{{1,4}}\\s+.+$')) AS hs FROM h),
      y AS (SELECT doc_id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS l FROM x)
      SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(length(regexp_extract(l, '^(#+)', 1)) AS BIGINT) AS level,
        trim(regexp_extract(l, '^#+\\s+(.+)$', 1), {WS}) AS heading FROM y""",
)
def _(spark, sf):
    rows = headed(spark, sf).select("doc_id", F.posexplode(K.headings(F.col("text"))).alias("pos", "h"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "h.level", "h.heading")


# --- sets and joins ------------------------------------------------------------------------


@query("u02_content_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, sf):
    return K.content_dedup(spread(load(spark, sf, "documents")))


@query(
    "u01_augment_paths",
    oracle(["docs"], """, o AS (SELECT concat('/in/', filename) AS path, doc_id AS pos FROM docs WHERE NOT ends_with(filename, '.pdf.txt')),
      s AS (SELECT source, path FROM (SELECT concat('/in/', filename) AS source, concat('/in/', filename, '.txt') AS path FROM docs WHERE ends_with(filename, '.pdf')
            UNION ALL SELECT concat('/in/', filename), concat('/in/', filename) FROM docs) t),
      b AS (SELECT path, pos, 0 AS side FROM o UNION ALL SELECT s.path, o.pos, 1 FROM s JOIN o ON o.path = s.source),
      r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos, side) AS rn FROM b)
      SELECT path, pos, side FROM r WHERE rn = 1"""),
)
def _(spark, sf):
    path = F.concat(F.lit("/in/"), F.col("filename"))
    d = docs(spark, sf)
    originals = d.filter("NOT endswith(filename, '.pdf.txt')").select(path.alias("path"), F.col("doc_id").alias("pos"))
    sidecars = d.filter("endswith(filename, '.pdf')").select(path.alias("source"), F.concat(path, F.lit(".txt")).alias("path"))
    return K.augment_paths(originals, sidecars.union(d.select(path, path)))


_REG = "SELECT DISTINCT concat('kb', CAST(n_nationkey % 5 AS VARCHAR)) AS kb_name FROM nation WHERE n_nationkey % 5 <> 2"


def registered(spark, sf):
    return load(spark, sf, "nation").selectExpr("concat('kb', CAST(n_nationkey % 5 AS STRING)) AS kb_name").filter("kb_name <> 'kb2'")


@query("c05_require_kb_exists", oracle(["docs"], f"SELECT doc_id, kb_name FROM docs WHERE kb_name IN ({_REG})"))
def _(spark, sf):
    return K.require_kb(docs(spark, sf).select("doc_id", "kb_name"), registered(spark, sf))[0]


@query("c05_rejected_kb", oracle(["docs"], f"SELECT doc_id, kb_name FROM docs WHERE kb_name NOT IN ({_REG})"))
def _(spark, sf):
    return K.require_kb(docs(spark, sf).select("doc_id", "kb_name"), registered(spark, sf))[1]


_COLL = "concat(kb_name, CASE doc_id % 4 WHEN 0 THEN '_figures' WHEN 1 THEN '-figures' ELSE '' END)"


@query("u05_purge_kb", oracle(["docs"], f"SELECT doc_id, {_COLL} AS collection FROM docs WHERE kb_name IN ({_REG})"))
def _(spark, sf):
    stored = docs(spark, sf).select("doc_id", "kb_name", F.expr(_COLL).alias("collection"))
    removed = K.require_kb(stored.select("kb_name").distinct(), registered(spark, sf))[1]
    return K.purge_kb(stored.select("doc_id", "collection"), removed)


@query("u05_purge_job", oracle(["docs"], f"SELECT doc_id, {_COLL} AS collection FROM docs WHERE kb_name IN ({_REG})"))
def _(spark, sf):
    """The stored table after the job: collections of removed bases gone, the others' files untouched."""
    path = scratch(spark, "collections")
    rows = docs(spark, sf).select("doc_id", "kb_name", F.expr(_COLL).alias("collection"))
    rows.drop("kb_name").write.partitionBy("collection").parquet(path)
    removed = K.require_kb(rows.select("kb_name").distinct(), registered(spark, sf))[1]
    rewrite_partitions(spark, path, "collection", lambda stored: K.purge_kb(stored, removed), scratch(spark, "staging"))
    return spark.read.parquet(path).select("doc_id", "collection")


@query("c15_already_synced", oracle(["docs"], "SELECT doc_id, concat(kb_name, '/', filename) AS source FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.concat_ws("/", "kb_name", "filename").alias("source"))
    return K.already_synced(rows, rows.join(load(spark, sf, "labels"), "doc_id", "left_semi"))


@query(
    "c13_prefer_longer_sidecar",
    """WITH s AS (SELECT doc_id, CASE WHEN quality = 1 THEN concat(text, text) ELSE concat(text, '.') END AS side FROM documents JOIN labels USING (doc_id))
      SELECT d.doc_id, coalesce(length(side) > length(text) * 1.2, FALSE) AS replaced,
        CASE WHEN length(side) > length(text) * 1.2 THEN side ELSE text END AS text FROM documents d LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf):
    d = spread(load(spark, sf, "documents")).select("doc_id", "text")
    side = d.join(load(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.expr("CASE WHEN quality = 1 THEN concat(text, text) ELSE concat(text, '.') END AS text"))
    return K.prefer_longer_sidecar(d, side)


@query(
    "c16_resume_checkpoint",
    """WITH p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS pages_done FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS embedded, o_orderkey % 6 AS total_pages, coalesce(pages_done, 0) AS pages_done,
        CASE WHEN o_orderstatus = 'F' THEN 'skip' WHEN o_orderkey % 6 > 0 AND coalesce(pages_done, 0) >= o_orderkey % 6 AND coalesce(pages_done, 0) > 0
          THEN 'assemble' ELSE 'process' END AS action FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "o_orderstatus = 'F' AS embedded", "o_orderkey % 6 AS total_pages")
    return K.resume_action(rows, load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page"))


@query(
    "a09_assemble_pages",
    """SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part, string_agg(concat('--- Page ', CAST(turn + 1 AS VARCHAR), ' ---', chr(10), text), chr(10) || chr(10) ORDER BY turn) AS text
      FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    return K.assemble_pages(load(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn AS page", "text"))


_FIG = """SELECT doc_id, concat('f', CAST(doc_id AS STRING), '-', CAST(k AS STRING)) AS figure_id,
  CASE WHEN k = 0 THEN substring(text, 20, 12) ELSE '' END AS caption, CASE WHEN k = 1 THEN 'geometry' ELSE 'unknown' END AS fig_type,
  CASE WHEN k = 2 THEN substring(text, 900, 25) ELSE '' END AS ocr_text FROM study_docs JOIN (VALUES (0), (1), (2)) AS v(k) ON 1 = 1"""


@query(
    "c06_link_figures_to_chunks",
    oracle(["study_docs"], f""", f AS ({_FIG}), c AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substring(text, CAST(i * 800 + 1 AS BIGINT), 800) AS text
        FROM study_docs, range(0, 100) r(i) WHERE i * 800 < length(text))
      SELECT c.doc_id, c.chunk_index, f.figure_id FROM c JOIN f USING (doc_id)
      WHERE (caption <> '' AND contains(c.text, caption)) OR (regexp_matches(c.text, {q(R.FIGURE_REFERENCE)}) AND (caption <> '' OR fig_type <> 'unknown'))
        OR (length(ocr_text) > 10 AND contains(c.text, ocr_text))"""),
)
def _(spark, sf):
    d = study(spark, sf)
    chunked = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.{1,800})"), F.lit(1))).alias("i", "text"))
    figures = d.select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).selectExpr(
        "doc_id", "concat('f', CAST(doc_id AS STRING), '-', CAST(k AS STRING)) AS figure_id",
        "CASE WHEN k = 0 THEN substring(text, 20, 12) ELSE '' END AS caption", "CASE WHEN k = 1 THEN 'geometry' ELSE 'unknown' END AS fig_type",
        "CASE WHEN k = 2 THEN substring(text, 900, 25) ELSE '' END AS ocr_text",
    )
    return K.link_figures(chunked.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "text"), figures)


@query(
    "c07_answer_leak",
    """WITH q AS (SELECT doc_id * 2 AS question_id, doc_id AS learner_id, substr(text, 50) AS question FROM documents UNION ALL
        SELECT doc_id * 2 + 1, doc_id, concat(text, 'zz') FROM documents)
      SELECT question_id, learner_id, length(question) > 5 AND contains(replace(replace(text, ' ', ''), chr(10), ''),
        replace(replace(question, ' ', ''), chr(10), '')) AS withheld FROM q JOIN documents ON doc_id = learner_id""",
)
def _(spark, sf):
    d = spread(load(spark, sf, "documents"))
    questions = d.selectExpr(
        "doc_id AS learner_id", "inline(array(struct(doc_id * 2 AS question_id, substring(text, 50) AS question), "
        "struct(doc_id * 2 + 1 AS question_id, concat(text, 'zz') AS question)))")
    return K.answer_leak(questions, d.selectExpr("doc_id AS learner_id", "text AS context"))


# --- curriculum ----------------------------------------------------------------------------


@query(
    "b17_curriculum_lookups",
    oracle(["kps"], """SELECT 'core' AS lookup, kp_id, name FROM kps WHERE importance = 'core'
      UNION ALL SELECT 'chapter', kp_id, name FROM kps WHERE subject = 'math' AND grade = 'g7' AND chapter = 'ch7'
      UNION ALL SELECT 'semester', kp_id, name FROM kps WHERE subject = 'physics' AND grade = 'g8'"""),
)
def _(spark, sf):
    kps = view(spark, sf, "kps")
    parts = {
        "core": U.kp_by_importance(kps, "core"), "chapter": U.chapter_kps(kps, "math", "g7", "ch7"),
        "semester": U.semester_kps(kps, "physics", "g8"),
    }
    rows = [df.select(F.lit(name).alias("lookup"), "kp_id", "name") for name, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


_DUE = "CASE WHEN level < 0.3 THEN 1 WHEN level < 0.6 THEN 3 WHEN level < 0.8 THEN 7 WHEN level < 0.9 THEN 14 ELSE 30 END"


@query(
    "c01_enrich_due_reviews",
    oracle(["answers", "kps"], f""", {C_CTE}, ld AS (SELECT learner_id, kp_id, max(day) AS d FROM answers GROUP BY 1, 2),
      s AS (SELECT learner_id, kp_id, level, d + ({_DUE}) AS due FROM m JOIN ld USING (learner_id, kp_id))
      SELECT learner_id, s.kp_id, level, CAST(due AS VARCHAR) AS due, name, chapter, grade FROM s LEFT JOIN kps USING (kp_id) WHERE due <= DATE '{AS_OF}'"""),
)
def _(spark, sf):
    due = M.due_reviews(M.review_schedule(answers(spark, sf)), AS_OF)
    return U.enrich_due_reviews(due, view(spark, sf, "kps")).withColumn("due", F.col("due").cast("string"))


@query(
    "c02_knowledge_graph_nodes",
    oracle(["answers", "kps"], f""", b AS (SELECT min(learner_id) AS id FROM answers), {C_CTE}
      SELECT kps.kp_id, name, importance, coalesce(level, 0) AS level, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct
      FROM kps LEFT JOIN (SELECT * FROM m WHERE learner_id = (SELECT id FROM b)) mm USING (kp_id)"""),
)
def _(spark, sf):
    lv = levels(spark, sf)
    one = lv.join(answers(spark, sf).agg(F.min("learner_id").alias("learner_id")), "learner_id", "left_semi")
    graph = U.knowledge_graph(view(spark, sf, "kps").select("kp_id", "name", "importance"), one.select("kp_id", "level", "total", "correct"))
    return graph.select("kp_id", "name", "importance", "level", "total", "correct")


@query("c02_knowledge_graph_edges", KP_EDGES_ORACLE)
def _(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("kp_id"))
    pre = F.array_append(F.array(F.expr("kp_id div 2")), F.when(F.expr("kp_id % 3 = 1"), F.col("kp_id") - 1))
    kps = part.withColumn("prerequisites", F.when(F.col("kp_id") > 0, F.array_compact(pre)))
    return U.knowledge_edges(kps).select(F.col("pre").alias("pre_kp"), "kp")


_BK = """bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts DESC, answer_id DESC) AS rn
  FROM answers WHERE score < 0.5) x WHERE rn <= 50)"""


@query(
    "c03_weak_with_wrongs",
    oracle(["answers"], f""", {C_CTE}, {_BK},
      w AS (SELECT learner_id, split_part(kp_id, '/', 1) AS subject, kp_id, level FROM m WHERE level < 0.6),
      wr AS (SELECT *, row_number() OVER (PARTITION BY learner_id, subject ORDER BY level, kp_id) AS rn FROM w),
      e AS (SELECT learner_id, split_part(kp_id, '/', 1) AS subject, kp_id AS wrong_kp, answer_id, question, row_number() OVER
        (PARTITION BY learner_id, split_part(kp_id, '/', 1) ORDER BY ts DESC, answer_id DESC) AS rn FROM bk)
      SELECT wr.learner_id, wr.subject, kp_id, level, wrong_kp, answer_id, question FROM wr JOIN e ON e.learner_id = wr.learner_id
        AND e.subject = wr.subject WHERE wr.rn <= 8 AND e.rn <= 10"""),
)
def _(spark, sf):
    a = answers(spark, sf)
    return U.weak_with_wrongs(M.weak_points(M.mastery(a)), P.wrong_book(a).drop("rn"))


@query(
    "c10_prerequisite_chain",
    oracle(["answers"], f""", kc AS (SELECT learner_id, CAST(kp AS BIGINT) AS kp, count(*) AS total, count(*) FILTER (score >= 1) AS correct,
        count(*) FILTER (score > 0 AND score < 1) AS partial FROM answers GROUP BY 1, 2),
      lv AS (SELECT learner_id, kp, {level_oracle()} AS level FROM kc),
      ed AS ({KP_EDGES_ORACLE}), w AS (SELECT learner_id, kp FROM lv WHERE level < 0.6),
      f AS (SELECT DISTINCT w.learner_id, w.kp, e.pre_kp AS pre, CAST(1 AS BIGINT) AS depth FROM w JOIN ed e ON e.kp = w.kp
        UNION SELECT w.learner_id, w.kp, e2.pre_kp, 2 FROM w JOIN ed e ON e.kp = w.kp JOIN ed e2 ON e2.kp = e.pre_kp),
      n AS (SELECT learner_id, kp, pre, min(depth) AS depth FROM f WHERE pre <> kp GROUP BY 1, 2, 3),
      l AS (SELECT n.*, coalesce(lv.level, 0) AS level FROM n LEFT JOIN lv ON lv.learner_id = n.learner_id AND lv.kp = n.pre),
      r AS (SELECT *, row_number() OVER (PARTITION BY learner_id, kp ORDER BY depth, level, pre) AS rn FROM l WHERE level < 0.6)
      SELECT learner_id, kp, pre, level, depth, rn FROM r WHERE rn <= 5"""),
)
def _(spark, sf):
    a = answers(spark, sf)
    lv = M.mastery(a).withColumn("kp", F.regexp_extract("kp_id", r"kp(\d+)$", 1).cast("long"))
    return U.prerequisite_chain(
        lv.filter("level < 0.6").select("learner_id", "kp"), kp_edges(spark, sf).select(F.col("pre_kp").alias("pre"), "kp"), lv
    )
