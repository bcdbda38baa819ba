"""Exam papers: layout, structure, replies, grading against the paper."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.text import GRADE_SQL, MATCH_SQL, first_sql, q, strip_sql, study
from studylake.functions import grading as G
from studylake.functions import rules as R
from studylake.operators import exam as X
from studylake.sources.tables import load, oracle, spread, view

_BLOCK = """SELECT doc_id, pos, pos div 40 AS page, CASE WHEN pos % 7 = 6 THEN 'image' ELSE 'text' END AS type,
  CASE WHEN pos % 3 = 0 THEN 350 ELSE 50 END AS x0, 600 AS page_width, 14 * (pos % 40) + 14 AS y1, 700 AS page_height,
  CASE WHEN pos % 7 = 6 THEN '' WHEN pos % 5 = 2 THEN concat(CAST(pos % 90 + 1 AS STRING), '. ', l)
    WHEN pos % 5 = 3 THEN concat('A. ', l) WHEN pos % 10 = 4 THEN concat(l, ' ____（', CAST(pos % 9 + 1 AS STRING), '分）')
    ELSE l END AS text"""

_BLOCKS_SQL = f"""bl AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS l
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM study_docs) s),
  blocks AS ({_BLOCK.replace('pos div 40', 'pos // 40').replace(' AS STRING', ' AS VARCHAR')} FROM bl)"""


def blocks(spark, sf):
    lines = study(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    return spark.sql(_BLOCK + " FROM {lines}", lines=lines.withColumn("pos", F.col("pos").cast("long")))


@query(
    "b18_layout_flags",
    oracle(["study_docs"], f""", {_BLOCKS_SQL},
      c AS (SELECT *, CASE WHEN type = 'text' THEN length({strip_sql('text')}) ELSE 0 END AS n FROM blocks)
      SELECT doc_id, page, sum(n) < 10 AS scanned,
        count(*) FILTER (type = 'text' AND x0 > 0) >= 4 AND count(*) FILTER (type = 'text' AND x0 > page_width * 0.45) > count(*) FILTER (type = 'text' AND x0 > 0) * 0.3 AS two_column,
        count(*) FILTER (type = 'text' AND n < 10) AS needs_ocr FROM c GROUP BY 1, 2"""),
)
def _(spark, sf):
    return X.layout_flags(blocks(spark, sf))


_OPS = """SELECT l_orderkey AS doc_id, l_partkey % 3 AS drawing, CASE WHEN l_quantity < 20 THEN 'l' WHEN l_quantity < 30 THEN 'c'
  WHEN l_quantity < 32 THEN 'qu' WHEN l_quantity < 46 THEN 're' WHEN l_quantity < 49 THEN 'quad' ELSE 'other' END AS op FROM lineitem"""


@query(
    "b19_figure_hint",
    f"""WITH n AS (SELECT doc_id, drawing, count(*) FILTER (op = 'l') AS l, count(*) FILTER (op IN ('c', 'qu')) AS c, count(*) FILTER (op = 're') AS r,
        count(*) FILTER (op IN ('l', 'c', 'qu', 're', 'quad')) AS t FROM ({_OPS}) o GROUP BY 1, 2)
      SELECT doc_id, drawing, CASE WHEN t = 0 THEN 'unknown' WHEN l / t > 0.6 THEN 'geometry' WHEN c / t > 0.4 THEN 'function_graph'
        WHEN r / t > 0.5 AND r >= 4 THEN 'table' ELSE 'illustration' END AS hint FROM n""",
)
def _(spark, sf):
    return X.figure_hint(spark.sql(_OPS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, sf, "lineitem")))


_START = r"^\s*(?:[0-9]{1,3}[．.、]\s|[（(]\s*[0-9]{1,3}\s*[）)]|[一二三四五六七八九十]{1,2}[、．.]\s)"


@query(
    "x05_structure_blocks",
    oracle(["study_docs"], f""", {_BLOCKS_SQL},
      s AS (SELECT *, type = 'text' AND regexp_matches(text, {q(_START)}) AS st FROM blocks),
      n AS (SELECT *, count(*) FILTER (st) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
              + CASE WHEN first_value(st) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS question FROM s),
      o AS (SELECT *, {strip_sql('text')} AS line, regexp_matches({strip_sql('text')}, {q(R.CHOICE_OPTION)}) AS opt FROM n),
      g AS (SELECT doc_id, question, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (type = 'text' AND NOT opt), '') AS content,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (type = 'text' AND opt), '') AS options,
        count(*) FILTER (type = 'text' AND opt) AS n_opt, count(*) FILTER (type = 'text' AND NOT opt) AS n_part,
        coalesce(arg_min(TRY_CAST(nullif(regexp_extract(text, {q(R.QUESTION_MARKS)}, 1), '') AS DOUBLE), pos)
          FILTER (type = 'text' AND regexp_matches(text, {q(R.QUESTION_MARKS)})), -1) AS score,
        arg_max(page, pos) AS page, count(*) FILTER (type <> 'text') AS figures FROM o GROUP BY 1, 2)
      SELECT doc_id, question, CASE WHEN n_opt > 0 THEN 'choice' WHEN regexp_matches(content, {q(R.BLANK)}) THEN 'fill_blank'
          WHEN regexp_matches({strip_sql('content')}, {q(R.SOLUTION_PREFIX)}) THEN 'solution' WHEN figures > 0 AND n_part = 0 THEN 'construction'
          WHEN length(content) > 80 THEN 'solution' ELSE 'unknown' END AS type, content, options, score, page, figures FROM g"""),
)
def _(spark, sf):
    found = X.structure_blocks(blocks(spark, sf))
    return found.withColumn("options", F.array_join("options", "\n")).na.fill(-1.0, ["score"])


def _extract(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(header, {q(pattern)}, {group}), '')"


@query(
    "h16_paper_metadata",
    oracle(["study_docs"], f""", {_BLOCKS_SQL},
      t AS (SELECT *, min(pos) FILTER (y1 > page_height * 0.2) OVER (PARTITION BY doc_id) AS stop FROM blocks WHERE page = 0),
      h AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (text <> ''), '') AS header FROM t WHERE stop IS NULL OR pos < stop GROUP BY 1)
      SELECT doc_id, coalesce(nullif({first_sql('header', R.PAPER_SUBJECTS, '')}, ''), '') AS subject, coalesce({_extract(R.PAPER_GRADE, 0)}, '') AS grade,
        coalesce(nullif({first_sql('header', R.PAPER_KINDS, '')}, ''), '') AS exam_type, coalesce(CAST({_extract(R.PAPER_YEAR)} AS INT), 0) AS year,
        coalesce(TRY_CAST({_extract(R.PAPER_TOTAL)} AS DOUBLE), 0) AS total_score, coalesce(TRY_CAST({_extract(R.PAPER_MINUTES)} AS INT), 0) AS minutes FROM h"""),
)
def _(spark, sf):
    header = X.header_text(blocks(spark, sf))
    cols = [c.alias(n) for n, c in X.paper_metadata(F.col("header")).items()]
    return header.select("doc_id", *cols).na.fill("").na.fill(0)


@query(
    "h13_parse_model_replies",
    oracle(["part_replies"], """, r AS (SELECT *, form < 8 AS ok FROM part_replies)
      SELECT p_partkey, CASE WHEN ok THEN idx ELSE 0 END AS index, CASE WHEN ok THEN qtype ELSE 'short_answer' END AS question_type,
        CASE WHEN ok THEN content ELSE '' END AS content, CASE WHEN NOT ok THEN CASE form WHEN 8 THEN 'no json' ELSE 'no question' END ELSE concat_ws(',',
          CASE WHEN content = '' THEN 'missing content' END, CASE WHEN answer_key = '' THEN 'missing answer_key' END,
          CASE WHEN qtype = 'riddle' THEN 'invalid question_type' END, CASE WHEN difficulty = 'extreme' THEN 'invalid difficulty' END,
          CASE WHEN qtype = 'choice' AND NOT has_options THEN 'choice without options' END, CASE WHEN idx > total THEN 'index exceeds total' END,
          CASE WHEN idx < 1 THEN 'index below 1' END) END AS errors FROM r"""),
)
def _(spark, sf):
    rows = view(spark, sf, "part_replies")
    body = F.to_json(F.struct(
        F.lit("FIRST_QUESTION").alias("phase"),
        F.struct(
            F.col("idx").alias("index"), "total", F.col("qtype").alias("question_type"), "content", "answer_key", "explanation", "difficulty",
            F.when(F.col("has_options"), F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2"))).alias("options"),
        ).alias("question"),
    ))
    fenced = F.concat(F.lit("first\n```json\n{\"phase\": \"X\"}\n```\nthen\n```json\n"), body, F.lit("\n```\nbye"))
    reply = (
        F.when(F.col("form") < 4, fenced).when(F.col("form") < 8, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(F.col("form") == 8, F.lit("no block here")).otherwise('{"phase": "X"}')
    )
    found = X.parse_model_replies(rows.select("p_partkey", reply.alias("reply")))
    return found.select("p_partkey", "index", "question_type", "content", F.array_join("errors", ",").alias("errors")).withColumn(
        "index", F.col("index").cast("long")
    )


_KEYS = """SELECT l_orderkey AS paper_id, l_linenumber AS index, min(CASE l_returnflag WHEN 'A' THEN 'choice' ELSE 'written' END) AS question_type,
  concat('line ', CAST(min(l_partkey) AS STRING)) AS content, min(CASE l_returnflag WHEN 'N' THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END) AS answer_key
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_MADE = """SELECT l_orderkey AS paper_id, l_linenumber + CAST(l_suppkey % 5 = 0 AS INT) AS expected, l_linenumber + CAST(l_partkey % 4 = 0 AS INT) AS index,
  'written' AS question_type, concat('said ', CAST(l_partkey AS STRING)) AS content, l_linestatus AS answer_key, l_partkey, l_suppkey, l_quantity FROM lineitem"""


def _lines(spark, sf, text):
    return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spread(load(spark, sf, "lineitem")))


@query(
    "c11_validate_against_paper",
    f"""WITH k AS ({_KEYS}), m AS ({_MADE}) SELECT m.paper_id, m.expected, m.l_partkey, m.l_suppkey, m.l_quantity,
      CASE WHEN k.index IS NOT NULL THEN m.expected ELSE m.index END AS index,
      CASE WHEN k.index IS NOT NULL AND m.index <> m.expected THEN k.question_type ELSE m.question_type END AS question_type,
      CASE WHEN k.index IS NOT NULL AND m.index <> m.expected THEN k.content ELSE m.content END AS content,
      CASE WHEN k.index IS NOT NULL THEN k.answer_key ELSE m.answer_key END AS answer_key,
      CASE WHEN k.index IS NOT NULL THEN 'pass' ELSE 'nudge' END AS action
      FROM m LEFT JOIN k ON k.paper_id = m.paper_id AND k.index = m.expected""",
)
def _(spark, sf):
    return X.validate_against_paper(_lines(spark, sf, _MADE), _lines(spark, sf, _KEYS))


_EVAL = """SELECT l_orderkey AS paper_id, l_linenumber + CAST(l_suppkey % 7 = 0 AS INT) AS index, concat('x=', CAST(CAST(l_quantity AS INT) AS STRING)) AS student_answer,
  l_returnflag = 'R' AS is_correct, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS score, l_partkey, l_suppkey FROM lineitem"""


@query(
    "c12_regrade",
    f"""WITH k AS ({_KEYS}), v AS ({_EVAL}), j AS (SELECT v.*, coalesce(k.answer_key, '') AS c, student_answer AS s FROM v
        LEFT JOIN k ON k.paper_id = v.paper_id AND k.index = v.index)
      SELECT paper_id, index, student_answer, l_partkey, l_suppkey, CASE WHEN c <> '' THEN {MATCH_SQL} ELSE is_correct END AS is_correct,
        CASE WHEN c <> '' THEN {GRADE_SQL} ELSE score END AS score, c <> '' AS keyed FROM j""",
)
def _(spark, sf):
    return X.regrade(_lines(spark, sf, _EVAL), _lines(spark, sf, _KEYS))


@query(
    "g11_paper_kp_summary",
    """SELECT l_orderkey AS paper_id, concat('kp', CAST(l_partkey % 5 AS VARCHAR)) AS knowledge_point, count(*) FILTER (l_returnflag = 'R') AS correct,
      count(*) AS total, count(*) FILTER (l_returnflag = 'R') / count(*) AS rate FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS paper_id", "concat('kp', CAST(l_partkey % 5 AS STRING)) AS knowledge_point",
        "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS score",
    )
    return X.paper_kp_summary(rows)


@query(
    "h18_figure_description",
    """SELECT p_partkey, CASE p_size % 5
        WHEN 0 THEN concat('[geometry] 顶点: A/B 已知: ', p_name, ' 求证/求: ', p_type)
        WHEN 1 THEN concat('[function_graph] 函数类型: ', p_type, ' x范围: [0, ', CAST(p_size AS VARCHAR), '] 关键点: P')
        WHEN 2 THEN concat('[table] ', p_name)
        WHEN 3 THEN concat('[illustration] ', p_name, ' 元素: ', p_brand, '; ', p_type)
        ELSE concat('[unknown] ', p_name) END AS description FROM part""",
)
def _(spark, sf):
    none, size = "CAST(array() AS array<string>)", "p_size % 5"
    rows = load(spark, sf, "part").selectExpr(
        "p_partkey", "p_name",
        f"CASE {size} WHEN 0 THEN 'geometry' WHEN 1 THEN 'function_graph' WHEN 2 THEN 'table' WHEN 3 THEN 'illustration' ELSE 'unknown' END AS fig_type",
        f"""CASE WHEN {size} < 4 THEN named_struct('vertices', IF({size} = 0, array('A', 'B'), {none}), 'given', IF({size} = 0, array(p_name), {none}),
          'to_find_or_prove', IF({size} = 0, p_type, ''), 'function_hint', IF({size} = 1, p_type, ''),
          'x_range', IF({size} = 1, array(0, p_size), CAST(array() AS array<int>)), 'y_range', CAST(array() AS array<int>),
          'point_labels', IF({size} = 1, array('P', ''), {none}), 'raw', IF({size} = 2, p_name, ''), 'description', IF({size} = 3, p_name, ''),
          'elements', IF({size} = 3, array(p_brand, p_type), {none})) END AS d""",
    )
    return rows.select("p_partkey", G.figure_description(F.col("fig_type"), F.col("d"), F.col("p_name")).alias("description"))
