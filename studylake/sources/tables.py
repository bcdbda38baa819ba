"""Input tables and the study views derived from them.

``load`` reads one parquet table.  The views turn the general tables (events, documents, parts,
conversations ...) into the study data the operators expect; they are plain projections, so
filters and column pruning still reach the parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores when its files split into fewer pieces than there are.

    For rules that cost much per row.  A table of ordinary size has far more splits than cores and
    is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _kp_id(n: str) -> str:
    return (
        f"concat(CASE {n} % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END, "
        f"'/g', CAST(7 + {n} % 3 AS STRING), 's1/ch01/kp', CAST({n} AS STRING))"
    )


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# View name -> (base table, SELECT list, optional WHERE).  The text is valid in Spark and in the
# SQL oracle alike.
VIEWS: dict[str, str] = {
    "answers": f"""
        SELECT event_id AS answer_id, user_id AS learner_id, {_K} % 10 AS kp,
               {_kp_id(f"({_K} % 10)")} AS kp_id,
               concat('q', CAST({_K} AS STRING)) AS question,
               CAST(CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score,
               ts, CAST(ts AS DATE) AS day
        FROM events""",
    "quiz_raw": f"""
        SELECT event_id AS answer_id, user_id AS learner_id,
               CASE WHEN {_K} % 7 < 2 THEN '' ELSE {_kp_id(f"({_K} % 10)")} END AS kp_id,
               CASE WHEN {_K} % 7 = 1 THEN 'physics' ELSE '' END AS domain,
               CASE WHEN {_K} % 14 = 1 THEN concat('topic', CAST({_K} AS STRING)) ELSE '' END AS topic,
               event_type <> 'error' AS is_correct,
               CASE WHEN event_type = 'view' THEN value / 100 - 1 END AS raw_score
        FROM events""",
    "kps": f"""
        SELECT p_partkey AS kp, {_kp_id("p_partkey")} AS kp_id, p_name AS name,
               CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END AS subject,
               concat('g', CAST(7 + p_partkey % 3 AS STRING)) AS grade,
               concat('ch', CAST(p_size AS STRING)) AS chapter,
               CASE WHEN p_size % 2 = 0 THEN 'core' ELSE 'basic' END AS importance
        FROM part""",
    "docs": """
        SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS size,
               concat(CASE doc_id % 5 WHEN 0 THEN 'test_' WHEN 1 THEN '化学' WHEN 2 THEN '数学'
                                      WHEN 3 THEN '物理' ELSE 'note' END,
                      CAST(doc_id AS STRING),
                      CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf.txt'
                                      WHEN 2 THEN '.txt' ELSE '.docx' END) AS filename,
               concat('kb', CAST(doc_id % 3 AS STRING)) AS kb_name
        FROM documents""",
    "study_docs": """
        SELECT doc_id, concat(CASE doc_id % 10
            WHEN 0 THEN '七年级数学期中试卷 满分：120 时间 90分钟 2023'
            WHEN 1 THEN '八年级 化学方程式 2H2+O2 = 2H2O 燃烧反应 第 2 题 第十二题'
            WHEN 2 THEN '二年级 阅读 应用题（5分）'
            WHEN 3 THEN '物理 如图 电路图所示 初二 第一题'
            WHEN 4 THEN 'EMBED Equation.3'
            WHEN 5 THEN '设备温度多少度 wifi状态 存储空间'
            WHEN 6 THEN '教材 练习题 解释概念'
            WHEN 7 THEN '考试时间 90'
            WHEN 8 THEN concat('(1,2)(3,4)(5,6)(7,8)(9,1)(2,3)', repeat('�', 12))
            ELSE '全县统一考试 语文 五年级' END, chr(10), text) AS text
        FROM documents""",
    "replies": """
        SELECT conv_id, turn, concat('【第', CAST(turn + 1 AS STRING), '题】', text,
            CASE turn % 4 WHEN 0 THEN concat(chr(10), 'A. 1', chr(10), 'B. 2 [ANSWER_KEY:B]')
              WHEN 1 THEN concat(' 答案是', CAST(conv_id % 7 AS STRING), '。 [KP_ID:math/g7s1/ch01/kp', CAST(turn AS STRING), ']')
              WHEN 2 THEN concat(' 所以选C。', chr(10), '[ANSWER:correct:physics/g8s1/ch01/kp2]')
              ELSE ' 【知识点：绝对值】 x=12' END) AS reply
        FROM conversations""",
    "grading_pairs": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE l_linenumber % 4 WHEN 0 THEN l_returnflag
                    WHEN 1 THEN concat('x=', CAST(CAST(l_quantity AS INT) AS STRING))
                    WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' cm')
                    ELSE lower(l_linestatus) END AS student,
               CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 3 THEN l_linestatus
                    ELSE CAST(CAST(l_quantity AS INT) % 25 AS STRING) END AS correct
        FROM lineitem""",
    "create_attempts": f"""
        SELECT event_id AS attempt_id, user_id AS learner_id, event_id AS at_s,
               concat('t', CAST({_K} % 3 AS STRING)) AS title,
               CASE WHEN event_type = 'view' THEN 'webui' ELSE 'wechat' END AS source
        FROM events""",
    "uploads": f"""
        SELECT event_id AS upload_id, user_id AS learner_id, event_id AS at_s,
               concat('h', CAST({_K} % 20 AS STRING)) AS file_hash
        FROM events""",
    "backend_calls": """
        SELECT event_id AS call_id, event_id AS at_s, user_id % 3 AS backend,
               event_type <> 'error' AS ok
        FROM events""",
    "sessions": """
        SELECT o_orderkey AS session_id, o_custkey AS learner_id, concat('chat', CAST(o_custkey AS STRING)) AS chat_id,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'active' ELSE 'completed' END AS status,
               o_orderdate AS created_at, o_orderdate + INTERVAL 400 DAY AS expires_at,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('paper ', o_orderpriority) END AS title,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('file', CAST(o_orderkey AS STRING)) END AS source_file,
               CASE o_orderkey % 4 WHEN 0 THEN 'wechat' WHEN 1 THEN 'web_upload' WHEN 2 THEN 'auto_generated' ELSE 'other' END AS source,
               CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'exam' END AS task_type
        FROM orders""",
    "ingest_stages": f"""
        SELECT event_id, ts, concat(CAST(user_id AS STRING), '-', CAST({_K} AS STRING)) AS trace_id,
               CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'embedded' ELSE 'received' END AS stage
        FROM events""",
    "ingest_steps": f"""
        SELECT user_id AS run_id, {_K} AS file_id,
               CASE event_type WHEN 'error' THEN CASE WHEN {_K} % 2 = 0 THEN 'page_failed' ELSE 'error' END
                 WHEN 'view' THEN 'page_done' WHEN 'click' THEN 'page_skipped' ELSE 'file_out' END AS kind
        FROM events""",
    "book_events": f"""
        SELECT user_id AS book_id, event_id AS pos,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' ELSE 'other' END AS kind,
               CASE {_K} % 6 WHEN 0 THEN 'ideation' WHEN 1 THEN 'exploration' WHEN 2 THEN 'synthesis' WHEN 3 THEN 'critique'
                 WHEN 4 THEN 'overview' ELSE 'compilation' END AS stage
        FROM events""",
    "book_kinds": f"""
        SELECT user_id AS book_id, event_id AS pos, CAST({_K} AS BIGINT) AS chapter_count,
               CASE {_K} % 7 WHEN 0 THEN 'page_planning' WHEN 1 THEN 'page_compiled' WHEN 2 THEN 'page_ready' WHEN 3 THEN 'block_ready'
                 WHEN 4 THEN 'block_error' WHEN 5 THEN 'spine_round' ELSE 'spine_ready' END AS kind
        FROM events""",
    "telemetry": f"""
        SELECT event_id, ts, user_id AS device_id, 40 + value / 10 AS cpu,
               least(value / 4, CAST(100 AS DOUBLE)) AS used_percent, 100 - {_K} AS ssd_life
        FROM events""",
    "messages": """
        SELECT conv_id, conv_id * 1000 + turn AS message_id,
               CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent_id, role, text
        FROM conversations
        UNION ALL
        SELECT conv_id, conv_id * 1000 + turn + 500, conv_id * 1000 + turn - 1, role, concat('edited ', text)
        FROM conversations WHERE turn > 0 AND turn % 3 = 2""",
    "part_replies": """
        SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 0 ELSE p_partkey % 5 + 1 END AS idx, CASE p_partkey % 7 WHEN 0 THEN 1 ELSE 8 END AS total,
               CASE p_partkey % 4 WHEN 0 THEN 'choice' WHEN 1 THEN 'fill_blank' WHEN 2 THEN 'written' ELSE 'riddle' END AS qtype,
               CASE p_partkey % 6 WHEN 0 THEN '' ELSE concat(p_name, ' of ', p_brand) END AS content,
               CASE p_partkey % 11 WHEN 0 THEN '' ELSE p_brand END AS answer_key, p_type AS explanation,
               CASE p_partkey % 5 WHEN 0 THEN 'extreme' ELSE 'easy' END AS difficulty, p_partkey % 8 < 4 AS has_options,
               p_partkey % 10 AS form
        FROM part""",
    "paper_lines": """
        SELECT conv_id AS paper_id, turn + 1 AS line_no,
               concat('第', CAST(turn + 1 AS STRING), '题 ', text) AS line
        FROM conversations""",
}

_BASE = {
    "answers": ["events"], "quiz_raw": ["events"], "kps": ["part"], "docs": ["documents"], "study_docs": ["documents"],
    "replies": ["conversations"],
    "sessions": ["orders"], "ingest_stages": ["events"], "ingest_steps": ["events"],
    "book_events": ["events"], "book_kinds": ["events"],
    "grading_pairs": ["lineitem"], "create_attempts": ["events"], "uploads": ["events"],
    "backend_calls": ["events"], "telemetry": ["events"], "messages": ["conversations"],
    "paper_lines": ["conversations"], "part_replies": ["part"],
}


# Base tables whose rows are costly to process: long texts, and pairs to grade.
_COSTLY = {"documents", "conversations", "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``."""
    (base,) = _BASE[name]
    rows = spread(load(spark, sf_dir, base)) if base in _COSTLY else load(spark, sf_dir, base)
    return spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: rows})


def oracle(views: list[str], body: str) -> str:
    """Oracle text: the named views as common table expressions, then ``body``.

    ``body`` may itself start with further ``name AS (...)`` items ended by the main SELECT when
    written as ``, name AS (...) SELECT ...``.
    """
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if body.startswith("RECURSIVE"):
        body = body[len("RECURSIVE"):].strip()
        return f"WITH RECURSIVE {ctes}\n{body}" if ctes else f"WITH RECURSIVE {body.lstrip(',')}"
    return f"WITH {ctes}\n{body}" if ctes else body


def kp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisite edges (pre_kp -> kp) as two equi-joins instead of one OR condition."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("kp"))
    known = part.select(F.col("kp").alias("pre_kp"))
    half = part.filter("kp > 0").select(F.expr("kp div 2").alias("pre_kp"), "kp")
    before = part.filter("kp > 0 AND kp % 3 = 1").select((F.col("kp") - 1).alias("pre_kp"), "kp")
    return half.union(before).distinct().join(known, "pre_kp", "left_semi")


KP_EDGES_ORACLE = """
    SELECT DISTINCT pre_kp, kp FROM (
      SELECT p_partkey // 2 AS pre_kp, p_partkey AS kp FROM part WHERE p_partkey > 0
      UNION ALL
      SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 1) c
    WHERE pre_kp IN (SELECT p_partkey FROM part)"""
