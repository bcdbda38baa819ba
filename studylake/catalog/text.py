"""Text rules, classifiers and grading over whole tables."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.functions import grading as G
from studylake.functions import rules as R
from studylake.functions import text as T
from studylake.operators import mastery as M
from studylake.sources.tables import load, oracle, spread, view

WS = R.WHITE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def hits_sql(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(w)}) AS INT)" for w in words) + ")"


def first_sql(col: str, words: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {q(w)}) THEN '{v}'" for w, v in words.items()) + f" ELSE '{default}' END"


def bands_sql(col: str, bands: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(col, ws)} THEN '{b}'" for b, ws in bands.items()) + f" ELSE '{default}' END"


def strip_sql(col: str) -> str:
    return f"trim({col}, {q(WS)})"


def matches_sql(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def count_sql(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {q(pattern)}))"


def without_sql(col: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(by)}, 'g')"


EXT_SQL = r"lower(regexp_extract(filename, '[^/.](\.[^./]*)$', 1))"


def docs(spark, sf):
    return view(spark, sf, "docs")


def study(spark, sf):
    return view(spark, sf, "study_docs")


# --- identifiers, subjects, grades ---------------------------------------------------------


@query(
    "b01_kp_id",
    oracle(["kps"], """SELECT kp_id, split_part(kp_id, '/', 1) AS subject, split_part(kp_id, '/', 2) AS grade,
      split_part(kp_id, '/', 3) AS chapter, split_part(kp_id, '/', -1) AS name,
      concat(subject, '/', grade, 's1/ch01/kp', CAST(kp AS VARCHAR)) AS rebuilt FROM kps"""),
)
def _(spark, sf):
    parts = T.kp_parts(F.col("kp_id"))
    rebuilt = T.make_kp_id(
        F.col("subject"), F.expr("substring(grade, 2)"), F.lit("s1"), F.lit("ch01"), F.concat(F.lit("kp"), F.col("kp").cast("string"))
    )
    return view(spark, sf, "kps").select("kp_id", *[c.alias(n) for n, c in parts.items()], rebuilt.alias("rebuilt"))


@query("b02_subject_from_filename", oracle(["docs"], f"SELECT doc_id, filename, {first_sql('filename', R.FILENAME_SUBJECTS, '')} AS subject FROM docs"))
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "filename", T.subject_from_filename(F.col("filename")).alias("subject"))


_SUBJECT = bands_sql("text", R.TEXT_SUBJECTS, "math")
SUBJECT_SQL = f"coalesce(nullif({first_sql('filename', R.FILENAME_SUBJECTS, '')}, ''), {_SUBJECT})"
GRADE_BAND_SQL = bands_sql("text", R.GRADE_BANDS, "")


@query(
    "b03_detect_subject",
    oracle(["docs", "study_docs"], f"""SELECT d.doc_id, coalesce(nullif({first_sql('filename', R.FILENAME_SUBJECTS, '')}, ''),
      {_SUBJECT.replace('(text,', '(s.text,')}) AS subject FROM docs d JOIN study_docs s USING (doc_id)"""),
)
def _(spark, sf):
    both = docs(spark, sf).select("doc_id", "filename").join(study(spark, sf), "doc_id")
    return both.select("doc_id", T.detect_subject(F.col("text"), F.col("filename")).alias("subject"))


@query("b04_infer_grade", oracle(["study_docs"], f"SELECT doc_id, {bands_sql('text', R.GRADE_BANDS, '')} AS grade FROM study_docs"))
def _(spark, sf):
    return study(spark, sf).select("doc_id", T.infer_grade(F.col("text")).alias("grade"))


@query(
    "b05_is_educational",
    oracle(["study_docs"], f"""SELECT doc_id, length({strip_sql('text')}) >= 20 AND (
        {hits_sql('lower(text)', R.STUDY_WORDS)} >= 2 OR {matches_sql('text', R.STUDY_SECTION)}
        OR {matches_sql('text', R.STUDY_MARKS)}
        OR (length(text) > 50 AND {count_sql('text', f'[{R.MATH_SYMBOLS}]')} / length(text) > 0.02)) AS educational
      FROM study_docs"""),
)
def _(spark, sf):
    return study(spark, sf).select("doc_id", T.is_educational(F.col("text")).alias("educational"))


_GARBLED = f"""(length(s) < 10 OR {count_sql('text', '�')} > greatest(2, length(text) * 0.03) OR contains(text, '[STUB:')
  OR len(list_filter(string_split_regex(s, '\r\n|\n|\r'), lambda x: regexp_matches(x, {q(R.OLE_LINE)})))
     / len(string_split_regex(s, '\r\n|\n|\r')) > 0.5
  OR length({without_sql('s', r'[^\p{L}\p{N}\p{Z}\s]+')}) < length(s) * 0.6)"""


@query(
    "b06_is_garbled",
    oracle(["study_docs"], f""", t AS (SELECT *, {strip_sql('text')} AS s FROM study_docs)
      SELECT doc_id, {_GARBLED} AS garbled,
        {_GARBLED} OR (length(s) >= 15 AND {count_sql('s', '[一-鿿]')} < length(s) * 0.10) AS garbled_zh FROM t"""),
)
def _(spark, sf):
    text = F.col("text")
    return study(spark, sf).select(
        "doc_id", T.is_garbled(text, require_cjk=False).alias("garbled"), T.is_garbled(text).alias("garbled_zh")
    )


@query(
    "b07_is_garbled_v2",
    oracle(["study_docs"], f""", t AS (SELECT *, {strip_sql('text')} AS s FROM study_docs),
      u AS (SELECT *, length({without_sql('s', '[ ' + chr(10) + ']')}) AS solid, {count_sql('s', r'\([0-9]+,[0-9]+\)')} AS pairs FROM t)
      SELECT doc_id, length(text) > 0 AND ({count_sql('text', '�')} > greatest(10, length(text) * 0.1)
          OR (length(text) > 20 AND (length(text) - length({without_sql('text', r'[^\p{C}\p{Z}]|[ \n\r\t]')})) / length(text) < 0.5)) AS unprintable,
        (length(s) < 10 OR (solid > 20 AND {count_sql('s', '[一-鿿㐀-䶿]')} / greatest(solid, 1) < 0.03)
          OR (pairs > 5 AND pairs * 5 > solid)) AS coordinates FROM u"""),
)
def _(spark, sf):
    text = F.col("text")
    return study(spark, sf).select(
        "doc_id", T.is_garbled_printable(text).alias("unprintable"), T.is_garbled_coordinates(text).alias("coordinates")
    )


# --- intake --------------------------------------------------------------------------------

REJECT_SQL = f"""CASE WHEN coalesce(filename, '') = '' THEN 'empty filename'
  WHEN {EXT_SQL} <> '.txt' AND {matches_sql(strip_sql('filename'), R.SUSPICIOUS_NAME)} THEN 'test or temp filename'
  WHEN size < 50 AND {EXT_SQL} NOT IN ('.txt', '.md', '.csv', '.json', '.yaml', '.yml') THEN 'file too small' ELSE '' END"""


@query("b08_admission_reject", oracle(["docs"], f"SELECT doc_id, filename, size, {REJECT_SQL} AS reason FROM docs"))
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "filename", "size", T.admission_reject(F.col("filename"), F.col("size")).alias("reason"))


@query("b08_admission_counts", oracle(["docs"], f"SELECT {REJECT_SQL} AS reason, count(*) AS n FROM docs GROUP BY 1"))
def _(spark, sf):
    reason = T.admission_reject(F.col("filename"), F.col("size")).alias("reason")
    return docs(spark, sf).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_validate_upload",
    oracle(["docs"], f"""SELECT doc_id, CASE WHEN {EXT_SQL} NOT IN ({", ".join(map(q, R.UPLOAD_EXTENSIONS))}) THEN 'unsupported type'
      WHEN {EXT_SQL} = '.pdf' AND size > 5000 THEN 'pdf too large' WHEN size > 10000 THEN 'file too large' ELSE '' END AS error FROM docs"""),
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.upload_error(F.col("filename"), F.col("size"), 10000, 5000).alias("error"))


@query("b10_drop_sidecars", oracle(["docs"], f"SELECT doc_id, filename FROM docs WHERE NOT {matches_sql('lower(filename)', R.SIDECAR_NAME)}"))
def _(spark, sf):
    return docs(spark, sf).filter(~T.is_sidecar(F.col("filename"))).select("doc_id", "filename")


_NAMES = """SELECT c_custkey, concat(CASE c_custkey % 6 WHEN 0 THEN 'test' WHEN 1 THEN '_' WHEN 2 THEN 'e2e-' WHEN 3 THEN ' ' ELSE '' END,
  c_mktsegment, CAST(c_custkey AS STRING), CASE WHEN c_custkey % 7 = 0 THEN '_session' ELSE '' END) AS learner_id FROM customer"""


@query(
    "b11_filter_real_learners",
    f"""SELECT * FROM ({_NAMES}) t WHERE trim(learner_id) <> '' AND NOT starts_with(trim(learner_id), '_')
      AND NOT starts_with(trim(learner_id), 'e2e-') AND NOT starts_with(trim(learner_id), 'test')
      AND NOT ends_with(trim(learner_id), '_session')""",
)
def _(spark, sf):
    names = spark.sql(_NAMES.replace("FROM customer", "FROM {customer}"), customer=load(spark, sf, "customer"))
    return names.filter(M.is_real_learner(F.col("learner_id")))


def _types_sql() -> str:
    return " ".join(f"WHEN {EXT_SQL} IN ({', '.join(map(q, s))}) THEN '{k}'" for k, s in R.EXTENSION_TYPES.items())


@query(
    "b12_doc_type",
    oracle(["docs"], f"""SELECT doc_id, CASE {_types_sql()} WHEN {EXT_SQL} = '.pdf' THEN
        CASE WHEN (doc_id % 9 > 2 AND doc_id % 5 > 0) OR (doc_id % 5 > 0 AND size > 200) THEN 'exam_pdf'
             WHEN size > 100 THEN 'text_pdf' ELSE 'scanned_pdf' END ELSE 'unknown' END AS type FROM docs"""),
)
def _(spark, sf):
    kind = T.doc_type(T.extension(F.col("filename")), F.expr("doc_id % 9"), F.expr("doc_id % 5"), F.col("size"))
    return docs(spark, sf).select("doc_id", kind.alias("type"))


_LOW = strip_sql("lower(text)")


def _intent_sql() -> str:
    scores = [f"{hits_sql('low', ws)} AS i{n}" for n, ws in enumerate(R.INTENT_WORDS.values())]
    names = "".join(f" WHEN i{n} = best THEN '{name}'" for n, name in enumerate(R.INTENT_WORDS))
    best = ", ".join(f"i{n}" for n in range(len(R.INTENT_WORDS)))
    return f""", l AS (SELECT doc_id, {_LOW} AS low FROM study_docs), s AS (SELECT doc_id, {", ".join(scores)} FROM l),
      g AS (SELECT *, greatest({best}) AS best FROM s)
      SELECT doc_id, CASE WHEN best = 0 THEN 'none' {names} END AS intent,
        round(least(best / CAST(3 AS DOUBLE), CAST(0.95 AS DOUBLE)), 2) AS confidence FROM g"""


@query("b13_classify_intent", oracle(["study_docs"], _intent_sql()))
def _(spark, sf):
    intent, confidence = T.classify_intent(F.col("text"))
    return study(spark, sf).select("doc_id", intent.alias("intent"), confidence.alias("confidence"))


@query(
    "b14_detect_scene",
    oracle(["study_docs"], f""", l AS (SELECT doc_id, lower(text) AS low FROM study_docs),
      s AS (SELECT doc_id, {any_sql('low', R.DEVICE_WORDS)} AS dev,
        2 * CAST({any_sql('low', R.SCENE_GROUPS['practice'][0][0])} AS INT) AS p,
        2 * CAST({any_sql('low', R.SCENE_GROUPS['reading'][0][0])} AS INT) AS r FROM l)
      SELECT doc_id, CASE WHEN dev THEN 'full' WHEN p >= 3 AND p > r THEN 'practice' WHEN r >= 3 AND r > p THEN 'reading'
          ELSE 'full' END AS scene,
        CASE WHEN dev THEN 'device' WHEN p + r >= 5 THEN 'high' WHEN p + r >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM s"""),
)
def _(spark, sf):
    scene, confidence = T.detect_scene(F.col("text"))
    return study(spark, sf).select("doc_id", scene.alias("scene"), confidence.alias("confidence"))


_ROUTE = f"""CASE WHEN {EXT_SQL} IN ({', '.join(map(q, R.EXTENSION_TYPES['image']))}) THEN 'ocr'
  WHEN {EXT_SQL} IN ({', '.join(map(q, R.EXTENSION_TYPES['text']))}) THEN 'text' ELSE 'document_extract' END"""


@query(
    "b15_route_document",
    oracle(["docs"], f"""SELECT doc_id, {_ROUTE} AS route, CASE WHEN length(text) < 5000 THEN 'EDUCATION' ELSE 'DOCUMENT' END AS intent,
      {_ROUTE} IN ('ocr', 'document_extract') AS dual_index FROM docs"""),
)
def _(spark, sf):
    route, intent, dual = T.document_route(T.extension(F.col("filename")), F.col("text"))
    return docs(spark, sf).select("doc_id", route.alias("route"), intent.alias("intent"), dual.alias("dual_index"))


@query(
    "b16_formula_diagram",
    oracle(["study_docs"], f"""SELECT doc_id, {matches_sql('text', R.FORMULA)} AND regexp_matches(text, '[=＝+]') AS formula,
      regexp_matches(text, '(?i)[图图表][0-9一二三四五六七八九十]|如图|Fig[.]|diagram|graph|figure|所示|示意图|电路图|受力分析|光路|函数[图像]|坐标系|坐标图') AS diagram FROM study_docs"""),
)
def _(spark, sf):
    text = F.col("text")
    return study(spark, sf).select("doc_id", T.has_formula(text).alias("formula"), T.mentions_diagram(text).alias("diagram"))


# --- cleaning and reading ------------------------------------------------------------------


def _qnum_sql(col: str) -> str:
    out = f"regexp_replace({col}, '第\\s+([0-9]+)\\s+题', '第\\1题', 'g')"
    for value, numeral in enumerate(R.NUMERALS, 1):
        out = f"regexp_replace({out}, '第\\s*{numeral}\\s*题', '第{value}题', 'g')"
    return f"regexp_replace({out}, '第\\s*[一二三四五六七八九十]+\\s*题', '第0题', 'g')"


@query("h01_normalize_qnum", oracle(["study_docs"], f"SELECT doc_id, {_qnum_sql('text')} AS text FROM study_docs"))
def _(spark, sf):
    return study(spark, sf).select("doc_id", T.normalize_qnum(F.col("text")).alias("text"))


def _first_match(col: str, patterns) -> list[str]:
    return [f"nullif(regexp_extract({col}, {q(p)}, 1), '')" for p in patterns]


_ANSWER = ", ".join(
    _first_match("e", R.ANSWER_LETTER + R.ANSWER_NUMBER)
    + [
        f"CASE WHEN length({strip_sql(f'regexp_extract(e, {q(p)}, 1)')}) BETWEEN 1 AND 49 THEN {strip_sql(f'regexp_extract(e, {q(p)}, 1)')} END"
        for p in R.ANSWER_TEXT
    ]
    + ["regexp_extract_all(e, '[=＝]([0-9]+)', 1)[-1]"]
)


@query(
    "h02_extract_correct_answer",
    oracle(["replies"], f""", x AS (SELECT conv_id, turn, string_split_regex(reply, '\n第\\s*[0-9]+\\s*题[：:]')[1] AS e FROM replies)
      SELECT conv_id, turn, coalesce({_ANSWER}, '') AS answer FROM x"""),
)
def _(spark, sf):
    answer = G.extract_correct_answer(F.col("reply"))
    return view(spark, sf, "replies").select("conv_id", "turn", F.coalesce(answer, F.lit("")).alias("answer"))


@query(
    "h03_extract_question_text",
    oracle(["replies"], f"""SELECT conv_id, turn, {strip_sql(r"regexp_extract(reply, '(?s)【第[0-9]+题】(.+?)(?:' || chr(10) || '[A-D][)．.、\s]|' || chr(10) || chr(10) || '|$)', 1)")} AS question FROM replies"""),
)
def _(spark, sf):
    return view(spark, sf, "replies").select("conv_id", "turn", G.extract_question_text(F.col("reply")).alias("question"))


_TAIL = R.ANSWER_TAIL.replace(r"\s", r"\s\pZ")
MATCH_SQL = f"""(CASE WHEN s = '' OR c = '' THEN FALSE WHEN upper(s) = upper(c) THEN TRUE
  WHEN s IN ('A','B','C','D') AND c IN ('A','B','C','D') THEN FALSE
  WHEN len(regexp_extract_all(c, '[0-9]+')) > 0 AND list_has_all(regexp_extract_all(s, '[0-9]+'), regexp_extract_all(c, '[0-9]+')) THEN TRUE
  ELSE {without_sql('s', _TAIL)} <> '' AND {without_sql('s', _TAIL)} = {without_sql('c', _TAIL)} END)"""


def _terms_sql(col: str) -> str:
    return "concat(" + ", ".join(f"CAST(contains({col}, {q(t)}) AS INT)" for t in R.KEY_TERMS) + ")"


_NONE = q("0" * len(R.KEY_TERMS))
SEMANTIC_SQL = f"""(lower(s) <> '' AND lower(c) <> '' AND lower(s) <> lower(c) AND (
  (regexp_extract(lower(s), '([a-d])\\)?$', 1) <> '' AND regexp_extract(lower(s), '([a-d])\\)?$', 1) = regexp_extract(lower(c), '([a-d])\\)?$', 1))
  OR (len(regexp_extract_all(s, '[0-9]+')) > 0 AND len(regexp_extract_all(c, '[0-9]+')) > 0
      AND len(list_intersect(list_distinct(regexp_extract_all(s, '[0-9]+')), list_distinct(regexp_extract_all(c, '[0-9]+'))))
          >= len(list_distinct(regexp_extract_all(c, '[0-9]+'))) * 0.5)
  OR ({_terms_sql('lower(s)')} <> {_NONE} AND {_terms_sql('lower(s)')} = {_terms_sql('lower(c)')})))"""
PAIR_CTE = f""", p AS (SELECT l_orderkey, l_linenumber, l_partkey, {strip_sql('student')} AS s, {strip_sql('correct')} AS c FROM grading_pairs)"""
GRADE_SQL = f"CASE WHEN {MATCH_SQL} THEN CAST(1 AS DOUBLE) WHEN {SEMANTIC_SQL} THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def _pairs(spark, sf):
    return view(spark, sf, "grading_pairs")


_S, _C = "student", "correct"


@query("h04_match_answers", oracle(["grading_pairs"], f"{PAIR_CTE} SELECT l_orderkey, l_linenumber, l_partkey, {MATCH_SQL} AS matched FROM p"))
def _(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", G.match_answers(F.col(_S), F.col(_C)).alias("matched"))


@query("h05_match_semantic", oracle(["grading_pairs"], f"{PAIR_CTE} SELECT l_orderkey, l_linenumber, l_partkey, {SEMANTIC_SQL} AS near FROM p"))
def _(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", G.match_semantic(F.col(_S), F.col(_C)).alias("near"))


@query("h06_grade", oracle(["grading_pairs"], f"{PAIR_CTE} SELECT l_orderkey, l_linenumber, l_partkey, {GRADE_SQL} AS score FROM p"))
def _(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", G.grade(F.col(_S), F.col(_C)).alias("score"))


@query(
    "h07_parse_markers",
    oracle(["replies"], r"""SELECT conv_id, turn, regexp_extract(reply, '\[ANSWER_KEY:([^\]]+)\]', 1) AS answer_key,
      regexp_extract(reply, '\[KP_ID:([^\]]+)\]', 1) AS kp_id,
      regexp_extract(reply, '\[ANSWER:(correct|wrong):([^\]]+)\]', 1) AS verdict,
      regexp_extract(reply, '\[ANSWER:(correct|wrong):([^\]]+)\]', 2) AS verdict_kp,
      regexp_extract(reply, '【知识点[：:]([^】]+)】', 1) AS kp_name,
      regexp_replace(regexp_replace(regexp_replace(reply, '\s*\[ANSWER_KEY:([^\]]+)\]', '', 'g'),
        '\s*\[KP_ID:([^\]]+)\]', '', 'g'), '\n?\[ANSWER:(correct|wrong):([^\]]+)\]', '', 'g') AS clean_text FROM replies"""),
)
def _(spark, sf):
    return view(spark, sf, "replies").select(
        "conv_id", "turn", *[c.alias(n) for n, c in T.parse_markers(F.col("reply")).items()]
    )


@query(
    "h08_strip_ole",
    oracle(["study_docs"], f"""SELECT doc_id, {strip_sql(without_sql(without_sql('text', R.OLE_REMNANT.replace('(?=[EOHPRTS])', '')), chr(10) + '{3,}', chr(10) * 2))} AS text
      FROM study_docs"""),
)
def _(spark, sf):
    return study(spark, sf).select("doc_id", T.strip_ole(F.col("text")).alias("text"))


def _html_sql(col: str) -> str:
    for tag in R.HTML_BLOCKS:
        col = without_sql(col, rf"(?is)<{tag}[^>]*>.*?</{tag}>")
    return without_sql(without_sql(col, R.HTML_QUOTED_HANDLER), R.HTML_BARE_HANDLER)


@query("h09_sanitize_html", f"SELECT page_id, {_html_sql('html')} AS html FROM pages")
def _(spark, sf):
    return spread(load(spark, sf, "pages")).select("page_id", T.sanitize_html(F.col("html")).alias("html"))


_KEEP = f"""NOT ({matches_sql('x', R.TITLE_PAGE_LINE)} OR {matches_sql('x', R.TITLE_NOISE)} OR {matches_sql('x', R.TITLE_QUESTION)}
  OR {matches_sql('x', R.TITLE_OPTION)} OR length(x) - length(replace(x, '|', '')) >= 2
  OR (length(x) > 15 AND {matches_sql('x', R.TITLE_MEASURES)}) OR (length(x) > 30 AND {matches_sql('x', R.TITLE_SENTENCE)}))"""


@query(
    "h11_derive_title",
    oracle(["study_docs"], f""", l AS (SELECT doc_id, list_filter(list_transform(string_split({strip_sql('text')}, chr(10)),
          lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM study_docs),
      c AS (SELECT doc_id, ls, list_filter(list_transform(list_filter(ls, lambda x: {_KEEP}),
          lambda x: regexp_replace(x, '^[-─═━\\s]+', '')), lambda x: length(x) > 3) AS cs FROM l)
      SELECT doc_id, coalesce(list_filter(cs, lambda x: {matches_sql('x', R.TITLE_WORDS)})[1][1:50], cs[1][1:50],
        list_filter(ls, lambda x: length(x) > 2 AND NOT {matches_sql('x', R.TITLE_QUESTION)}
          AND NOT {matches_sql('x', R.TITLE_LAST_RESORT_SKIP)})[1][1:50], '') AS title FROM c"""),
)
def _(spark, sf):
    return study(spark, sf).select("doc_id", T.derive_title(F.col("text")).alias("title"))


@query(
    "h12_strip_options",
    oracle(["replies"], f""", c AS (SELECT conv_id, turn, reply, {strip_sql(without_sql(without_sql(
        'reply', r'(?s)(^|' + chr(10) + r')[ 	]*[A-F]([.．、]|[ 	]+[^\s]).*$'), r'(?s)[ 	]+[A-F][.．、\s][ 	]+[^\s].*$'))} AS cut FROM replies)
      SELECT conv_id, turn, CASE WHEN cut = '' THEN reply ELSE cut END AS content FROM c"""),
)
def _(spark, sf):
    return view(spark, sf, "replies").select("conv_id", "turn", G.strip_options(F.col("reply")).alias("content"))


@query(
    "h14_question_types",
    f"""SELECT p_partkey, CASE {" ".join(f"WHEN regexp_replace(lower(trim(t)), '[[:space:]]+', '_', 'g') IN ({', '.join(map(q, a))}) THEN '{k}'" for k, a in R.QUESTION_TYPES.items())}
      ELSE 'short_answer' END AS type,
      CASE WHEN given = '' THEN '' WHEN upper(given) IN ('A', 'B') THEN upper(given)
           WHEN lower(given) = lower(trim(p_name)) THEN 'A' WHEN lower(given) = lower(trim(p_brand)) THEN 'B' ELSE upper(given) END AS answer_key,
      CASE WHEN lower(given) IN ('true', 'false') THEN lower(given) ELSE '' END AS concept
    FROM (SELECT p_partkey, p_name, p_brand, CASE p_size % 8 WHEN 0 THEN ' MCQ ' WHEN 1 THEN 'True False' WHEN 2 THEN 'cloze'
        WHEN 3 THEN 'essay' WHEN 4 THEN 'code' WHEN 5 THEN 'open-ended' WHEN 6 THEN '' ELSE p_type END AS t,
      CASE p_partkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_brand WHEN 3 THEN 'TRUE' WHEN 4 THEN '' ELSE 'e' END AS given
      FROM part) x""",
)
def _(spark, sf):
    rows = load(spark, sf, "part").selectExpr(
        "p_partkey", "map('A', p_name, 'B', p_brand) AS options",
        """CASE p_size % 8 WHEN 0 THEN ' MCQ ' WHEN 1 THEN 'True False' WHEN 2 THEN 'cloze' WHEN 3 THEN 'essay'
           WHEN 4 THEN 'code' WHEN 5 THEN 'open-ended' WHEN 6 THEN '' ELSE p_type END AS t""",
        """CASE p_partkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_brand WHEN 3 THEN 'TRUE'
           WHEN 4 THEN '' ELSE 'e' END AS given""",
    )
    return rows.select(
        "p_partkey", G.normalize_qtype(F.col("t")).alias("type"), G.choice_key(F.col("given"), F.col("options")).alias("answer_key"),
        G.concept_answer(F.col("given")).alias("concept"),
    )




@query(
    "h17_fig_type",
    oracle(["study_docs"], f"""SELECT doc_id, CASE WHEN {any_sql('lower(text)', R.FIGURE_SHAPES)} THEN 'geometry'
      WHEN regexp_matches(lower(text), '[=xysincostanlim]') AND regexp_matches(text, '[0-9]') THEN 'function_graph'
      WHEN regexp_matches(text, '[│|]\\s*[^│|]+\\s*[│|]') OR contains(lower(text), 'table') THEN 'table'
      WHEN {any_sql('lower(text)', R.FIGURE_WORDS)} THEN 'illustration' ELSE 'unknown' END AS fig_type
      FROM study_docs"""),
)
def _(spark, sf):
    return study(spark, sf).select("doc_id", G.fig_type_from_text(F.col("text")).alias("fig_type"))


@query(
    "h17_fig_type_from_description",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'unknown' WHEN p_partkey % 5 = 0 THEN 'geometry' WHEN p_partkey % 5 = 1 THEN 'function_graph'
      WHEN p_size % 3 = 0 THEN 'table' ELSE 'illustration' END AS fig_type FROM part""",
)
def _(spark, sf):
    keys = "CASE p_partkey % 5 WHEN 0 THEN array('type', 'figure_type') WHEN 1 THEN array('function_hint') WHEN 4 THEN NULL ELSE array('caption', 'type') END"
    kind = "CASE WHEN p_size % 3 = 0 THEN 'Table' ELSE p_type END"
    rows = load(spark, sf, "part").select("p_partkey", F.expr(keys).alias("keys"), F.expr(kind).alias("kind"))
    return rows.select("p_partkey", G.fig_type_from_description(F.col("keys"), F.col("kind")).alias("fig_type"))


@query(
    "h25_subject_of_kp",
    oracle(["kps"], """SELECT kp_id, CASE WHEN contains(kp_id, 'math') THEN 'math' WHEN contains(kp_id, 'physics') THEN 'physics'
      WHEN contains(kp_id, 'chemistry') THEN 'chemistry' ELSE 'math' END AS subject FROM kps"""),
)
def _(spark, sf):
    return view(spark, sf, "kps").select("kp_id", T.subject_of_kp(F.col("kp_id")).alias("subject"))


@query(
    "g16_total_questions",
    oracle(["study_docs", "replies"], """, t AS (SELECT doc_id AS id, 'doc' AS kind, text FROM study_docs UNION ALL
        SELECT conv_id, 'reply', string_agg(reply, chr(10) ORDER BY turn) FROM replies GROUP BY 1)
      SELECT id, kind, coalesce(list_max(list_transform(list_filter(list_concat(
        regexp_extract_all(text, '(?m)(?:第|^)\\s*([0-9]+)\\s*[.、．）\\)](?:\\s|[一-鿿　])|第\\s*([0-9]+)\\s*题', 1),
        regexp_extract_all(text, '(?m)(?:第|^)\\s*([0-9]+)\\s*[.、．）\\)](?:\\s|[一-鿿　])|第\\s*([0-9]+)\\s*题', 2)),
        lambda x: x <> ''), lambda x: CAST(x AS BIGINT))), 0) AS questions FROM t"""),
)
def _(spark, sf):
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "reply"))), lambda s: s["reply"]), "\n")
    papers = view(spark, sf, "replies").groupBy(F.col("conv_id").alias("id"), F.lit("reply").alias("kind")).agg(said.alias("text"))
    texts = study(spark, sf).select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), "text").union(papers)
    return texts.select("id", "kind", T.total_questions(F.col("text")).alias("questions"))
