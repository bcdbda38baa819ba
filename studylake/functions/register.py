"""SQL names for the scalar rules and the chunking table function.

``register(spark)`` creates temporary SQL functions, so the rules can be called from SQL text and
are optimised like any other expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from studylake.functions import rules as R


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_text(w)})" for w in words) + ")"


def _first(col: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {_text(w)}) THEN '{v}'" for w, v in table.items()) + f" ELSE '{default}' END"


def _bands(col: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_contains(col, ws)} THEN '{v}'" for v, ws in table.items()) + f" ELSE '{default}' END"


def _strip(col: str) -> str:
    return f"btrim({col}, {_text(R.WHITE)})"


def _digits(col: str) -> str:
    return f"regexp_extract_all({col}, '(?U)(\\\\d+)', 1)"


def _bare(col: str) -> str:
    return f"regexp_replace({_strip(col)}, {_text('(?U)' + R.ANSWER_TAIL)}, '')"


def definitions() -> dict[str, str]:
    """Function name -> signature and body."""
    s, c = _strip("s"), _strip("c")
    letters = "('A', 'B', 'C', 'D')"
    pack = """aggregate(split(t, '(?U)\\\\n\\\\s*\\\\n'), named_struct('done', CAST(array() AS ARRAY<STRING>), 'cur', ''),
      (acc, p) -> IF(length(acc.cur) + length(p) + 2 < size,
        named_struct('done', acc.done, 'cur', {join}),
        named_struct('done', IF(acc.cur = '', acc.done, array_append(acc.done, acc.cur)), 'cur', p)),
      acc -> IF(acc.cur = '', acc.done, array_append(acc.done, acc.cur)))""".format(join=_strip("concat(acc.cur, '\\n\\n', p)"))
    pieces = f"""flatten(transform({pack}, x -> IF(length(x) <= size, array(x),
      regexp_extract_all(x, concat('(?s)(.{{1,', CAST(size AS STRING), '}})'), 1))))"""
    packed = f"IF(length(t) <= size OR size({pieces}) = 0, array(t), {pieces})"
    return {
        "review_interval": "(l DOUBLE) RETURNS INT RETURN CASE WHEN l < 0.3 THEN 1 WHEN l < 0.6 THEN 3 WHEN l < 0.8 THEN 7 WHEN l < 0.9 THEN 14 ELSE 30 END",
        "mastery_band": "(l DOUBLE) RETURNS STRING RETURN CASE WHEN l >= 0.9 THEN 'consolidated' WHEN l >= 0.8 THEN 'mastered' "
        "WHEN l >= 0.6 THEN 'progressing' WHEN l >= 0.4 THEN 'learning' ELSE 'weak' END",
        "mastery_guidance": "(l DOUBLE, total BIGINT) RETURNS STRING RETURN CASE WHEN l < 0.3 AND total >= 2 THEN 'explain_basics' "
        "WHEN l < 0.5 THEN 'more_practice' WHEN l >= 0.8 AND total >= 3 THEN 'fewer_hints' ELSE '' END",
        "subject_from_filename": f"(f STRING) RETURNS STRING RETURN {_first('f', R.FILENAME_SUBJECTS, '')}",
        "subject_from_text": f"(t STRING) RETURNS STRING RETURN {_bands('t', R.TEXT_SUBJECTS, 'math')}",
        "infer_grade": f"(t STRING) RETURNS STRING RETURN {_bands('t', R.GRADE_BANDS, '')}",
        "match_answers": f"""(s STRING, c STRING) RETURNS BOOLEAN RETURN CASE WHEN {s} = '' OR {c} = '' THEN false
          WHEN upper({s}) = upper({c}) THEN true WHEN {s} IN {letters} AND {c} IN {letters} THEN false
          WHEN size({_digits('c')}) > 0 AND size(array_except({_digits('c')}, {_digits('s')})) = 0 THEN true
          ELSE {_bare('s')} <> '' AND {_bare('s')} = {_bare('c')} END""",
        "normalize_qtype": "(v STRING) RETURNS STRING RETURN CASE "
        + " ".join(
            f"WHEN regexp_replace(lower({_strip('v')}), '(?U)\\\\s+', '_') IN ({', '.join(map(_text, a))}) THEN '{k}'"
            for k, a in R.QUESTION_TYPES.items()
        )
        + " ELSE 'short_answer' END",
        "is_sidecar": f"(f STRING) RETURNS BOOLEAN RETURN lower(f) RLIKE {_text(R.SIDECAR_NAME)}",
        "pack_chunks": f"(t STRING, size INT) RETURNS ARRAY<STRING> RETURN {packed}",
        "chunk": f"(t STRING, size INT) RETURNS TABLE (chunk_index INT, text STRING) RETURN SELECT posexplode({packed})",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
