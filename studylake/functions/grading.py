"""Grading an answer against a key, and finding the key in an explanation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake.functions import rules as R
from studylake.functions.text import any_of, bind, strip


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\d+)"), F.lit(1))


def _pair(student: Column, correct: Column, body) -> Column:
    """Evaluate ``body`` on both answers stripped, with their digit runs, each computed once."""
    s, c = strip(student), strip(correct)
    pair = F.struct(s.alias("s"), c.alias("c"), _numbers(s).alias("sn"), _numbers(c).alias("cn"))
    return bind(pair, body)


def _same(p: Column) -> Column:
    letters = ["A", "B", "C", "D"]
    tail = "(?U)" + R.ANSWER_TAIL
    s, c = p["s"], p["c"]
    return (
        F.when((s == "") | (c == ""), False)
        .when((s == c) | (F.upper(s) == F.upper(c)), True)
        .when(s.isin(letters) & c.isin(letters), False)
        .when((F.size(p["cn"]) > 0) & (F.size(F.array_except(p["cn"], p["sn"])) == 0), True)
        .otherwise(bind(F.regexp_replace(s, tail, ""), lambda bare: (bare != "") & (bare == F.regexp_replace(c, tail, ""))))
    )


def _terms(text: Column) -> Column:
    """Bit set of the key terms in the text."""
    return sum((text.contains(t).cast("long") * (1 << i) for i, t in enumerate(R.KEY_TERMS)), F.lit(0).cast("long"))


def _near(p: Column) -> Column:
    letter = r"([a-d])\)?$"
    sn, cn = F.array_distinct(p["sn"]), F.array_distinct(p["cn"])
    lows = F.struct(F.lower(p["s"]).alias("s"), F.lower(p["c"]).alias("c"))

    def judge(low: Column) -> Column:
        s, c = low["s"], low["c"]
        s_letter, terms = F.regexp_extract(s, letter, 1), _terms(s)
        near = (
            ((s_letter != "") & (s_letter == F.regexp_extract(c, letter, 1)))
            | ((F.size(sn) > 0) & (F.size(cn) > 0) & (F.size(F.array_intersect(sn, cn)) >= F.size(cn) * 0.5))
            | ((terms != 0) & (terms == _terms(c)))
        )
        return (s != "") & (c != "") & (s != c) & near

    return bind(lows, judge)


def match_answers(student: Column, correct: Column) -> Column:
    """Same answer: equal text (case aside), every digit run of the key given, or equal without
    trailing units.  Two different option letters never match."""
    return _pair(student, correct, _same)


def match_semantic(student: Column, correct: Column) -> Column:
    """Right idea, not the same answer: same option letter, half of the numbers, same key terms."""
    return _pair(student, correct, _near)


def grade(student: Column, correct: Column) -> Column:
    """1 for the same answer, one half for the right idea, else 0."""
    return _pair(student, correct, lambda p: F.when(_same(p), 1.0).when(_near(p), 0.5).otherwise(0.0))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?Ud)" + pattern, 1), F.lit(""))


def extract_correct_answer(explanation: Column) -> Column:
    """The right answer an explanation states, looking no further than the next question."""
    text = F.split(explanation, r"(?U)\n第\s*\d+\s*题[：:]", 2)[0]
    candidates = [_found(text, p) for p in R.ANSWER_LETTER + R.ANSWER_NUMBER]
    for pattern in R.ANSWER_TEXT:
        answer = strip(F.regexp_extract(text, "(?Ud)" + pattern, 1))
        candidates.append(F.when((answer != "") & (F.length(answer) < 50), answer))
    equals = F.regexp_extract_all(text, F.lit(r"(?U)[=＝](\d+)"), F.lit(1))
    candidates.append(F.try_element_at(equals, F.lit(-1)))
    bare = strip(text)
    candidates.append(F.when(F.length(bare) < 50, _found(bare, r"(?m)^\s*(-?\d+(?:\.\d+)?)\s*$")))
    return F.coalesce(*candidates)


def extract_question_text(reply: Column) -> Column:
    """Text of the announced question, up to its options or a blank line."""
    return strip(F.regexp_extract(reply, r"(?Us)【第\d+题】(.+?)(?:\n[A-D][)．.、\s]|\n\n|$)", 1))


def strip_options(content: Column) -> Column:
    """Question text before its options, whether on lines of their own or inline; the whole text
    where nothing would be left."""
    own_line = r"(?U)(?:^|\n)[^\S\n]*[A-F](?:[\.．、]|[^\S\n]+\S)(?s:.*)$"
    inline = r"(?U)[^\S\n]+[A-F][\.．、\s][^\S\n]+\S(?s:.*)$"
    cut = strip(F.regexp_replace(F.regexp_replace(content, own_line, ""), inline, ""))
    return F.when(cut == "", content).otherwise(cut)


def normalize_qtype(value: Column) -> Column:
    name = F.regexp_replace(F.lower(strip(F.coalesce(value, F.lit("")))), r"(?U)\s+", "_")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, aliases in R.QUESTION_TYPES.items():
        out = out.when(name.isin(aliases), kind)
    return out.otherwise("short_answer")


def choice_key(correct: Column, options: Column) -> Column:
    """Option letter of an answer given as letter or as label.  ``options`` is a string map."""
    given = strip(F.coalesce(correct, F.lit("")))
    same = F.map_keys(F.map_filter(options, lambda k, v: F.lower(strip(F.coalesce(v, F.lit("")))) == F.lower(given)))
    return (
        F.when((given == "") | options.isNull(), "")
        .when(F.map_contains_key(options, F.upper(given)), F.upper(given))
        .otherwise(F.coalesce(F.upper(F.try_element_at(same, F.lit(1))), F.upper(given)))
    )


def concept_answer(correct: Column) -> Column:
    value = F.lower(strip(F.coalesce(correct, F.lit(""))))
    return F.when(value.isin("true", "false"), value).otherwise("")


def fig_type_from_text(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, R.FIGURE_SHAPES), "geometry")
        .when(low.rlike("[=xysincostanlim]") & low.rlike(r"(?U)\d"), "function_graph")
        .when(text.rlike(r"(?U)[│|]\s*[^│|]+\s*[│|]") | low.contains("table"), "table")
        .when(any_of(low, R.FIGURE_WORDS), "illustration")
        .otherwise("unknown")
    )


def figure_description(fig_type: Column, desc: Column, ocr_text: Column) -> Column:
    """One searchable line for a figure.

    ``desc`` is a struct with vertices, given, to_find_or_prove, function_hint, x_range, y_range,
    point_labels, raw, description and elements; absent parts are null.
    """

    def listed(label: str, items: Column, sep: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))

    def named(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    def span(label: str, ends: Column) -> Column:
        return F.when(
            F.size(ends) > 0, F.format_string(label + ": [%s, %s]", ends[0].cast("string"), ends[1].cast("string"))
        )

    head = F.concat(F.lit("["), fig_type, F.lit("]"))
    human = F.nullif(desc["description"], F.lit(""))
    geometry = F.concat_ws(
        " ", head, listed("顶点: ", desc["vertices"], "/"), listed("已知: ", desc["given"], "; "),
        named("求证/求: ", desc["to_find_or_prove"]), human,
    )
    graph = F.concat_ws(
        " ", head, named("函数类型: ", desc["function_hint"]), span("x范围", desc["x_range"]), span("y范围", desc["y_range"]),
        F.when(
            F.size(desc["point_labels"]) > 0,
            F.concat(F.lit("关键点: "), F.array_join(F.filter(desc["point_labels"], lambda p: p != ""), ", ")),
        ),
        human,
    )
    table = F.concat_ws(" ", head, F.nullif(desc["raw"], F.lit("")), F.when(human != F.coalesce(desc["raw"], F.lit("")), human))
    other = F.concat_ws(
        " ", head, F.coalesce(human, desc["raw"], F.lit("")), listed("元素: ", F.slice(desc["elements"], 1, 8), "; ")
    )
    body = (
        F.when(fig_type == "geometry", geometry).when(fig_type == "function_graph", graph)
        .when(fig_type == "table", table).otherwise(other)
    )
    return F.when(desc.isNotNull(), body).when(
        F.coalesce(ocr_text, F.lit("")) != "", F.concat(head, F.lit(" "), ocr_text)
    ).otherwise("")


def fig_type_from_description(keys: Column, kind: Column) -> Column:
    """Figure type from the field names of a description and its ``type`` value."""
    return (
        F.when(keys.isNull(), "unknown")
        .when(F.array_contains(keys, "figure_type"), "geometry")
        .when(F.array_contains(keys, "function_hint"), "function_graph")
        .when(F.array_contains(keys, "type") & (F.lower(kind) == "table"), "table")
        .otherwise("illustration")
    )
