"""Exam papers: structure from blocks, model replies, validation and regrading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions import rules as R
from studylake.functions.grading import grade, strip_options
from studylake.functions.text import first_of, strip
from studylake.operators.scan import Scan, by_heat

# Layout limits.
SELF_SUFFICIENT_CHARS = 10
HEADER_SHARE = 0.20


def layout_flags(blocks: DataFrame) -> DataFrame:
    """Per page: scanned, two columns, and text blocks that need recognition.

    ``blocks`` is (doc_id, page, block, type, x0, page_width, text).
    """
    is_text = F.col("type") == "text"
    chars = F.when(is_text, F.length(strip(F.coalesce("text", F.lit(""))))).otherwise(0)
    placed = is_text & (F.col("x0") > 0)
    return (
        blocks.groupBy("doc_id", "page")
        .agg(
            F.sum(chars).alias("chars"),
            F.count_if(placed).alias("_n"),
            F.count_if(placed & (F.col("x0") > F.col("page_width") * 0.45)).alias("_right"),
            F.count_if(is_text & (chars < SELF_SUFFICIENT_CHARS)).alias("needs_ocr"),
        )
        .select(
            "doc_id", "page", (F.col("chars") < SELF_SUFFICIENT_CHARS).alias("scanned"),
            ((F.col("_n") >= 4) & (F.col("_right") > F.col("_n") * 0.3)).alias("two_column"), "needs_ocr",
        )
    )


def figure_hint(primitives: DataFrame) -> DataFrame:
    """Kind of each drawing from the mix of its strokes.  ``primitives`` is (doc_id, drawing, op)."""
    def share(*ops: str) -> Column:
        return F.count_if(F.col("op").isin(*ops))

    n = primitives.groupBy("doc_id", "drawing").agg(
        share("l").alias("lines"), share("c", "qu").alias("curves"), share("re").alias("rects"), share("quad").alias("quads")
    )
    total = F.col("lines") + F.col("curves") + F.col("rects") + F.col("quads")
    hint = (
        F.when(total == 0, "unknown")
        .when(F.col("lines") / total > 0.6, "geometry")
        .when(F.col("curves") / total > 0.4, "function_graph")
        .when((F.col("rects") / total > 0.5) & (F.col("rects") >= 4), "table")
        .otherwise("illustration")
    )
    return n.select("doc_id", "drawing", hint.alias("hint"))


def structure_blocks(blocks: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Questions of each paper from its blocks in order.

    A block that starts like a question opens one; the running number of starts is the question
    index, found in slices for a paper with very many blocks.  Everything after that is one
    aggregation per question.  ``blocks`` is (doc_id, pos, page, type, text).
    """
    start = (F.col("type") == "text") & F.coalesce("text", F.lit("")).rlike("(?U)" + R.QUESTION_START)

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan(df, ["doc_id"], {"_starts": ("sum", start.cast("long")), "_n": ("count", F.lit(1))})

    rows = by_heat(blocks, ["doc_id"], ["pos"], F.floor(F.col("pos") / 1000), body, hot_rows)
    # Blocks before the first start form a question of their own, so numbers begin at 1 either way.
    opens = rows.filter(F.col("_n") == 1).select("doc_id", F.when(start, 0).otherwise(1).alias("_shift"))
    rows = rows.join(opens, "doc_id").withColumn("question", F.col("_starts") + F.col("_shift"))
    lines = F.transform(F.split("text", "\n"), strip)
    option = lambda line: line.rlike("(?U)" + R.CHOICE_OPTION)
    is_text = F.col("type") == "text"
    marks = F.regexp_extract("text", "(?U)" + R.QUESTION_MARKS, 1)
    rows = rows.select(
        "doc_id", "question", "pos", "page", is_text.alias("is_text"),
        F.when(is_text, F.filter(lines, lambda line: ~option(line))).alias("parts"),
        F.when(is_text, F.filter(lines, option)).alias("options"),
        F.when(is_text, marks.try_cast("double")).alias("score"),
    )

    def in_order(col: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("pos", col))))
        return F.flatten(F.transform(kept, lambda s: s[col]))

    q = rows.groupBy("doc_id", "question").agg(
        in_order("parts").alias("parts"), in_order("options").alias("options"),
        F.min_by("score", F.when(F.col("score").isNotNull(), F.col("pos"))).alias("score"),
        F.max_by("page", "pos").alias("page"), F.count_if(~F.col("is_text")).alias("figures"),
    )
    content = F.array_join("parts", "\n")
    kind = (
        F.when(F.size("options") > 0, "choice")
        .when(content.rlike(R.BLANK), "fill_blank")
        .when(strip(content).rlike(R.SOLUTION_PREFIX), "solution")
        .when((F.col("figures") > 0) & (F.size("parts") == 0), "construction")
        .when(F.length(content) > 80, "solution")
        .otherwise("unknown")
    )
    return q.select("doc_id", "question", kind.alias("type"), content.alias("content"), "options", "score", "page", "figures")


def paper_metadata(header: Column) -> dict[str, Column]:
    """Subject, grade, kind, year, total and minutes of a paper from its header text."""

    def found(pattern: str, kind: str, group: int = 1) -> Column:
        value = F.nullif(F.regexp_extract(header, "(?U)" + pattern, group), F.lit(""))
        return value if kind == "string" else value.try_cast(kind)

    return {
        "subject": first_of(header, R.PAPER_SUBJECTS),
        "grade": found(R.PAPER_GRADE, "string", 0),
        "exam_type": first_of(header, R.PAPER_KINDS),
        "year": found(R.PAPER_YEAR, "int"),
        "total_score": found(R.PAPER_TOTAL, "double"),
        "minutes": found(R.PAPER_MINUTES, "int"),
    }


def header_text(blocks: DataFrame) -> DataFrame:
    """Text of the blocks of page 0 that come before the first one reaching below the top fifth."""
    first = blocks.filter(F.col("page") == 0)
    deep = F.col("y1") > F.col("page_height") * HEADER_SHARE
    stop = first.filter(deep).groupBy("doc_id").agg(F.min("pos").alias("_stop"))
    top = first.join(stop, "doc_id", "left").filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("header"))


# What a question in a model reply must hold.
REQUIRED_TEXT = ["question_type", "content", "answer_key", "explanation"]
VALID_TYPES = ["choice", "fill_blank", "short_answer", "written"]
VALID_DIFFICULTIES = ["easy", "medium", "hard"]
REPLY = (
    "phase string, question struct<index: int, total: int, question_type: string, content: string, answer_key: string, "
    "explanation: string, knowledge_point: string, hints: array<string>, difficulty: string, options: map<string, string>>, "
    "next_question struct<index: int, total: int, question_type: string, content: string, answer_key: string, "
    "explanation: string, knowledge_point: string, hints: array<string>, difficulty: string, options: map<string, string>>"
)


def json_block(reply: Column) -> Column:
    """Last fenced block of a reply, else the reply itself if it is a bare object."""
    fenced = F.regexp_extract_all(reply, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1))
    bare = strip(reply)
    return F.coalesce(
        strip(F.try_element_at(fenced, F.lit(-1))), F.when(bare.startswith("{") & bare.endswith("}"), bare)
    )


def parse_model_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Question of each model reply with the list of what is wrong with it (empty: valid)."""
    raw = json_block(F.col(column))
    parsed = replies.withColumn("_raw", raw).withColumn("_p", F.from_json("_raw", REPLY))
    parsed = parsed.withColumn("q", F.coalesce("_p.question", "_p.next_question"))
    q = F.col("q")
    q_type, level = F.coalesce(q["question_type"], F.lit("short_answer")), F.coalesce(q["difficulty"], F.lit("medium"))
    index, total = F.coalesce(q["index"], F.lit(0)), F.coalesce(q["total"], F.lit(0))
    content = strip_options(F.coalesce(q["content"], F.lit("")))
    missing = [
        F.when(strip(F.coalesce(q[f], F.lit("short_answer" if f == "question_type" else ""))) == "", f"missing {f}")
        for f in REQUIRED_TEXT
    ]
    errors = F.array(
        F.when(F.col("_raw").isNull(), "no json"),
        F.when(F.col("_raw").isNotNull() & q.isNull(), "no question"),
        *[F.when(q.isNotNull(), m) for m in missing],
        F.when(q.isNotNull() & ~q_type.isin(VALID_TYPES), "invalid question_type"),
        F.when(q.isNotNull() & ~level.isin(VALID_DIFFICULTIES), "invalid difficulty"),
        F.when((q_type == "choice") & (F.coalesce(F.size(q["options"]), F.lit(0)) <= 0) & q.isNotNull(), "choice without options"),
        F.when(q.isNotNull() & (index > total), "index exceeds total"),
        F.when(q.isNotNull() & (index < 1), "index below 1"),
    )
    others = [c for c in replies.columns if c != column]
    return parsed.select(
        *others, F.col("_p.phase").alias("phase"), index.alias("index"), total.alias("total"), q_type.alias("question_type"),
        content.alias("content"), F.coalesce(q["answer_key"], F.lit("")).alias("answer_key"), q["options"].alias("options"),
        F.array_compact(errors).alias("errors"),
    )


def validate_against_paper(questions: DataFrame, paper: DataFrame) -> DataFrame:
    """Correct model questions by the extracted paper.

    The expected question is looked up; a wrong number takes over every field of the paper, a
    right number only the key, and a question the paper lacks asks for another try.
    ``questions`` is (paper_id, expected, index, question_type, content, answer_key).
    """
    truth = paper.select(
        "paper_id", F.col("index").alias("expected"), F.col("question_type").alias("_type"), F.col("content").alias("_content"),
        F.col("answer_key").alias("_key"), F.lit(True).alias("_known"),
    )
    rows = questions.join(truth, ["paper_id", "expected"], "left")
    known, wrong = F.col("_known").isNotNull(), F.col("index") != F.col("expected")

    def fixed(name: str, true: str) -> Column:
        return F.when(known & wrong, F.col(true)).otherwise(F.col(name))

    others = [c for c in questions.columns if c not in ("index", "question_type", "content", "answer_key")]
    return rows.select(
        *others,
        F.when(known, F.col("expected")).otherwise(F.col("index")).alias("index"),
        fixed("question_type", "_type").alias("question_type"), fixed("content", "_content").alias("content"),
        F.when(known, F.col("_key")).otherwise(F.col("answer_key")).alias("answer_key"),
        F.when(known, "pass").otherwise("nudge").alias("action"),
    )


def regrade(evaluations: DataFrame, paper: DataFrame) -> DataFrame:
    """Grade by the paper's key; without a key the given evaluation stands.

    ``evaluations`` is (paper_id, index, student_answer, is_correct, score).
    """
    keys = paper.select("paper_id", "index", F.col("answer_key").alias("_key"))
    rows = evaluations.join(keys, ["paper_id", "index"], "left")
    keyed = F.coalesce(F.col("_key"), F.lit("")) != ""
    # Graded once: an answer matches exactly if its grade is 1.
    rows = rows.withColumns({"keyed": keyed, "_grade": F.when(keyed, grade(F.col("student_answer"), F.col("_key")))})
    return rows.withColumns(
        {
            "is_correct": F.when(F.col("keyed"), F.col("_grade") == 1.0).otherwise(F.col("is_correct")),
            "score": F.when(F.col("keyed"), F.col("_grade")).otherwise(F.col("score")),
        }
    ).drop("_key", "_grade")


def paper_kp_summary(results: DataFrame) -> DataFrame:
    """Right answers, questions and rate per knowledge point of a paper."""
    out = results.groupBy("paper_id", "knowledge_point").agg(
        F.count_if(F.col("score") >= 1).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn("rate", F.col("correct") / F.greatest(F.col("total"), F.lit(1)))
