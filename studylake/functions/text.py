"""Text rules as column expressions: cleaning, admission, classification.

Everything stays in built-in functions, so the rules run inside the scan stage of the table they
are applied to.  Patterns carry ``(?U)`` where white space or digits must be read as Unicode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake.functions import rules as R


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(R.WHITE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Conditions are evaluated lazily, so an expression repeated inside them would otherwise be
    computed again for every use.
    """
    return F.transform(F.array(value), body)[0]


def any_of(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def first_of(text: Column, words: dict[str, str], default: str | None = None) -> Column:
    """Value of the first word, in order, that occurs in the text."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, value in words.items():
        out = out.when(text.contains(word), value)
    return out.otherwise(F.lit(default))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]*)$", 1))


# --- subjects and grades -------------------------------------------------------------------


def subject_from_filename(filename: Column) -> Column:
    return first_of(filename, R.FILENAME_SUBJECTS, "")


def subject_from_text(text: Column, default: str = "math") -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for subject, words in R.TEXT_SUBJECTS.items():
        out = out.when(any_of(text, words), subject)
    return out.otherwise(default)


def detect_subject(text: Column, filename: Column, explicit: Column | None = None) -> Column:
    """Given subject, else the one the file name shows, else the one the text shows."""
    chain = [F.nullif(subject_from_filename(filename), F.lit("")), subject_from_text(text)]
    if explicit is not None:
        chain.insert(0, F.nullif(explicit, F.lit("")))
    return F.coalesce(*chain)


def infer_grade(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for band, words in R.GRADE_BANDS.items():
        out = out.when(any_of(text, words), band)
    return out.otherwise("")


def subject_of_kp(kp_id: Column) -> Column:
    name = F.lower(kp_id)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for subject, words in {
        "math": ["数学", "math"], "physics": ["物理", "physics"], "chemistry": ["化学", "chemistry"],
        "english": ["英语", "english"],
    }.items():
        out = out.when(any_of(name, words), subject)
    return out.otherwise("math")


def make_kp_id(domain: Column, grade: Column, semester: Column, chapter: Column, kp: Column) -> Column:
    return F.concat(domain, F.lit("/g"), grade, semester, F.lit("/"), chapter, F.lit("/"), kp)


def kp_parts(kp_id: Column) -> dict[str, Column]:
    """Subject, grade with semester, chapter and short name of a knowledge point id."""
    parts = F.split(kp_id, "/")
    return {
        "subject": parts[0],
        "grade": F.try_element_at(parts, F.lit(2)),
        "chapter": F.try_element_at(parts, F.lit(3)),
        "name": F.element_at(parts, -1),
    }


# --- admission -----------------------------------------------------------------------------


def is_educational(text: Column, min_chars: int = 20) -> Column:
    symbols = count_matches(text, f"[{R.MATH_SYMBOLS}]")
    long_enough = F.length(strip(text)) >= min_chars
    study = (
        bind(F.lower(text), lambda low: hits(low, R.STUDY_WORDS) >= 2)
        | text.rlike("(?U)" + R.STUDY_SECTION)
        | text.rlike("(?U)" + R.STUDY_MARKS)
        | ((F.length(text) > 50) & (symbols / F.length(text) > 0.02))
    )
    return long_enough & study


def is_garbled(text: Column, require_cjk: bool = True) -> Column:
    """Useless extraction: too short, replacement characters, stubs, object remnants, symbol noise
    and (for Chinese sources) hardly any Chinese."""

    def judge(s: Column) -> Column:
        n = F.length(s)
        lines = F.split(s, "\r\n|\n|\r")
        ole = F.size(F.filter(lines, lambda line: line.rlike(R.OLE_LINE)))
        bad = (
            (n < 10)
            | (count_matches(text, "�") > F.greatest(F.lit(2.0), F.length(text) * 0.03))
            | text.contains("[STUB:")
            | (ole / F.size(lines) > 0.5)
            | (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}\p{Z}\s]+", "")) < n * 0.6)
        )
        if require_cjk:
            bad = bad | ((n >= 15) & (count_chinese(s) < n * 0.10))
        return bad

    return bind(strip(text), judge)


def count_chinese(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^一-鿿]+", ""))


def is_garbled_printable(text: Column) -> Column:
    """Variant for recognised pages: replacement characters or mostly unprintable."""
    n = F.length(text)
    hidden = F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]+|[ \n\r\t]+", ""))
    return (n > 0) & (
        (count_matches(text, "�") > F.greatest(F.lit(10.0), n * 0.1)) | ((n > 20) & ((n - hidden) / n < 0.5))
    )


def is_garbled_coordinates(text: Column) -> Column:
    """Variant for a recogniser that may emit positions: too short, no Chinese, coordinate pairs."""

    def judge(s: Column) -> Column:
        solid = F.length(F.regexp_replace(s, "[ \n]+", ""))
        chinese = F.length(F.regexp_replace(s, "[^一-鿿㐀-䶿]+", ""))
        pairs = count_matches(s, r"\([0-9]+,[0-9]+\)")
        return (
            (F.length(s) < 10)
            | ((solid > 20) & (chinese / F.greatest(solid, F.lit(1)) < 0.03))
            | ((pairs > 5) & (pairs * 5 > solid))
        )

    return bind(strip(text), judge)


def admission_reject(filename: Column, size: Column) -> Column:
    """Reason a file may not enter a knowledge base; empty where it may."""
    ext = extension(filename)
    return (
        F.when(F.coalesce(filename, F.lit("")) == "", "empty filename")
        .when((ext != ".txt") & strip(filename).rlike(R.SUSPICIOUS_NAME), "test or temp filename")
        .when((size < R.SMALL_FILE_BYTES) & ~ext.isin(R.SMALL_TEXT_EXTENSIONS), "file too small")
        .otherwise("")
    )


def upload_error(
    filename: Column, size: Column, max_bytes: int = R.MAX_FILE_BYTES, max_pdf_bytes: int = R.MAX_FILE_BYTES
) -> Column:
    ext = extension(filename)
    return (
        F.when(~ext.isin(R.UPLOAD_EXTENSIONS), "unsupported type")
        .when((ext == ".pdf") & (size > max_pdf_bytes), "pdf too large")
        .when(size > max_bytes, "file too large")
        .otherwise("")
    )


def is_sidecar(filename: Column) -> Column:
    return F.lower(filename).rlike(R.SIDECAR_NAME)


def doc_type(ext: Column, pages: Column, images: Column, chars: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, suffixes in R.EXTENSION_TYPES.items():
        out = out.when(ext.isin(suffixes), kind)
    pdf = (
        F.when(((pages > 2) & (images > 0)) | ((images > 0) & (chars > 200)), "exam_pdf")
        .when(chars > 100, "text_pdf")
        .otherwise("scanned_pdf")
    )
    return out.when(ext == ".pdf", pdf).otherwise("unknown")


def document_route(ext: Column, text: Column) -> tuple[Column, Column, Column]:
    """Route, intent and whether the second index wants the document."""
    route = (
        F.when(ext.isin(R.EXTENSION_TYPES["image"]), "ocr")
        .when(ext.isin(R.EXTENSION_TYPES["text"]), "text")
        .otherwise("document_extract")
    )
    intent = F.when(F.length(text) < 5000, "EDUCATION").otherwise("DOCUMENT")
    return route, intent, route.isin("ocr", "document_extract")


# --- message rules -------------------------------------------------------------------------


def classify_intent(text: Column) -> tuple[Column, Column]:
    """Intent with most trigger words (first wins ties) and its confidence."""

    def judge(low: Column) -> Column:
        scores = F.array(*[hits(low, words) for words in R.INTENT_WORDS.values()])
        return F.struct(scores.alias("scores"), F.array_max(scores).alias("best"))

    found = bind(strip(F.lower(text)), judge)
    names = F.array(*[F.lit(name) for name in R.INTENT_WORDS])
    place = F.array_position(found["scores"], found["best"])
    intent = F.when(found["best"] == 0, "none").otherwise(F.element_at(names, place.cast("int")))
    return intent, F.round(F.least(found["best"] / 3.0, F.lit(0.95)), 2)


def detect_scene(message: Column, current: str = "full") -> tuple[Column, Column]:
    """Scene of a message and the confidence; device words override everything."""
    low = F.lower(message)
    score = {
        scene: sum((any_of(low, words).cast("int") * weight for words, weight in groups), F.lit(0))
        for scene, groups in R.SCENE_GROUPS.items()
    }
    practice, reading = score["practice"], score["reading"]
    device = any_of(low, R.DEVICE_WORDS)
    scene = (
        F.when(device, "full")
        .when((practice >= R.SCENE_THRESHOLD) & (practice > reading), "practice")
        .when((reading >= R.SCENE_THRESHOLD) & (reading > practice), "reading")
        .when((practice >= R.SCENE_THRESHOLD) & (practice == reading), current)
        .otherwise("full")
    )
    total = practice + reading
    confidence = F.when(device, "device").when(total >= 5, "high").when(total >= 2, "medium").otherwise("low")
    return scene, confidence


def has_formula(text: Column) -> Column:
    # The operator is looked for first: it is cheap and rules out most texts.
    return any_of(text, R.FORMULA_OPERATORS) & text.rlike(R.FORMULA)


def mentions_diagram(text: Column) -> Column:
    return any_of(F.lower(text), R.DIAGRAM_WORDS) | text.rlike(R.DIAGRAM)


# --- cleaning ------------------------------------------------------------------------------


def strip_ole(text: Column) -> Column:
    clean = F.regexp_replace(text, "(?U)" + R.OLE_REMNANT, "")
    return strip(F.regexp_replace(clean, "\n{3,}", "\n\n"))


def sanitize_html(html: Column) -> Column:
    for tag in R.HTML_BLOCKS:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    html = F.regexp_replace(html, R.HTML_QUOTED_HANDLER, "")
    return F.regexp_replace(html, R.HTML_BARE_HANDLER, "")


def strip_page_marks(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?m)^--- Page \d+ ---\s*", ""))


def normalize_qnum(text: Column) -> Column:
    """Question numbers in one form: Arabic digits, no inner spaces; unknown numerals become 0."""
    given = text
    text = F.regexp_replace(text, r"(?U)第\s+(\d+)\s+题", "第$1题")
    for value, numeral in enumerate(R.NUMERALS, 1):
        text = F.regexp_replace(text, rf"(?U)第\s*{numeral}\s*题", f"第{value}题")
    text = F.regexp_replace(text, r"(?U)第\s*[一二三四五六七八九十]+\s*题", "第0题")
    return F.when(given.contains("第"), text).otherwise(given)


def parse_markers(reply: Column) -> dict[str, Column]:
    """Hidden markers of a teaching reply, and the reply without them."""
    clean = reply
    for pattern in (r"\s*\[ANSWER_KEY:([^\]]+)\]", r"\s*\[KP_ID:([^\]]+)\]", r"\n?\[ANSWER:(correct|wrong):([^\]]+)\]"):
        clean = F.regexp_replace(clean, pattern, "")
    return {
        "answer_key": F.regexp_extract(reply, r"\[ANSWER_KEY:([^\]]+)\]", 1),
        "kp_id": F.regexp_extract(reply, r"\[KP_ID:([^\]]+)\]", 1),
        "verdict": F.regexp_extract(reply, r"\[ANSWER:(correct|wrong):([^\]]+)\]", 1),
        "verdict_kp": F.regexp_extract(reply, r"\[ANSWER:(correct|wrong):([^\]]+)\]", 2),
        "kp_name": F.regexp_extract(reply, r"【知识点[：:]([^】]+)】", 1),
        "clean_text": clean,
    }


def derive_title(text: Column) -> Column:
    """First line that reads like an exam title, else the first line that may be one.

    One pass over the lines that stops testing once a title is found: the costly checks run only
    on lines that could still change the answer.
    """
    lines = F.transform(F.split(strip(text), "\n"), strip)

    def clean(s: Column) -> Column:
        return F.substring(F.regexp_replace(s, r"(?U)^[-─═━\s]+", ""), 1, 50)

    def usable(s: Column) -> Column:
        bars = F.length(s) - F.length(F.replace(s, F.lit("|")))
        return (F.length(clean(s)) > 3) & ~(
            s.rlike(R.TITLE_NOISE)
            | s.rlike("(?U)" + R.TITLE_QUESTION)
            | s.rlike("(?U)" + R.TITLE_OPTION)
            | s.rlike("(?U)" + R.TITLE_PAGE_LINE)
            | (bars >= 2)
            | ((F.length(s) > 30) & s.rlike(R.TITLE_SENTENCE))
            | ((F.length(s) > 15) & s.rlike("(?U)" + R.TITLE_MEASURES))
        )

    def spare(s: Column) -> Column:
        return (F.length(s) > 2) & ~s.rlike("(?U)" + R.TITLE_QUESTION) & ~s.rlike("(?U)" + R.TITLE_LAST_RESORT_SKIP)

    none = F.lit(None).cast("string")
    start = F.struct(none.alias("title"), none.alias("first"), none.alias("spare"))

    def step(acc: Column, s: Column) -> Column:
        wordy = s.rlike(R.TITLE_WORDS)
        open_ = acc["first"].isNull() | wordy
        fits = F.when(open_, usable(s)).otherwise(False)
        return F.when(acc["title"].isNotNull() | (s == ""), acc).otherwise(
            F.when(
                fits,
                F.struct(
                    F.when(wordy, clean(s)).alias("title"), F.coalesce(acc["first"], clean(s)).alias("first"), acc["spare"].alias("spare")
                ),
            ).otherwise(
                F.struct(
                    acc["title"].alias("title"), acc["first"].alias("first"),
                    F.when(acc["first"].isNull() & acc["spare"].isNull() & spare(s), F.substring(s, 1, 50)).otherwise(acc["spare"]).alias("spare"),
                )
            )
        )

    return F.aggregate(lines, start, step, lambda acc: F.coalesce(acc["title"], acc["first"], acc["spare"], F.lit("")))


def total_questions(text: Column) -> Column:
    """Largest question number a paper mentions, 0 where none."""
    dotted = F.regexp_extract_all(
        text, F.lit(r"(?m)(?:第|^)\s*(\d+)\s*[.、．）\)](?:\s|(?=[一-鿿　]))|第\s*(\d+)\s*题"), F.lit(1)
    )
    worded = F.regexp_extract_all(
        text, F.lit(r"(?m)(?:第|^)\s*(\d+)\s*[.、．）\)](?:\s|(?=[一-鿿　]))|第\s*(\d+)\s*题"), F.lit(2)
    )
    numbers = F.transform(F.filter(F.concat(dotted, worded), lambda s: s != ""), lambda s: s.try_cast("long"))
    return F.coalesce(F.array_max(numbers), F.lit(0).cast("long"))
