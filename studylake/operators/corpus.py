"""Corpus preparation: chunking, splitting, content ids, dedup, linking, resume.

Everything that works inside one document is array work on its row, so it runs in the scan stage
without a shuffle.  Steps that meet other rows are aggregations or equi-joins on content hash,
document id or knowledge base.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.functions import rules as R
from studylake.functions.text import infer_grade, strip
from studylake.operators.scan import null_safe

# Chunk sizes and overlaps in characters.
CHUNK_SIZE = 800
SEMANTIC_OVERLAP = 100
SLIDING_SIZE, SLIDING_OVERLAP = 512, 64

PARAGRAPH = r"(?U)\n\s*\n"


def _hard_split(chunk: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters; one linear pass over the text."""
    return F.when(F.length(chunk) <= size, F.array(chunk)).otherwise(
        F.regexp_extract_all(chunk, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    )


def _pack(paragraphs: Column, fits, join) -> Column:
    """Greedy packing of paragraphs; ``fits(cur, para)`` decides, ``join`` appends."""
    text, texts = T.StringType(), "array<string>"
    start = F.struct(F.array().cast(texts).alias("done"), F.lit("").cast(text).alias("cur"))

    def close(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))

    def step(acc: Column, para: Column) -> Column:
        keep = fits(acc["cur"], para)
        return F.struct(
            F.when(keep, acc["done"]).otherwise(close(acc)).alias("done"),
            F.when(keep, join(acc["cur"], para)).otherwise(para).alias("cur"),
        )

    return F.aggregate(paragraphs, start, step, close)


def pack_chunks(text: Column, size: int = CHUNK_SIZE, separator: str = PARAGRAPH) -> Column:
    """Chunks of a text: paragraphs packed while they fit, oversize ones cut hard."""
    packed = _pack(
        F.split(text, separator),
        lambda cur, para: F.length(cur) + F.length(para) + 2 < size,
        lambda cur, para: strip(F.concat(cur, F.lit("\n\n"), para)),
    )
    pieces = F.flatten(F.transform(packed, lambda c: _hard_split(c, size)))
    return F.when((F.length(text) <= size) | (F.size(pieces) == 0), F.array(text)).otherwise(pieces)


def chunk_rows(docs: DataFrame, size: int = CHUNK_SIZE, separator: str = PARAGRAPH) -> DataFrame:
    """One row per chunk, with ids made from the content: equal texts get equal ids, within a knowledge
    base where the documents have a ``kb_name``."""
    named = F.concat(F.coalesce("kb_name", F.lit("")), F.lit("\x1f"), F.col("text")) if "kb_name" in docs.columns else F.col("text")
    key = F.sha2(named.cast("binary"), 256)
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, key.alias("content_key"), F.posexplode(pack_chunks(F.col("text"), size, separator))).select(
        *others, F.concat("content_key", F.lit("_"), F.col("pos").cast("string")).alias("chunk_id"),
        F.col("pos").cast("long").alias("chunk_index"), F.col("col").alias("text"),
    )


def semantic_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = SEMANTIC_OVERLAP) -> Column:
    """Chunks along ``##``..``####`` headings: array of (text, heading_path, chunk_index, char_count).

    The text is cut before every heading line, headings are carried as a stack, long sections are
    packed by paragraph, and each chunk starts with the tail of the one before it.
    """
    heading = r"(?U)^(#{2,4})[^\S\n]+(\S[^\n]*)"
    parts = F.split(text, r"(?U)\n(?=#{2,4}[^\S\n]+\S)")
    stack_type = "array<struct<level:int,title:string>>"
    section_type = "array<struct<heading:string,body:string>>"

    def add(acc: Column, part: Column) -> Column:
        marks = F.regexp_extract(part, heading, 1)
        is_heading = marks != ""
        title = strip(F.regexp_extract(part, heading, 2))
        outer = F.filter(acc["stack"], lambda h: h["level"] < F.length(marks))
        stack = F.when(
            is_heading, F.array_append(outer, F.struct(F.length(marks).alias("level"), title.alias("title")))
        ).otherwise(acc["stack"])
        body = strip(F.when(is_heading, F.regexp_replace(part, heading, "")).otherwise(part))
        path = F.array_join(F.transform(stack, lambda h: h["title"]), " > ")
        done = F.when(body == "", acc["done"]).otherwise(
            F.array_append(acc["done"], F.struct(path.alias("heading"), body.alias("body")))
        )
        return F.struct(done.alias("done"), stack.alias("stack"))

    sections = F.aggregate(
        parts,
        F.struct(F.array().cast(section_type).alias("done"), F.array().cast(stack_type).alias("stack")),
        add,
        lambda acc: acc["done"],
    )

    def pieces(body: Column) -> Column:
        packed = _pack(
            F.split(body, PARAGRAPH),
            lambda cur, para: (cur == "") | (F.length(cur) + F.length(para) + 2 <= size),
            lambda cur, para: F.when(cur == "", para).otherwise(strip(F.concat(cur, F.lit("\n\n"), para))),
        )
        return F.when(F.length(body) <= size, F.array(body)).otherwise(
            F.filter(F.transform(packed, strip), lambda c: c != "")
        )

    own = F.flatten(
        F.transform(
            sections,
            lambda s: F.transform(pieces(s["body"]), lambda c: F.struct(s["heading"].alias("heading"), c.alias("own"))),
        )
    )

    def lead(prev: Column) -> Column:
        tail = F.substring(prev, -overlap, overlap)
        newline = F.locate("\n", tail) - 1
        cut = F.when(newline > overlap // 2, F.substr(tail, newline + 2)).otherwise(tail)
        return F.when(F.length(prev) > overlap, F.concat(cut, F.lit("\n"))).otherwise("")

    chunk_type = "array<struct<text:string,heading_path:string,chunk_index:int,char_count:int>>"

    def overlay(acc: Column, c: Column) -> Column:
        n = F.size(acc["done"])
        prefix = F.when(n > 0, lead(acc["prev"])).otherwise("") if overlap > 0 else F.lit("")
        full = F.concat(prefix, c["own"])
        chunk = F.struct(
            full.alias("text"), c["heading"].alias("heading_path"), n.alias("chunk_index"), F.length(c["own"]).alias("char_count")
        )
        return F.struct(F.array_append(acc["done"], chunk).alias("done"), full.alias("prev"))

    overlaid = F.aggregate(
        own,
        F.struct(F.array().cast(chunk_type).alias("done"), F.lit("").alias("prev")),
        overlay,
        lambda acc: acc["done"],
    )
    whole = F.array(
        F.struct(text.alias("text"), F.lit("").alias("heading_path"), F.lit(0).alias("chunk_index"), F.length(text).alias("char_count"))
    )
    return F.when(F.length(text) <= size, whole.cast(chunk_type)).otherwise(overlaid)


def sliding_chunk(size: int = SLIDING_SIZE, overlap: int = SLIDING_OVERLAP):
    """Vectorised function: overlapping windows of a text that prefer to end at a sentence.

    One pattern describes a window: the longest stretch past its half that ends with a sentence
    mark, else all of it.  A window starts ``overlap`` before the end of the last one, so the
    pattern is applied from place to place inside the batch.
    """
    half, last = size // 2 + 1, size - 1
    window = re.compile(rf"(?s).{{{last}}}[。\n]|.{{{half},{last - 1}}}(?:[。\n]|\.(?= ))|.{{{size}}}")

    def places(text: str):
        at = 0
        while len(text) - at > size:
            found = window.match(text, at)
            yield found.group()
            at = found.end() - overlap
        yield text[at:]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for p in (w.strip() for w in places(t or "")) if p])

    return cut


# Question numbers of a scanned paper, 1 to 200.
_NUMBER = r"(?:0{0,2}[1-9]|0?[1-9][0-9]|1[0-9][0-9]|200)"
QUESTION_MARK = (
    rf"(?:第\s*{_NUMBER}\s*[题、．.）\)]|{_NUMBER}\s*[.．、）\)]|[（(]\s*{_NUMBER}\s*[）)])"
)
LEADING_MARK = r"^(?:第\s*\d+\s*[题、．.）\)]|\d+\s*[.．、）\)]|[（(]\s*\d+\s*[）)])\s*"


def split_questions(text: Column) -> Column:
    """Questions of a scanned paper as array of (number, content); a repeated number keeps its
    last text, a paper without numbers is question 1."""
    parts = F.split(F.concat(F.lit("\n"), text), rf"(?U)\n(?=\s*{QUESTION_MARK})")
    entries = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            F.regexp_extract(strip(p), r"(?U)^\D{0,8}?(\d+)", 1).try_cast("int").alias("number"),
            strip(F.regexp_replace(strip(p), "(?U)" + LEADING_MARK, "")).alias("content"),
        ),
    )
    entries = F.reverse(F.filter(entries, lambda e: e["number"].isNotNull() & (e["content"] != "")))
    numbers = F.transform(entries, lambda e: e["number"])
    last = F.reverse(F.filter(entries, lambda e, i: F.array_position(numbers, e["number"]) == i + 1))
    alone = F.array(F.struct(F.lit(1).alias("number"), strip(text).alias("content")))
    return F.when(strip(text) == "", F.slice(alone, 1, 0)).when(F.size(parts) > 1, last).otherwise(alone)


def headings(text: Column) -> Column:
    """Markdown headings of level 1 to 4, in order: array of (level, heading)."""
    pattern = r"(?Um)^(#{1,4})\s+(.+)$"
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(
        marks, titles, lambda m, t: F.struct(F.length(m).cast("long").alias("level"), strip(t).alias("heading"))
    )


# --- content identity ----------------------------------------------------------------------


def content_dedup(docs: DataFrame) -> DataFrame:
    """One document per distinct text (the smallest id) with the number of copies.

    Only hash, id and count are shuffled, combined map-side, so a text with very many copies
    costs one row per partition.
    """
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
    )


def redundant_copies(docs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Ids of documents whose text an earlier document already has, with equal columns ``within``.

    Texts are hashed where they are read.  Only groups with copies are joined back, so the list
    that meets the rows has one entry per repeated text, and a text with very many copies is an
    ordinary lookup.
    """
    key = ["content_hash", *within]
    hashed = docs.select("doc_id", *within, F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    repeated = hashed.groupBy(*key).agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return null_safe(hashed, repeated, key).filter("doc_id <> _first").select("doc_id")


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks to append: one row per id, of the smallest document; ids already stored left out.

    The choice moves ids only; texts meet it once.
    """
    new = chunks.select("chunk_id", "doc_id").join(existing.select("chunk_id"), "chunk_id", "left_anti")
    chosen = new.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return chunks.join(chosen, ["chunk_id", "doc_id"], "left_semi").dropDuplicates(["chunk_id"])


def augment_paths(originals: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Originals with their sidecars right behind them; a path listed twice keeps its first place.

    ``originals`` is (path, pos), ``sidecars`` is (source, path).
    """
    beside = sidecars.join(originals.select(F.col("path").alias("source"), "pos"), "source")
    both = originals.select("path", "pos", F.lit(0).alias("side")).unionByName(
        beside.select("path", "pos", F.lit(1).alias("side"))
    )
    place = both.groupBy("path").agg(F.min(F.struct("pos", "side")).alias("p"))
    return place.select("path", "p.pos", "p.side")


def collection_names(kb_name: Column) -> Column:
    """Names under which a knowledge base's text and figure collections may be stored."""
    return F.array_distinct(F.array(kb_name, F.concat(kb_name, F.lit("_figures")), F.concat(kb_name, F.lit("-figures"))))


def purge_kb(collections: DataFrame, removed: DataFrame) -> DataFrame:
    """Stored rows without those of removed knowledge bases, under every name variant."""
    names = removed.select(F.explode(collection_names(F.col("kb_name"))).alias("collection")).distinct()
    return collections.join(names, "collection", "left_anti")


def require_kb(rows: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose knowledge base is registered, and the rejected rest."""
    names = registered.select("kb_name").distinct()
    return rows.join(names, "kb_name", "left_semi"), rows.join(names, "kb_name", "left_anti")


def already_synced(sources: DataFrame, index: DataFrame) -> DataFrame:
    return sources.join(index.select("source").distinct(), "source", "left_anti")


def prefer_longer_sidecar(docs: DataFrame, sidecars: DataFrame, factor: float = 1.2) -> DataFrame:
    """Replace a text by its sidecar where that is clearly longer."""
    side = sidecars.select("doc_id", F.col("text").alias("_side"))
    use = F.coalesce(F.length("_side") > F.length("text") * factor, F.lit(False))
    return docs.join(side, "doc_id", "left").withColumns(
        {"replaced": use, "text": F.when(use, F.col("_side")).otherwise(F.col("text"))}
    ).drop("_side")


def resume_action(docs: DataFrame, page_checkpoints: DataFrame) -> DataFrame:
    """What a re-run does with each document: skip, assemble its stored pages, or process it."""
    done = page_checkpoints.groupBy("doc_id").agg(F.countDistinct("page").alias("pages_done"))
    rows = docs.join(done, "doc_id", "left").na.fill(0, ["pages_done"])
    action = (
        F.when(F.col("embedded"), "skip")
        .when((F.col("total_pages") > 0) & (F.col("pages_done") >= F.col("total_pages")) & (F.col("pages_done") > 0), "assemble")
        .otherwise("process")
    )
    return rows.withColumn("action", action)


# --- assembling ----------------------------------------------------------------------------


def assemble(
    parts: DataFrame, key: str, order: str, text: Column, separator: str, per_part: int | None = None
) -> DataFrame:
    """Join the pieces of a key in order: (key, part, text).

    A key is one row, part 0.  With ``per_part``, a part holds so many consecutive positions, for keys
    too long for one value; parts are then read one after the other.
    """
    piece = F.struct(F.col(order).alias("o"), text.alias("t"))
    grouped = parts.groupBy(key, (F.floor(F.col(order) / per_part) if per_part else F.lit(0).cast("long")).alias("part")).agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    return grouped.select(key, "part", F.array_join(F.transform("ps", lambda p: p["t"]), separator).alias("text"))


def assemble_pages(pages: DataFrame, per_part: int | None = None) -> DataFrame:
    """Page texts of a document in order, each under its ``--- Page n ---`` line."""
    text = F.concat(F.lit("--- Page "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    return assemble(pages, "doc_id", "page", text, "\n\n", per_part)


# --- figures -------------------------------------------------------------------------------


def link_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures a chunk refers to: its caption or text occurs, or the chunk points at a figure
    and the figure is captioned or typed.  Joined on the document, so a pair only ever lies
    within one document."""
    text = F.col("text")
    caption, ocr = F.coalesce("caption", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    match = (
        ((caption != "") & text.contains(caption))
        | (F.col("_points") & ((caption != "") | (F.col("fig_type") != "unknown")))
        | ((F.length(ocr) > 10) & text.contains(ocr))
    )
    marked = chunks.withColumn("_points", F.col("text").rlike("(?U)" + R.FIGURE_REFERENCE))
    return (
        marked.join(figures.dropDuplicates(["doc_id", "figure_id"]), "doc_id")
        .filter(match)
        .select("doc_id", "chunk_index", "figure_id")
    )


def answer_leak(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Which earlier misses are questions of the learner's live paper, so their key is withheld.

    Both sides belong to one learner: at most a handful of recent misses meet one context.
    """
    def solid(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))

    question = F.col("question")
    leak = (F.length(question) > 5) & solid(F.col("context")).contains(solid(question))
    return questions.join(contexts, "learner_id", "left").select(
        "question_id", "learner_id", F.coalesce(leak, F.lit(False)).alias("withheld")
    )


def ingest_metadata(text: Column, summary: Column, subject: Column) -> dict[str, Column]:
    """Text to index, its kind and the grade.  Science subjects keep the raw text, because a
    summary would lose formulas."""
    use = ~subject.isin("chemistry", "math", "physics") & (F.coalesce(summary, F.lit("")) != "")
    return {
        "text": F.when(use, summary).otherwise(text),
        "type": F.when(use, "teaching_summary").otherwise("raw_ocr"),
        "grade": infer_grade(text),
    }


def embed(docs: DataFrame, encoder, column: str = "text", batch: int = 16) -> DataFrame:
    """Add ``embedding`` by a caller-supplied encoder (list of texts -> list of vectors).

    The encoder is built once per Python worker by ``encoder()`` and fed batches of ``batch``.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        encode = encoder()
        for pdf in frames:
            texts = pdf[column].tolist()
            vectors: list = []
            for i in range(0, len(texts), batch):
                vectors.extend(encode(texts[i : i + batch]))
            yield pdf.assign(embedding=[[float(x) for x in v] for v in vectors])

    return docs.mapInPandas(run, schema)
