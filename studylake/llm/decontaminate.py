"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up in every token window.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other non-ASCII characters.
A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
window. A word of a document inside any occurrence of a window is hit.

Null or empty texts have no words and are never hit. An item with null text is no item; one with a
null id still marks words, but is not named. Repeated items count once, repeated documents each for
themselves. Empty tables give empty results (no document, or no hit). Columns named like an output
are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import append, bound, cut, segments, written

WINDOW = 10
#: Bytes of item texts that are sent to the tasks at once. A larger benchmark is taken in blocks.
BLOCK_BYTES = 32 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and makes every separator a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


class Windows:
    """The windows of some items: exact look-up by the numbers of their words."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, text in items:
            words = (text or "").encode().translate(_FOLD).split()
            if not words:
                continue
            row = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32)
            length = min(size, len(words))
            table = self.by_length.setdefault(length, {})
            for at in range(len(words) - length + 1):
                owners = table.setdefault(row[at : at + length].tobytes(), [])
                if not owners or owners[-1] != len(self.ids):
                    owners.append(len(self.ids))
            self.ids.append(item)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items (by place) with occurring windows."""
        get = self.number.get
        row = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        hit, items = np.zeros(len(row) + 1, np.int32), set()
        known = np.concatenate(([0], np.cumsum(row != 0)))
        for length, table in self.by_length.items():
            if length > len(row):
                continue
            for at in np.flatnonzero(known[length:] - known[:-length] == length).tolist():
                if owners := table.get(row[at : at + length].tobytes()):
                    hit[at] += 1
                    hit[at + length] -= 1
                    items.update(owners)
        return np.cumsum(hit[:-1]) > 0, items


def _code_points(raw: bytes) -> np.ndarray:
    """How many code points begin before each byte of an encoded text."""
    return np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))


def _spans(raw: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point offsets."""
    places = [m.span() for m in WORD.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    chars = _code_points(raw)
    return [{"start": int(chars[places[i][0]]), "end": int(chars[places[j - 1][1]])} for i, j in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _scan(df: DataFrame, items: list[tuple[str | None, str | None]], size: int, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)

    def make():
        windows = Windows(shared.value, size)

        def work(batch: pa.RecordBatch) -> list[list]:
            n_words, n_hit, named, spans = [], [], [], []
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                raw = (raw or b"").translate(_LOWER)
                words = raw.translate(_FOLD).split()
                hit, items = windows.scan(words)
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                named.append(sorted({windows.ids[i] for i in items} - {None}))
                spans.append(_spans(raw, hit) if items else [])
            return [n_words, n_hit, named, spans]

        return work

    return append(df, FOUND, make)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def find(
    df: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``df`` with n_words, n_hit, items (ids as strings, sorted) and spans (code points, end exclusive).

    ``benchmark`` has item_id and text. Up to ``block_bytes`` of it is one block: one narrow pass over ``df``.
    Beyond, each block makes a pass of its own, whose hits are written and merged by row.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total // block_bytes)
    if blocks == 1:
        return _scan(df, [tuple(r) for r in items.collect()], size, text)
    # Equal texts have equal hits, so a digest of the text is key enough.
    df = df.withColumn("_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    passes = []
    for k in range(blocks):
        block = [tuple(r) for r in items.where(part == k).collect()]
        found = _scan(df.select("_key", text), block, size, text).where("n_hit > 0").select("_key", "items", "spans")
        passes.append(written(found.dropDuplicates(["_key"])))
    hits = passes[0]
    for other in passes[1:]:
        hits = hits.union(other)
    hits = hits.groupBy("_key").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    joined = df.drop("n_words", "n_hit", "items", "spans").join(hits, "_key", "left")

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            out: list[list] = [[], [], [], []]
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for raw, items, spans in zip(texts, batch.column("_items").to_pylist(), batch.column("_spans").to_pylist()):
                raw = (raw or b"").translate(_LOWER)
                words = [m.span() for m in WORD.finditer(raw)]
                hit = np.zeros(len(words) + 1, np.int32)
                if spans:
                    chars = _code_points(raw)
                    first = {int(chars[a]): i for i, (a, _) in enumerate(words)}
                    last = {int(chars[b]): i for i, (_, b) in enumerate(words)}
                    for s in spans:
                        hit[first[s["start"]]] += 1
                        hit[last[s["end"]] + 1] -= 1
                marked = np.cumsum(hit[:-1]) > 0
                for column, value in zip(out, (len(words), int(marked.sum()), sorted(set(items or [])), _spans(raw, marked) if spans else [])):
                    column.append(value)
            return out

        return work

    return append(joined, FOUND, make, drop=("_key", "_items", "_spans"))


def without_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with every span of ``spans`` cut out of ``text``."""
    # What stands before each span and after the last, each part taken once from the text's segments.
    every = lambda start, end: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    edges = F.concat(F.array(every(F.lit(0), F.lit(0))), F.transform(spans, lambda s: every(s["start"], s["end"])), F.array(every(F.length(text), F.length(text))))
    pairs = lambda e: F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: every(a["end"], b["start"]))
    rest = bound(segments(F.col(text)), lambda parts: F.array_join(F.transform(bound(edges, pairs), lambda p: cut(parts, p["start"], p["end"])), ""))
    return df.withColumn(text, F.when(F.size(spans) > 0, rest).otherwise(F.col(text)))


def without_documents(df: DataFrame) -> DataFrame:
    """The documents of ``find`` that have no hit."""
    return df.where("n_hit = 0")
