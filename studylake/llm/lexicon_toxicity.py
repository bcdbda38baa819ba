"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding strips marks, maps homoglyphs, letters in other shapes and digit substitutions to Latin letters and everything but letters to a
space, and joins letters written apart. Lexicon terms are whole words and word beginnings, learned with their weights (log odds) from labelled
documents; at each word the heaviest term counts. A term inside an exception phrase (two words which labelled
documents show to be harmless) does not count. The score is a logistic function of the summed weights,
also taken per word, so length is normalised.

Null and empty texts have no matches and get the score of a text without any. Rows with a null id count as the
empty id when rows are split. A label other than 0 and 1 is ignored; of several labels of one document the
largest holds. Without labels of both kinds the lexicon is empty and every score is the share of toxic labels
(0 without labels). Columns named like an output are replaced.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import append
from studylake.llm.minmax_dedup import near_duplicates

#: Labelled documents, about, that the lexicon and the weights are fitted on, chosen by a hash of their id. Of near
#: copies with one label one counts: edits of one text are one witness of each class. Texts that share a passage are not.
TRAIN_DOCS = 20_000
#: Lengths of word beginnings that may become terms.
STEMS = range(4, 9)
#: Least log odds of a term and least likelihood ratio statistic (chance alone: one in a billion).
LEAST_WEIGHT, LEAST_RATIO = 3.0, 40.0
#: An exception phrase has a term, but is no more toxic than documents are; against other documents with a term
#: that is at least so unlikely by chance.
EXCEPT_RATIO = 15.0
# Look-alike letters and digits, as pairs: what is read, what it stands for.
_ALIKE = dict(zip(
    "01345689@$!7|аеорсухікмтнвԁѕјгαεοριτυνκηβ",
    "oieasbbgasitiaeopcyxikmthbdsjraeopituvknb",
))
_TABLE_SIZE = 0x110000
_SIGN = np.array([chr(c) in "01345689@$!7|" for c in range(128)])
# Letters without a decomposition that are a Latin letter in another shape, by their names: small capitals, dotless, with a stroke ...
_SHAPED = re.compile(r"LATIN (?:SMALL LETTER|CAPITAL LETTER|LETTER SMALL CAPITAL) (?:(?:DOTLESS|SCRIPT|BARRED|LONG|INSULAR|BLACKLETTER|OPEN|TURNED) )?([A-Z])(?: WITH .*)?")
#: Single letters in a row, from so many on, that are a word written apart.
APART = 4


@functools.cache
def fold_table() -> np.ndarray:
    """For each code point the letter it folds to, or a space; 0 for marks, which vanish."""
    table = np.full(_TABLE_SIZE, 32, np.uint32)
    for code in range(_TABLE_SIZE):
        base = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        base = unicodedata.normalize("NFKD", base)[:1]
        if base > "\x7f" and (shaped := _SHAPED.fullmatch(unicodedata.name(base, ""))):
            base = shaped[1].lower()
        base = _ALIKE.get(base, base)
        base = "i" if base == "l" else base  # l, I, 1 and | look alike
        if unicodedata.category(chr(code)) in ("Mn", "Cf"):
            table[code] = 0
        elif base.isalpha():
            table[code] = ord(base)
    return table


def fold(text: str | None, table: np.ndarray) -> str:
    """Words of ``text`` in folded letters, each between single spaces; '' if there is none."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    codes = table[np.minimum(raw, _TABLE_SIZE - 1)]
    raw, codes = raw[codes != 0], codes[codes != 0]
    # A digit or sign stands for a letter only if a letter follows, perhaps after one more: "1d10t", not "idiot!!".
    n = len(codes)
    sign = np.pad((raw < 128) & _SIGN[np.minimum(raw, 127)], (0, 2))
    plain = np.pad(codes != 32, (0, 2)) & ~sign
    stands = plain[1 : n + 1] | (sign[1 : n + 1] & plain[2:])
    codes = np.where(sign[:n] & ~stands, np.uint32(32), codes)
    words = codes.tobytes().decode("utf-32-le").split()
    return f" {' '.join(_joined(words))} " if words else ""


def _joined(words: list[str]) -> list[str]:
    """``words`` with rows of ``APART`` or more single letters made one word ("i.d.i.o.t"); ideographs are words, not letters."""
    out, row = [], []
    for word in [*words, ""]:
        if len(word) == 1 and word < "\u2e80":
            row.append(word)
            continue
        out += ["".join(row)] if len(row) >= APART else row
        out.append(word)
        row = []
    return out[:-1]


@dataclass
class Lexicon:
    """Terms with a leading space (words also with a trailing one), their weights, harmless phrases and the model."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    model: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = -50.0

    def automaton(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        if not self.weights:
            return None
        out.make_automaton()
        return out


def matches(folded: str, automaton) -> dict[int, float]:
    """Start of each word with a term, and the heaviest weight there."""
    best: dict[int, float] = {}
    for end, (size, weight) in automaton.iter(folded) if automaton else ():
        start = end - size + 1
        if weight > best.get(start, 0.0):
            best[start] = weight
    return best


def phrases(folded: str, start: int) -> tuple[str, str]:
    """The word at ``start`` with the word before and with the word after."""
    stop = folded.index(" ", start + 1)
    before = folded.rfind(" ", 0, start) if start else start
    after = folded.find(" ", stop + 1)
    return folded[before + 1 : stop] if start else "", folded[start + 1 : after] if after > 0 else ""


def features(text: str | None, table: np.ndarray, lexicon: Lexicon, automaton) -> tuple[float, float, float]:
    folded = fold(text, table)
    total = 0.0
    for start, weight in matches(folded, automaton).items():
        if not lexicon.exceptions or not lexicon.exceptions.intersection(phrases(folded, start)):
            total += weight
    words = max(1, folded.count(" ") - 1)
    return float(np.log1p(total)), float(np.log1p(100 * total / words)), float(total > 0)


def _odds(table, total: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and likelihood ratio of the columns toxic and clean against the class sizes."""
    t, n = table["toxic"].to_numpy(float), table["clean"].to_numpy(float)
    big_t, big_n = total
    weight = np.log((t + 0.5) / (big_t - t + 0.5)) - np.log((n + 0.5) / (big_n - n + 0.5))
    share = big_t / (big_t + big_n)
    part = lambda x, of: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(of, 1e-9)), 0.0)
    return weight, 2 * (part(t, (t + n) * share) + part(n, (t + n) * (1 - share)))


def _counted(sample: DataFrame, terms) -> DataFrame:
    """Documents of each class that have a term; ``terms()`` gives, per task, the function from text to its terms."""

    def tally(batches):
        of = terms()
        both = (Counter(), Counter())

        def counted():
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([both[1][x] for x in names], pa.int64()), pa.array([both[0][x] for x in names], pa.int64())],
                names=["term", "toxic", "clean"],
            )

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                both[label].update(of(text))
                if len(both[0]) + len(both[1]) > 300_000:
                    yield from counted()
                    both[0].clear(), both[1].clear()
        yield from counted()

    found = sample.mapInArrow(tally, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Lexicon:
    """Learn lexicon, exceptions and model from about ``train_docs`` of the labelled ``docs``."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    size = known.count()
    if not size:
        return Lexicon({})
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, train_docs / size) * (1 << 30))
    sample = docs.select(key, F.col(text).alias("text")).where(drawn).join(known.where(drawn), key)
    # Rows with the same id and text are one document, whatever the type of the id.
    sample = sample.select(F.xxhash64(key, "text").alias("id"), "text", "label").persist()
    try:
        copies = near_duplicates(sample, "id").select(F.col("doc_id").alias("id"), "component_id").distinct()
        witnesses = sample.join(copies, "id").groupBy("component_id", "label").agg(F.min("text").alias("text")).select("text", "label").persist()
        try:
            return _fit(witnesses)
        finally:
            witnesses.unpersist()
    finally:
        sample.unpersist()


def _fit(sample: DataFrame) -> Lexicon:
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    both = total.get(1, 0), total.get(0, 0)
    if not both[0] or not both[1]:
        return Lexicon({}, bias=50.0 if both[0] else -50.0)
    prior = float(np.log(both[0] / both[1]))
    folds = sample.sparkSession.sparkContext.broadcast(fold_table())

    def terms():
        table = folds.value

        def of(value: str | None) -> set[str]:
            words = set(fold(value, table).split())
            return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}

        return of

    # A term needs many toxic documents to pass, so what is left is a small part of the sample's words.
    share = both[0] / sum(both)
    needed = int(LEAST_RATIO / 2 / -np.log(share)) if share < 1 else 1
    rows = _counted(sample, terms).where(F.col("toxic") >= max(2, needed)).where(F.col("clean") * both[0] < F.col("toxic") * both[1]).toPandas()
    weight, ratio = _odds(rows, both)
    passed = (weight >= LEAST_WEIGHT) & (ratio >= LEAST_RATIO)
    lexicon = Lexicon(dict(sorted(zip(rows.term[passed], weight[passed].tolist()))), bias=prior)
    if not lexicon.weights:
        return lexicon
    weights = lexicon.weights

    def contexts():
        table, automaton = folds.value, Lexicon(weights).automaton()

        def of(value: str | None) -> set[str]:
            folded = fold(value, table)
            # Where there is a term, '' stands for any phrase: it counts the documents with a term.
            return {p for start in matches(folded, automaton) for p in (*phrases(folded, start), "")}

        return of

    # A phrase that passes is in several clean documents; phrases of toxic ones alone stay behind.
    rows = _counted(sample, contexts).where("clean >= 3 OR term = ''").toPandas()
    hit = rows[rows.term == ""]
    weight, ratio = _odds(rows, (int(hit.toxic.sum()), int(hit.clean.sum())))
    harmless = rows.toxic * both[1] <= rows.clean * both[0]
    lexicon.exceptions = frozenset(rows.term[harmless & (weight < 0) & (ratio >= EXCEPT_RATIO) & (rows.term != "")])

    def measured(batches):
        table, automaton = folds.value, lexicon.automaton()
        for batch in batches:
            x = [features(v, table, lexicon, automaton) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], pa.float64()) for i in range(3)] + [batch.column("label")], names=["a", "b", "c", "label"])

    # Four numbers for each of the sampled documents.
    rows = sample.mapInArrow(measured, "a double, b double, c double, label int").toPandas()
    x = np.column_stack([rows[["a", "b", "c"]].to_numpy(float), np.ones(len(rows))])
    y, w = rows.label.to_numpy(float), np.zeros(4)
    for _ in range(30):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), x.T @ (y - p) - 0.01 * w)
        w += step
    lexicon.model, lexicon.bias = tuple(w[:3].tolist()), float(w[3])
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.model, lexicon.bias))
    folds = df.sparkSession.sparkContext.broadcast(fold_table())

    def make():
        known = Lexicon(*shared.value)
        table, automaton = folds.value, known.automaton()

        def one(value: str | None) -> float:
            z = known.bias + sum(a * b for a, b in zip(known.model, features(value, table, known, automaton)))
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        def work(batch: pa.RecordBatch) -> list[list]:
            scores = [one(v) for v in batch.column(text).to_pylist()]
            return [scores, [int(s >= 0.5) for s in scores]]

        return work

    return append(df, "score double, predicted int", make)
