"""Language identification with a language-bitmask n-gram filter.

The filter is a bit-sliced Bloom filter: each position holds a bitmask of languages, and the AND of an n-gram's
positions is the set of all languages that contain it. A text's n-grams are looked up at once; a popcount for each
language, corrected for that slice's false positives, decides.

Text is lower-cased; runs of anything but letters become one space. n-grams are looked up in whole texts.
Null text and text without a letter get ``und`` and score 0. Ties go to the first language in order;
text with letters of which no n-gram is known gets the first language with score 0. A null id counts as
the empty one when rows are split. Without labelled rows every text is ``und``. Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import append

UND = "und"
ORDERS = (3, 4)
#: Positions of the filter (a power of two) and hash draws for each n-gram.
BITS, DRAWS = 22, 3
#: Labelled documents of one language that the filter is fitted on, about, chosen by a hash of their id.
TRAIN_DOCS = 5000
#: An n-gram belongs to a language if this share of its documents, and two at least, have it; with fewer documents
#: than ``FEW``, one is enough.
LEAST_SHARE, FEW = 0.005, 20
#: Languages that a filter of this many positions may hold (one byte a position for each eight).
MAX_LANGUAGES = 512
_RANDOM = np.random.Generator(np.random.PCG64(7))
_GRAM = _RANDOM.integers(0, 1 << 63, (max(ORDERS) + 1, max(ORDERS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DRAW = _RANDOM.integers(0, 1 << 63, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def letters() -> np.ndarray:
    """Which code points are letters, as packed bits."""
    return np.packbits(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def grams(text: str | None, letter: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of ``text``; none if it has no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter[raw]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    kept = is_letter | np.concatenate(([False], is_letter[:-1]))
    codes = np.where(is_letter, raw, 32)[kept].astype(np.uint64)
    codes = np.pad(codes, (1, int(codes[-1] != 32)), constant_values=32)
    out = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h += codes[j : len(codes) - n + 1 + j] * _GRAM[n, j]
        out.append((h ^ (h >> np.uint64(32))) * _GRAM[0, 0])
    return np.concatenate(out)


def places(h: np.ndarray) -> list[np.ndarray]:
    """The filter positions of n-gram hashes, one array a draw."""
    return [((h ^ (h >> np.uint64(29))) * m) >> np.uint64(64 - BITS) for m in _DRAW]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Filter:
    """Languages in order, and the slices: ``masks[s, position]`` holds the languages 8 s to 8 s + 7."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        self.bits = bits.astype(np.int64)
        full = [np.bincount(m, minlength=256) @ self.bits for m in masks]
        fill = np.concatenate(full)[: len(languages)] / (1 << BITS) if languages else np.zeros(0)
        self.false = fill**DRAWS

    def counts(self, h: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams it holds, less those expected by chance."""
        at = places(h)
        found = []
        for slice_ in self.masks:
            m = slice_[at[0]]
            for p in at[1:]:
                m = m & slice_[p]
            found.append(np.bincount(m, minlength=256) @ self.bits)
        raw = np.concatenate(found)[: len(self.languages)]
        return np.maximum(0.0, (raw - len(h) * self.false) / (1 - self.false))


def _least(docs: int) -> int:
    """How many of a language's ``docs`` documents must have an n-gram."""
    return 1 if docs < FEW else max(2, int(LEAST_SHARE * min(docs, TRAIN_DOCS)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filter:
    """The filter of the languages in ``labelled``; rows with null language are left out."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col(lang).isNotNull())
    docs = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages = sorted(docs)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the filter holds {MAX_LANGUAGES}")
    masks = np.zeros(((len(languages) + 7) // 8, 1 << BITS), np.uint8)
    if not languages:
        return Filter(languages, masks)
    number = spark.createDataFrame(
        [(name, i, int(min(1.0, TRAIN_DOCS / docs[name]) * (1 << 30)), _least(docs[name])) for i, name in enumerate(languages)],
        "_lang string, _n int, _rate long, _least long",
    )
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    sample = labelled.join(F.broadcast(number), F.col(lang) == F.col("_lang")).where(drawn < F.col("_rate")).select("_n", "_least", F.col(text).alias("_text"))
    packed = spark.sparkContext.broadcast(letters())

    def tally(batches):
        letter = np.unpackbits(packed.value).view(bool)
        waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def counted():
            for (n, least), parts in waiting.items():
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), n, np.int32)), pa.array(np.full(len(gram), least, np.int64)), pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))],
                    names=["n", "least", "gram", "docs"],
                )

        for batch in batches:
            for n, least, value in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.unique(grams(value, letter))
                waiting.setdefault((n, least), []).append(own)
                size += len(own)
                if size > 4_000_000:
                    yield from counted()
                    waiting, size = {}, 0
        yield from counted()

    def positions(batches):
        for batch in batches:
            n, gram = batch.column("n").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            at = np.concatenate(places(gram)).astype(np.int64)
            n = np.tile(n, DRAWS)
            yield pa.RecordBatch.from_arrays([pa.array((n // 8).astype(np.int32)), pa.array(at), pa.array((1 << (n % 8)).astype(np.int32))], names=["slice", "at", "mask"])

    known = sample.mapInArrow(tally, "n int, least long, gram long, docs long").groupBy("n", "least", "gram").agg(F.sum("docs").alias("docs"))
    known = known.where("docs >= least").select("n", "gram").mapInArrow(positions, "slice int, at long, mask int")
    # At most one row a position and slice, whatever the corpus.
    rows = known.groupBy("slice", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[rows.column("slice").to_numpy(), rows.column("at").to_numpy()] = rows.column("mask").to_numpy()
    return Filter(languages, masks)


def predict(df: DataFrame, fitted: Filter, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (the language's share of all languages' counts) and coverage (the share of
    the text's n-grams that the language holds)."""
    shared = df.sparkSession.sparkContext.broadcast((fitted.languages, fitted.masks, letters()))

    def make():
        languages, masks, packed = shared.value
        letter, known = np.unpackbits(packed).view(bool), Filter(languages, masks)

        def one(value: str | None) -> tuple[str, float, float]:
            h = grams(value, letter)
            if not len(h) or not languages:
                return UND, 0.0, 0.0
            counts = known.counts(h)
            best = int(counts.argmax())
            return languages[best], float(counts[best] / max(counts.sum(), 1e-9)), float(min(1.0, counts[best] / len(h)))

        def work(batch: pa.RecordBatch) -> list[list]:
            return [list(c) for c in zip(*map(one, batch.column(text).to_pylist()))] or [[], [], []]

        return work

    return append(df, "lang_pred string, score double, coverage double", make)
