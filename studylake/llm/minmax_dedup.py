"""Near-duplicate documents by min-max hashing.

A document's set holds the 64-bit hashes of its distinct ``WIDTH``-word shingles. Each permutation of the hash
space yields two signature values, the smallest and the largest element, so ``PERMUTATIONS`` evaluations
give twice as many values. Mins and maxes are banded apart, each band over ``ROWS_A_BAND`` permutations. Two sets
of Jaccard similarity 0.85 share none of the 24 bands with probability 2e-8, of 0.80 with 3e-6; lower thresholds are refused.

1. Documents with equal sets form a class, named by its smallest id. Only classes go on.
2. Members of a band's bucket are paired with the bucket's smallest member and compared on full sets.
3. Where a bucket still holds several components, its members are compared block by block: every pair of
   different components, in the first band it shares, by signature and, if that may reach the threshold, on full
   sets. Only links that join components leave the task.
Inside a component nothing is left to find, so no group is expanded into pairs.

Null, empty and blank texts have no shingles (n_shingles 0) and are linked with nothing. A null id is never
linked: component_id null, kept true. Rows with one id are one document, linked as any of its texts
is. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import append, by_group, components, paired_blocks, written

WIDTH = 5
PERMUTATIONS = 48
ROWS_A_BAND = 4
#: Members of a bucket whose signatures one task compares with those of another block.
BLOCK = 512
#: The least threshold, in per cent, that the bands serve.
LEAST_PER_CENT = 80
#: Bits of a band key below its band's number.
KEY_BITS = 58
_RANDOM = np.random.Generator(np.random.PCG64(20240))
_ODD = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 63, (2 * PERMUTATIONS // ROWS_A_BAND, ROWS_A_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 8192


def least_estimate(per_cent: int) -> float:
    """Pairs whose signatures agree on less than this share of values are not compared on full sets: six standard
    deviations below the threshold."""
    j = per_cent / 100
    return j - 6 * (j * (1 - j) / (2 * PERMUTATIONS)) ** 0.5


def _finish(h: np.ndarray) -> np.ndarray:
    """Mix all bits of 64-bit sums."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted shingle hashes of an encoded text; words are split at ASCII white space, A-Z lower-cased."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += h[j : n - width + 1 + j] * _MIX[j]
    return np.unique(_finish(total))


def signature(values: np.ndarray) -> np.ndarray:
    """Smallest, then largest element under each permutation."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), _CHUNK):
        h = values[None, at : at + _CHUNK] * _ODD[:, None]
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.concatenate([low, high])


def bands(sign: np.ndarray) -> np.ndarray:
    """One key a band: the band's number, then a hash of its values."""
    h = _finish((sign.reshape(_BAND.shape) * _BAND).sum(axis=1, dtype=np.uint64)) >> np.uint64(64 - KEY_BITS)
    return h.view(np.int64) + (np.arange(len(h), dtype=np.int64) << KEY_BITS)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with set size, a digest of the set, band keys and the signature's low halves."""

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            out: list[list] = [[], [], [], []]
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                values = shingles(raw)
                out[0].append(len(values))
                if not len(values):
                    for column in out[1:]:
                        column.append(None)
                    continue
                sign = signature(values)
                out[1].append(xxhash.xxh3_128_digest(values.tobytes()))
                out[2].append(bands(sign))
                out[3].append(sign.astype("<u4").tobytes())
            return out

        return work

    return append(df, "n_shingles long, digest binary, bands array<long>, sketch binary", make, drop=(text,))


def _sets(df: DataFrame, text: str) -> DataFrame:
    def make():
        return lambda batch: [[shingles(raw).view(np.int64) for raw in batch.column(text).cast(pa.binary()).to_pylist()]]

    return append(df, "shingles array<long>", make, drop=(text,))


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    x, y = (sets.select(F.col("id").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    both = pairs.join(x, "a").join(y, "b").where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * per_cent)
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    # No aggregation here: it would tie the rows of a hot leader together, and Spark could not split them.
    return written(both.where(100 * F.col("common") >= per_cent * (F.col("total") - F.col("common"))).select("a", "b"))


def _joining(groups: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between different components of a block pair's members, enough to join them."""

    def work(table: pa.Table, starts: np.ndarray):
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        own, i_of, j_of, rep, component, keys = (column[c].to_numpy() for c in ("own", "i", "j", "rep", "component", "key"))
        sketch = np.frombuffer(b"".join(column["sketch"].to_pylist()), "<u4").reshape(table.num_rows, -1)
        band = column["bands"].flatten().to_numpy().reshape(table.num_rows, -1)
        values, offsets = column["shingles"].flatten().to_numpy().view(np.uint64), column["shingles"].offsets.to_numpy()
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        least = least_estimate(per_cent) * sketch.shape[1]
        found: list[tuple[int, int]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            label = component[start:end].copy()
            if end - start < 2 or (label == label[0]).all():
                continue
            same_block = i_of[start] == j_of[start]
            right = np.arange(end - start) if same_block else np.flatnonzero(own[start:end] == j_of[start])
            earlier = int(keys[start] >> KEY_BITS)
            for x in range(end - start) if same_block else np.flatnonzero(own[start:end] == i_of[start]).tolist():
                other = right[(label[right] != label[x]) & ((right > x) | (not same_block))]
                if not len(other):
                    continue
                other = other[(sketch[start + other] == sketch[start + x]).sum(axis=1) >= least]
                other = other[~(band[start + other, :earlier] == band[start + x, :earlier]).any(axis=1)]
                small, large = np.minimum(sizes[start + other], sizes[start + x]), np.maximum(sizes[start + other], sizes[start + x])
                other = other[100 * small >= per_cent * large]
                if not len(other):
                    continue
                mine = values[offsets[start + x] : offsets[start + x + 1]]
                theirs = np.concatenate([values[offsets[start + y] : offsets[start + y + 1]] for y in other.tolist()])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                n = sizes[start + other]
                common = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
                linked = other[100 * common >= per_cent * (n + len(mine) - common)]
                parts, first = np.unique(label[linked], return_index=True)
                found += [(int(rep[start + x]), int(rep[start + y])) for y in linked[first].tolist()]
                label[np.isin(label, parts)] = label[x]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return by_group(groups, ["key", "i", "j"], "a long, b long", work)


def _left_over(members: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that join components in buckets that hold several."""
    named = members.join(labels, members.rep == labels.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
        F.expr("bit_xor(xxhash64(rep))").alias("f"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(38,0)")).alias("g"),
    ).where("lo <> hi")
    # Buckets of the same members are one, that of the first band.
    mixed = written(mixed.groupBy("n", "f", "g").agg(F.min("key").alias("key")).select("key", "n"))
    inside = written(named.join(mixed, "key"))
    inside = inside.join(reps, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    return written(_joining(paired_blocks(inside, ["key"], "rep", "n", BLOCK), per_cent).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", per_cent: int = 85) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id reachable by links) and kept.

    Linked are documents with 100 * intersection >= ``per_cent`` * union of their shingle sets.
    """
    if not LEAST_PER_CENT <= per_cent <= 100:
        raise ValueError(f"per_cent {per_cent}; the bands serve {LEAST_PER_CENT} to 100")
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    rows = written(features(docs, "_text"))
    full = rows.where("id IS NOT NULL AND n_shingles > 0")
    classes = written(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = full.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"])
    reps = written(reps.select(F.col("id").alias("rep"), "bands", "sketch"))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    lead = written(keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = written(keys.join(lead, "key"))
    nodes = written(members.select(F.col("rep").alias("id")).distinct())
    sets = written(_sets(docs.join(nodes, "id", "left_semi"), "_text").distinct())
    links = _verified(members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), sets, per_cent)
    links = links.union(_left_over(members, reps, sets, written(components(links)), per_cent))
    labels = components(links)
    named = classes.join(labels, classes.rep == labels.node, "left").where("copies > 1 OR component IS NOT NULL")
    named = written(named.select("digest", F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(named, "digest", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
