"""Near-duplicate vectors by a pivot permutation index.

Each vector is described by its ``NEAREST`` closest reference points (pivots), in order. Inverted lists hold the
vectors that have the same ``SHARED`` pivots among these, so two vectors meet exactly if at least so many pivots are
shared; each pair is compared in one list only, that of its first shared pivots. Vectors that meet are
compared by cosine in double precision. At cosine 0.93 in 64 dimensions, over 0.98 of pairs meet.

The pivots are up to ``PIVOTS`` vectors of a sample of ``SAMPLE`` rows chosen by hash, no two of them closer than
``APART``: a group of near copies would else take many, and their order would be chance. Every vector is indexed. Vectors of a dimension that the sample lacks make one list, compared block by block.

Compared are vectors of equal label and dimension. Null, empty, zero and non-finite vectors, and those with null
label or id, are linked with nothing; a null id has component_id null and kept true. Identical vectors form a class
and are compared once. Rows with one id are vectors of their own that share a component. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import append, by_group, components, paired_blocks, written

PIVOTS, NEAREST, SHARED = 1024, 9, 3
SAMPLE = 8192
APART = 0.8
#: Members of a list that one task compares with as many others.
BLOCK = 512


def valid(vector) -> bool:
    x = np.array([np.nan if v is None else v for v in vector] if vector is not None else [], float)
    return bool(len(x)) and bool(np.isfinite(x).all()) and bool((x != 0).any())


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _rows(df: DataFrame) -> DataFrame:
    """Digest of (label, vector) and the raw vector as double bytes for valid rows, else null."""

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            digests, raws, sizes = [], [], []
            for vec_id, vector, label in zip(*(batch.column(c).to_pylist() for c in ("id", "vector", "label"))):
                if vec_id is None or label is None or not valid(vector):
                    raw = digest = None
                else:
                    raw = (np.asarray(vector, "<f8") + 0.0).tobytes()
                    digest = xxhash.xxh3_128_digest(raw + repr(label).encode())
                digests.append(digest)
                raws.append(raw)
                sizes.append(len(raw) // 8 if raw else None)
            return [digests, raws, sizes]

        return work

    return append(df, "digest binary, raw binary, size int", make, drop=("vector",))


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Reference points by dimension, at most ``PIVOTS`` each, from a sample of at most ``SAMPLE`` rows."""
    sample = classes.select("raw", "size").orderBy(F.xxhash64("raw")).limit(SAMPLE).collect()
    raws: dict[int, list[bytes]] = {}
    for row in sample:
        raws.setdefault(row["size"], []).append(bytes(row["raw"]))
    found = {}
    for size, of in raws.items():
        rows = _unit(np.frombuffer(b"".join(dict.fromkeys(of)), "<f8").reshape(-1, size))
        chosen, near = [], np.zeros(len(rows), bool)
        for i in range(len(rows)):
            if len(chosen) < PIVOTS and not near[i]:
                chosen.append(i)
                near |= rows @ rows[i] >= APART
        found[size] = rows[chosen]
    return found


def described(df: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``df`` with ``near``, the numbers of the closest pivots in order (empty without pivots of that dimension)."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def make():
        def work(batch: pa.RecordBatch) -> list[list]:
            raws, near = batch.column("raw").to_pylist(), []
            for size, group in itertools.groupby(raws, len):
                points = shared.value.get(size // 8)
                rows = list(group)
                if points is None:
                    near += [[] for _ in rows]
                    continue
                cos = _unit(np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)) @ points.T
                near += np.argsort(-cos, axis=1, kind="stable")[:, : min(NEAREST, len(points))].tolist()
            return [near]

        return work

    return append(df, "near array<int>", make)


def _lists(df: DataFrame) -> DataFrame:
    """One row (label, size, list, digest) for each inverted list a vector is in."""

    def run(batches):
        for batch in batches:
            at, keys = [], []
            for i, near in enumerate(batch.column("near").to_pylist()):
                for subset in itertools.combinations(sorted(near), min(SHARED, len(near))):
                    key = 0
                    for p in subset:
                        key = key * PIVOTS + p
                    at.append(i)
                    keys.append(key)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("size"), pa.array(keys, pa.int64()), rows.column("digest")], names=["label", "size", "list", "digest"])

    kind = df.schema["label"].dataType.simpleString()
    return df.select("label", "size", "digest", "near").mapInArrow(run, f"label {kind}, size int, list long, digest binary")


def _compared(members: DataFrame, least: float) -> DataFrame:
    """Per block pair: each member's count of linked vectors there, and links that hold its parts together."""

    def pairs(near: np.ndarray, other: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """Whether the shared pivots up to the list's last are the list's own: else another list has the pair."""
        both = np.zeros(np.broadcast_shapes(near.shape[:-1], other.shape[:-1]), np.int16)
        near = np.where(near <= listed, near, -1)
        for p in range(near.shape[-1]):
            for q in range(other.shape[-1]):
                both += near[..., p] == other[..., q]
        return both

    def work(table: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], table.num_rows)
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        own, lists, rep, copies = (column[c].to_numpy() for c in ("own", "list", "rep", "copies"))
        i, j, size = (column[c].to_numpy() for c in ("i", "j", "size"))
        digests, raws = column["digest"].to_pylist(), column["raw"].to_pylist()
        nears = column["near"].to_pylist()
        out: dict[str, list] = {"digest": [], "linked": [], "a": [], "b": []}
        # Lists of two, by far the most, all at once; a dimension has one number of pivots.
        first = starts[(ends - starts == 2) & (i[starts] == j[starts])]
        for dims in np.unique(size[first]).tolist():
            one = first[size[first] == dims]
            x, y = (_unit(np.frombuffer(b"".join([raws[k] for k in at.tolist()]), "<f8").reshape(len(at), -1)) for at in (one, one + 1))
            link = (x * y).sum(axis=1) >= least
            one = one[link]
            if not len(one):
                continue
            p, q = (np.array([nears[k] for k in at.tolist()], np.int32).reshape(len(at), -1) for at in (one, one + 1))
            if p.shape[1]:
                one = one[pairs(p, q, (lists[one] % PIVOTS)[:, None]) == min(SHARED, p.shape[1])]
            for k in one.tolist():
                out["digest"] += [digests[k], digests[k + 1], None]
                out["linked"] += [int(copies[k + 1]), int(copies[k]), None]
                out["a"] += [None, None, int(rep[k])]
                out["b"] += [None, None, int(rep[k + 1])]
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end - start < 2 or end - start == 2 and i[start] == j[start]:
                continue
            x = _unit(np.frombuffer(b"".join(raws[start:end]), "<f8").reshape(end - start, -1))
            near = np.array([sorted(n) for n in nears[start:end]], np.int32).reshape(end - start, -1)
            left, right = np.flatnonzero(own[start:end] == i[start]), np.flatnonzero(own[start:end] == j[start])
            if not len(left) or not len(right):
                continue
            link = x[left] @ x[right].T >= least
            if near.shape[1]:
                last = lists[start] % PIVOTS
                link &= pairs(near[left][:, None, :], near[right][None, :, :], last) == min(SHARED, near.shape[1])
            if i[start] == j[start]:
                np.fill_diagonal(link, False)
            for side, sums in ((left, link @ copies[start:end][right]), (right, copies[start:end][left] @ link)):
                if side is right and i[start] == j[start]:
                    break
                for k in np.flatnonzero(sums).tolist():
                    out["digest"].append(digests[start + side[k]])
                    out["linked"].append(int(sums[k]))
                    out["a"].append(None)
                    out["b"].append(None)
            # Parts: give each row the smallest number it reaches, then link it with that row.
            label_l, label_r = left.copy(), right.copy()
            while link.any():
                big = np.where(link, label_r[None, :], end - start)
                new_l = np.minimum(label_l, big.min(axis=1))
                new_r = np.minimum(label_r, np.where(link, new_l[:, None], end - start).min(axis=0))
                if (new_l == label_l).all() and (new_r == label_r).all():
                    break
                label_l, label_r = new_l, new_r
            for side, label in ((left, label_l), (right, label_r)):
                for k in np.flatnonzero(label != side).tolist():
                    out["digest"].append(None)
                    out["linked"].append(None)
                    out["a"].append(int(rep[start + side[k]]))
                    out["b"].append(int(rep[start + label[k]]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.binary()), ("linked", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    return by_group(members, ["label", "size", "list", "i", "j"], "digest binary, linked long, a long, b long", work)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked with it), component_id (smallest id reachable), kept."""
    rows = written(_rows(df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))))
    good = rows.where("digest IS NOT NULL")
    names = good.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    first = good.select("digest", F.col("id").alias("rep"), "label", "size", "raw")
    classes = written(described(first.join(written(names), ["digest", "rep"]).dropDuplicates(["digest"]), choose_pivots(good)))
    lists = written(_lists(classes))
    full = lists.groupBy("label", "size", "list").agg(F.count("*").alias("n")).where("n > 1")
    members = lists.join(written(full), ["label", "size", "list"])
    members = members.join(classes.select("digest", "rep", "copies", "near", "raw"), "digest")
    found = written(_compared(paired_blocks(members, ["label", "size", "list"], "digest", "n", BLOCK), least))
    counts = found.where("digest IS NOT NULL").groupBy("digest").agg(F.sum("linked").alias("linked"))
    parts = components(found.where("a IS NOT NULL").select("a", "b"))
    named = classes.select("digest", "rep", "copies").join(counts, "digest", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "digest").join(written(named), "digest", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
