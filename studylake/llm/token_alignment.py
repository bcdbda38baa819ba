"""Cross-tokenizer alignment: the ids of two tokenizers, cut into the smallest groups that cover the same bytes.

Both tokenizers encode " " + text. A dictionary from each cumulative end (in bytes) to its token's index is made for either
id list; the keys that both hold, sorted, slice the two lists into groups. The links of a slice are its pairs of
overlapping tokens. Over all texts, links are counted by id pair, and each text is scored by these counts.

Null and empty texts, and texts whose tokens of either side do not spell " " + text (characters a vocabulary normalises
or lacks), have no tokens: zeros, '' for the groups. Rows are independent: repeated rows give repeated results, counted each time;
an empty table gives an empty one. Other columns are carried on, but a column named like an output is replaced. Long
texts are encoded piece by piece, cut where no token of either vocabulary goes on, with the result of one call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studylake.llm.common import append, once, written

#: Largest vocabulary file that is sent to the tasks.
MAX_FILE_BYTES = 32 << 20
#: Characters after which a long text is cut at the next boundary.
PIECE = 1 << 16
#: Counts of this many id pairs, the most frequent, are sent to the tasks; the others are joined.
HOT_PAIRS = 1 << 20
#: A space between a character that is no white space and an ASCII letter starts a token on both sides.
_CUT = re.compile(r"(?<=\S)(?= [A-Za-z])")
#: How GPT-2 style byte-level vocabularies split a text before merging (fixed value).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"


@dataclass
class Coder:
    """One tokenizer: ``encode`` a piece that starts with a space, the bytes of each id, whether all texts are spelled as they are."""

    encode: Callable[[str], np.ndarray]
    spelled: list[bytes]
    lossless: bool = False

    @property
    def size(self) -> int:
        return len(self.spelled)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_FILE_BYTES + 1)
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has over {MAX_FILE_BYTES} bytes")
    return raw


def _byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(raw: bytes) -> Coder:
    """The coder of a byte-level BPE file of the ``tokenizers`` library.

    Where ids follow the merges and nothing is normalised, merging by rank gives the same ids, and tiktoken does it several times faster.
    """
    spec = json.loads(raw)
    model, added = spec["model"], {t["id"] for t in spec["added_tokens"]}
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i not in added}
    spelled = [b""] * (max([*ranks.values(), *added]) + 1)
    for token, i in ranks.items():
        spelled[i] = token
    for token in spec["added_tokens"]:
        spelled[token["id"]] = token["content"].encode()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    in_order = len(ranks) == 256 + len(merged) and all(model["vocab"][m] == 256 + i for i, m in enumerate(merged))
    before = spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if in_order and plain and not spec["normalizer"] and not model.get("ignore_merges"):
        fast = tiktoken.Encoding("local", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        return Coder(lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64), spelled, lossless=True)
    slow = Tokenizer.from_str(raw.decode())
    slow.encode_special_tokens = True
    return Coder(lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.int64), spelled)


def pieced(raw: bytes) -> Coder:
    """The coder of a ``sentencepiece`` model that puts a space before each text."""
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def spell(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    spelled = [spell(i) for i in range(model.get_piece_size())]
    return Coder(lambda text: np.array(model.encode(text[1:], num_threads=1), np.int64), spelled)


def aligner(raw_a: bytes, raw_b: bytes) -> Callable[[str | None], tuple]:
    """The function from a text to its row of ``ALIGNED``; an id pair is written as a * (size of B) + b."""
    a_coder, b_coder = byte_level(raw_a), pieced(raw_b)
    sizes_a, sizes_b = (np.array([len(s) for s in c.spelled], np.int64) for c in (a_coder, b_coder))
    # Tokens as text with what follows them: inside and at the end of a group's ids of A, then of B.
    shown = [f"{i}{end}" for end, n in ((",", a_coder.size), ("|", a_coder.size), (",", b_coder.size), (";", b_coder.size)) for i in range(n)]
    none = (0, 0, 0, 0, "", [], [])

    def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the last tokens of each group, in A and in B."""
        at_a = dict(zip(ends_a.tolist(), range(len(ends_a))))
        at_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
        common = list(filter(at_b.__contains__, at_a))  # sorted, as ends ascend
        return tuple(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))

    def links(ends_a: np.ndarray, ends_b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token indices (A, B) of every link, of all slices at once: in a slice, one link ends wherever a token of either side does.

        The partner of the token that ends there is the first one of the other side that does not end before.
        """
        inner = np.ones(len(ends_b), bool)
        inner[last_b] = False
        rest = np.flatnonzero(inner)
        i = np.concatenate((np.arange(len(ends_a)), np.searchsorted(ends_a, ends_b[rest])))
        return i, np.concatenate((np.searchsorted(ends_b, ends_a), rest))

    def listed(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as a1,a2|b1;a3|b2,b3; with a semicolon after each."""
        n_a, n_b = last_a.copy(), last_b.copy()
        n_a[1:] -= last_a[:-1]
        n_b[1:] -= last_b[:-1]
        n_a[0] += 1
        n_b[0] += 1
        code_a, code_b = a.copy(), b + 2 * a_coder.size
        code_a[last_a] += a_coder.size
        code_b[last_b] += b_coder.size
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(last_b + 1 - n_b, n_a)] = code_a
        code[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = code_b
        return "".join(map(shown.__getitem__, code.tolist()))

    def pieces(text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE and (cut := _CUT.search(text, start + PIECE)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def align(text: str | None) -> tuple:
        if not text:
            return none
        n_a = n_b = n_groups = n_links = 0
        groups, pairs = [], []
        for piece in pieces(" " + text):
            raw, a, b = piece.encode(), a_coder.encode(piece), b_coder.encode(piece)
            if any(b"".join(map(c.spelled.__getitem__, ids.tolist())) != raw for ids, c in ((b, b_coder), (a, a_coder)) if not c.lossless):
                return none
            # A token without bytes would end where another does: such vocabularies are not for this operator.
            ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
            last_a, last_b = slices(ends_a, ends_b)
            i, j = links(ends_a, ends_b, last_b)
            groups.append(listed(a, b, last_a, last_b))
            pairs.append(a[i] * b_coder.size + b[j])
            n_a, n_b, n_groups, n_links = n_a + len(a), n_b + len(b), n_groups + len(last_a), n_links + len(i)
        found, times = np.unique(np.concatenate(pairs), return_counts=True)
        return n_a, n_b, n_groups, n_links, "".join(groups)[:-1], found, times

    return align


def align(df: DataFrame, raw_a: bytes, raw_b: bytes, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with the columns ``ALIGNED``: token, group and link counts, the groups as ``a1,a2|b1;a3|b2,b3``, and the distinct id
    pairs of the links with the number of links of each. ``raw_a``: a byte-level ``tokenizers`` file, ``raw_b``: a ``sentencepiece`` model."""
    shared = df.sparkSession.sparkContext.broadcast((raw_a, raw_b))

    def make():
        one = once(shared, aligner)

        def work(batch: pa.RecordBatch) -> list[list]:
            rows = [one(v) for v in batch.column(text).to_pylist()]
            return [list(column) for column in zip(*rows)]

        return work

    return append(df, ALIGNED, make, drop=() if keep_text else (text,))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Rows (pair, n, best): in how many links of all texts an id pair stands, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    b = F.pmod("pair", F.lit(size_b))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return written(counts.join(most, b == most.b).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _least_hot(counts: DataFrame, hot: int) -> int:
    """The smallest power of two such that at most ``hot`` pairs have that many links; the classes are at most 63 rows."""
    classes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()
    least, room = 63, hot
    for k, pairs in sorted(((r["k"], r["count"]) for r in classes), reverse=True):
        if (room := room - pairs) < 0:
            break
        least = k
    else:
        return 1
    return 1 << least if least < 63 else (1 << 63) - 1


def scored(aligned: DataFrame, size_b: int, hot: int = HOT_PAIRS) -> DataFrame:
    """``aligned``, a written table with a column ``row`` of unique ids, with ``n_best`` and ``count_sum`` in place of its pairs.

    ``count_sum`` adds up the count of each link's pair, ``n_best`` counts the links whose pair is the most frequent of its
    B id. The ``hot`` most frequent pairs are looked up in the tasks; the others, rare ones, are joined.
    """
    counts = pair_counts(aligned, size_b)
    least = _least_hot(counts, hot)
    table = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def make():
        keys, n, best = shared.value

        def work(batch: pa.RecordBatch) -> list[list]:
            # All rows of a batch at once, from the lists' flat values; sums of a row are differences of running sums.
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = np.cumsum(np.concatenate(([0], pairs.value_lengths().to_numpy())))
            p, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
            known = keys[at] == p if len(keys) else np.zeros(len(p), bool)
            seen = np.where(known, t, 0)
            sums = [np.concatenate(([0], np.cumsum(seen * (of[at] if len(keys) else 0))))[ends] for of in (best, n)]
            cut = np.concatenate(([0], np.cumsum(~known)))[ends].astype(np.int32)
            rare = [pa.ListArray.from_arrays(cut, pa.array(v[~known])) for v in (p, t.astype(np.int32))]
            return [np.diff(sums[0]), np.diff(sums[1]), *rare]

        return work

    first = append(aligned, "n_best long, count_sum long, pairs array<bigint>, times array<int>", make)
    if least == 1:
        return first.drop("pairs", "times", "row")
    rare = first.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    rare = rare.join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    joined = first.join(more, "row", "left")
    added = {c: (F.col(c) + F.coalesce(m, F.lit(0))).cast("long") for c, m in (("n_best", "_best"), ("count_sum", "_sum"))}
    return joined.withColumns(added).drop("pairs", "times", "row", "_best", "_sum")
