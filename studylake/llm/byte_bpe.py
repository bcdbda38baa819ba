"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut at safe boundaries before encoding, so a very long text is encoded piece by piece
with the same result as in one call. Ids are packed as little-endian unsigned 32-bit integers.

Null text encodes as the empty text (no ids, empty bytes); null ids decode to empty bytes. Rows are
independent: repeated rows give repeated results, an empty table gives an empty one. Other columns
are carried on, but a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from studylake.llm.common import append

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 1 << 16
#: Largest rank file that is sent to the tasks.
MAX_RANK_BYTES = 16 << 20
#: Before white space that follows something else, and between ASCII letters and digits, no match
#: of the GPT-2 style patterns goes on, and none looks behind.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def pieces(text: str, size: int = PIECE):
    """``text`` cut at the first safe boundary after each ``size`` characters."""
    start = 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packed(coder: tiktoken.Encoding, value: str | None) -> bytes:
    parts = (coder.encode_to_numpy(p, disallowed_special=()) for p in pieces(value or ""))
    return b"".join(p.astype("<u4", copy=False).tobytes() for p in parts)


def _raw(coder: tiktoken.Encoding, packed: bytes | None) -> bytes:
    values = np.frombuffer(packed or b"", "<u4")
    return b"".join(coder.decode_bytes(values[at : at + PIECE].tolist()) for at in range(0, len(values), PIECE))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` and ``token_ids`` (packed ids) for its column ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        coder = _encoding(shared.value, pattern)

        def work(batch: pa.RecordBatch) -> list[list]:
            ids = [_packed(coder, v) for v in batch.column(text).to_pylist()]
            return [[len(b) // 4 for b in ids], ids]

        return work

    return append(df, "n_tokens long, token_ids binary", make, drop=() if keep_text else (text,))


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the packed ids in its column ``ids``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        coder = _encoding(shared.value, pattern)
        return lambda batch: [[_raw(coder, v) for v in batch.column(ids).to_pylist()]]

    return append(df, "decoded binary", make)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and then ``decode``, without the text, in one Python worker a task."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        coder = _encoding(shared.value, pattern)

        def work(batch: pa.RecordBatch) -> list[list]:
            ids = [_packed(coder, v) for v in batch.column(text).to_pylist()]
            return [[len(b) // 4 for b in ids], ids, [_raw(coder, b) for b in ids]]

        return work

    return append(df, "n_tokens long, token_ids binary, decoded binary", make, drop=(text,))
