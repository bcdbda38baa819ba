import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from studylake.llm import byte_bpe as B
from tests.llm.helpers import edge, edge_rows, empty, prose

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_edges_round_trip(spark):
    df = edge(spark, "n_tokens string, token_ids int")
    got = B.decode(B.encode(df, RANKS, public_tokenizers.PATTERN, keep_text=True), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        want = CODER.encode_ordinary(r.text or "")
        assert list(struct.unpack(f"<{r.n_tokens}I", r.token_ids)) == want and bytes(r.decoded) == (r.text or "").encode()
    both = B.round_trip(df, RANKS, public_tokenizers.PATTERN).select("token_ids", "decoded").collect()
    assert sorted((bytes(r.token_ids), bytes(r.decoded)) for r in both) == sorted((bytes(r.token_ids), bytes(r.decoded)) for r in got)
    assert B.encode(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sdt1 \n\t\r  \x1c!.é你")), max_size=80), st.integers(1, 9))
def test_pieces_give_the_ids_of_the_whole(text, size):
    parts = list(B.pieces(text, size))
    assert "".join(parts) == text
    assert sum((CODER.encode_ordinary(p) for p in parts), []) == CODER.encode_ordinary(text)


def test_pieces_of_prose():
    text = prose(3, 5000)
    assert len(list(B.pieces(text, 1000))) > 20
    assert list(B.pieces("", 10)) == [""] and list(B.pieces("x" * 100, 10)) == ["x" * 100]
