"""Token groups and links against the libraries of the two vocabularies and a plain restatement."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studylake.llm import token_alignment as T
from studylake.llm.common import settings, written
from studylake.llm.queries import ALIGNED_FILES
from tests.llm.helpers import edge, empty, prose

A, B = (public_tokenizers.path(n) for n in ALIGNED_FILES)
RAW = T.read_file(A), T.read_file(B)
TEXTS = [
    "Hello world, it's 12345 o'clock.", "  two  spaces\n\n\nlines\t\ttabs ", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — 你好世界 \U0001f600\U0001f468‍\U0001f469", "ﬁne ① ½ Ａ",
    "á ë ​ 　x", "▁under▁score ▁▁", "x" * 5000, " ", "\n", "", None, "don't DON'T 'S ''", "кириллица и العربية", "\x00\x01 a", "word " * 30_000, prose(3, 20_000),
]


def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute(texts):
    """Per text (n_a, n_b, groups, links as id pairs), byte by byte."""
    a, b = libraries()
    letters = T._byte_of_letter()
    out = []
    for text in texts:
        if not text:
            out.append(([], [], "", []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        spell_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
            out.append(([], [], "", []))
            continue
        owner_a = [i for i, s in enumerate(spell_a) for _ in s]
        owner_b = [i for i, s in enumerate(spell_b) for _ in s]
        links = dict.fromkeys(zip(owner_a, owner_b))
        groups, x, y = [], [], []
        for at in range(len(owner_a)):
            last = at + 1 == len(owner_a)
            end_a, end_b = last or owner_a[at + 1] != owner_a[at], last or owner_b[at + 1] != owner_b[at]
            x += [str(ids_a[owner_a[at]])] if end_a else []
            y += [str(ids_b[owner_b[at]])] if end_b else []
            if end_a and end_b:
                groups.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        out.append((ids_a, ids_b, ";".join(groups), [(ids_a[i], ids_b[j]) for i, j in links]))
    return out


def want(texts):
    each = brute(texts)
    counts = Counter(p for *_, links in each for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
         sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links))
        for a, b, groups, links in each
    ]


def got(df, hot=T.HOT_PAIRS):
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = written(T.align(df, *RAW).withColumns({"groups_sha256": digest, "row": F.monotonically_increasing_id()}).drop("groups"))
    out = T.scored(aligned, T.pieced(RAW[1]).size, hot)
    return {r["at"]: tuple(r[c] for c in "n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()) for r in out.collect()}


@pytest.mark.parametrize("hot", [T.HOT_PAIRS, 50, 0])
def test_brute(spark, hot):
    """All counts sent to the tasks, some, none."""
    settings(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS[:3])], "at int, text string").repartition(3)
    found = got(df, hot)
    assert [found[i] for i in range(len(found))] == want(TEXTS + TEXTS[:3])


def test_pieces(monkeypatch):
    """A text cut at every boundary has the groups of the whole one."""
    text = prose(5, 400) + "  double  spaces\n new line don't stop 12 a1 你好 word"
    whole = T.aligner(*RAW)(text)
    monkeypatch.setattr(T, "PIECE", 1)
    pieced = T.aligner(*RAW)(text)
    assert whole[:5] == pieced[:5] and all((x == y).all() for x, y in zip(whole[5:], pieced[5:]))


def test_fast_ids_are_the_library_s():
    """Every code point that the given tables may hold, alone and beside letters: ids as by the library of the file."""
    slow, _ = libraries()
    fast = T.byte_level(RAW[0])
    assert fast.lossless
    points = [chr(c) for c in [*range(0x3100), *range(0x4E00, 0x5200), *range(0xAC00, 0xAD00), *range(0x1F300, 0x1F700)]]
    for at in range(0, len(points), 64):
        text = " " + "".join(f"a{c} {c}{c}1" for c in points[at : at + 64])
        assert fast.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark):
    settings(spark)
    df = edge(spark, "n_a int, groups string, pairs string, n_best string, row string")
    aligned = written(T.align(df, *RAW).withColumn("row", F.monotonically_increasing_id()))
    out = T.scored(aligned, T.pieced(RAW[1]).size).collect()
    assert len(out) == df.count()
    assert all((r["n_a"], r["groups"], r["count_sum"]) == (0, "", 0) for r in out if r["doc_id"] in (4, 5) or (r["doc_id"] is None and r["n_a"] == 0))
    none = written(T.align(empty(spark), *RAW).withColumn("row", F.monotonically_increasing_id()))
    assert T.scored(none, T.pieced(RAW[1]).size).count() == 0
