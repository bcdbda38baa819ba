"""The trie of rebuilt conversations against a plain restatement."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from studylake.llm import prefix_trie as T
from studylake.llm.common import settings
from studylake.llm.queries import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            tok = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), tok, len((text or "").encode())))
    turns = {c: [(tok, size) for _, tok, size in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * node[-1][1] if node else 0)
    out = set()
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(of), len(node), parent, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return [tuple(r) for r in df.select(names).collect()]


def awkward():
    r = random.Random(5)
    rows = []
    for c in range(60):
        rows += [(c, t, r.choice(["user", None]), r.choice(["a", "bé", None]), 1, "k", "n") for t in range(r.randrange(1, 14))]
    rows += [(c, t, "user", f"same {t}", None, None, None) for c in range(100, 140) for t in range(12)]  # copies
    rows += [(200, t, "user", f"same {t}" if t < 11 else f"own {t}", None, None, None) for t in range(3000)]  # a long one
    rows += [(205, None, "user", "no turn", None, None, None), (205, 3, None, None, None, None, None), (205, 3, None, None, None, None, None)]
    rows += [(None, 0, "user", "no conversation", None, None, None), (311, 0, "user", "short", None, None, None)]
    return rows


@pytest.mark.parametrize("batches", [1, 3])
def test_brute(spark, batches):
    settings(spark)
    rows = awkward()
    found = got(T.trie(*rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(5)), batches=batches))
    want, n = brute(rows)
    assert len(found) == n and set(found) == want


def test_empty(spark):
    settings(spark)
    assert got(T.trie(*rebuilt(spark.createDataFrame([], SCHEMA)))) == []
    assert got(T.trie(*rebuilt(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], SCHEMA)))) == []


def test_turnless_only(spark):
    settings(spark)
    h = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    found = got(T.trie(*rebuilt(spark.createDataFrame([(h, 0, "user", "x", None, None, None)], SCHEMA))))
    assert found == [(h, 0, None, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())]


def test_running_over_tasks(spark):
    """A key that goes over all tasks, and keys at their borders."""
    settings(spark)
    rows = spark.range(5000).select(F.when(F.col("id") < 10, 0).when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("long").alias("k"), "id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("lanes"))
    sums = T.running(rows, "k", [F.col("id")], 1).select("k", "id", F.conv(F.hex("total"), 16, 10).cast("long").alias("total"), F.conv(F.hex("before"), 16, 10).cast("long").alias("before"))
    seen = defaultdict(int)
    for k, i, total, before in sorted(tuple(r) for r in sums.collect()):
        assert before == seen[k]
        seen[k] += i
        assert total == seen[k]


def test_search_finds_the_exit(spark):
    """The fat binary search gives the longest prefix that the trie holds."""
    settings(spark)
    r = random.Random(2)
    seqs = {c: [r.choice("ab") for _ in range(r.randrange(1, 40))] for c in range(80)}
    seqs |= {c: seqs[c - 80][: r.randrange(1, 40)] + list("xyz"[: r.randrange(0, 3)]) for c in range(80, 120)}
    turns = spark.createDataFrame([(c, len(s), d, x, 1) for c, s in seqs.items() for d, x in enumerate(s, 1)], "conv_id long, n long, depth long, digest string, size long")
    table = T.written(T.prefixes(turns))
    each = table.where("depth = n").select(F.col("conv_id").alias("seq"), "n")
    paths = T.Paths(table, each)
    nodes = T.insert(None, each.where("seq < 80"), paths)
    held = {tuple(s[:d]) for c, s in seqs.items() if c < 80 for d in range(len(s) + 1)}
    for row in T.exits(nodes, each.where("seq >= 80"), paths).collect():
        s = seqs[row["seq"]]
        assert row["match"] == max(d for d in range(len(s) + 1) if tuple(s[:d]) in held)
