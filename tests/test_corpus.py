"""Chunking and splitting against plain statements of the rules, on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from studylake.operators import corpus as K
from studylake.operators import dialog as D
from studylake.sources import readers, sinks


def texts(seed, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        paras = ["".join(rng.choice("ab 数\n") for _ in range(rng.choice([0, 5, 40, 300, 900]))) for _ in range(rng.randrange(1, 9))]
        out.append(rng.choice(["\n\n", "\n \n"]).join(paras))
    return [*out, "", "Short text", "x" * 2000, " \n\n ", "𝒳" * 900]


def pack(text, size):
    if len(text) <= size:
        return [text]
    chunks, cur = [], ""
    for para in re.split(r"\n\s*\n", text):
        if len(cur) + len(para) + 2 < size:
            cur = f"{cur}\n\n{para}".strip()
        else:
            chunks += [cur] if cur else []
            cur = para
    chunks += [cur] if cur else []
    cut = [c[i : i + size] for c in chunks for i in range(0, len(c), size)]
    return cut or [text]


def sections(text):
    stack, path, body, out = [], "", [], []

    def flush():
        joined = "\n".join(body).strip()
        if joined:
            out.append((path, joined))
        body.clear()

    for line in text.split("\n"):
        m = re.match(r"^(#{2,4})\s+(.+)$", line.strip())
        if m and line.startswith("#"):
            flush()
            stack = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            path = " > ".join(t for _, t in stack)
        else:
            body.append(line)
    flush()
    return out


def semantic(text, size, overlap):
    if len(text) <= size:
        return [(text, "")]
    own = []
    for path, body in sections(text):
        if len(body) <= size:
            own.append((body, path))
            continue
        buf = ""
        for para in re.split(r"\n\s*\n", body):
            if buf and len(buf) + len(para) + 2 > size:
                own.append((buf.strip(), path))
                buf = para
            else:
                buf = f"{buf}\n\n{para}".strip() if buf else para
        if buf.strip():
            own.append((buf.strip(), path))
    out = []
    for i, (chunk, path) in enumerate(own):
        if i and len(out[-1][0]) > overlap:
            tail = out[-1][0][-overlap:]
            cut = tail.find("\n")
            chunk = (tail[cut + 1 :] if cut > overlap // 2 else tail) + "\n" + chunk
        out.append((chunk, path))
    return out


@pytest.mark.parametrize("seed,size", [(1, 100), (2, 300), (3, 800)])
def test_pack_chunks(spark, seed, size):
    data = texts(seed)
    df = spark.createDataFrame(list(enumerate(data)), "i long, text string")
    got = {r.i: list(r.c) for r in df.select("i", K.pack_chunks(F.col("text"), size).alias("c")).collect()}
    for i, text in enumerate(data):
        assert got[i] == pack(text, size), (i, text)
        assert all(len(c) <= max(size, len(text) if len(text) <= size else size) for c in got[i])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_semantic_chunks(spark, seed):
    rng = random.Random(seed)
    data = []
    for text in texts(seed):
        lines = [f"{'#' * rng.choice([1, 2, 3, 4, 5])} title {i}" if rng.random() < 0.2 else l for i, l in enumerate(text.split("\n"))]
        data.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(data)), "i long, text string")
    got = {r.i: [(c.text, c.heading_path) for c in r.c] for r in df.select("i", K.semantic_chunks(F.col("text"), 120, 30).alias("c")).collect()}
    for i, text in enumerate(data):
        assert got[i] == semantic(text, 120, 30), (i, text)


def test_semantic_chunk_plain(spark):
    df = spark.createDataFrame([("Short text",)], "text string").select(F.inline(K.semantic_chunks(F.col("text"))))
    assert [tuple(r) for r in df.collect()] == [("Short text", "", 0, 10)]


@pytest.mark.parametrize("text,want", [
    ("1. 甲\n2. 乙", {1: "甲", 2: "乙"}), ("第1题 甲\n第 2 题 乙\nA. x", {1: "甲", 2: "乙\nA. x"}), ("(1) 甲\n（2） 乙", {1: "甲", 2: "乙"}),
    ("无编号", {1: "无编号"}), ("", {}), ("1. a\n1. b", {1: "b"}), ("前言\n3、c\n\n 4. d", {3: "c", 4: "d"}), ("201. x", {1: "201. x"}),
])
def test_split_questions(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string").select(F.inline(K.split_questions(F.col("text"))))
    assert {r.number: r.content for r in df.collect()} == want


def test_copies_count_once(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = {r.copies: r.doc_id for r in K.content_dedup(docs).collect() if r.copies > 1}
    assert got == {200: 1}


def test_upsert_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 5} " + "w\n\n" * 500, f"kb{i % 2}") for i in range(20)], "doc_id long, text string, kb_name string")
    chunks, path = K.chunk_rows(docs), str(tmp_path / "chunks")
    sinks.upsert_chunks(chunks, path)
    first = spark.read.parquet(path).count()
    sinks.upsert_chunks(chunks, path)
    stored = spark.read.parquet(path)
    assert stored.count() == first == stored.select("chunk_id").distinct().count()
    texts = {kb: {r.text for r in stored.filter(F.col("kb_name") == kb).collect()} for kb in ("kb0", "kb1")}
    assert texts["kb0"] == texts["kb1"] != set()


def test_notifications_are_written_once(spark, tmp_path):
    reports = spark.createDataFrame([(1, "daily", "2024-01-01", "a"), (2, "daily", "2024-01-01", "b")], "learner_id long, report_type string, period string, content string")
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.write_notifications(sinks.notifications(reports), path)
    assert spark.read.json(path).count() == 2


def test_decode_chain(spark):
    rows = [(1, "中文".encode()), (2, "中文内容".encode("gbk")), (3, "𠮷".encode("gb18030")), (4, b"\xff\xfe\xff")]
    got = {r.i: r.text for r in readers.decode_text(spark.createDataFrame(rows, "i long, content binary")).collect()}
    assert (got[1], got[2], got[3]) == ("中文", "中文内容", "𠮷") and got[4] == b"\xff\xfe\xff".decode("latin-1")


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x" * 60)
    (tmp_path / "b").write_text("y")
    got = {(r.filename, r.ext, r["size"]) for r in readers.scan_documents(spark, str(tmp_path)).select("filename", "ext", "size").collect()}
    assert got == {("a.TXT", ".txt", 60), ("b", "", 1)}


def test_embed_batches(spark):
    def encoder():
        return lambda batch: [[float(len(t)), float(len(batch) <= 16)] for t in batch]

    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: list(r.embedding) for r in K.embed(docs, encoder).collect()}
    assert got == {i: [float(i), 1.0] for i in range(50)}


def test_long_conversations_come_in_parts(spark):
    turns = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(25)], "conv_id long, turn long, role string, text string")
    parts = {r.part: r.text for r in D.export_conversation(turns, per_part=10).collect()}
    whole = "".join(parts[p] for p in sorted(parts))
    assert sorted(parts) == [0, 1, 2] and [f"m{i}" for i in range(25)] == re.findall(r"m\d+", whole)


def test_visible_path_follows_selection(spark):
    tree = [(1, None), (2, 1), (3, 1), (4, 2), (5, 3), (6, 5)]
    messages = spark.createDataFrame([(1, m, p, "user", f"t{m}") for m, p in tree], "conv_id long, message_id long, parent_id long, role string, text string")
    assert sorted(r.message_id for r in D.visible_path(messages).collect()) == [1, 3, 5, 6]
    picked = spark.createDataFrame([(1, 1, 2)], "conv_id long, parent_id long, selected long")
    assert sorted(r.message_id for r in D.visible_path(messages, picked).collect()) == [1, 2, 4]
