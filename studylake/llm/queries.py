"""The registered queries of the operators in this subpackage, with SQL where SQL can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.llm import (
    byte_bpe, contextual_pii, decontaminate, language_bitmask, lexicon_toxicity, means_tree, minmax_dedup, pivot_dedup, prefix_trie, reply_trees, shard_tree, text_density,
    token_alignment,
)
from studylake.llm.common import settings, written
from studylake.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Production parameters.
RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = 8
ALIGNED_FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op1_minmax_dedup", NEAR_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(load(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = rf"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, d.size, item_id FROM doc_windows d JOIN item_windows m ON d.win = m.win AND d.size = m.size),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op2_decontaminate", DECONTAMINATE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS good FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id AND x.good AND y.good
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN counts USING (vec_id) GROUP BY vec_id"""


@query("op3_pivot_dedup", VECTOR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS r,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS t FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(r + t + 20) AS chars
  FROM sized GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM joined"""


@query("op4_reply_trees", CHAT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree in which every turn answers the one before."""
    extra = spark.sql(
        "SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    messages = turns.select(F.col("conv_id").alias("tree"), place.cast("long").alias("id"), "role", "text", F.lit(1.0).alias("score"))
    messages = messages.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))
    found = reply_trees.conversations(messages)
    read = found.select("tree", "conversation", reply_trees.read_back(F.col("conversation")).alias("turns"), reply_trees.masked(F.col("conversation"), F.col("loss")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


@query("op5_text_density")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_density.main_text(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def _descend_sql(tree: list[shard_tree.Leaf]) -> str:
    """The shard of ``id`` in SQL: a common table expression's columns p1, p2, p3 descend level by level."""

    def draw(child: str, weight: float) -> str:
        return f"-ln((CAST(('0x' || substr(md5(id || '{child}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {weight}::DOUBLE"

    def choose(path: str, level: dict[str, dict[str, float]]) -> str:
        cases = " ".join(
            f"WHEN {path} = '{parent}' THEN list_min([{', '.join(f"{{'d': {draw(c, w)}, 'p': '{c}'}}" for c, w in children.items())}]).p"
            for parent, children in level.items()
        )
        return f"CASE {cases} END"

    one, two, three = shard_tree.levels_of(tree)
    return (
        f"SELECT id, CAST(split_part({choose('p2', three)}, '/', -1) AS INTEGER) AS shard "
        f"FROM (SELECT id, {choose('p1', two)} AS p2 FROM (SELECT id, {choose("''", one)} AS p1 FROM ids))"
    )


SHARD_SQL = f"""
WITH ids AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
old AS ({_descend_sql(shard_tree.tree_of(SHARDS))}),
new AS ({_descend_sql(shard_tree.tree_of(SHARDS + 1))}),
raw AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
docs AS (
  SELECT doc_id, id, len(bytes) + 1 AS size, CAST(xor(list_reduce(bytes,
    lambda c, x: list_reduce([xor(c, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, k: xor(a >> 1, 3988292384 * (a & 1))), 4294967295), 4294967295) AS BIGINT) AS text_crc32 FROM raw)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, old.shard AS shard,
  row_number() OVER (PARTITION BY old.shard ORDER BY CAST(('0x' || substr(md5(id), 1, 8)) AS BIGINT) % {shard_tree.BUCKETS}, doc_id, text_crc32, size) - 1 AS slot,
  new.shard AS grown_shard
FROM docs JOIN old USING (id) JOIN new USING (id)"""


@query("op6_hash_tree_shards", SHARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    grown = shard_tree.shard_of(F.col("doc_id"), shard_tree.tree_of(SHARDS + 1))
    shards = shard_tree.with_slots(shard_tree.placed(docs, shard_tree.tree_of(SHARDS)), "doc_id", ["doc_id", "text_crc32", "size"])
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), grown.alias("grown_shard"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents").select("doc_id", "text"))


def encoded(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_tokens, ids_sha256 and decoded_sha256."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    both = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return both.withColumns({"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("token_ids", "decoded")


@query("op8_language_bitmask")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = language_bitmask.held_out(F.col("doc_id"), 3, 1)
    fitted = language_bitmask.fit(docs.where(~out).select("doc_id", "text", "lang"))
    return language_bitmask.predict(docs.select("doc_id", "text", out.alias("held_out")), fitted).drop("text")


@query("op9_contextual_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, contextual_pii.NAMES), F.sha2(contextual_pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        contextual_pii.listed(F.col("spans")).alias("spans"),
    )


@query("op10_lexicon_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    out = language_bitmask.held_out(F.col("doc_id"), 5, 0)
    fitted = lexicon_toxicity.fit(docs.where(~out), labels.where(~out))
    return lexicon_toxicity.score(docs.withColumn("held_out", out), fitted).drop("text")


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) AS place, tok, size FROM (
    SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok,
      octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL)),
lens AS (SELECT conv_id, max(place) AS len, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, len, conv_id - conv_id % 5 AS source, CAST(xor(list_reduce(bytes,
    lambda c, x: list_reduce([xor(c, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, k: xor(a >> 1, 3988292384 * (a & 1))), 4294967295), 4294967295) AS BIGINT) % 9 AS h FROM lens),
convs AS (SELECT c.conv_id, c.source, c.h, least(c.h, coalesce(g.len, 0)) AS base, least(c.h, coalesce(g.len, 0)) + greatest(c.len - c.h, 0) AS n FROM heads c LEFT JOIN heads g ON g.conv_id = c.source),
rebuilt AS (
  SELECT c.conv_id, base + place - h AS depth, tok, size FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE place > h
  UNION ALL SELECT c.conv_id, place, tok, size FROM turns t JOIN convs c ON t.conv_id = c.source WHERE place <= h),
whole AS (SELECT conv_id, list(tok ORDER BY depth) AS toks, list(size ORDER BY depth) AS sizes FROM rebuilt GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, CASE WHEN d = 0 THEN '' ELSE md5(array_to_string(toks[1:d], ',')) END AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = n AS at_end
  FROM (SELECT c.conv_id, n, toks, sizes, unnest(range(0, n + 1)) AS d FROM convs c LEFT JOIN whole w ON w.conv_id = c.conv_id)),
nodes AS (
  SELECT key, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end), '') AS ends FROM prefixes GROUP BY key),
steps AS (SELECT n.key, p.key AS parent FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS key, count(*) AS n FROM steps GROUP BY parent),
under AS (
  SELECT p.key, sum((u.n_convs - 1) * u.size) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN children c ON c.key = u.key GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN under USING (key) LEFT JOIN children c ON c.key = n.key LEFT JOIN steps s ON s.key = n.key LEFT JOIN nodes p ON p.key = s.parent"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*rebuilt(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, n, depth, digest, size) of the rebuilt conversations, and the ids of those without turns.

    The first h turns of conversation c are those of conversation c - c % 5 (there are up to five such c), the others its own.
    """
    turns = written(prefix_trie.numbered(conversations))
    lens = turns.groupBy("conv_id").agg(F.max("place").alias("len"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    heads = lens.withColumns({"source": F.col("conv_id") - F.col("conv_id") % 5, "h": h})
    base = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = heads.join(lens.select(F.col("conv_id").alias("source"), F.col("len").alias("there")), "source", "left")
    convs = written(convs.select("conv_id", "source", "h", base.alias("base"), (base + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("n")))
    own = turns.join(convs, "conv_id").where("place > h").withColumn("depth", F.col("base") + F.col("place") - F.col("h"))
    heads = turns.where("place <= 8").withColumnRenamed("conv_id", "source")
    lent = heads.join(convs, "source").where("place <= h").withColumn("depth", F.col("place"))
    columns = ["conv_id", "n", "depth", "digest", "size"]
    return own.select(columns).unionByName(lent.select(columns)), convs.where("n = 0").select("conv_id")


@query("op12_means_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return means_tree.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_a, raw_b = (token_alignment.read_file(public_tokenizers.path(name)) for name in ALIGNED_FILES)
    aligned = token_alignment.align(load(spark, sf_dir, "documents").select("doc_id", "text"), raw_a, raw_b)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = written(aligned.withColumns({"groups_sha256": digest, "row": F.monotonically_increasing_id()}).drop("groups"))
    return token_alignment.scored(aligned, token_alignment.pieced(raw_b).size)
