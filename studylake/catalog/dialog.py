"""Conversations and memory citations."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.text import strip_sql
from studylake.operators import dialog as D
from studylake.sources.tables import load, oracle, view


@query(
    "a08_export_conversation",
    f"""SELECT conv_id, CAST(0 AS BIGINT) AS part, concat('# Chat Session', chr(10), chr(10),
      string_agg(rtrim(concat('## ', CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END, chr(10), chr(10), {strip_sql('text')})),
        concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn), chr(10)) AS text FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    return D.export_conversation(load(spark, sf, "conversations"))


@query(
    "w14_sibling_info",
    oracle(["messages"], """SELECT conv_id, message_id, count(*) OVER (PARTITION BY conv_id, parent_id) AS siblings,
      row_number() OVER (PARTITION BY conv_id, parent_id ORDER BY message_id) AS place FROM messages"""),
)
def _(spark, sf):
    return D.sibling_info(view(spark, sf, "messages")).select("conv_id", "message_id", "siblings", "place")


@query(
    "w14_visible_path",
    oracle(["messages"], """RECURSIVE, b AS (SELECT conv_id, parent_id, max(message_id) AS message_id FROM messages GROUP BY 1, 2),
      p AS (SELECT conv_id, message_id FROM b WHERE parent_id IS NULL
        UNION ALL SELECT b.conv_id, b.message_id FROM p JOIN b ON b.conv_id = p.conv_id AND b.parent_id = p.message_id)
      SELECT m.conv_id, m.message_id, m.role, m.text FROM messages m JOIN p ON p.conv_id = m.conv_id AND p.message_id = m.message_id"""),
)
def _(spark, sf):
    return D.visible_path(view(spark, sf, "messages")).select("conv_id", "message_id", "role", "text")


_SURFACE = "CASE c_nationkey % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'quiz' WHEN 2 THEN 'book' ELSE 'notes' END"
_L2 = f"""SELECT 2 AS layer, {_SURFACE} AS place, concat('m_', CAST(o_custkey % 400 AS STRING)) AS entry_id, o_orderkey AS seq,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'quiz' ELSE 'kb' END, ':e', CAST(o_orderkey % 50 AS STRING)) AS r1,
  concat('quiz:u:', CAST(o_orderkey % 7 AS STRING)) AS r2, 'plain' AS r3 FROM orders JOIN customer ON c_custkey = o_custkey"""
_L3 = f"""SELECT 3 AS layer, CASE c_nationkey % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'recent' ELSE 'scope' END AS place, concat('p', CAST(c_custkey AS STRING)) AS entry_id,
  c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'chat' ELSE 'quiz' END AS r1, concat('chat:m_', CAST(c_custkey % 600 AS STRING)) AS r2, 'quiz:x' AS r3 FROM customer"""
_L1 = "SELECT CASE p_partkey % 2 WHEN 0 THEN 'chat' ELSE 'quiz' END AS surface, CASE p_partkey % 3 WHEN 0 THEN concat('u:', CAST(p_partkey % 5 AS STRING)) ELSE concat('e', CAST(p_partkey % 40 AS STRING)) END AS entity_id FROM part"


@query(
    "c09_citation_edges",
    f"""WITH a AS ({_L2} UNION ALL {_L3}), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, place, entry_id ORDER BY seq) AS n FROM a) x WHERE n = 1),
      r AS (SELECT layer, place, entry_id, 0 AS pos, r1 AS ref FROM once UNION ALL SELECT layer, place, entry_id, 1, r2 FROM once UNION ALL SELECT layer, place, entry_id, 2, r3 FROM once),
      s AS (SELECT *, concat('L', CAST(layer AS VARCHAR), ':', place, ':', entry_id) AS source, split_part(ref, ':', 1) AS surface,
        CASE WHEN contains(ref, ':') THEN substr(ref, strpos(ref, ':') + 1) ELSE '' END AS target FROM r),
      l1 AS (SELECT DISTINCT surface, entity_id FROM ({_L1}) y),
      l2 AS (SELECT entry_id, arg_max(place, coalesce(list_position(['chat', 'notebook', 'quiz', 'kb', 'book', 'tutorbot', 'cowriter'], place), 0)) AS place
        FROM once WHERE layer = 2 GROUP BY 1),
      st3 AS (SELECT s.*, o.place AS l2_at FROM s JOIN l2 o ON o.entry_id = s.target WHERE s.layer = 3 AND starts_with(s.target, 'm_')),
      an AS (SELECT source, surface, min(pos) AS pos FROM s WHERE layer = 3 AND NOT starts_with(target, 'm_') AND surface IN ('chat', 'notebook', 'quiz', 'kb', 'book', 'tutorbot', 'cowriter') GROUP BY 1, 2)
      SELECT DISTINCT source, concat('L1:', s.surface, ':', target) AS target, 'strong' AS kind FROM s JOIN l1 ON l1.surface = s.surface AND l1.entity_id = s.target WHERE layer = 2
      UNION SELECT source, concat('L2:', l2_at, ':', target), 'strong' FROM st3
      UNION SELECT source, concat('L2:', surface, ':__anchor__'), 'soft' FROM an WHERE NOT EXISTS
        (SELECT 1 FROM st3 WHERE st3.source = an.source AND st3.surface = an.surface AND st3.pos <= an.pos)""",
)
def _(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    l2 = spark.sql(_L2.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}"), orders=orders, customer=customer)
    l3 = spark.sql(_L3.replace("FROM customer", "FROM {customer}"), customer=customer)
    entries = l2.union(l3).select("layer", "place", "entry_id", "seq", F.array("r1", "r2", "r3").alias("refs"))
    return D.citation_edges(entries, spark.sql(_L1.replace("FROM part", "FROM {part}"), part=load(spark, sf, "part")))
