"""Conversations: export, branches, citation edges between memory layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import strip
from studylake.operators.corpus import assemble
from studylake.session import checkpoint_dir

SEPARATOR = "\n\n---\n\n"


def role_heading(role: Column) -> Column:
    return F.when(role == "user", "User").when(role == "assistant", "Assistant").otherwise("System")


def export_conversation(messages: DataFrame, title: str = "Chat Session", per_part: int | None = None) -> DataFrame:
    """Markdown of each conversation, on demand in parts of ``per_part`` turns; part 0 carries the heading."""
    entry = F.concat(F.lit("## "), role_heading(F.col("role")), F.lit("\n\n"), strip(F.coalesce("text", F.lit(""))))
    parts = assemble(messages, "conv_id", "turn", F.rtrim(entry), SEPARATOR, per_part)
    head = F.when(F.col("part") == 0, f"# {title}\n\n").otherwise("")
    return parts.withColumn("text", F.concat(head, "text", F.lit("\n")))


def sibling_info(messages: DataFrame) -> DataFrame:
    """Number and 1-based place of each message among those with the same parent.

    Siblings are the edits of one turn, so the windows stay small.
    """
    group = Window.partitionBy("conv_id", "parent_id")
    return messages.withColumns(
        {
            "siblings": F.count(F.lit(1)).over(group),
            "place": F.row_number().over(group.orderBy("message_id")).cast("long"),
        }
    )


def visible_path(messages: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Messages on the shown branch: at each fork the selected child, else the newest.

    Choosing a child needs only its siblings.  A message is shown when it and all its ancestors
    are chosen; that is followed by doubling: after round n every message knows its ancestor 2^n
    steps up, so the rounds grow with the log of the longest branch.  Each round is checkpointed
    in the shared folder, which keeps the plan short and survives lost executors.  A round that
    roots no further message is the last: what is left goes round a loop of parents and is not shown.
    """
    best = messages.groupBy("conv_id", "parent_id").agg(F.max("message_id").alias("newest"))
    if selected is not None:
        best = best.join(
            selected.select("conv_id", "parent_id", "selected"),
            (best["conv_id"] == selected["conv_id"]) & best["parent_id"].eqNullSafe(selected["parent_id"]), "left",
        ).select(best["conv_id"], best["parent_id"], F.coalesce("selected", "newest").alias("newest"))
    chosen = messages.join(
        best.select("conv_id", F.col("newest").alias("message_id")), ["conv_id", "message_id"], "left_semi"
    )
    links = chosen.select("conv_id", "message_id", F.col("parent_id").alias("up"), F.col("parent_id").isNull().alias("rooted"))
    checkpoint_dir(messages.sparkSession)
    links = links.checkpoint()
    before, now = -1, links.filter("rooted").count()
    while before < now and not links.filter("NOT rooted AND up IS NOT NULL").isEmpty():
        above = links.select(
            "conv_id", F.col("message_id").alias("up"), F.col("up").alias("up2"), F.col("rooted").alias("rooted2")
        )
        rooted = F.col("rooted") | F.coalesce("rooted2", F.lit(False))
        links = links.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "message_id", F.when(~rooted, F.col("up2")).alias("up"), rooted.alias("rooted")
        ).checkpoint()
        before, now = now, links.filter("rooted").count()
    return chosen.join(links.filter("rooted").select("conv_id", "message_id"), ["conv_id", "message_id"], "left_semi")


# Surfaces a citation may point at.
SURFACES = ["chat", "notebook", "quiz", "kb", "book", "tutorbot", "cowriter"]


def citation_edges(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from memory entries to what they cite.

    ``entries`` is (layer, place, entry_id, refs): layer-2 entries of a surface cite entities
    ``surface:id``; layer-3 entries of a slot cite layer-2 entries ``surface:m_...`` or a whole
    surface.  Repeated ids count once (the first), unresolved references are dropped, and an
    entry gets at most one edge to the anchor of a surface, none where it cites an entry of it.
    ``entities`` is (surface, entity_id).
    """
    once = entries.groupBy("layer", "place", "entry_id").agg(F.min_by("refs", "seq").alias("refs"))
    refs = once.select("layer", "place", "entry_id", F.posexplode("refs").alias("pos", "ref"))
    colon = F.locate(":", F.col("ref"))
    refs = refs.withColumns(
        {
            "surface": F.when(colon > 0, F.substr("ref", F.lit(1), colon - 1)).otherwise(F.col("ref")),
            "target": F.when(colon > 0, F.substr("ref", colon + 1)).otherwise(""),
        }
    )
    source = F.concat(F.lit("L"), F.col("layer").cast("string"), F.lit(":"), "place", F.lit(":"), "entry_id").alias("source")
    low = refs.filter((F.col("layer") == 2) & (F.col("surface") != "") & (F.col("target") != ""))
    known = entities.select("surface", F.col("entity_id").alias("target")).distinct()
    strong2 = low.join(known, ["surface", "target"], "left_semi").select(
        source, F.concat(F.lit("L1:"), "surface", F.lit(":"), "target").alias("target"), F.lit("strong").alias("kind")
    )
    high = refs.filter("layer = 3")
    # An entry id found on several surfaces stands for the one on the last of them.
    rank = F.array_position(F.array(*[F.lit(s) for s in SURFACES]), F.col("place"))
    l2 = once.filter("layer = 2").groupBy(F.col("entry_id").alias("target")).agg(F.max_by("place", rank).alias("_at"))
    cites = high.filter(F.col("target").startswith("m_")).join(l2, "target")
    strong3 = cites.select(source, F.concat(F.lit("L2:"), "_at", F.lit(":"), "target").alias("target"), F.lit("strong").alias("kind"))
    blocked = cites.groupBy("layer", "place", "entry_id", "surface").agg(F.min("pos").alias("_strong_at"))
    wide = high.filter(~F.col("target").startswith("m_") & F.col("surface").isin(SURFACES))
    anchors = wide.groupBy("layer", "place", "entry_id", "surface").agg(F.min("pos").alias("pos"))
    # An anchor edge is drawn only if it comes before any edge to an entry of that surface.
    soft = anchors.join(blocked, ["layer", "place", "entry_id", "surface"], "left").filter(
        F.col("_strong_at").isNull() | (F.col("pos") < F.col("_strong_at"))
    )
    soft = soft.select(source, F.concat(F.lit("L2:"), "surface", F.lit(":__anchor__")).alias("target"), F.lit("soft").alias("kind"))
    return strong2.unionByName(strong3).unionByName(soft).distinct()
