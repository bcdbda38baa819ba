"""Personal data by bootstrapped contextual extraction.

Base patterns find seed identifiers: e-mail and IP addresses, card and phone numbers. The words around them become
lexical patterns. A graph joins patterns with the identifiers they surround, seeds and candidates of looser
form alike; rounds of joins score patterns by the identifiers they hold and candidates by their best pattern. The
candidates of high-confidence patterns are added to the base spans. DataFrame and SQL functions only.

Spans are code points of the whole text, end exclusive. Base spans are the leftmost non-overlapping matches of each
kind, less those failing the kind's test. Possessive quantifiers and look-behinds keep the matching linear; they
find what the plain patterns find.

Null and empty texts have no spans. Rows are independent of their ids: repeated rows, equal and null ids each give a row
of their own. Identifiers count once however often they occur. Empty tables give empty results. Columns named like an
output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import bound, cut, prefix_maxima, prefix_sums, segments, written

#: Distinct identifiers of one kind, seeds or discovered before with the least confidence, that a pattern needs; its
#: least confidence, what a candidate of unknown nature counts against it, and the rounds.
LEAST_SUPPORT, LEAST_CONFIDENCE, UNKNOWN, ROUNDS = 5, 0.8, 0.2, 3
#: Code points beside a span that its patterns are taken from.
CONTEXT = 48
#: Characters of a text in which spans are compared with each other.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of identifier: its base pattern, the looser form of its candidates, and their tests."""

    name: str
    pattern: str
    loose: str
    hint: str  # a text without a match of this has neither


_LOCAL, _ATOM = r"[A-Za-z0-9._%+-]", r"[^\s@<>()\[\],;:\"]"
_NUMBER = r"(?<![A-Za-z0-9])(?<![0-9][ ().-])\(?[0-9](?:[ ().-]{0,2}+[0-9]){%s}+(?![A-Za-z0-9])"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"(?<!{_ATOM}){_ATOM}++@{_ATOM}++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]*+(?:[.:][0-9A-Fa-f]++){3,7}+(?![0-9A-Za-z])", "[0-9]"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,}+", _NUMBER % "11,18", "[0-9]"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _NUMBER % "6,10", "[0-9]"),
)
NAMES = [k.name for k in KINDS]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of ``digits`` is right."""

    def total(back: Column) -> Column:
        digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
        counted = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + counted(i))

    return bound(F.reverse(digits), total) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        return bound(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``: array of structs start, end, value, left and right (what stands beside it)."""

    def placed(pieces: Column, values: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value"), F.right(p, F.lit(CONTEXT)).alias("left")))
        after = F.zip_with(pairs, F.slice(pieces, 2, F.size(values)), lambda s, p: F.struct(s["gap"], s["value"], s["left"], F.left(p, F.lit(CONTEXT)).alias("right")))

        def spans(s: Column) -> Column:
            starts = prefix_sums(F.transform(s, lambda x: x["gap"] + F.length(x["value"])))
            return F.zip_with(s, starts, lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"], x["left"], x["right"]
            ))

        return bound(after, spans)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(values, lambda v: bound(F.split(text, pattern, -1), lambda p: placed(p, v)))


_SPAN = "array<struct<kind: int, start: bigint, end: bigint, value: string, left: string, right: string>>"


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"], s["left"], s["right"])).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """The base spans of ``text``, by kind and start."""

    def of(n: int, kind: Kind) -> Column:
        spans = F.filter(matches(text, kind.pattern), lambda s: _passes(kind.name, s["value"]))
        return F.when(text.rlike(kind.hint), _tagged(spans, n)).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def candidate_spans(text: Column) -> Column:
    """Spans of looser form."""

    def of(n: int, kind: Kind) -> Column:
        least = 0 if kind.name == "email" else 3
        spans = F.filter(matches(text, kind.loose), lambda s: F.length(_digits(s["value"])) >= least)
        return F.when(text.rlike(kind.hint), _tagged(spans, n)).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def _apart(more: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of ``more`` that touch no row of ``base`` of the same text: they meet in blocks of ``BLOCK`` characters, so a text of any
    length is many small groups."""
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    there = base.select(F.col("_row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"), block.alias("_b"))
    place = ["_row", "kind", "start", "end"]
    here = more.select(*place, block.alias("_block"))
    same = (F.col("_row") == F.col("_r")) & (F.col("_block") == F.col("_b")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))
    return more.join(here.join(there, same, "left_semi").select(*place).distinct(), place, "left_anti")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a context: one and two words before, one word after."""
    last = F.regexp_extract(F.lower(left), r"(\S+)\s*$", 1)
    two = F.regexp_extract(F.lower(left), r"(\S+\s+\S+)\s*$", 1)
    first = F.regexp_extract(F.lower(right), r"^\s*(\S+)", 1)
    named = F.array(*[F.when(c != "", F.concat(F.lit(f"{n} "), F.regexp_replace(c, r"\s+", " "))) for n, c in (("before", last), ("before2", two), ("after", first))])
    return F.filter(named, lambda p: p.isNotNull())


def discovered(instances: DataFrame) -> DataFrame:
    """(kind, value, score) of candidates in high-confidence patterns; ``instances`` has kind, value, seed, left, right."""
    edges = instances.select("kind", "value", "seed", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    edges = written(edges.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")))
    seeds = edges.where("seed").select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    new = None
    for _ in range(ROUNDS):
        scores = seeds if new is None else seeds.unionByName(new.join(seeds.drop("score"), ["kind", "value"], "left_anti"))
        rated = edges.join(written(scores), ["kind", "value"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        sums = [F.sum(F.when(F.col("kind") == n, F.col("score"))).alias(f"s{n}") for n in range(len(KINDS))]
        seen = [F.count(F.when((F.col("kind") == n) & (F.col("score") >= LEAST_CONFIDENCE), 1)).alias(f"n{n}") for n in range(len(KINDS))]
        rated = rated.groupBy("pattern").agg(*sums, *seen, F.sum("score").alias("all"), F.sum(1 - F.col("score")).alias("unknown"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(f"s{n}", F.lit(0.0)).alias("own"), F.col(f"n{n}").alias("support")) for n in range(len(KINDS))]))
        good = rated.select("pattern", "all", "unknown", each.alias("k")).where(F.col("k.support") >= LEAST_SUPPORT)
        good = good.select("pattern", "k.kind", (F.col("k.own") / (F.col("all") + UNKNOWN * F.col("unknown"))).alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        held = edges.where("NOT seed").join(written(good), ["pattern", "kind"])
        new = written(held.groupBy("kind", "value").agg(F.max("confidence").alias("score")))
    return new


def find(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with base and spans: arrays of structs kind (name), start, end, by kind and start; spans are base and
    discovered ones."""
    kept = [c for c in df.columns if c.lower() not in ("base", "spans") and (keep_text or c != text)]
    rows = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_base", base_spans(F.col("_text")))
    rows = rows.withColumn("_more", candidate_spans(F.col("_text")))
    # The table fixes the row numbers.
    rows = written(rows.select(*kept, F.monotonically_increasing_id().alias("_row"), "_base", "_more"))
    span = lambda c, seed: rows.where(F.size(c) > 0).select("_row", F.explode(c).alias("s"), F.lit(seed).alias("seed")).select("_row", "seed", "s.*")
    seeds = span("_base", True)
    more = written(_apart(span("_more", False), seeds))
    instances = seeds.unionByName(more).select("kind", F.lower("value").alias("value"), "seed", "left", "right")
    found = discovered(instances)
    hits = more.withColumn("value", F.lower("value")).join(found, ["kind", "value"], "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_found"))
    out = rows.join(hits, "_row", "left")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    named = lambda c: F.transform(c, lambda s: F.struct(F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1).alias("kind"), s["start"], s["end"]))
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    every = F.sort_array(F.concat(plain(F.col("_base")), F.coalesce("_found", none)))
    return out.select(*kept, named(plain(F.col("_base"))).alias("base"), named(every).alias("spans"))


def listed(spans: Column) -> Column:
    """``spans`` as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first names the mask.

    Each part of the text is taken once from its segments, so the time grows with the text and not with its square.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def of(parts: Column, sorted_: Column) -> Column:
        ends = prefix_maxima(F.transform(sorted_, lambda s: s["end"]))
        after = F.zip_with(sorted_, ends, lambda s, at: F.struct(s["start"], s["kind"], at.alias("at")))
        kept = F.filter(after, lambda s: s["start"] >= s["at"])
        pieces = F.transform(kept, lambda s: F.concat(cut(parts, s["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        last = F.array_max(F.transform(sorted_, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(parts, last, F.length(text).cast("bigint")))

    done = bound(segments(text), lambda parts: bound(ordered, lambda sorted_: of(parts, sorted_)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
