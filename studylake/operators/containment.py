"""Which texts contain which others, by the rarest gram of each needle.

Every needle is looked up by one gram only, that which fewest texts have; a needle with a gram that no text has is in none. So a
needle meets just the texts that have its rarest gram, and these are checked in full. Grams of texts that are in no needle are
dropped before anything is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; needles shorter than that are grams themselves.
SIZE = 4


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: list[str], size: int = SIZE) -> DataFrame:
    """Each row of ``needles`` beside each row of ``texts`` of equal ``on`` whose ``text`` contains its ``needle``.

    Null and empty needles and null texts match nothing. Columns other than ``on`` must have different names.
    """
    keys = [*on, "_gram"]
    wanted = needles.select(*on, F.col(needle).alias("_needle")).filter("_needle <> ''").distinct()
    sizes = [F.when(F.length("_needle") == n, F.array("_needle")) for n in range(1, size)]
    of_needle = wanted.select("*", F.explode(F.coalesce(*sizes, _grams(F.col("_needle"), size))).alias("_gram"))
    known = of_needle.select(*keys).distinct()
    all_grams = F.flatten(F.array(*[_grams(F.col(text), n) for n in range(1, size + 1)]))
    of_text = texts.select("*", F.explode(all_grams).alias("_gram")).join(known, keys, "left_semi")
    counts = of_text.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rated = of_needle.join(counts, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*on, "_needle").agg(F.min(F.struct("_n", "_gram")).alias("_r")).filter("_r._n > 0")
    rarest = rarest.select(*on, "_needle", F.col("_r._gram").alias("_gram"))
    found = of_text.join(rarest, keys).filter(F.col(text).contains(F.col("_needle"))).drop("_gram")
    return needles.withColumn("_needle", F.col(needle)).join(found, [*on, "_needle"]).drop("_needle")
