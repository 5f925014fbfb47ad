"""Which texts lie within others: an index of q-grams instead of a comparison of all with all.

A part is looked up by the one of its q-grams that the fewest wholes have, then compared; a part with a
q-gram that no whole has lies in none. Parts shorter than q are looked up as they are among the grams of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    places = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
    listed = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.char_length(text) >= n, listed).otherwise(F.array().cast("array<string>"))


def keyed(parts: DataFrame, wholes: DataFrame, q: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """parts (p) with the gram (g) to look each up by, and wholes (w), a row per gram that may be looked up; texts are distinct and not empty."""
    lengths = [r["n"] for r in parts.where(F.char_length("p") < q).select(F.char_length("p").alias("n")).distinct().collect()]  # fewer than q numbers
    index = wholes.select("w", F.explode(grams(F.col("w"), q)).alias("g"))
    held = index.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_n"))
    asked = parts.where(F.char_length("p") >= q).select("p", F.explode(grams(F.col("p"), q)).alias("g")).join(held, F.col("g") == F.col("_g"), "left")
    rare = asked.groupBy("p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("p", "m.g")
    for n in lengths:
        index = index.unionByName(wholes.select("w", F.explode(grams(F.col("w"), n)).alias("g")))
    return rare.unionByName(parts.where(F.char_length("p") < q).select("p", F.col("p").alias("g"))), index


def lies_within(parts: DataFrame, wholes: DataFrame, q: int = GRAM) -> DataFrame:
    """The parts (p) that some whole (w) contains."""
    looked, index = keyed(parts, wholes, q)
    return looked.join(index, (looked["g"] == index["g"]) & F.contains("w", "p"), "left_semi").select("p")


def contains_any(wholes: DataFrame, parts: DataFrame, q: int = GRAM) -> DataFrame:
    """The wholes (w) that contain some part (p)."""
    looked, index = keyed(parts, wholes, q)
    return index.join(looked, (looked["g"] == index["g"]) & F.contains("w", "p"), "left_semi").select("w").distinct()
