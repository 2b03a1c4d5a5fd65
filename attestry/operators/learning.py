"""Confusion statistics from proven reads, and what they allow to repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST, OBSERVED, KEPT = 3, 3, 3


def substitutions(raw: Column, proven: Column, most: int = MOST) -> Column:
    """array<struct<seen, truth>>: differing characters of two reads of equal length; empty if there are more than ``most``."""
    letters = lambda c: F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    pairs = F.filter(F.arrays_zip(letters(raw).alias("seen"), letters(proven).alias("truth")), lambda p: p["seen"] != p["truth"])
    fits = (F.length(raw) == F.length(proven)) & (F.size(pairs) <= most)
    return F.when(fits, pairs).otherwise(F.array().cast("array<struct<seen:string,truth:string>>"))


def confusion_counts(proven: DataFrame) -> DataFrame:
    """(seen, truth, n) from rows (raw, proven)."""
    return proven.select(F.explode(substitutions(F.col("raw"), F.col("proven"))).alias("p")).groupBy("p.seen", "p.truth").agg(F.count("*").alias("n"))


def add_counts(prior: DataFrame, more: DataFrame) -> DataFrame:
    return prior.unionByName(more).groupBy("seen", "truth").agg(F.sum("n").alias("n"))


def confusion_probability(counts: DataFrame, asked: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(seen, truth, p) for each asked pair: add-alpha over the known alternatives, the pair and the identity, which has a second pseudo-count."""
    asked = asked.select(F.upper("seen").alias("seen"), F.upper("truth").alias("truth")).distinct()
    rows = counts.groupBy("seen").agg(F.sum("n").alias("mass"), F.collect_set("truth").alias("known"))
    out = asked.join(rows, "seen", "left").join(counts, ["seen", "truth"], "left")
    kinds = F.size(F.array_union(F.coalesce("known", F.array().cast("array<string>")), F.array("seen", "truth")))
    top = F.coalesce("n", F.lit(0)) + alpha + F.when(F.col("seen") == F.col("truth"), alpha).otherwise(0.0)
    return out.select("seen", "truth", (top / (F.coalesce("mass", F.lit(0)) + alpha * kinds + alpha)).alias("p"))


def plausible_truths(counts: DataFrame, observed: int = OBSERVED, kept: int = KEPT) -> DataFrame:
    """(seen, truth, p, rank): the most frequent truths of characters seen at least ``observed`` times."""
    rows = counts.withColumn("mass", F.sum("n").over(W.partitionBy("seen"))).filter(F.col("mass") >= observed)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("seen").orderBy(F.desc("n"), "truth")))
    return rows.filter(F.col("rank") <= kept).select("seen", "truth", (F.col("n") / F.col("mass")).alias("p"), "rank")


def repairs(values: DataFrame, truths: DataFrame, valid: Callable[[Column], Column]) -> DataFrame:
    """(id, value, repaired, p): invalid values that exactly one substitution (or, if none, one pair) of plausible characters makes valid.

    values: id, value. Valid values are never touched; several repairs are none."""
    wrong = values.filter(~F.coalesce(valid(F.col("value")), F.lit(False)))
    letters = F.filter(F.split("value", ""), lambda x: x != "")
    spots = wrong.select("id", "value", F.posexplode(letters).alias("pos", "ch")).withColumn("seen", F.upper("ch"))
    alts = spots.join(truths.select("seen", "truth", "p"), "seen").filter("truth <> seen").select("id", "value", "pos", "truth", "p")
    put = lambda s, pos, ch: F.concat(F.substring(s, F.lit(1), pos), ch, F.substring(s, pos + 2, F.length(s)))
    one = alts.withColumn("repaired", put(F.col("value"), F.col("pos"), F.col("truth"))).filter(valid(F.col("repaired"))).select("id", "value", "repaired", "p")
    rest = alts.join(one.select("id").distinct(), "id", "left_anti")
    second = rest.select("id", F.col("pos").alias("pos2"), F.col("truth").alias("truth2"), F.col("p").alias("p2"))
    two = rest.join(second, "id").filter("pos < pos2").withColumn("repaired", put(put(F.col("value"), F.col("pos"), F.col("truth")), F.col("pos2"), F.col("truth2")))
    two = two.filter(valid(F.col("repaired"))).select("id", "value", "repaired", (F.col("p") * F.col("p2")).alias("p"))
    found = one.unionByName(two)
    return found.groupBy("id", "value").agg(F.count("*").alias("n"), F.first("repaired").alias("repaired"), F.first("p").alias("p")).filter("n = 1").drop("n")
