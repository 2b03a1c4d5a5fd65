"""Quality gates over labelled results: results (family, entry, class, passed, silent_errors, mrz_valid, field_hits, field_total)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes that have no machine-readable zone to judge.
NO_ZONE = ["adversarial", "negative", "invoice", "invoice_degraded", "receipt", "form"]


def summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, passes, silent errors and rates, over all or by group."""
    zone = ~F.col("class").isin(NO_ZONE)
    hostile = F.col("class") == "adversarial"
    rate = lambda top, bottom: top / F.greatest(bottom, F.lit(1))
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("entries"),
        F.count_if("passed").alias("passed"),
        F.coalesce(F.sum("silent_errors"), F.lit(0)).alias("silent_errors"),
        rate(F.count_if(zone & F.col("mrz_valid")), F.count_if(zone)).alias("mrz_valid_rate"),
        rate(F.coalesce(F.sum("field_hits"), F.lit(0)), F.coalesce(F.sum("field_total"), F.lit(0))).alias("field_hit_rate"),
        rate(F.count_if(hostile & F.col("passed")), F.count_if(hostile)).alias("refusal_rate"),
    )


def rolled_up(results: DataFrame) -> DataFrame:
    """Entries and passes by family and class, by family, and in all (an extension: ``rollup``)."""
    return results.rollup("family", "class").agg(F.count("*").alias("entries"), F.count_if("passed").alias("passed"))


def merged_shards(shards: DataFrame) -> DataFrame:
    """Rates of shards (family, shard, entries, passed, silent_errors, mrz_valid_rate, field_hit_rate), weighed by their entries."""
    weigh = lambda c: F.sum(F.col(c) * F.col("entries")) / F.greatest(F.sum("entries"), F.lit(1))
    return shards.groupBy("family").agg(F.sum("entries").alias("entries"), F.sum("passed").alias("passed"), F.sum("silent_errors").alias("silent_errors"), weigh("mrz_valid_rate").alias("mrz_valid_rate"), weigh("field_hit_rate").alias("field_hit_rate"))


def uncovered(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected entries that no shard reported."""
    return expected.join(results, ["family", "entry"], "left_anti")


def below_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Families that pass less than their baseline, or confirm anything wrong."""
    met = current.join(baseline.select("family", F.col("passed").alias("base")), "family", "left")
    return met.filter("silent_errors > 0 or passed < coalesce(base, 0)").select("family", "passed", "base", "silent_errors")
