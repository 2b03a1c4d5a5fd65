"""Event streams: time windows, sessions, duplicate suppression, running statistics. All take batch or streaming input.

events: a timestamp column ``ts``; one without a zone is read as UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in windows of ``size``, every ``slide``."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = timed(events).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str]) -> DataFrame:
    """Sessions that end after a pause of ``gap``."""
    sums = timed(events).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a stream forgets keys older than the watermark."""
    rows = timed(events, late)
    return rows.dropDuplicatesWithinWatermark(key) if events.isStreaming else rows.dropDuplicates(key)


def confusion_stream(proven: DataFrame) -> DataFrame:
    """Running (seen, truth, n) of a stream of proven reads."""
    from attestry.operators.learning import confusion_counts

    return confusion_counts(proven)


def running_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean) after each micro-batch, kept in state as (n, mean)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for batch in batches:
            for x in batch[value]:
                n += 1
                mean += (x - mean) / n
        state.update((n, mean))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "mean": [mean]})

    return rows.groupBy(key).applyInPandasWithState(step, "key string, n long, mean double", "n long, mean double", "update", "NoTimeout")
