"""The routing of a file from upload to record, as a fold of its events: batch and streaming twins.

events: file_id, seq, type, family_id, score, open_fields. An event that a state does not allow leaves the state as it
is and is counted; it never stops the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN, CONFIRM = 0.75, 0.55
START = "hashing"
TERMINAL = ("done", "failed", "duplicate")
# Transitions that depend on nothing but state and event.
MOVES = {
    ("hashing", "SHA256_HIT"): "duplicate",
    ("hashing", "SHA256_MISS"): "perceiving",
    ("duplicate", "PROCESS_ANYWAY"): "perceiving",
    ("perceiving", "BUNDLE_READY"): "identifying",
    ("confirm_family", "USER_CONFIRMED_FAMILY"): "known_family",
    ("confirm_family", "USER_REJECTED_FAMILY"): "discovery",
    ("known_family", "RECORD_APPENDED"): "record_appended",
    ("discovery", "DRAFT_CREATED"): "draft_family",
    ("draft_family", "FAMILY_APPROVED"): "family_approved",
    ("family_approved", "RECORD_APPENDED"): "record_appended",
    ("review_lane", "REVIEW_RESOLVED"): "done",
}


def move(state: str, event: str, family: str | None, score: float | None, open_fields: int) -> str | None:
    """The next state, None if the event is not allowed. ``open_fields``: of the record appended last."""
    if event == "ERROR":
        return None if state in TERMINAL else "failed"
    if (state, event) == ("identifying", "TEMPLATE_SCORED"):
        if family is None or score is None or score < CONFIRM:
            return "discovery"
        return "known_family" if score >= KNOWN else "confirm_family"
    if (state, event) == ("record_appended", "REVIEW_RESOLVED"):
        return "review_lane" if open_fields > 0 else "done"
    return MOVES.get((state, event))


def move_column(state: Column, event: Column, family: Column, score: Column, open_fields: Column) -> Column:
    """``move`` as an expression."""
    table = F.create_map(*[F.lit(x) for (s, e), to in MOVES.items() for x in (f"{s}|{e}", to)])
    scored = F.when(family.isNull() | score.isNull() | (score < CONFIRM), "discovery").when(score >= KNOWN, "known_family").otherwise("confirm_family")
    return (
        F.when(event == "ERROR", F.when(~state.isin(*TERMINAL), "failed"))
        .when((state == "identifying") & (event == "TEMPLATE_SCORED"), scored)
        .when((state == "record_appended") & (event == "REVIEW_RESOLVED"), F.when(open_fields > 0, "review_lane").otherwise("done"))
        .otherwise(F.try_element_at(table, F.concat(state, F.lit("|"), event)))
    )


def fold(events: DataFrame) -> DataFrame:
    """(file_id, state, applied, illegal): each file's state after its events in the order of seq."""
    item = F.struct("seq", "type", "family_id", F.col("score").cast("double").alias("score"), F.coalesce(F.col("open_fields").cast("int"), F.lit(0)).alias("open_fields"))
    files = events.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("open"), F.lit(0).alias("applied"), F.lit(0).alias("illegal"))

    def step(acc: Column, e: Column) -> Column:
        to = move_column(acc["state"], e["type"], e["family_id"], e["score"], acc["open"])
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            F.when(to == "record_appended", e["open_fields"]).otherwise(acc["open"]).alias("open"),
            (acc["applied"] + to.isNotNull().cast("int")).alias("applied"),
            (acc["illegal"] + to.isNull().cast("int")).alias("illegal"),
        )

    folded = files.select("file_id", F.aggregate("events", start, step).alias("s"))
    return folded.select("file_id", "s.state", "s.applied", "s.illegal")


STATE = "state string, open int, applied int, illegal int"
OUT = "file_id string, state string, applied int, illegal int"


def fold_stream(events: DataFrame) -> DataFrame:
    """``fold`` over a stream: one updated row for each file that a micro-batch touches. Events of a file must come in order;
    those of one micro-batch are sorted by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, opened, applied, illegal = state.get if state.exists else (START, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, family, score, n in zip(rows["type"], rows["family_id"], rows["score"], rows["open_fields"]):
            to = move(now, kind, None if pd.isna(family) else family, None if pd.isna(score) else score, opened)
            if to is None:
                illegal += 1
                continue
            if to == "record_appended":
                opened = 0 if pd.isna(n) else int(n)
            now, applied = to, applied + 1
        state.update((now, opened, applied, illegal))
        yield pd.DataFrame({"file_id": [key[0]], "state": [now], "applied": [applied], "illegal": [illegal]})

    return events.groupBy("file_id").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def next_files(queue: DataFrame, active: int, concurrency: int = 2) -> DataFrame:
    """The files to start next: those still hashing and not active, in queue order, as many as there are slots."""
    return queue.filter("state = 'hashing' and not active").orderBy("ord").limit(max(0, concurrency - active)).select("file_id")
