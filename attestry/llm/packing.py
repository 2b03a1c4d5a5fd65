"""Bulk-synchronous best-fit packing.

Documents become pieces of at most ``capacity`` tokens. Each round sweeps all sizes downwards with
the open gaps and the waiting pieces sorted together: a piece is matched with its successor, the
smallest gap that still holds it; where several pieces want the same gap, the larger one has it and,
among equals, the one of lower rank. Every gap takes one piece a round, then the gaps are updated
and the next round begins. When nothing fits, the largest waiting pieces open as many new sequences
as the waiting tokens need at least.

Sizes are integers up to the capacity, so the sorted range is held as runs of equal size, each a
count with a rank interval: the sweep's state is at most ``capacity`` runs whatever the corpus, and
only the ranks of the pieces inside their run are computed over the data, split into hashed blocks
so that a size which many documents share does not meet in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bpe
from .common import arrow_map, durable, sliced, texts, tidy

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces. A null or empty text is the end id alone."""

    def make():
        encoder = bpe.load(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = batch.column("doc_id").to_pylist(), []
            parts = [t.encode() for t in batch.column("text").to_pylist()]
            encoded = encoder.encode(parts)
            flat, at = encoded.flat().tobytes(), 0
            for doc_id, n in zip(ids, encoded.counts().tolist()):
                data = flat[4 * at : 4 * (at + n)] + end
                at += n
                for k in range(0, n + 1, capacity):
                    piece = data[4 * k : 4 * (k + capacity)]
                    rows.append((doc_id, k // capacity, k, len(piece) // 4, zlib.crc32(piece)))
            columns = zip(*rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in PIECES.split(", ")])

        return step

    return arrow_map(texts(docs, id_col, text_col), make, PIECES)


class Runs:
    """Equal things in a row: intervals [first, first + count), taken from the front."""

    def __init__(self):
        self.parts: list[list[int]] = []

    def add(self, first: int, count: int) -> None:
        if count:
            if self.parts and sum(self.parts[-1]) == first:
                self.parts[-1][1] += count
            else:
                self.parts.append([first, count])

    def take(self, most: int) -> tuple[int, int]:
        part = self.parts[-1]
        n = min(most, part[1])
        first = part[0]
        part[0] += n
        part[1] -= n
        if not part[1]:
            self.parts.pop()
        return first, n


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, count, first sequence, offset): pieces of that size and those ranks go, in order,
    to the sequences from the first on, at the offset. counts: pieces by size, 1 to capacity."""
    waiting = {s: [0, n] for s, n in counts.items() if n}  # next rank, how many wait
    gaps: dict[int, Runs] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(size: int, n: int, first: int, gap: int, later: dict[int, Runs]) -> None:
        rank, _ = waiting[size]
        rows.append((size, rank, n, first, capacity - gap))
        waiting[size][0] += n
        waiting[size][1] -= n
        if not waiting[size][1]:
            del waiting[size]
        if gap > size:
            later.setdefault(gap - size, Runs()).add(first, n)

    while waiting:
        later: dict[int, Runs] = {}
        stack: list[int] = []
        moved = 0
        for size in sorted({*gaps, *waiting}, reverse=True):
            if size in gaps:
                stack.append(size)
            while size in waiting and stack:
                gap = stack[-1]
                first, n = gaps[gap].take(waiting[size][1])
                if not gaps[gap].parts:
                    stack.pop()
                    del gaps[gap]
                put(size, n, first, gap, later)
                moved += n
        for gap, runs in later.items():
            for first, n in runs.parts:
                gaps.setdefault(gap, Runs()).add(first, n)
        if not moved:
            new = -(-sum(s * n for s, (_, n) in waiting.items()) // capacity)
            while new and waiting:
                size = max(waiting)
                n = min(new, waiting[size][1])
                opened: dict[int, Runs] = {}
                put(size, n, sequences, capacity, opened)
                for gap, runs in opened.items():
                    for first, k in runs.parts:
                        gaps.setdefault(gap, Runs()).add(first, k)
                sequences += n
                new -= n
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(table: DataFrame, keys: list[str]) -> DataFrame:
    """table with ``rank``: each row's place, from 0, among the rows of its length. Equal keys are equal rows."""
    blocks = max(1, math.isqrt(table.count()))  # a run's blocks, and the rows of a block, grow alike
    table = table.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    sizes = table.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "block").orderBy(*keys)
    table = table.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["length", "block"])
    return table.withColumn("rank", F.col("base") + F.col("inside")).drop("block", "base", "inside")


def pack(table: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """table (with a ``length`` of 1 to capacity) and each row's sequence_id and offset: sequences are gapless from 0.

    An empty table gives an empty result; repeated rows are packed each for itself."""
    table = durable(table)
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = rows[:, 0] * (1 << 48) + rows[:, 1]  # size and rank in one sorted number
    schema = table.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                size, rank = (part.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                at = np.searchsorted(starts, size * (1 << 48) + rank, "right") - 1
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(table, keys).mapInArrow(tidy(run), out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with the sequence and the offset that hold each.

    Odd rows: a null or empty text is the end id alone; a text longer than a sequence is cut, whatever its length;
    repeated rows are packed each for itself, and pieces that are equal in all they show may change places; an empty table
    gives an empty result; other columns are ignored, so their names cannot clash."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), ["doc_id", "piece", "ids_crc32"], capacity)
