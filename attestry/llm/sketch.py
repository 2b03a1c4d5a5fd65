"""Document fingerprints: threshold-scaled sketches of character shingles.

A shingle's 64-bit hash is kept when it lies below 2**64 / SCALE, a threshold fixed for all documents,
so that sketches of very unequal documents compare and merge without a common size. So that no text but the empty one
is without a hash, the smallest is kept in any case. Both rules survive merging: the union, cut by the same rules,
is the sketch of the united texts. Below the lower of two sketches' bounds (the threshold, or the smallest hash where
that lies above it) both are complete, and containment is counted there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, texts, tidy
from .words import mix

#: One shingle hash in SCALE is kept, and the FLOOR smallest; code points of a shingle.
SCALE, FLOOR, WIDTH = 16, 1, 12
LIMIT = np.uint64((1 << 64) // SCALE)
END = np.uint64((1 << 64) - 1)
STEP = np.uint64(0x100000001B3)


def shingle_hashes(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` code points; a shorter text is one run; an empty one has none."""
    if not len(points):
        return np.zeros(0, np.uint64)
    points = points.astype(np.uint64)
    if len(points) < width:
        width = len(points)
    n = len(points) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total *= STEP
        total += points[k : k + n]
    return mix(total * np.uint64(0x9E3779B97F4A7C15))


def sketch(points: np.ndarray) -> np.ndarray:
    """Sorted kept hashes."""
    hashes = shingle_hashes(points)
    kept = np.unique(hashes[hashes < LIMIT])
    if len(kept) < FLOOR:
        kept = np.unique(hashes)
        kept = kept[: max(FLOOR, int(np.searchsorted(kept, LIMIT)))]
    return kept


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' united shingle sets."""
    both = np.union1d(a, b)
    return both[: max(FLOOR, int(np.searchsorted(both, LIMIT)))]


def bound(kept: np.ndarray) -> np.uint64:
    """Below and at this hash the sketch is complete."""
    return END if len(kept) < FLOOR else max(LIMIT - np.uint64(1), kept[-1]) if len(kept) == FLOOR else LIMIT - np.uint64(1)


def containment(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimated shares of a's shingles in b and of b's in a; 1.0 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0, 1.0
    top = min(bound(a), bound(b))
    a, b = a[a <= top], b[b <= top]
    if not len(a) or not len(b):
        return 0.0, 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / len(a), common / len(b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The larger containment, 0 to 1."""
    return max(containment(a, b))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def text_of(kept: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits for each hash, ascending; equal texts, equal fingerprints."""
    return kept.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row. A null text is empty: no characters, an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                points = [points_of(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(p) for p in points], pa.int64()), pa.array([text_of(sketch(p)) for p in points], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_chars long, fingerprint string")


def with_successor(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, ghost, doc_id, text) such that each block, read by descending doc_id, holds every
    row's successor: a block's last row is followed by a copy (ghost) of the first row of the next
    block that has any, the last block by a copy of the first of all. Only ids are aggregated ahead
    (one row a block reaches the driver); texts are shuffled once."""
    low = -(1 << 63)
    docs = docs.withColumn("place", F.coalesce(F.col("doc_id"), F.lit(low)))
    if blocks > 1:
        marks = docs.agg(F.percentile_approx("place", [k / blocks for k in range(1, blocks)], blocks * 8).alias("m")).first()["m"] or []
    else:
        marks = []
    marks = np.array(sorted({*marks}), np.int64)

    @F.pandas_udf("int")
    def block_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, place.to_numpy()).astype(np.int32))

    docs = docs.withColumn("block", block_of("place"))
    tops = sorted((r["block"], r["top"]) for r in docs.groupBy("block").agg(F.max("place").alias("top")).collect())
    if not tops:
        return docs.select("block", F.lit(0).alias("ghost"), "doc_id", "text")
    # a block's first row also goes to the block of the next higher ids, whose last row it follows
    higher = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}

    @F.pandas_udf("int")
    def goes_to(place: pd.Series) -> pd.Series:
        return place.map(higher).astype("Int32")

    docs = docs.withColumn("goes", goes_to("place"))
    home = F.struct("block", F.lit(0).alias("ghost"))
    homes = F.when(F.col("goes").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("goes").alias("block"), F.lit(1).alias("ghost"))))
    return docs.withColumn("home", F.explode(homes)).select("home.block", "home.ghost", "doc_id", "text")


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def successor_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n/3) code points replaced by the
    first as many (or all) of the next document by descending doc_id (after the last: the first).

    Ties in doc_id go by text; a null doc_id comes last; a lone document follows itself; a null text
    is empty. Two empty texts are alike (1.0), an empty one is unlike any other (0.0). Texts of any length are taken whole.
    Repeated rows follow each other; an empty table gives an empty result; other columns are ignored, so their names
    cannot clash."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successor(texts(docs, id_col, text_col), 4 * parts)
    dealt = rows.repartition(parts, "block").sortWithinPartitions("block", "ghost", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, held, out = None, False, None, []

        def flush():
            return pa.RecordBatch.from_pylist(out, pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in PAIRS.split(", ")]))

        def pair(a, b):
            """a, b: (doc_id, points, sketch)"""
            (doc_id, points, kept), (_, after, kept_next) = a, b
            n = len(points)
            cut = n // 3
            edited = np.concatenate([points[: n - cut], after[:cut]])
            kept_edited = sketch(edited)
            out.append({"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest(), "fingerprint": text_of(kept), "edited_fingerprint": text_of(kept_edited), "near_edited": likeness(kept, kept_edited), "near_next": likeness(kept, kept_next)})

        for batch in batches:
            for part in sliced(batch):
                for b, ghost, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("block", "ghost", "doc_id", "text"))):
                    if b != block:
                        block, held, first = b, None, False
                    if ghost and first:
                        continue  # repeated rows of the first of the next block
                    points = points_of(text)
                    now = (doc_id, points, sketch(points))
                    if held is not None:
                        pair(held, now)
                    held, first = now, bool(ghost)
                if out:
                    yield flush()
                    out.clear()

    return dealt.mapInArrow(tidy(run), PAIRS)
