"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python call holds at once; Arrow batches are cut to this.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where the session keeps Spark's default, which is meant for narrow rows: whole documents are wide.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"


def small_batches(spark: SparkSession) -> None:
    """Both sides of the pipe to Python hold whole batches; a session that set its own size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, are pruned; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Where none is configured: a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="attestry-")
        sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives
    lost executors, and keeps column pruning. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: an idle Python worker keeps none of what its last task held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that releases its memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow over slices of at most SLICE_BYTES. ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch):
                if (out := step(part)) is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: Bits of the map that tells which keys may be in a set; a bitmap row holds MAP_ROW of them, 4 KB.
MAP_BITS, MAP_ROW = 1 << 24, 1 << 15


def flagged(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with ``maybe``: false where the key is surely not in ids (one column, named key).

    The ids go into a hash bitmap of MAP_BITS bits, whatever their number: at most 2 MB, which is broadcast. A fuller
    map flags more rows than need be, never fewer."""
    slot = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    maps = ids.select(slot.alias("s")).groupBy((F.col("s") / MAP_ROW).cast("int").alias("_row")).agg(F.bitmap_construct_agg((F.col("s") % MAP_ROW).cast("long")).alias("_map"))
    at = (F.col("_slot") % MAP_ROW).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(1) == 1, F.lit(False))
    met = rows.withColumn("_slot", slot).withColumn("_row", (F.col("_slot") / MAP_ROW).cast("int")).join(F.broadcast(maps), "_row", "left")
    return met.withColumn("maybe", bit).drop("_row", "_slot", "_map")


def only(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key is in ids; rows that the bitmap rules out are not shuffled."""
    some = flagged(rows, ids, key).filter("maybe").drop("maybe")
    return some.join(ids.distinct(), key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key is not in ids (a null key is in none); rows that the bitmap rules out are not shuffled."""
    seen = flagged(rows, ids, key)
    sure, rest = seen.filter("not maybe"), seen.filter("maybe")
    return sure.select(*rows.columns).unionByName(rest.join(ids.distinct(), key, "left_anti").select(*rows.columns))
