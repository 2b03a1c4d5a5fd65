"""Stores: key-value tables in Parquet, content-addressed files, sealed rows, evidence bundles."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.workspace import latest

#: Rounds of key derivation, and how far a box may leave its page.
ROUNDS, TOLERANCE = 600_000, 0.05

LINE = "struct<text:string,confidence:double,polygon:array<array<double>>,lattice:array<array<struct<ch:string,p:double>>>>"
BUNDLE = f"bundle_version int, source struct<kind:string,sha256:string,pages:int>, pages array<struct<index:int,route:string,width:double,height:double,lines:array<{LINE}>>>"


class Table:
    """An append-only table: every put adds a version, the last one of a key is read; a removal is a version as well."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T._parse_datatype_string(f"{schema}, version long, removed boolean") if isinstance(schema, str) else schema

    def create(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)

    def put(self, rows: DataFrame, version: int, removed: bool = False) -> None:
        full = rows.withColumns({"version": F.lit(version).cast("long"), "removed": F.lit(removed)})
        full.select(*(f.name for f in self.schema.fields)).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return latest(rows, [self.key], "version").filter("not removed").drop("version", "removed")

    def get(self, key) -> DataFrame:
        return self.all().filter(F.col(self.key) == key)

    def by(self, column: str, value) -> DataFrame:
        return self.all().filter(F.col(column) == value)


def content_address(content: Column) -> Column:
    """The path of a content under its store: two levels of its SHA-256."""
    sha = F.sha2(content, 256)
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha)


def derive_key(secret: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, rounds, 32)


def new_keyring(secret: str, rounds: int = ROUNDS) -> dict:
    """Salt and a check value: what has to be stored so that the secret can be recognised, and no more."""
    salt = os.urandom(16)
    return {"salt": salt.hex(), "rounds": rounds, "check": hashlib.sha256(derive_key(secret, salt, rounds)).hexdigest()}


def unlock(keyring: dict, secret: str) -> bytes:
    key = derive_key(secret, bytes.fromhex(keyring["salt"]), keyring["rounds"])
    if hashlib.sha256(key).hexdigest() != keyring["check"]:
        raise ValueError("wrong secret")
    return key


def sealed(rows: DataFrame, key: bytes, clear: list[str]) -> DataFrame:
    """The ``clear`` columns and one encrypted column (AES-GCM) of all others."""
    rest = [c for c in rows.columns if c not in clear]
    return rows.select(*clear, F.base64(F.aes_encrypt(F.to_json(F.struct(*rest)), F.lit(key), F.lit("GCM"))).alias("sealed"))


def unsealed(rows: DataFrame, key: bytes, schema: str, strict: bool = True) -> DataFrame:
    """The sealed columns again. A wrong key or a changed row raises; without ``strict`` its columns are null."""
    read = F.aes_decrypt if strict else F.try_aes_decrypt
    plain = F.from_json(read(F.unbase64("sealed"), F.lit(key), F.lit("GCM")).cast("string"), schema)
    return rows.withColumn("_p", plain).select(*(c for c in rows.columns if c != "sealed"), "_p.*")


def bundle_faults(bundles: DataFrame) -> DataFrame:
    """(doc_id, rule, page): what is wrong with an evidence bundle. A vision line must bring its lattice; boxes stay on their page."""
    whole = F.filter(
        F.array(
            F.when(F.coalesce("bundle_version", F.lit(0)) < 1, "version"),
            F.when(F.col("source.sha256").isNull() | ~F.col("source.sha256").rlike("^[0-9a-f]{64}$"), "sha256"),
            F.when(~F.size("pages").eqNullSafe(F.col("source.pages")), "page_count"),
        ),
        lambda x: x.isNotNull(),
    )
    top = bundles.select("doc_id", F.explode(whole).alias("rule"), F.lit(None).cast("int").alias("page"))
    lines = bundles.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.index").alias("page"), F.col("p.route").alias("route"), F.explode("p.lines").alias("l"))
    out = lambda v: ~v.between(-TOLERANCE, 1 + TOLERANCE)
    off = F.exists("l.polygon", lambda point: F.exists(point, out))
    rules = F.filter(
        F.array(F.when((F.col("route") == "vision") & F.col("l.lattice").isNull(), "lattice"), F.when(F.col("l.polygon").isNull() | (F.size("l.polygon") < 4) | off, "geometry"), F.when(~F.col("l.confidence").between(0, 1), "confidence")),
        lambda x: x.isNotNull(),
    )
    return top.unionByName(lines.select("doc_id", F.explode(rules).alias("rule"), "page").distinct())


def bundle_items(bundles: DataFrame) -> DataFrame:
    """Lines of bundles as items (doc_id, page, node_id, text, confidence, x1, y1, x2, y2); a page with one bad polygon is refused whole."""
    pages = bundles.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.index").alias("page"), F.posexplode("p.lines").alias("k", "l"))
    bad = bundle_faults(bundles).filter("rule = 'geometry'").select("doc_id", "page").distinct()
    good = pages.join(bad, ["doc_id", "page"], "left_anti")
    side = lambda f, at: f(F.transform("l.polygon", lambda point: F.get(point, at)))
    return good.select("doc_id", "page", F.concat_ws(":", "doc_id", "page", "k").alias("node_id"), F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), side(F.array_min, 0).alias("x1"), side(F.array_min, 1).alias("y1"), side(F.array_max, 0).alias("x2"), side(F.array_max, 1).alias("y2"))


def cell_place(ref: Column) -> Column:
    """struct<r, c> of a spreadsheet reference such as BC12, from 0."""
    letters = F.filter(F.split(F.regexp_extract(ref, "^([A-Z]+)", 1), ""), lambda x: x != "")
    col = F.aggregate(letters, F.lit(0), lambda n, ch: n * 26 + F.ascii(ch) - 64) - 1
    return F.struct((F.regexp_extract(ref, r"(\d+)$", 1).try_cast("int") - 1).alias("r"), col.alias("c"))
