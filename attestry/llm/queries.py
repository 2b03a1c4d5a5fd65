"""Queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, langid, licenses, media, mixing, packing, sitetree, sketch, tokens
from .bpe import tokenizer_path
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))), tokenizer_path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "fit")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.successor_fingerprints(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract_main_text(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))))).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_chats(chat.format_chats(turns))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_media": op1_media,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_source_mixing": op5_source_mixing,
    "op6_main_text": op6_main_text,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op5_source_mixing": mixing.oracle(),
    "op7_jaccard_join": jaccard.oracle(4, 85),
    "op9_chat_format": chat.oracle(),
    "op10_license_scan": licenses.oracle(),
}
