"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; the last returns the packed pieces.

In every stage an empty table gives an empty result, texts of any length are taken whole, and further columns of docs
travel along whatever their names (the last stage drops all). What each does with nulls, empty texts, ties and repeated
rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import jaccard, langid, mixing, packing
from attestry.llm.bpe import tokenizer_path
from attestry.llm.common import durable, table

#: Posterior of the predicted language below which a document is rejected.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter (null and empty texts among them), or between languages, go.

    A null doc_id is kept and learned from; repeated rows are judged each for itself, alike."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))), tokenizer_path("piece_bpe_32k.model"))
    return langid.told(docs, model, SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Of several rows of that doc_id the one of the smallest text stays. Documents without words are in no group, and stay;
    so do all rows with a null doc_id."""
    return jaccard.first_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their domain, language and source; some twice, some not at all.

    Null names are 'unknown', a null text has the price of one token; equal rows, and rows of one leaf and doc_id, are in or
    out together."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document of the mix in sequences of 2048 tokens; a null or empty text is the end id alone, and
    repeated rows are packed each for itself."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Language models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
