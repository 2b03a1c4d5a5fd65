"""Document types by corroborated keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of each type, in the order that breaks ties.
KEYWORDS = {
    "passport": ["passport", "passeport", "nationality", "place of birth", "date of issue", "authority"],
    "id_card": ["identity card", "id card", "id no", "resident identity", "national id"],
    "invoice": ["invoice", "bill to", "invoice number", "amount due", "subtotal", "tax", "total due", "vendor"],
    "receipt": ["receipt", "subtotal", "change due", "cash", "card", "merchant", "thank you"],
    "bank_statement": ["bank statement", "statement period", "opening balance", "closing balance", "account holder", "total credits", "total debits"],
    "payslip": ["payslip", "pay slip", "pay period", "gross pay", "net pay", "total deductions", "employee id", "earnings"],
    "utility_bill": ["utility bill", "total due", "due date", "billing period", "current charges", "previous balance", "meter", "account number"],
}


def keyword_scores(text: Column, has_mrz: Column) -> dict[str, Column]:
    low = F.lower(text)
    scores = {kind: sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)) for kind, keys in KEYWORDS.items()}
    scores["passport"] = scores["passport"] + F.when(has_mrz, 3).otherwise(0)
    scores["id_card"] = scores["id_card"] + F.when(has_mrz, 1).otherwise(0)
    return scores


def classify(docs: DataFrame, text: Column, has_mrz: Column) -> DataFrame:
    """docs with doc_type and type_confidence: the type with most keywords, the first among equals; one keyword alone is not enough.

    A zone makes a passport, or an identity card where the text says so and never 'passport'."""
    low = F.lower(text)
    rows = docs.withColumn("_s", F.struct(*(c.alias(k) for k, c in keyword_scores(text, has_mrz).items())))
    ranked = F.sort_array(F.array(*(F.struct(F.col("_s")[k].alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KEYWORDS))), asc=False)
    rows = rows.withColumn("_r", ranked)
    top, second = F.get("_r", 0)["s"], F.get("_r", 1)["s"]
    word = F.contains(low, F.lit("passport")) | F.contains(low, F.lit("passeport"))
    generic = (top == 0) | (~has_mrz & (top < 2))
    kind = F.when(has_mrz & word, "passport").when(has_mrz & F.contains(low, F.lit("identity")), "id_card").when(has_mrz & (F.col("_s.passport") >= F.col("_s.id_card")), "passport").otherwise(F.get("_r", 0)["k"])
    sure = F.least(F.lit(1.0), top / (top + second + 1))
    sure = F.when(has_mrz & word, F.greatest(sure, F.lit(0.8))).when(has_mrz, F.greatest(sure, F.lit(0.5))).otherwise(sure)
    return rows.withColumn("doc_type", F.when(generic, "generic").otherwise(kind)).withColumn("type_confidence", F.when(generic, 0.4).otherwise(sure)).drop("_s", "_r")
