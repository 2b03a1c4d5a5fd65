"""Fields of a page end to end: labels by registry, values by position and type, the best assignment, caps.

items: doc_id, page, node_id, text, confidence, x1, y1, x2, y2, region_id.
registry: canonical_label, phrase, ord, value_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestry.functions import scalars as S

from . import consensus, layout

#: Weights of type and position in a pair's score; share of the winner from which a rival makes it ambiguous; its cap.
TYPE, POSITION, RIVAL, CAP = 0.5, 0.4, 0.7, 0.45


def is_caption(text: Column) -> Column:
    """Ends in a colon, or is short words without a digit that end in a label's word: never a value."""
    return text.rlike(r"[:：]\s*$") | text.rlike(r"(?i)^[A-Za-z /]{2,30}\b(no|number|date|name|total|amount|code)\.?$")


def chaotic(text: Column) -> Column:
    """A read of mostly single characters and symbols."""
    words = F.filter(F.split(S.clean_text(text), " "), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,:;/\-()]"))
    return (F.size(words) >= 3) & (single * 2 > F.size(words)) | (symbols * 2 > F.length(text))


def well_formed_amount(text: Column) -> Column:
    return S.strip(text).rlike(r"^\(?[-+]?\s*(?:[$₹€£]|[A-Z]{3})?\s*\d[\d.,' ]*(?:\s*(?:[$₹€£]|[A-Z]{3}))?\)?$") & S.parse_amount(text)["valid"]


def type_score(text: Column, kind: Column) -> Column:
    """0 to 1: how well a value is of a type. A date is no identifier, and a line with words is no amount."""
    date, letters = S.parse_date(text)["valid"], text.rlike(r"\p{L}{3,}")
    digits = F.regexp_count(text, F.lit(r"\d"))
    return (
        F.when(kind == "date", F.when(date, 1.0).otherwise(0.0))
        .when(kind == "amount", F.when(letters | date, 0.0).when(well_formed_amount(text), 1.0).otherwise(0.0))
        .when(kind == "id_number", F.when(date, 0.0).when((digits >= 3) & text.rlike(r"^[A-Za-z0-9][A-Za-z0-9 \-/]*$"), 0.9).otherwise(0.0))
        .when(kind == "email", F.when(S.is_valid_email(S.strip(text)), 1.0).otherwise(0.0))
        .when(kind == "phone", F.when(S.is_plausible_phone(text), 0.9).otherwise(0.0))
        .when(kind == "name", F.when(letters & (digits == 0), 0.8).otherwise(0.0))
        .otherwise(F.when(S.strip(text) != "", 0.5).otherwise(0.0))
    )


def inline_pairs(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Lines that hold 'Label: value' themselves: (doc_id, canonical_label, value_id, value, score)."""
    rows = items.select("doc_id", "node_id", F.explode(F.array(S.split_inline_label(F.col("text")))).alias("p")).filter("p is not null")
    met = rows.join(F.broadcast(registry), F.lower(F.col("p.label")) == F.col("phrase"))
    return met.select("doc_id", "canonical_label", F.col("node_id").alias("value_id"), F.col("p.value").alias("value"), F.lit(1.0).alias("score")).filter("value <> ''")


def extract(items: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, canonical_label, value_id, value, score, review_cap): one value for each label that has one.

    A value serves one label. A label whose best rival, left without a label, reaches 70 % of the winner is ambiguous: its score is
    capped and it stays in review."""
    labels = layout.labels_by_registry(items.filter(~chaotic(F.col("text"))), registry.select("canonical_label", "phrase", "ord"))
    best = W.partitionBy("doc_id", "canonical_label").orderBy(F.desc("score"), F.length("text"), "node_id")
    labels = labels.join(items, ["doc_id", "node_id"]).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    values = items.join(labels.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti").filter(~is_caption(F.col("text")))
    pairs = layout.label_values(labels, values)
    kinds = registry.groupBy("canonical_label").agg(F.min("value_type").alias("value_type"))
    pairs = pairs.join(labels.select("doc_id", F.col("node_id").alias("label_id"), "canonical_label"), ["doc_id", "label_id"]).join(F.broadcast(kinds), "canonical_label")
    pairs = pairs.join(values.select("doc_id", F.col("node_id").alias("value_id"), F.col("text").alias("value"), "confidence"), ["doc_id", "value_id"])
    fit = type_score(F.col("value"), F.col("value_type"))
    pairs = pairs.withColumn("fit", fit).filter("fit > 0").withColumn("score", (TYPE * F.col("fit") + POSITION * F.col("position") / (1 + F.col("gap") * 4) + 0.1 * F.col("confidence")))
    inline = inline_pairs(items, registry)
    pairs = pairs.select("doc_id", "canonical_label", "value_id", "value", "score").join(inline.select("doc_id", "canonical_label").distinct(), ["doc_id", "canonical_label"], "left_anti")
    pairs = pairs.join(inline.select("doc_id", "value_id").distinct(), ["doc_id", "value_id"], "left_anti")
    profit = pairs.select("doc_id", F.col("canonical_label").alias("label"), F.col("value_id").alias("id"), F.lit(0).alias("ord"), "value", F.lit(False).alias("proven"), F.col("score").alias("profit"))
    won = consensus.assign(profit).select("doc_id", F.col("label").alias("canonical_label"), F.col("id").alias("value_id"), "value", F.col("profit").alias("score"))
    orphans = pairs.join(won.select("doc_id", "value_id"), ["doc_id", "value_id"], "left_anti").groupBy("doc_id", "canonical_label").agg(F.max("score").alias("rival"))
    won = won.join(orphans, ["doc_id", "canonical_label"], "left")
    unsure = F.coalesce(F.col("rival") >= RIVAL * F.col("score"), F.lit(False))
    won = won.select("doc_id", "canonical_label", "value_id", "value", F.when(unsure, F.least("score", F.lit(CAP))).otherwise(F.col("score")).alias("score"), F.when(unsure, "ambiguous").alias("review_cap"))
    return won.unionByName(inline.withColumn("review_cap", F.lit(None).cast("string")).dropDuplicates(["doc_id", "canonical_label"]))


# Labels of free text that may wrap; lines that are joined at most; slack of alignment, gap and height.
WRAPPED, LINES, ALIGN, LINE_GAP, HEIGHTS = ["issuing_authority", "place_of_birth"], 2, 0.02, 1.6, (0.6, 1.6)


def continued(fields: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, canonical_label, value, continuation): wrapped free text with the lines right below it, at most two.

    fields: doc_id, ord, canonical_label, value_id, value. A line goes on if it is close, aligned left or at the centre, as high, in the
    same region where both have one, no field's value, and free text; of several the first in reading order. A line serves one field, the
    earlier. Fields that do not wrap are not listed."""
    boxes = items.select("doc_id", F.col("node_id").alias("value_id"), "page", "x1", "y1", "x2", "y2", "region_id")
    box = ["page", "x1", "y1", "x2", "y2", "region_id"]
    heads = fields.filter(F.col("canonical_label").isin(WRAPPED)).select("doc_id", "ord", "canonical_label", "value_id", "value").join(boxes, ["doc_id", "value_id"])
    heads = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "canonical_label", "value", *box))).alias("heads"))
    text = S.strip(F.col("text"))
    free = ~S.parse_date(text)["valid"] & ~text.rlike(r"^\d[\d\s/.-]*$") & text.rlike("[A-Za-z]")
    rest = items.join(heads.select("doc_id"), "doc_id", "left_semi").join(fields.select("doc_id", F.col("value_id").alias("node_id")), ["doc_id", "node_id"], "left_anti")
    lines = rest.filter(free & ~is_caption(F.col("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "node_id", S.clean_text(F.col("text")).alias("text"), "page", "x2", "y2", "region_id"))).alias("lines"))

    def follows(line: Column, tail: Column) -> Column:
        high = F.greatest(tail["y2"] - tail["y1"], F.lit(0.004))
        apart = line["y1"] - tail["y2"]
        left = F.abs(line["x1"] - tail["x1"]) <= ALIGN
        centre = F.abs((line["x1"] + line["x2"] - tail["x1"] - tail["x2"]) / 2) <= ALIGN
        region = line["region_id"].isNull() | tail["region_id"].isNull() | (line["region_id"] == tail["region_id"])
        return (line["page"] == tail["page"]) & region & (apart >= -0.005) & (apart <= LINE_GAP * high) & (left | centre) & ((line["y2"] - line["y1"]) / high).between(*HEIGHTS)

    place = lambda x: F.struct(*(x[c].alias(c) for c in box))

    def grown(state: Column) -> Column:
        """state: struct<tail, parts, taken> with the next line, if there is one."""
        found = F.get(F.filter("lines", lambda x: ~F.array_contains(state["taken"], x["node_id"]) & follows(x, state["tail"])), 0)
        more = lambda x: F.struct(place(x).alias("tail"), F.array_append(state["parts"], x["text"]).alias("parts"), F.array_append(state["taken"], x["node_id"]).alias("taken"))
        return S.let(found, lambda x: F.when(x.isNull(), state).otherwise(more(x)))

    def step(acc: Column, head: Column) -> Column:
        state = F.struct(place(head).alias("tail"), F.array(head["value"]).alias("parts"), acc["taken"].alias("taken"))
        for _ in range(LINES):
            state = S.let(state, grown)
        row = lambda s: F.struct(head["canonical_label"].alias("canonical_label"), F.array_join(s["parts"], " ").alias("value"), F.slice(s["taken"], F.size(acc["taken"]) + 1, F.size(s["taken"]) - F.size(acc["taken"])).alias("continuation"))
        return S.let(state, lambda s: F.struct(s["taken"].alias("taken"), F.array_append(acc["out"], row(s)).alias("out")))

    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<canonical_label:string,value:string,continuation:array<string>>>").alias("out"))
    rows = heads.join(lines, "doc_id", "left")
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType)))
    return rows.select("doc_id", F.explode(F.aggregate("heads", start, step)["out"]).alias("f")).select("doc_id", "f.*")


def first_page_wins(fields: DataFrame, pages: int = 8) -> DataFrame:
    """fields (doc_id, page, canonical_label, ..): of a label on several of the first pages, the first page's."""
    rows = fields.filter(F.col("page") <= pages)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "canonical_label").orderBy("page"))).filter("k = 1").drop("k")


def counterfactual_caps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, canonical_label, review_cap): labels that a second reading of the page reads differently. Agreement changes nothing."""
    met = first.join(second.select("doc_id", "canonical_label", F.col("value").alias("again")), ["doc_id", "canonical_label"])
    return met.filter(S.normalize_id(F.col("value")) != S.normalize_id(F.col("again"))).select("doc_id", "canonical_label", F.lit("divergent reads").alias("review_cap"))


def page_bands(height: Column, width: Column, aspect: float = 2.5, overlap: float = 0.15) -> Column:
    """array<struct<y1, y2>> of pixels: one band, or for tall pages bands of ``aspect`` widths that overlap."""
    band = width * aspect
    step = band * (1 - overlap)
    n = F.ceil((height - band) / step)
    bands = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long"))), lambda i: F.struct(F.least(i * step, F.greatest(height - band, F.lit(0.0))).alias("y1"), F.least(i * step + band, height).alias("y2")))
    return F.when(height > band, bands).otherwise(F.array(F.struct(F.lit(0.0).alias("y1"), height.cast("double").alias("y2"))))


def keystoned(angles: DataFrame) -> DataFrame:
    """(doc_id, page, keystoned) from line angles in degrees: at least four, spread by 5 or with an upper median of 8 or more."""
    rows = angles.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.abs("angle"))).alias("a"), (F.max("angle") - F.min("angle")).alias("spread"))
    middle = F.get("a", F.floor(F.size("a") / 2).cast("int"))
    return rows.select("doc_id", "page", ((F.size("a") >= 4) & ((F.col("spread") >= 5) | (middle >= 8))).alias("keystoned"))
