"""Records and families: duplicates, schemas, review queues, rolling statistics, replay, exports.

hypotheses: doc_id, ord, label, canonical_label, value_type, value, status, rejected, required, confidence.
records: record_id, family_id, values (map<field, struct<value, status, confidence>>), created_at, sha256, phash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestry.functions.fuzzy import hamming64
from attestry.functions.scalars import family_name, slug

# Form types of value types; text where not listed.
FORM_TYPES = {"text": "text", "date": "date", "amount": "amount", "currency": "amount", "id_number": "id", "phone": "phone", "email": "email", "name": "text", "country": "text", "checkbox": "checkbox", "table": "table", "visual_asset": "photo", "barcode": "text"}
NO_COLUMN = ["photo", "signature", "seal", "table"]
QUESTIONS = 3
BANDS = 9


# --- duplicates ---------------------------------------------------------------------------------


def content_classes(docs: DataFrame, content: Column, key: str) -> DataFrame:
    """(sha256, first, copies): one row for each distinct content."""
    return docs.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def known_duplicates(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming rows whose sha256 a known record has."""
    return incoming.join(known.select("sha256").distinct(), "sha256", "left_semi")


def new_contents(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known.select("sha256").distinct(), "sha256", "left_anti")


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(family_id, phash, id, copies): the smallest id and the number of rows of each hash of a family."""
    hashes = hashes.filter(F.col("phash").rlike("^[0-9a-fA-F]{16}$")).withColumn("phash", F.lower("phash"))
    return hashes.groupBy("family_id", "phash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def near_duplicates(hashes: DataFrame, limit: int = 8) -> DataFrame:
    """(a, b, distance): pairs a < b of one family whose 64-bit hashes differ in at most ``limit`` (up to 8) bits.

    hashes: family_id, id, phash (16 hexadecimal digits). Of limit + 1 bands at least one is equal, so pairs are found by
    equal bands; a pair is listed in its first common band only. Equal hashes are compared once, through their smallest id:
    near_duplicate_members tells which ids that one stands for."""
    n = limit + 1
    distinct = hash_classes(hashes)
    bits = F.concat(*(F.lpad(F.conv(F.substring("phash", k, 8), 16, 2), 32, "0") for k in (1, 9)))
    cut = [64 * k // n for k in range(n + 1)]
    banded = distinct.withColumn("bits", bits).withColumn("bands", F.array(*(F.substring("bits", a + 1, b - a) for a, b in zip(cut, cut[1:]))))
    rows = banded.select("family_id", "id", "phash", "bands", F.posexplode("bands").alias("band", "piece"))
    left, right = (rows.select("family_id", "band", "piece", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "phash", "bands"))) for s in "ab")
    met = left.join(right, ["family_id", "band", "piece"]).filter("id_a < id_b")
    same = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True)
    met = met.filter(same == F.col("band") + 1).withColumn("distance", hamming64(F.col("phash_a"), F.col("phash_b")).cast("int"))
    return met.filter(F.col("distance") <= limit).select("family_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance")


def near_duplicate_members(hashes: DataFrame, limit: int = 8) -> DataFrame:
    """(family_id, id, representative, copies, n_links) of every row with a family and a hash of 16 digits.

    representative: the smallest id with the same family and hash, as listed by near_duplicates; copies: the rows it stands
    for, itself included; n_links: the other rows of the family within ``limit`` bits, equal hashes included."""
    classes = hash_classes(hashes)
    pairs = near_duplicates(hashes, limit)
    both = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
    ends = pairs.select("family_id", F.explode(both).alias("e")).select("family_id", "e.*")
    size = classes.select("family_id", F.col("id").alias("other"), F.col("copies").alias("m"))
    links = ends.join(size, ["family_id", "other"]).groupBy("family_id", "id").agg(F.sum("m").alias("far"))
    classes = classes.join(links, ["family_id", "id"], "left").withColumnRenamed("id", "representative")
    rows = hashes.select("family_id", "id", F.lower("phash").alias("phash"))
    found = rows.join(classes, ["family_id", "phash"])
    return found.select("family_id", "id", "representative", "copies", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


# --- schemas and values -------------------------------------------------------------------------


def form_fields(hypotheses: DataFrame) -> DataFrame:
    """(doc_id, ord, field_id, label, value_type, required, is_column, value, status, confidence): eligible hypotheses, the first of each field id."""
    form = F.create_map(*[F.lit(x) for pair in FORM_TYPES.items() for x in pair])
    rows = hypotheses.filter("value_type <> 'mrz' and status <> 'rejected' and not coalesce(rejected, false)")
    rows = rows.withColumn("field_id", slug(F.coalesce("canonical_label", "label"))).withColumn("k", F.row_number().over(W.partitionBy("doc_id", "field_id").orderBy("ord")))
    kind = F.coalesce(F.try_element_at(form, F.col("value_type")), F.lit("text"))
    return rows.filter("k = 1").select("doc_id", "ord", "field_id", "label", kind.alias("value_type"), F.coalesce("required", F.lit(False)).alias("required"), (~kind.isin(NO_COLUMN)).alias("is_column"), "value", "status", "confidence")


def merge_schema(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(family_id, ord, field_id, label): existing fields as they are, then the incoming ones that are new, in order."""
    top = existing.groupBy("family_id").agg(F.max("ord").alias("top"))
    new = incoming.join(existing, ["family_id", "field_id"], "left_anti").join(top, "family_id", "left")
    place = F.row_number().over(W.partitionBy("family_id").orderBy("ord"))
    new = new.withColumn("ord", (F.coalesce("top", F.lit(-1)) + place).cast("int"))
    return existing.select("family_id", "ord", "field_id", "label").unionByName(new.select("family_id", "ord", "field_id", "label"))


def removed_fields(old: Column, new: Column) -> Column:
    return F.array_except(old, new)


def values_map(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", F.struct("value", "status", "confidence"))))).alias("values"))


def families_for(docs: DataFrame, families: DataFrame) -> DataFrame:
    """docs (doc_id, doc_type) with the family of that name, whatever its case; where there is none, a name to create."""
    named = docs.withColumn("name", family_name(F.col("doc_type")))
    return named.join(families.select("family_id", F.lower("name").alias("key")), F.lower("name") == F.col("key"), "left").select("doc_id", "name", "family_id", F.col("family_id").isNull().alias("is_new"))


def open_fields(values: Column) -> Column:
    """Fields that still need review, by name."""
    return F.array_sort(F.map_keys(F.map_filter(values, lambda k, v: v["status"].isin("needs_review", "conflict"))))


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """records with the latest edit of each field (record_id, field_id, value, at): confirmed at confidence 1. Edits of absent fields change nothing."""
    last = edits.groupBy("record_id", "field_id").agg(F.max_by("value", "at").alias("value"))
    put = last.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "value"))).alias("put"))
    rows = records.join(put, "record_id", "left")
    new = lambda k, v: F.when(F.map_contains_key("put", k), F.struct(F.try_element_at("put", k).alias("value"), F.lit("confirmed").alias("status"), F.lit(1.0).alias("confidence"))).otherwise(v)
    return rows.withColumn("values", F.when(F.col("put").isNull(), F.col("values")).otherwise(F.transform_values("values", new))).drop("put")


# --- queues and statistics ------------------------------------------------------------------------


def rank_questions(fields: DataFrame, cap: int = QUESTIONS) -> DataFrame:
    """(doc_id, rank, field_id, kind, priority): what to ask first, at most ``cap`` for each document.

    fields: doc_id, field_id, status, confidence, critical, required, is_column, n_candidates."""
    tier = F.when(F.col("critical"), 3).when(F.col("required"), 2).when(F.col("is_column"), 1).otherwise(0)
    conflict = (F.col("status") == "conflict") & (F.col("n_candidates") >= 2)
    priority = tier * 100 + F.when(conflict, 50).otherwise(0) + (1 - F.col("confidence")) * 40
    rows = fields.filter("status <> 'confirmed'").withColumn("priority", priority).withColumn("kind", F.when(conflict, "conflict").otherwise("low_confidence"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("priority"), "field_id")))
    return rows.filter(F.col("rank") <= cap).select("doc_id", "rank", "field_id", "kind", "priority")


def rolling_means(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with the mean of each column over the rows so far: what folding one row at a time into (n, mean) gives."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({new: F.avg(old).over(upto) for new, old in columns.items()} | {"n_so_far": F.count("*").over(upto)})


# --- replay ---------------------------------------------------------------------------------------


def diff_fields(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """(doc_id, label, kind, side): what a replay changed. Both: doc_id, label, value, status.

    Only confirmed stored fields can regress; others improve when confirmed with the same value; fields that only the replay has are new."""
    s = stored.select("doc_id", "label", F.col("value").alias("sv"), F.col("status").alias("ss"), F.lit(True).alias("s"))
    r = replayed.select("doc_id", "label", F.col("value").alias("rv"), F.col("status").alias("rs"), F.lit(True).alias("r"))
    both = s.join(r, ["doc_id", "label"], "full_outer")
    sure = F.col("ss") == "confirmed"
    kind = (
        F.when(F.col("s").isNull(), "new_field")
        .when(sure & F.col("r").isNull(), "field_lost")
        .when(sure & ~F.col("rv").eqNullSafe(F.col("sv")), "value_changed")
        .when(sure & (F.col("rs") != "confirmed"), "status_downgraded")
        .when(~sure & (F.col("rs") == "confirmed") & F.col("rv").eqNullSafe(F.col("sv")), "status_upgraded")
    )
    rows = both.select("doc_id", "label", kind.alias("kind")).filter("kind is not null")
    return rows.withColumn("side", F.when(F.col("kind").isin("new_field", "status_upgraded"), "improvement").otherwise("regression"))


def replay_verdict(diffs: DataFrame) -> DataFrame:
    """One row (verdict, regressions, improvements): any regression decides, then any improvement."""
    n = diffs.agg(F.count_if(F.col("side") == "regression").alias("regressions"), F.count_if(F.col("side") == "improvement").alias("improvements"))
    return n.select(F.when(F.col("regressions") > 0, "regressed").when(F.col("improvements") > 0, "improved").otherwise("identical").alias("verdict"), "regressions", "improvements")


# --- exports --------------------------------------------------------------------------------------


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def csv_lines(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """One column, ``line``: the cells quoted where they must be (RFC 4180), joined by commas."""
    return rows.select(F.concat_ws(",", *(csv_field(c.cast("string")) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CRLF parts that are, one after another, one file; the first of them is the header."""
    header = rows.sparkSession.range(1, numPartitions=1).select(F.concat_ws(",", *(csv_field(F.lit(c)) for c in columns)).alias("line"))
    header.union(csv_lines(rows, [F.col(c) for c in columns])).write.option("lineSep", "\r\n").text(path)


def record_columns(records: DataFrame, fields: list[str], provenance: bool = False) -> DataFrame:
    """A column for each field's value and, with ``provenance``, its status and confidence."""
    cell = lambda f, part: F.try_element_at(F.col("values"), F.lit(f))[part]
    out = [F.coalesce(cell(f, "value"), F.lit("")).alias(f) for f in fields]
    if provenance:
        out += [x for f in fields for x in (cell(f, "status").alias(f"{f}_status"), cell(f, "confidence").alias(f"{f}_confidence"))]
    return records.select("record_id", *out)


def json_archive(records: DataFrame) -> DataFrame:
    """One column, ``json``: whole records, nothing lost."""
    return records.select(F.to_json(F.struct("*")).alias("json"))


def manifest(records: DataFrame, engine: str, now: str) -> DataFrame:
    return records.groupBy("family_id").agg(F.count("*").alias("records")).withColumns({"engine_version": F.lit(engine), "exported_at": F.lit(now)})


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last version of each key in an append-only table; of several with the same ``order``, the one whose other columns sort last.

    Aggregated before the shuffle: at most one row of a key leaves a task."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_last"))
    return last.select(*key, "_last.*").select(*rows.columns)


def page(rows: DataFrame, order: list[str], top: int, height: int) -> DataFrame:
    """The rows of a scrolled window."""
    return rows.orderBy(*order).offset(top).limit(height)
