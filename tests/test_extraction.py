"""Fields from boxes, end to end."""

from pyspark.sql import functions as F

from attestry.operators import extraction

ITEM = "doc_id string, page int, node_id string, text string, confidence double, x1 double, y1 double, x2 double, y2 double, region_id string"


def page(spark, lines):
    return spark.createDataFrame([("d", 1, f"n{k}", t, 0.9, x, y, x + 0.2, y + 0.03, None) for k, (t, x, y) in enumerate(lines)], ITEM)


def registry(spark):
    return spark.createDataFrame([("total", "total due", 1, "amount"), ("invoice_date", "invoice date", 2, "date"), ("invoice_number", "invoice number", 3, "id_number")], "canonical_label string, phrase string, ord int, value_type string")


def test_fields_from_a_page(spark):
    items = page(spark, [("Total Due", 0.1, 0.1), ("$120.00", 0.4, 0.1), ("Invoice Date", 0.1, 0.2), ("2024-03-01", 0.4, 0.2), ("Invoice Number: A-1234", 0.1, 0.3), ("Some other words", 0.4, 0.4)])
    got = {r.canonical_label: (r.value, r.review_cap) for r in extraction.extract(items, registry(spark)).collect()}
    assert got == {"total": ("$120.00", None), "invoice_date": ("2024-03-01", None), "invoice_number": ("A-1234", None)}


def test_rivals_cap_the_winner(spark):
    items = page(spark, [("Total Due", 0.1, 0.1), ("$120.00", 0.4, 0.1), ("$125.00", 0.65, 0.1)])
    row = extraction.extract(items, registry(spark)).first()
    assert row.value == "$120.00" and row.review_cap == "ambiguous" and row.score <= extraction.CAP


def test_empty_page(spark):
    assert extraction.extract(page(spark, [("x", 0.1, 0.1)]).limit(0), registry(spark)).count() == 0


def test_page_laws(spark):
    bands = spark.createDataFrame([(100.0, 100.0), (600.0, 100.0)], "h double, w double").select(extraction.page_bands(F.col("h"), F.col("w")).alias("b")).collect()
    assert len(bands[0].b) == 1 and bands[1].b[-1].y2 == 600.0 and len(bands[1].b) == 3
    angles = spark.createDataFrame([("a", 1, x) for x in (0.0, 1.0, 0.5, 0.2)] + [("b", 1, x) for x in (-3.0, 3.0, 0.0, 1.0)] + [("c", 1, 20.0)], "doc_id string, page int, angle double")
    assert {r.doc_id: r.keystoned for r in extraction.keystoned(angles).collect()} == {"a": False, "b": True, "c": False}
    first = spark.createDataFrame([("d", "total", "A-1"), ("d", "date", "B")], "doc_id string, canonical_label string, value string")
    again = spark.createDataFrame([("d", "total", "a1"), ("d", "date", "C")], "doc_id string, canonical_label string, value string")
    assert [r.canonical_label for r in extraction.counterfactual_caps(first, again).collect()] == ["date"]
