"""Pairs without a registry: admission, geometry laws, contacts, probes, countries."""

import pytest

from attestry.operators import generic

ITEM = "doc_id string, page int, node_id string, text string, confidence double, x1 double, y1 double, x2 double, y2 double, region_id string, angle double"


def page(spark, lines, doc="d", angle=0.0):
    return spark.createDataFrame([(doc, 1, f"n{k:02d}", t, 0.9, x, y, x + w, y + 0.02, region, angle) for k, (t, x, y, w, region) in enumerate((*l, *(0.2, None)[len(l) - 3 :]) for l in lines)], ITEM)


def got(df):
    return {r.canonical_label: (r.value_type, r.value) for r in df.collect()}


def test_rows_inline_and_contacts(spark):
    items = page(spark, [("JANE Q DOE", 0.1, 0.05), ("Invoice Date", 0.1, 0.1), ("2024-03-01", 0.32, 0.1), ("Amount Due", 0.1, 0.2), ("$120.00", 0.32, 0.2), ("Reference: A-1234", 0.1, 0.3), ("Email jane@example.org", 0.1, 0.4), ("Phone +1 555 010 9999", 0.1, 0.5), ("P<UTODOE", 0.1, 0.6), (None, 0.1, 0.7)])
    assert got(generic.generic_fields(items)) == {"full_name": ("name", "JANE Q DOE"), "invoice_date": ("date", "2024-03-01"), "amount_due": ("amount", "$120.00"), "reference": ("id_number", "A-1234"), "email": ("email", "jane@example.org"), "phone": ("phone", "+1 555 010 9999")}


def test_stacked_pairs_and_interposition(spark):
    items = page(spark, [("Total Due", 0.1, 0.1), ("$120.00", 0.1, 0.13), ("Issue Date", 0.5, 0.1), ("2024-03-01", 0.5, 0.13)])
    assert got(generic.generic_fields(items)) == {"total_due": ("amount", "$120.00"), "issue_date": ("date", "2024-03-01")}
    through = page(spark, [("Anna Smith", 0.1, 0.1), ("Monthly Rent", 0.1, 0.14), ("1,334.77", 0.1, 0.18)])
    assert got(generic.generic_fields(through))["monthly_rent"] == ("amount", "1,334.77")


def test_table_rows_cross_wide_gaps(spark):
    items = page(spark, [("Test", 0.05, 0.1, 0.15, None), ("Result", 0.4, 0.1, 0.15, None), ("Unit", 0.7, 0.1, 0.15, None), ("Iron", 0.05, 0.14, 0.15, None), ("113.75", 0.4, 0.14, 0.15, None), ("209.11", 0.7, 0.14, 0.15, None), ("Zinc", 0.05, 0.18, 0.15, None), ("183.41", 0.4, 0.18, 0.15, None), ("208.22", 0.7, 0.18, 0.15, None)])
    fields = got(generic.generic_fields(items))
    assert fields["iron"] == ("amount", "113.75") and fields["zinc"] == ("amount", "183.41")


def test_regions_do_not_mix_and_claimed_lines_stay_out(spark):
    items = page(spark, [("Total Due", 0.1, 0.1, 0.2, "a"), ("$120.00", 0.32, 0.1, 0.2, "b")])
    assert got(generic.generic_fields(items)) == {}
    one = page(spark, [("Total Due", 0.1, 0.1), ("$120.00", 0.32, 0.1), ("$99.00", 0.54, 0.1)])
    claimed = spark.createDataFrame([("d", "n01")], "doc_id string, node_id string")
    assert got(generic.generic_fields(one, claimed=claimed)) == {"total_due": ("amount", "$99.00")}


def test_definite_labels_are_no_values(spark):
    items = page(spark, [("Place", 0.1, 0.1), ("Issue Place", 0.32, 0.1)])
    registry = spark.createDataFrame([("issue place",)], "phrase string")
    assert got(generic.generic_fields(items)) == {"place": ("text", "Issue Place")}
    assert got(generic.generic_fields(items, registry)) == {}


def test_admission(spark):
    stamps = [(t, 0.1 * k, 0.1 * k) for k, t in enumerate(("75", "Jt", "§§±±¤¤", "ВИЗА", "ok words here"))]
    level = [("Some level words", 0.1, 0.1 * k) for k in range(5)]
    rows = page(spark, stamps, "stamps").unionByName(page(spark, level, "level"))
    for k, angle in enumerate((20.0, -35.0, 50.0, 5.0)):
        rows = rows.unionByName(page(spark, [(f"words of tilt {k}", 0.1, 0.1 * k)], "tilted", angle))
    assert {r.doc_id: r.admitted for r in generic.admitted_pages(rows).collect()} == {"stamps": False, "level": True, "tilted": False}
    captions = rows.filter("doc_id = 'tilted'").unionByName(page(spark, [("Date:", 0.1, 0.5)], "tilted"))
    assert generic.admitted_pages(captions).first().admitted


def test_odd_rows(spark):
    one = page(spark, [("Total Due", 0.1, 0.1), ("$120.00", 0.32, 0.1)])
    assert generic.generic_fields(one.limit(0)).count() == 0
    doubled = one.unionByName(one).selectExpr("*", "'x' as label", "1 as score", "'y' as value", "true as admitted")
    assert got(generic.generic_fields(doubled)) == {"total_due": ("amount", "$120.00")}
    boxless = one.selectExpr("doc_id", "page", "node_id", "text", "cast(null as double) as confidence", "x1", "cast(null as double) as y1", "x2", "y2", "region_id")
    assert got(generic.generic_fields(boxless)) == {}
    many = page(spark, [(t, x, 0.001 * k) for k in range(400) for t, x in ((f"Caption {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}", 0.1), (f"${k}.50", 0.32))])
    assert generic.generic_fields(many).count() == 400


def test_many_pages_are_one_call_and_batches_do_not_cut_them(spark):
    rows = page(spark, [("Total Due", 0.1, 0.1), ("$100.00", 0.32, 0.1)], "d0")
    for k in range(1, 7):
        head = [("Total Due", 0.1, 0.1), (f"${k}.00", 0.32, 0.1), ("Invoice Date", 0.1, 0.2), (f"2024-03-0{k}", 0.32, 0.2)]
        rows = rows.unionByName(page(spark, head + [(f"Reference {'abcdefg'[j]}: A-{k}00{j}", 0.1, 0.3 + 0.05 * j) for j in range(k)], f"d{k}"))
    want = {("d0", "total_due", "$100.00")}
    for k in range(1, 7):
        want |= {(f"d{k}", "total_due", f"${k}.00"), (f"d{k}", "invoice_date", f"2024-03-0{k}")} | {(f"d{k}", f"reference_{'abcdefg'[j]}", f"A-{k}00{j}") for j in range(k)}
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", rows.coalesce(1)
    for size in ("10000", "1", "3", "7"):
        spark.conf.set(key, size)
        try:
            fields = generic.generic_fields(rows)
            assert "FlatMapGroups" not in fields._jdf.queryExecution().executedPlan().toString()  # no Python call of its own for each page
            assert {(r.doc_id, r.canonical_label, r.value) for r in fields.collect()} == want
        finally:
            spark.conf.unset(key)


@pytest.mark.parametrize("text, like", [("Place of Birth", True), ("Date of Birth / जन्म तिथि", True), ("2024-03-01", False), ("$12.00", False), ("one two three four five six", False), ("A1234", False), ("A1234:", True), ("x", False), ("", False), (None, False)])
def test_label_shapes(spark, text, like):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(generic.looks_like_label(df.t).alias("k")).first().k is like


def test_sparse_probe(spark):
    anchors = spark.createDataFrame([("t", k, v, k == 0) for k, v in enumerate(("Invoice Number", "Total", "Date", "Customer", "Address", "Terms", "Page"))], "template_id string, anchor_id int, value string, required boolean")
    words = {r.anchor_id: r.value for r in anchors.collect()}
    read = lambda doc, change: [(doc, "t", k, change.get(k, v)) for k, v in words.items()]
    reads = spark.createDataFrame(read("all", {}) + read("inside", {0: "the INVOICE NUMBER is"}) + read("one", {6: "xx"}) + read("two", {5: "xx", 6: None}) + read("required", {0: "xx"}), "doc_id string, template_id string, anchor_id int, text string")
    assert {r.doc_id: r.hit for r in generic.sparse_probe(anchors, reads).collect()} == {"all": True, "inside": True, "one": True, "two": False, "required": False}


def test_country_codes(spark):
    names = spark.createDataFrame([("IND", "India"), ("ZAF", "South Africa"), ("ZAF", "South African"), ("D", "Germany"), ("DEU", "Germany"), ("CIV", "Côte d'Ivoire")], "code string, name string")
    values = spark.createDataFrame([(1, "India / IND"), (2, "south african"), (3, "India/Germany"), (4, "Germany"), (5, "D"), (6, "Atlantis"), (7, None), (8, "Cote d'Ivoire / nowhere")], "id int, value string")
    assert {r.id: r.code for r in generic.country_codes(values, names).collect()} == {1: "IND", 2: "ZAF", 3: None, 4: "DEU", 5: "D", 6: None, 7: None, 8: "CIV"}
