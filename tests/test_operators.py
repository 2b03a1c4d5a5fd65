"""Operators without a SQL twin, on small fixtures."""

import io
import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import checksums as C
from attestry.functions import mrz
from attestry.functions import scalars as S
from attestry.operators import consensus, decode, gate, layout, learning, tables, verify, workspace
from attestry.sources import files, stores
from attestry.streaming import routing, windows

CANDIDATES = "doc_id string, id string, ord int, canonical_label string, value_type string, value string, channel string, marks array<string>"


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 5, 2)
        p = rng.random((n, m))
        p[rng.random((n, m)) < 0.3] = np.nan
        got = sum(p[i, j] for i, j in enumerate(consensus.assign_optimal(p)) if j >= 0)
        best = 0.0
        for pick in itertools.product(range(-1, m), repeat=n):
            used = [j for j in pick if j >= 0]
            if len({*used}) == len(used) and not any(j >= 0 and math.isnan(p[i, j]) for i, j in enumerate(pick)):
                best = max(best, sum(p[i, j] for i, j in enumerate(pick) if j >= 0))
        assert abs(got - best) < 1e-9


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATES)


def test_only_proof_confirms(spark):
    rows = [
        ("d", "a", 1, "iban", "id_number", "GB82 WEST 1234 5698 7654 32", "ocr", []),
        ("d", "b", 2, "iban", "id_number", "GB82 WEST 1234 5698 7654 33", "ocr", []),
        ("d", "c", 3, "note", "text", "plain", "ocr", []),
        ("d", "e", 4, None, "text", "4111111111111111", "ocr", []),
        ("d", "f", 5, "expiry_date", "date", "31/02/2024", "ocr", []),
    ]
    got = {r.label: (r.status, r.candidate_id) for r in consensus.solve(candidates(spark, rows), "2026-01-01", ["iban", "note", "expiry_date"]).collect()}
    assert got == {"iban": ("confirmed", "a"), "note": ("review", "c"), "card_number": ("review", "e"), "expiry_date": ("refused", "f")}


def test_payload_witnesses_but_never_receives(spark):
    code = "(01)09506000134352(17)251231(10)AB12"
    rows = [("d", "p", 1, None, "barcode", code, "payload", ["barcode_payload"]), ("d", "a", 2, "lot_number", "text", "ab-12", "ocr", []), ("d", "b", 3, "date_of_expiry", "date", "30/12/2025", "ocr", [])]
    got = {(r.candidate_id, r.verdict) for r in consensus.attest_payloads(candidates(spark, rows)).collect()}
    assert got == {("a", "proves"), ("b", "contradicts")}


def test_empty_candidates(spark):
    assert consensus.solve(candidates(spark, []), "2026-01-01", ["total"]).count() == 0


def test_date_order_is_none_without_evidence(spark):
    rows = [("d", "a", 1, "date_of_birth", "date", "13/04/1990", "ocr", []), ("d", "b", 2, "date_of_birth", "date", "1990-04-13", "native", [])]
    assert consensus.globals_of(candidates(spark, rows), "2026-01-01").first().date_order is None


def test_zone_repair_is_unique_or_nothing():
    zone = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    assert mrz.failures(zone, "TD3") == []
    broken = [zone[0], zone[1].replace("L898902C3", "L89890ZC3")]
    assert mrz.failures(broken, "TD3")
    assert mrz.repair_zone(broken, "TD3") in (zone, None)
    hopeless = [zone[0], "X" * 44]
    assert mrz.repair_zone(hopeless, "TD3") is None
    two = [zone[0], zone[1].replace("740812", "7A0812").replace("120415", "12O415")]  # two parts fail on their own
    assert [f for f in mrz.failures(two, "TD3") if f != "composite"] and mrz.repair_zone(two, "TD3") is None
    one = [zone[0], zone[1].replace("740812", "7A0812")]
    assert mrz.repair_zone(one, "TD3") == zone


def test_csv_files_have_a_header(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, " x\ny ")], "k int, v string").coalesce(1)
    workspace.write_csv(rows, ["k", "v"], f"file://{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_bytes().decode() for p in parts) == 'k,v\r\n1,"a ""b"", c"\r\n2,\r\n3," x\ny "\r\n'


def test_latest_is_one_row_of_each_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, None), (None, 5, "n")], "k int, at int, v string")
    assert sorted(map(tuple, workspace.latest(rows, ["k"], "at").collect()), key=str) == [(1, 2, "c"), (2, 1, None), (None, 5, "n")]


def test_no_rules_is_not_the_registry(spark):
    fields = spark.createDataFrame([("d", "a", "x@", "email", False, True)], "doc_id string, id string, value string, value_type string, rejected boolean, required boolean")
    assert verify.validate(fields, []).count() == 0 and verify.validate(fields).count() > 0


def test_prior_sees_the_step():
    asked = []
    decode.beam([[("a", 0.6), ("", 0.4)], [("b", 1.0)]], decode.Positional(["ab", "ab"]), prior=lambda ch, at: asked.append((ch, at)) or 1.0)
    assert {("a", 0), ("", 0), ("b", 1)} <= set(asked)


def test_zone_formats(spark):
    td1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
    td2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
    rows = spark.createDataFrame([(td1,), (td2,), ("too short",), (None,)], "z string").select(mrz.parse_mrz(F.col("z"), 2026).alias("m")).select("m.format", "m.status", "m.fields.surname").collect()
    assert [tuple(r) for r in rows] == [("TD1", "valid", "ERIKSSON"), ("TD2", "valid", "ERIKSSON"), (None, None, None), (None, None, None)]


@pytest.mark.parametrize("name", ["luhn", "verhoeff"])
def test_single_errors_are_caught(spark, name):
    good = {"luhn": "4111111111111111", "verhoeff": "2363"}[name]
    wrong = [good[:i] + d + good[i + 1 :] for i in range(len(good)) for d in "0123456789" if d != good[i]]
    assert not any(r[0] for r in spark.createDataFrame([(w,) for w in wrong], "s string").select(C.PREDICATES[name](F.col("s"))).collect())


def test_beam_obeys_its_grammar():
    steps = [[("1", 0.6), ("I", 0.4)], [("", 0.9), ("1", 0.1)], [("O", 0.7), ("0", 0.3)]]
    assert decode.beam(steps, decode.Positional(["0123456789"] * 2))[0][0] == "10"
    assert decode.beam(steps, decode.OneOf(["IO"]))[0][0] == "IO"
    assert decode.beam(steps, decode.OneOf(["ZZ"])) == []
    luhn = decode.Checked(decode.Positional(["0123456789"] * 2), lambda t: t == "18")
    assert decode.beam(steps, luhn) == []


def test_beam_sums_paths():
    steps = [[("a", 0.5), ("", 0.5)], [("a", 0.5), ("", 0.5)]]
    found = dict(decode.beam(steps, decode.OneOf(["", "a", "aa"])))
    assert math.isclose(math.exp(found["a"]), 0.75) and math.isclose(math.exp(found[""]), 0.25) and "aa" not in found


def test_beam_decoder_column(spark):
    rows = spark.createDataFrame([([[("M", 0.6), ("N", 0.4)]],), ([[("Q", 1.0)]],), (None,)], f"l {decode.LATTICE}")
    got = [r.d.text for r in rows.select(decode.beam_decoder(decode.sex_grammar)("l").alias("d")).collect()]
    assert got == ["M", None, None]


def test_table_repair_needs_one_reading(spark):
    cells = [("t", 0, 0, "1.00", ["7.00"]), ("t", 1, 0, "2.00", []), ("t", 2, 0, "9.00", ["3.00"]), ("t", 0, 1, "5.00", []), ("t", 1, 1, "5.00", []), ("t", 2, 1, "10.00", [])]
    df = spark.createDataFrame(cells, "doc_id string, r int, c int, raw string, alternates array<string>")
    assert tables.closure_status(df).first().status == "review"
    found = [tuple(r) for r in tables.repairs(df).collect()]
    assert found == []  # two single readings close it: 7 + 2 = 9 and 1 + 2 = 3
    once = df.withColumn("alternates", F.when(F.col("r") == 2, F.col("alternates")).otherwise(F.array().cast("array<string>")))
    assert [tuple(r) for r in tables.repairs(once).collect()] == [("t", 2, 0, "9.00", "3.00")]


def test_learned_repairs(spark):
    prior = spark.createDataFrame([("O", "0", 5), ("I", "1", 5)], "seen string, truth string, n long")
    values = spark.createDataFrame([("a", "4111O11111111111"), ("b", "41111111I1111111"), ("c", "4111111111111111"), ("d", "9999")], "id string, value string")
    got = {r.id: r.repaired for r in learning.repairs(values, learning.plausible_truths(prior), C.luhn).collect()}
    assert got.get("b") == "4111111111111111" and "c" not in got and "d" not in got


def test_suppression_boundaries(spark):
    boxes = spark.createDataFrame([("d", "a", 0.9, 0.0, 0.0, 1.0, 1.0), ("d", "b", 0.8, 0.0, 0.0, 1.0, 0.5), ("d", "c", 0.7, 2.0, 2.0, 3.0, 3.0)], "doc_id string, node_id string, score double, x1 double, y1 double, x2 double, y2 double")
    keep = lambda strict: sorted(r.node_id for r in layout.suppress(boxes, 0.5, strict).collect())
    assert keep(True) == ["a", "b", "c"] and keep(False) == ["a", "c"]


def test_text_lines(spark):
    runs = spark.createDataFrame([("d", 1, "world", 0.5, 0.1, 0.9, 0.2), ("d", 1, "hello", 0.1, 0.11, 0.4, 0.21), ("d", 1, "next", 0.1, 0.5, 0.4, 0.6)], "doc_id string, page int, text string, x1 double, y1 double, x2 double, y2 double")
    assert [r.text for r in layout.text_lines(runs).orderBy("line").collect()] == ["hello world", "next"]


def test_anchor_matching(spark):
    anchors = spark.createDataFrame([("t", "a1", "Invoice Number"), ("t", "a2", "Total")], "template_id string, anchor_id string, value string")
    items = spark.createDataFrame([("d", "n1", "invoice numbar"), ("d", "n2", "TOTAL "), ("d", "n3", "Totel")], "doc_id string, node_id string, text string")
    got = {(r.anchor_id, r.node_id) for r in layout.anchor_matches(anchors, items).collect()}
    assert got == {("a1", "n1"), ("a2", "n2")}


def test_registry_labels(spark):
    items = spark.createDataFrame([("d", "n1", "Total Due"), ("d", "n2", "Invoce Number"), ("d", "n3", "zzz")], "doc_id string, node_id string, text string")
    registry = spark.createDataFrame([("total", "total due", 1), ("invoice_number", "invoice number", 2)], "canonical_label string, phrase string, ord int")
    got = {r.node_id: r.canonical_label for r in layout.labels_by_registry(items, registry).collect()}
    assert got == {"n1": "total", "n2": "invoice_number"}


def test_csv_and_xlsx_cells(spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("[Content_Types].xml", "spreadsheetml")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Total</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+2</f><v>3</v></c></row></sheetData></worksheet>')
    rows = spark.createDataFrame([("a.csv", bytearray(b"x;y\n1;2\n")), ("b.xlsx", bytearray(book.getvalue()))], "path string, content binary")
    assert {(r.r, r.c, r.raw) for r in files.csv_cells(rows.filter("path = 'a.csv'")).collect()} == {(0, 0, "x"), (0, 1, "y"), (1, 0, "1"), (1, 1, "2")}
    assert {(r.path, r.r, r.c, r.raw, r.formula) for r in files.xlsx_cells(rows).collect()} == {("b.xlsx", 0, 0, "Total", None), ("b.xlsx", 0, 1, "3", "1+2")}


def test_table_store(spark, tmp_path):
    store = stores.Table(spark, f"file://{tmp_path}/t", "id", "id string, v int")
    store.create()
    assert store.all().count() == 0
    store.put(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), 1)
    store.put(spark.createDataFrame([("a", 2)], "id string, v int"), 2)
    store.put(spark.createDataFrame([("b", 1)], "id string, v int"), 3, removed=True)
    assert [tuple(r) for r in store.all().collect()] == [("a", 2)]
    assert store.by("v", 2).count() == 1 and store.get("b").count() == 0


def test_sealed_rows(spark):
    ring = stores.new_keyring("secret", 10)
    key = stores.unlock(ring, "secret")
    with pytest.raises(ValueError):
        stores.unlock(ring, "other")
    rows = spark.createDataFrame([("a", "x", 1)], "id string, v string, n int")
    shut = stores.sealed(rows, key, ["id"])
    assert shut.columns == ["id", "sealed"]
    assert [tuple(r) for r in stores.unsealed(shut, key, "v string, n int").collect()] == [("a", "x", 1)]
    other = stores.derive_key("other", b"salt", 10)
    assert stores.unsealed(shut, other, "v string, n int", strict=False).first().v is None
    with pytest.raises(Exception):
        stores.unsealed(shut, other, "v string, n int").collect()


def test_bundles(spark):
    line = lambda x, lattice: ("t", 0.9, [[x, 0.1], [0.5, 0.1], [0.5, 0.2], [x, 0.2]], lattice)
    rows = [("ok", 1, ("img", "a" * 64, 1), [(0, "vision", 1.0, 1.0, [line(0.1, [[("t", 1.0)]])])]), ("bad", 1, ("img", "zz", 2), [(0, "vision", 1.0, 1.0, [line(1.9, None), line(0.1, None)])])]
    df = spark.createDataFrame(rows, f"doc_id string, {stores.BUNDLE}")
    assert {(r.doc_id, r.rule) for r in stores.bundle_faults(df).collect()} == {("bad", "sha256"), ("bad", "page_count"), ("bad", "lattice"), ("bad", "geometry")}
    assert [r.doc_id for r in stores.bundle_items(df).collect()] == ["ok"]


EVENTS = [("f1", 1, "SHA256_MISS", None, None, 0), ("f1", 2, "BUNDLE_READY", None, None, 0), ("f1", 3, "TEMPLATE_SCORED", "fam", 0.6, 0), ("f1", 4, "USER_CONFIRMED_FAMILY", None, None, 0), ("f1", 5, "RECORD_APPENDED", "fam", None, 2), ("f1", 6, "REVIEW_RESOLVED", None, None, 0), ("f1", 7, "REVIEW_RESOLVED", None, None, 0), ("f1", 8, "ERROR", None, None, 0), ("f2", 1, "SHA256_HIT", None, None, 0), ("f2", 2, "BUNDLE_READY", None, None, 0), ("f3", 1, "ERROR", None, None, 0)]
EVENT = "file_id string, seq int, type string, family_id string, score double, open_fields int"


def test_routing_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(EVENTS, EVENT)
    want = {tuple(r) for r in routing.fold(batch).collect()}
    assert want == {("f1", "done", 7, 1), ("f2", "duplicate", 1, 1), ("f3", "failed", 1, 0)}
    src = str(tmp_path / "src")
    batch.filter("seq <= 4").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    out = routing.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).start()
    out.processAllAvailable()
    batch.filter("seq > 4").coalesce(1).write.mode("append").parquet(src)
    out.processAllAvailable()
    out.stop()
    last = {}
    for r in spark.sql("select * from routed").collect():
        if r.applied + r.illegal >= sum(last.get(r.file_id, (0, 0, 0, 0))[2:]):
            last[r.file_id] = tuple(r)
    assert {*last.values()} == want


def test_window_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:30:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 3.0)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    out = windows.tumbling(stream, "1 hour", ["k"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    out.processAllAvailable()
    out.stop()
    assert {(r.k, r.n, r.total) for r in spark.sql("select * from tumbled").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_gate(spark):
    shards = spark.createDataFrame([("a", 1, 10, 9, 0, 1.0, 0.5), ("a", 2, 30, 30, 0, 0.5, 0.9)], "family string, shard int, entries long, passed long, silent_errors long, mrz_valid_rate double, field_hit_rate double")
    merged = gate.merged_shards(shards)
    row = merged.first()
    assert (row.entries, row.passed) == (40, 39) and math.isclose(row.mrz_valid_rate, 0.625) and math.isclose(row.field_hit_rate, 0.8)
    base = spark.createDataFrame([("a", 40)], "family string, passed long")
    assert gate.below_baseline(merged, base).count() == 1


def test_null_inputs_stay_null(spark):
    one = spark.createDataFrame([(None,)], "s string")
    s = F.col("s")
    row = one.select(S.parse_date(s), S.parse_amount(s), S.closure_amount(s), S.slug(s), S.infer_value_type(s), S.plausible_iso_dates(s), C.luhn(s), C.iban(s), C.verhoeff(s)).first()
    assert all(x is None for x in row)


ZONE = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def test_zone_bears_witness(spark):
    rows = [
        ("d", "z", 1, "mrz", "mrz", ZONE, "ocr", ["mrz_text"]), ("d", "a", 2, "passport_number", "id_number", "l898902c3", "ocr", []), ("d", "b", 3, "surname", "name", "Eriksson", "ocr", []),
        ("d", "c", 4, "date_of_birth", "date", "12/08/1974", "ocr", []), ("d", "e", 5, "date_of_expiry", "date", "16/04/2012", "ocr", []), ("d", "f", 6, "nationality", "country", "Utopia", "ocr", []), ("d", "g", 7, "full_name", "name", "Anna Maria Eriksson", "ocr", []),
        ("x", "z", 1, "mrz", "mrz", ZONE.replace("L898902C36", "L898902C37"), "ocr", []), ("x", "a", 2, "surname", "name", "Other", "ocr", []),
    ]
    got = {(r.doc_id, r.candidate_id): r.verdict for r in consensus.attest_zones(candidates(spark, rows), "2026-01-01").collect()}
    assert got == {("d", "z"): "proves", ("d", "a"): "proves", ("d", "b"): "supports", ("d", "c"): "proves", ("d", "e"): "contradicts", ("d", "g"): "supports", ("x", "z"): "contradicts"}


def test_partial_zone(spark):
    second = ZONE.split("\n")[1]
    rows = spark.createDataFrame([(second[13:],), (second[:30],), ("short",), (None,)], "s string").select(mrz.partial_fields(F.col("s")).alias("f"), mrz.partial_fields(F.col("s"), "left").alias("l")).collect()
    fields = lambda xs: {x.label: x.value for x in xs}
    assert fields(rows[0].l) == {"date_of_birth": "1974-08-12", "date_of_expiry": "2012-04-15", "personal_number": "ZE184226B"}
    assert fields(rows[1].f).get("passport_number") == "L898902C3" and fields(rows[2].f) == {}


def test_text_layer(spark):
    reads = spark.createDataFrame([("a", "total due", "Total Due"), ("a", "abc def", "zzz"), ("b", "x y z", "x y z"), ("b", "one", "one"), ("b", "two", "qqq")], "doc_id string, claimed string, seen string")
    assert {r.doc_id: r.trusted for r in layout.text_layer_trust(reads).collect()} == {"a": False, "b": True}


def test_members_of_near_duplicates(spark):
    rows = [("f", 5, "00" * 8), ("f", 2, "00" * 8), ("f", 9, "00" * 7 + "0F"), ("f", 7, "00" * 7 + "0f"), ("f", 1, "ff" * 8), ("g", 3, "00" * 8), ("g", 4, "none")]
    got = workspace.near_duplicate_members(spark.createDataFrame(rows, "family_id string, id long, phash string")).collect()
    near = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1") <= 8
    valid = [(f, i, h.lower()) for f, i, h in rows if h != "none"]
    want = set()
    for f, i, h in valid:
        same = [j for g, j, k in valid if (g, k) == (f, h)]
        want.add((f, i, min(same), len(same), sum(g == f and near(h, k) for g, _, k in valid) - 1))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
