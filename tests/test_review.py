"""Zones from lattices, review caps, continuations, samples and the folds of review events, on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import mrz
from attestry.operators import decode, extraction, layout, review, verify, zones

PASSPORT = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
CARD = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]


def printed(text, weak=None, p=0.99):
    """A lattice that reads text, a blank after each character; ``weak``: entries of the step by place."""
    out = []
    for i, ch in enumerate(text):
        out += [sorted((weak or {}).get(i, [(ch, p), ("?", 1 - p)]), key=lambda e: -e[1]), [("", 1.0)]]
    return out


@pytest.mark.parametrize("lines, kind", [(PASSPORT, "TD3"), (CARD, "TD1")])
def test_zone_is_read_and_proven(lines, kind):
    got = zones.decode_zone([printed(x) for x in lines])
    assert got["format"] == kind and got["zone"] == "\n".join(lines) and got["doubts"] == []


def test_check_digits_steer_the_read():
    first, second = PASSPORT
    got = zones.decode_zone([printed(first), printed(second, {14: [("9", 0.6), ("4", 0.4)]})])
    assert got["zone"] == "\n".join(PASSPORT) and got["doubts"] == []  # 79 for 74 fails the birth date's check


def test_invisible_rivals_stay_in_doubt():
    first, second = PASSPORT
    near = zones.decode_zone([printed(first), printed(second, {7: [("C", 0.6), ("M", 0.4)]})])["doubts"]
    assert [(d["field"], d["place"], d["alternative"], d["kind"]) for d in near] == [("document_number", 51, "M", "near_tie")]
    weak = zones.decode_zone([printed(first), printed(second, {7: [("C", 0.7), ("?", 0.1)]})])["doubts"]
    assert {d["kind"] for d in weak} == {"low_posterior"} and weak[0]["chosen"] == "C"
    span = zones.decode_zone([printed(first), printed(second, {i: [(second[i], 0.3), ("?", 0.3)] for i in range(9)})])["doubts"]
    assert [(d["field"], d["kind"]) for d in span] == [("document_number", "weak_span")]


def test_contradictions_and_other_formats_are_refused():
    first, second = PASSPORT
    clear = second[:9] + "7" + second[10:]
    assert zones.decode_zone([printed(first), printed(clear)]) is None  # nothing else is there to read
    assert zones.decode_zone([printed(first), printed(second, {9: [("7", 0.9), ("6", 0.1)]})]) is None  # a clear print is not overruled
    assert zones.decode_zone([printed(first), printed(second, {9: [("7", 0.6), ("6", 0.4)]})])["zone"] == "\n".join(PASSPORT)
    assert zones.decode_zone([printed(first + "<<<"), printed(second)]) is None  # a line that reads too long
    assert zones.decode_zone([printed(first)]) is None and zones.decode_zone([]) is None
    flat = [[("<", 0.01), ("?", 0.99)] if i % 2 == 0 else [("", 1.0)] for i in range(88)]
    assert zones.decode_zone([flat, printed(second)]) is None


def test_zone_decoder_over_rows(spark):
    as_rows = [[[{"ch": c, "p": p} for c, p in step] for step in printed(x)] for x in PASSPORT]
    weak = [[[{"ch": c, "p": p} for c, p in step] for step in printed(x, w)] for x, w in zip(PASSPORT, ({}, {7: [("C", 0.6), ("M", 0.4)]}))]
    rows = spark.createDataFrame([(1, as_rows), (2, None), (3, []), (4, [[]]), (5, weak)], f"k int, z array<{decode.LATTICE}>")
    got = {r.k: r.d for r in rows.select("k", zones.zone_decoder()("z").alias("d")).collect()}
    assert got[1].zone == "\n".join(PASSPORT) and got[1].doubts == []
    assert got[2].zone is None and got[3].zone is None and got[4].zone is None
    assert got[5].doubts[0].kind == "near_tie"


def test_spelled_takes_the_likeliest_steps():
    steps = [[("a", 0.9), ("", 0.1)], [("a", 0.6), ("b", 0.4)], [("", 1.0)], [("a", 0.7), ("b", 0.3)]]
    assert decode.spelled(steps, "aa") == [(0, pytest.approx(0.9)), (3, pytest.approx(0.7))]
    assert decode.spelled(steps, "aba") == [(0, pytest.approx(0.9)), (1, pytest.approx(0.4)), (3, pytest.approx(0.7))]
    assert decode.span_posterior([0.5, 0.5]) == pytest.approx(0.5) and decode.span_posterior([]) == 0.0


def test_weak_redecodes_are_no_reading(spark):
    rows = spark.createDataFrame([([[("M", 0.6), ("N", 0.4)]],), ([[("N", 0.7), ("M", 0.3)]],), ([[("Q", 1.0)]],), (None,), ([[("", 1.0)], [("F", 0.9), ("E", 0.1)]],)], f"l {decode.LATTICE}")
    assert [r.d for r in rows.select(decode.redecoder(decode.sex_grammar)("l").alias("d")).collect()] == ["M", None, None, None, "F"]


def test_sex_and_table_rules(spark):
    fields = [("d", "a", "Sex / Sexe", "sex", "text", " f ", False), ("d", "b", "Gender", None, "text", "LONDON", False), ("d", "c", "Sussex", None, "text", "x", False), ("d", "e", "Sex", None, "text", "", False), ("d", "g", None, None, "text", "x", False)]
    rows = spark.createDataFrame(fields, "doc_id string, id string, label string, canonical_label string, value_type string, value string, rejected boolean").withColumns({"required": F.lit(False), "user_edited": F.lit(False)})
    results = verify.validate(rows)
    assert {r.id: (r.validator, r.status) for r in results.collect()} == {"a": ("sex_token", "pass"), "b": ("sex_token", "fail")}
    assert {r.id: r.status for r in verify.statuses(rows, results).collect()}["b"] == "needs_review"
    sums = spark.createDataFrame([("d", "a", [1.0, None, 2.0], 3.005), ("d", "b", [1.0], 1.02), ("d", "c", None, 1.0), ("d", "e", [1.0], None)], "doc_id string, id string, lines array<double>, total double").withColumn("rejected", F.lit(False))
    assert {r.id: (r.status, r.suggested) for r in verify.validate(sums, [verify.table_arithmetic(F.col("lines"), F.col("total"))]).collect()} == {"a": ("pass", None), "b": ("fail", "conflict")}


def test_field_places_and_boxes(spark):
    boxes = [{"x1": 0.0, "y1": 0.1, "x2": 0.88, "y2": 0.2}, {"x1": 0.0, "y1": 0.2, "x2": 0.88, "y2": 0.3}]
    rows = spark.createDataFrame([("TD3", "nationality", boxes, [44, 44]), ("TD3", "nationality", boxes, [44, 12]), ("TD1", "personal_number", boxes, [30, 30]), ("TD2", "personal_number", boxes, [36, 36]), (None, "sex", boxes, [44, 44])], "kind string, label string, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>, n array<int>")
    got = [r.b for r in rows.select(mrz.field_box(F.col("kind"), F.col("label"), F.col("boxes"), F.col("n")).alias("b")).collect()]
    assert (round(got[0].x1, 6), round(got[0].x2, 6), got[0].y1) == (0.2, 0.26, 0.2) and got[1:] == [None] * 4


def test_print_agrees_with_the_zone(spark):
    names = {"UTO": "Utopia", "D": "Germany"}
    rows = [("id_number", "L898902C3", "l 898-902 c3", True), ("date", "2024-04-03", "03/04/2024", True), ("date", "2024-04-03", "05/04/2024", False), ("country", "Utopia", "UTO", True), ("country", "Utopia", "UTOPIA / UTO", True), ("country", "Utopia", "Utopia / Germany", False), ("country", "Nowhere", "Nowhere", False), ("name", "O NEILL", "o'neill", True), ("name", "ONEILL", "o'neill", False), ("name", "ANNA MARIA", "Anna-Maria", True), ("name", "A", None, False)]
    df = spark.createDataFrame(rows, "kind string, value string, printed string, want boolean")
    got = df.select("want", mrz.agrees_with_print(F.col("kind"), F.col("value"), F.col("printed"), names).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_no_zone_has_no_fields(spark):
    df = spark.createDataFrame([("no zone",), (None,)], "raw string")
    assert [r.f for r in df.select(mrz.derived_fields(mrz.parse_mrz(F.col("raw"), 2026)).alias("f")).collect()] == [[], []]


ITEM = "doc_id string, page int, node_id string, text string, x1 double, y1 double, x2 double, y2 double, region_id string"
FIELD = "doc_id string, ord int, canonical_label string, value_id string, value string"


def test_a_line_continues_one_field_only(spark):
    box = lambda node, text, x, y, region=None: ("d", 1, node, text, x, y, x + 0.2, y + 0.03, region)
    items = spark.createDataFrame([box("a", "CITY OF", 0.1, 0.1), box("b", "SPRINGS", 0.1, 0.14), box("c", "STATE", 0.1, 0.18), box("e", "FOURTH", 0.1, 0.22), box("f", "UTO", 0.1, 0.1), box("g", "OTHER", 0.1, 0.14, "r")], ITEM)
    fields = spark.createDataFrame([("d", 1, "place_of_birth", "a", "CITY OF"), ("d", 2, "issuing_authority", "f", "UTO"), ("d", 3, "total", "e", "FOURTH")], FIELD)
    got = {r.canonical_label: (r.value, r.continuation) for r in extraction.continued(fields, items).collect()}
    assert got == {"place_of_birth": ("CITY OF SPRINGS STATE", ["b", "c"]), "issuing_authority": ("UTO OTHER", ["g"])}
    assert extraction.continued(fields.filter("ord = 3"), items).count() == 0
    alone = extraction.continued(fields.filter("ord = 1"), items.filter("node_id = 'a'")).first()
    assert alone.value == "CITY OF" and alone.continuation == []


def test_samples_equal_a_pool_that_shrinks(spark):
    sizes = {str(d): n for d, n in enumerate([0, 1, 7, 8, 9, 30, 200])}
    rows = [(d, 1, k, f"span {k}") for d, n in sizes.items() for k in range(n)] + [("1", 1, 99, " a b c ")]
    got = layout.seeded_samples(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string"), 8, 5).collect()
    for d, n in sizes.items():
        pool, want = list(range(n)), []
        for x in layout.draws(8, 5) if n > 8 else []:
            want.append(pool.pop(int(x * len(pool))))
        assert [r.ord for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.draw)] == (want or pool)
    assert all(0 <= x < 1 for x in layout.draws(50, 0)) and layout.draws(3, 0) == layout.draws(3, 1)


def test_random_schema_edits_equal_plain_python(spark):
    rng = random.Random(3)
    names, kinds = ["a", "b", "c"], ["RENAME", "RETYPE", "TOGGLE_REQUIRED", "TOGGLE_COLUMN", "DELETE", "DELETE", "UNDO_DELETE", "OTHER", "APPROVE"]
    events, want = [], {}
    for fam in map(str, range(40)):
        fields = {n: {"label": n, "value_type": "text", "required": False, "is_column": False, "deleted": False} for n in names}
        undo, approved, error = [], False, None
        for seq in range(rng.randint(0, 14)):
            kind, f, label = rng.choice(kinds), rng.choice([*names, "x"]), rng.choice([" n ", " ", None])
            events.append((fam, seq, kind, f, label, "date"))
            text = (label or "").strip()
            if approved or kind == "OTHER" or (kind == "DELETE" and (f not in fields or fields[f]["deleted"])) or (kind == "UNDO_DELETE" and not undo):
                continue
            error = None
            if kind == "UNDO_DELETE":
                fields[undo.pop()]["deleted"] = False
            elif kind == "DELETE":
                fields[f]["deleted"] = True
                undo.append(f)
            elif kind == "APPROVE":
                approved = any(not x["deleted"] for x in fields.values())
                error = None if approved else review.NO_FIELD
            elif kind == "RENAME" and not text:
                error = review.NO_LABEL
            elif f in fields:
                key = {"RENAME": "label", "RETYPE": "value_type", "TOGGLE_REQUIRED": "required", "TOGGLE_COLUMN": "is_column"}[kind]
                fields[f][key] = text if kind == "RENAME" else "date" if kind == "RETYPE" else not fields[f][key]
        want[fam] = (approved, error, [{"field_id": n, **x} for n, x in fields.items() if not (approved and x["deleted"])])
    fields = spark.createDataFrame([(fam, k, n, n, "text", None, False) for fam in want for k, n in enumerate(names)], "family_id string, ord int, field_id string, label string, value_type string, required boolean, is_column boolean")
    told = spark.createDataFrame(events, "family_id string, seq int, type string, field_id string, label string, value_type string")
    got = {r.family_id: (r.approved, r.error, [f.asDict() for f in r.fields]) for r in review.edit_schemas(fields, told).collect()}
    assert got == want
    assert review.edit_schemas(fields.limit(0), told).count() == 0


def test_review_lane_keys(spark):
    items = spark.createDataFrame([("l", 2, "b", "2"), ("l", 1, "a", "1"), ("m", 1, "c", None)], "lane_id string, ord int, item_id string, value string")
    keys = [("KEY", "ArrowUp", None), ("KEY", "E", None), ("EDIT_INPUT", None, "z"), ("KEY", "Escape", None), ("EDIT_INPUT", None, "lost"), ("KEY", "ArrowDown", None), ("KEY", "Enter", None), ("KEY", "e", None), ("ACTION_DONE", None, None), ("KEY", "e", None), ("KEY", "Enter", None), ("ACTION_DONE", None, None), ("KEY", "Enter", None)]
    events = spark.createDataFrame([("l", i, *k) for i, k in enumerate(keys)], "lane_id string, seq int, type string, key string, value string")
    got = {r.lane_id: r for r in review.review_lanes(items, events).collect()}
    assert [tuple(a) for a in got["l"].actions] == [("accept", "b", "2"), ("save_edit", "a", "1")] and got["l"].done and not got["l"].editing
    assert got["m"].open == 1 and got["m"].actions == [] and not got["m"].done


def test_caps_without_a_document(spark):
    fields = spark.createDataFrame([("d", "a", "full_name", "name", "A", "registry", None, None), ("d", "b", None, None, None, None, None, None), ("d", "c", "note", "text", "x", "generic", None, None)], "doc_id string, id string, canonical_label string, value_type string, value string, origin string, ambiguous boolean, proven boolean")
    docs = spark.createDataFrame([], "doc_id string, identity boolean, zone string, surname string, given_names string")
    assert {r.id: r.review_cap for r in verify.review_caps(fields, docs).collect()} == {"a": "unattested name", "b": None, "c": None}
