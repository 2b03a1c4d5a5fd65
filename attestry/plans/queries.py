"""Queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestry.functions import checksums as C
from attestry.functions import fuzzy, geometry, mrz, payloads
from attestry.functions import scalars as S
from attestry.operators import classify, consensus, decode, extraction, gate, generic, layout, learning, review, tables, verify, workspace
from attestry.sources import files, stores
from attestry.streaming import routing, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2026-01-01"


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(x) -> str:
    if x is None:
        return "NULL"
    return str(x).lower() if isinstance(x, bool) else repr(float(x)) if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def known(name: str, rows: list[tuple], make: Callable[[Column], Column], kind: str) -> None:
    """A query of known answers: rows of (input, expected)."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k long, input string")
        return df.select("k", "input", make(F.col("input")).cast({"VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}[kind]).alias("out"))

    QUERIES[name] = f
    values = ", ".join(f"({k}::BIGINT, {sql_text(a)}::VARCHAR, {sql_text(b)}::{kind})" for k, (a, b) in enumerate(rows))
    ORACLES[name] = f"SELECT * FROM (VALUES {values}) v(k, input, out)"


# --- scalar functions ---------------------------------------------------------------------------------

DATES = [
    ("2024-02-29", "2024-02-29"), ("2023-02-29", ""), ("03/04/2024", "2024-03-04|2024-04-03"), ("13/04/2024", "2024-04-13"), ("04.13.2024", "2024-04-13"),
    ("5 March 2023", "2023-03-05"), ("Sept. 9, 2021", "2021-09-09"), ("31 April 2020", ""), ("210412", ""), (" 1.1.1999 ", "1999-01-01"), ("01 02 2003", "2003-01-02|2003-02-01"), ("2024/1/5", "2024-01-05"), ("x", ""), ("", ""),
]
known("q_date_parse", DATES, lambda c: F.array_join(S.parse_date(c)["candidates"], "|"), "VARCHAR")
AMOUNTS = [("$1,234.50", 1234.5), ("1.234,56 EUR", 1234.56), ("(12.5)", -12.5), ("-3", -3.0), ("1,5", 1.5), ("1,234", 1234.0), ("1.2.3", 123.0), ("abc", None), ("€ 7", 7.0), ("", None), ("12,34", 12.34), ("0.12345", 0.1235)]
known("q_amount_parse", AMOUNTS, lambda c: S.parse_amount(c)["value"], "DOUBLE")
known("q_amount_currency", [("$5", "USD"), ("₹5", "INR"), ("5 EUR", "EUR"), ("£1", "GBP"), ("7", "USD"), ("chf 3", "CHF"), ("none", None)], lambda c: S.parse_amount(c)["currency"], "VARCHAR")
known("q_closure_amount", [("1,5", 15.0), ("1,234", 1234.0), ("1.234,56", 1234.56), ("(100.00)", -100.0), ("$ 12.30", 12.3), ("x", None), ("1.2.3", None)], S.closure_amount, "DOUBLE")
known("q_infer_type", [("a@b.co", "email"), ("2024-01-31", "date"), ("$12.00", "amount"), ("+1 (555) 010-9999", "phone"), ("AB-12345", "id_number"), ("plain words", "text")], S.infer_value_type, "VARCHAR")
known("q_slugs", [("Total Due:", "total_due"), ("__A--b__", "a_b"), ("名前", "field"), ("", "field")], S.slug, "VARCHAR")
known("q_label_fold", [("Größe", "grosse"), ("Prénom / Nom", "prenom nom"), ("  A.B  ", "a b")], S.normalize_label_text, "VARCHAR")
known("q_bilingual_label", [("名前 / Full Name:", "Full Name"), ("Date / Datum", "Datum"), ("Surname", "Surname")], S.clean_label_text, "VARCHAR")
known("q_inline_label", [("Total: 12", "Total=12"), ("no colon", None), ("A: x", None), ("Name : Bob Ray", "Name=Bob Ray")], lambda c: S.let(S.split_inline_label(c), lambda p: F.when(p.isNotNull(), F.concat(p["label"], F.lit("="), p["value"]))), "VARCHAR")
known("q_family_name", [("bank_statement", "Bank Statement"), ("", "Documents"), ("id-card v2", "Id Card V2")], S.family_name, "VARCHAR")
known("q_string_hash", [("", "0"), ("a", "61"), ("hello", "5e918d2"), ("hello world", "6aefe2c4")], S.string_hash_hex, "VARCHAR")
known("q_plausible_dates", [("03/04/2024", "2024-04-03|2024-03-04"), ("24 02 2021", ""), ("2021-02-30", ""), ("x 31.12.1999 y", "1999-12-31")], lambda c: F.array_join(S.plausible_iso_dates(c), "|"), "VARCHAR")
known("q_mrz_line", [("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", True), ("PLAIN TEXT WITHOUT FILLERS 123", False), ("L898902C36UTO7408122F1204159ZE184226B<<<<<10", True)], mrz.is_zone_line, "BOOLEAN")
known("q_cell_reference", [("A1", "0:0"), ("BC12", "11:54"), ("Z9", "8:25")], lambda c: F.concat_ws(":", stores.cell_place(c)["r"], stores.cell_place(c)["c"]), "VARCHAR")

SUMS = [
    ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "GB82 WEST 1234 5698 7654 33", False),
    ("verhoeff", "2363", True), ("verhoeff", "2364", False), ("isbn10", "0-306-40615-2", True), ("isbn10", "080442957X", True), ("isbn10", "0804429570", False), ("nhs", "943 476 5919", True), ("nhs", "943 476 5918", False),
    ("imo", "IMO 9074729", True), ("imo", "9074728", False), ("ean13", "4006381333931", True), ("ean8", "73513537", True), ("upc_a", "036000291452", True), ("upc_a", "036000291453", False), ("vin", "1M8GDM9AXKP042788", True),
    ("vin", "1M8GDM9A1KP042788", False), ("isin", "US0378331005", True), ("isin", "US0378331006", False), ("gstin", "27AAPFU0939F1ZV", True), ("gstin", "27AAPFU0939F1ZW", False), ("pan", "AAAPL1234C", True), ("pan", "AAAXL1234C", False), ("ssn", "123-45-6789", True), ("ssn", "666-45-6789", False), ("ssn", "123-00-6789", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({sql_text(a)}, {sql_text(b)}, {sql_text(c)})" for a, b, c in SUMS) + ") v(kind, value, ok)")
def q_checksum_vectors(spark, sf_dir):
    rows = spark.createDataFrame([(a, b) for a, b, _ in SUMS], "kind string, value string")
    ok = F.coalesce(*(F.when(F.col("kind") == k, f(F.col("value"))) for k, f in C.PREDICATES.items()))
    return rows.select("kind", "value", ok.alias("ok"))


PAYLOADS = [
    ("BCD\n002\n1\nSCT\nBIC\nRed Cross\nBE72000000001616\nEUR12.30\n\nRef1", "epc-qr", "iban=BE72000000001616;payee_name=Red Cross;payment_reference=Ref1;total=12.30"),
    ("upi://pay?pa=a%40b&pn=Foo%20Bar&am=12.00", "upi-qr", "payee_name=Foo Bar;total=12.00;upi_id=a@b"),
    ("(01)09506000134352(17)251231(10)AB12", "gs1", "date_of_expiry=2025-12-31;gtin=09506000134352;lot_number=AB12"),
    ("]C10109506000134352172512001099\x1d21XYZ", "gs1", "gtin=09506000134352;lot_number=99;serial_number=XYZ"),
    ("M1DESMARAIS/LUC       EABC123 YULFRAAC 0834 226F001A0025 100", "bcbp", "booking_reference=ABC123;destination=FRA;flight_number=AC834;full_name=LUC DESMARAIS;given_names=LUC;origin=YUL;seat=1A;surname=DESMARAIS"),
    ("@\n\x1e\rANSI 636000090002DL00410278ZV03190008DLDAQT64235789\nDCSSAMPLE\nDACMICHAEL\nDBB06061986\nDBC1\n", "aamva", "date_of_birth=1986-06-06;document_number=T64235789;full_name=MICHAEL SAMPLE;given_names=MICHAEL;license_number=T64235789;sex=M;surname=SAMPLE"),
    ("nothing known", None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {sql_text(g)}::VARCHAR, {sql_text(f)}::VARCHAR)" for k, (_, g, f) in enumerate(PAYLOADS)) + ") v(k, grammar, facts)")
def q_payload_facts(spark, sf_dir):
    rows = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PAYLOADS)], "k long, p string").select("k", payloads.read_payload(F.col("p")).alias("r"))
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("r.facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select("k", F.col("r.grammar").alias("grammar"), F.when(F.col("r").isNotNull(), facts).alias("facts"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{13,19}\b')) AS value FROM documents),
c AS (SELECT doc_id, value, row_number() OVER () AS i FROM d),
g AS (SELECT i, unnest(range(1, len(value) + 1)) AS k, len(value) AS n, value FROM c),
x AS (SELECT i, sum(CASE WHEN (n - k) % 2 = 1 THEN CASE WHEN 2 * substr(value, k, 1)::INT > 9 THEN 2 * substr(value, k, 1)::INT - 9 ELSE 2 * substr(value, k, 1)::INT END ELSE substr(value, k, 1)::INT END) % 10 = 0 AS ok FROM g GROUP BY i)
SELECT doc_id, value, CASE WHEN ok THEN 'proves' ELSE 'contradicts' END AS verdict, CASE WHEN ok THEN 'confirmed' ELSE 'refused' END AS status FROM c JOIN x USING (i)""")
def q_card_attest(spark, sf_dir):
    """Card numbers of the documents: candidates, the Luhn attestor's verdict, and the status that follows."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{13,19}\b"), F.lit(0))).alias("value"))
    spec = next(s for s in consensus.CHECKSUMS if s[0] == "checksum.luhn-card")
    verdict = consensus.checksum_verdict(spec, F.lit("card_number"), F.col("value"), F.array().cast("array<string>"))
    rows = found.withColumn("verdict", verdict)
    return rows.withColumn("status", consensus.status_of(F.col("verdict") == "proves", F.col("verdict") == "contradicts"))


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS value FROM documents)
SELECT doc_id, value, regexp_full_match(value, '[^\s@]+@[^\s@]+\.[^\s@]+') AS ok FROM e""")
def q_emails(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("value"))
    return found.withColumn("ok", S.is_valid_email(F.col("value")))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS value, 'USD' AS currency, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders")
def q_printed_orders(spark, sf_dir):
    """Prices and dates of the orders, printed and read back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return rows.select("o_orderkey", S.parse_amount(F.col("price"))["value"].alias("value"), S.parse_amount(F.col("price"))["currency"].alias("currency"), S.parse_date(F.col("day"))["ambiguous"].alias("ambiguous"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS sim FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def q_name_similarity(spark, sf_dir):
    return fuzzy.similar_pairs(table(spark, sf_dir, "part"), ["p_type", "p_size"], "p_partkey", "p_name")


# --- consensus ----------------------------------------------------------------------------------------


def order_candidates(spark, sf_dir) -> DataFrame:
    """Each order as an invoice: subtotal and tax from its lines, and as its total the sum, or for every third order the stored price."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("subtotal"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"))
    rows = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("total", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(F.col("subtotal") + F.col("tax")))
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("canonical_label"), F.format_number(name, 2).alias("value")) for k, name in enumerate(("subtotal", "tax", "total"))))).alias("p")
    flat = rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), parts).select("doc_id", "p.*")
    return flat.select("doc_id", F.concat_ws("/", "doc_id", "canonical_label").alias("id"), "ord", "canonical_label", F.lit("amount").alias("value_type"), "value", F.lit("ocr").alias("channel"), F.array().cast("array<string>").alias("marks"))


INVOICES = """
WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS subtotal, round(sum(l_extendedprice * l_tax), 2) AS tax FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, subtotal, tax, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE subtotal + tax END, 2) AS total FROM l JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT *, abs(subtotal + tax - total) AS gap, greatest(0.01, 0.005 * greatest(subtotal, tax, total, 0.01)) AS slack FROM t)"""


@query(INVOICES + " SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN gap <= slack THEN 'proves' ELSE 'contradicts' END AS verdict, count(*)::BIGINT AS n FROM e, range(3) GROUP BY ALL")
def q_amount_closure(spark, sf_dir):
    told = consensus.attest_closure(order_candidates(spark, sf_dir))
    return told.groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))


@query(INVOICES + " SELECT CASE WHEN gap <= slack THEN 'confirmed' ELSE 'refused' END AS status, count(*)::BIGINT AS n FROM e, range(3) GROUP BY ALL")
def q_outcomes(spark, sf_dir):
    """All attestors over the invoices, folded to a status for each candidate."""
    rows = order_candidates(spark, sf_dir)
    folded = consensus.outcomes(rows, consensus.attest_all(rows, NOW))
    return folded.select(consensus.status_of(F.col("proven"), F.col("contradicted")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(INVOICES + " SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN gap <= slack THEN 'confirmed' ELSE 'refused' END AS status FROM e")
def q_solved_totals(spark, sf_dir):
    """The total of each invoice after assignment: confirmed by proof, or refused."""
    solved = consensus.solve(order_candidates(spark, sf_dir), NOW, ["subtotal", "tax", "total"])
    return solved.filter("label = 'total'").select("doc_id", "status")


@query(INVOICES + " SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN gap <= slack THEN 'confirmed' ELSE 'needs_review' END AS status, CASE WHEN gap <= slack THEN CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE 'promoted' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'downgraded' ELSE 'kept' END END AS change FROM e WHERE gap <= 0.01 OR gap > slack")
def q_bridge(spark, sf_dir):
    """Stored statuses against the proofs: odd orders were in review, even ones confirmed."""
    rows = order_candidates(spark, sf_dir)
    told = consensus.attest_all(rows, NOW)
    exact = told.filter("attestor_id = 'closure.amount' and strength <> 0.9").select("doc_id").distinct()
    stored = rows.filter("canonical_label = 'total'").join(exact, "doc_id", "left_semi").select("doc_id", "id", F.when(F.col("doc_id").cast("long") % 2 == 0, "confirmed").otherwise("needs_review").alias("status"), F.lit(None).cast("string").alias("review_cap"), F.lit(False).alias("user_edited"), F.lit(0.5).alias("confidence"))
    return consensus.bridge(stored, consensus.outcomes(rows, told), told).select("doc_id", "status", "change")


@query("SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN day(o_orderdate) <= 12 AND o_orderkey % 2 = 0 AND day(o_orderdate) <> month(o_orderdate) THEN 'proves' WHEN o_orderkey % 2 = 0 THEN 'proves' ELSE 'contradicts' END AS verdict FROM orders")
def q_cross_dates(spark, sf_dir):
    """The order date over two channels: printed day first, and native; shifted by 400 days on odd orders."""
    rows = table(spark, sf_dir, "orders")
    native = F.date_format(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 400 days")), "yyyy-MM-dd")
    both = rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.explode(F.array(F.struct(F.lit("a").alias("id"), F.lit(0).alias("ord"), F.lit("ocr").alias("channel"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("value")), F.struct(F.lit("b").alias("id"), F.lit(1).alias("ord"), F.lit("native").alias("channel"), native.alias("value")))).alias("x")).select("doc_id", "x.*")
    both = both.withColumns({"canonical_label": F.lit("invoice_date"), "value_type": F.lit("date"), "marks": F.array().cast("array<string>")})
    return consensus.attest_cross_dates(both).filter("candidate_id = 'a'").select("doc_id", "verdict")


# --- classification, learning, decoding -----------------------------------------------------------------

_SCORES = ", ".join(f"{' + '.join(f'''(contains(t, {sql_text(k)}))::INT''' for k in keys)} AS {kind}" for kind, keys in classify.KEYWORDS.items())
_LIST = ", ".join(f"{{'s': {k}, 'i': {-i}, 'k': '{k}'}}" for i, k in enumerate(classify.KEYWORDS))


@query(f"""
WITH x AS (SELECT item_id, lower(text) || ' invoice ' || CASE WHEN item_id % 2 = 0 THEN 'bill to' ELSE '' END AS t FROM benchmark),
s AS (SELECT item_id, {_SCORES} FROM x),
r AS (SELECT item_id, list_reverse_sort([{_LIST}]) AS l FROM s)
SELECT item_id, CASE WHEN l[1].s < 2 THEN 'generic' ELSE l[1].k END AS doc_type, round(CASE WHEN l[1].s < 2 THEN 0.4 ELSE least(1.0, l[1].s / (l[1].s + l[2].s + 1)) END, 6) AS confidence FROM r""")
def q_classify(spark, sf_dir):
    """Types of the benchmark texts, with one or two invoice keywords added."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" Invoice "), F.when(F.col("item_id") % 2 == 0, "Bill to").otherwise("")).alias("t"))
    out = classify.classify(rows, F.col("t"), F.lit(False))
    return out.select("item_id", F.col("doc_type"), F.round("type_confidence", 6).alias("confidence"))


def misread(spark, sf_dir) -> DataFrame:
    """Customer names as proven values, and reads in which 0 looks like O and, every seventh time, 1 like I."""
    rows = table(spark, sf_dir, "customer").select(F.right("c_name", F.lit(4)).alias("proven"), "c_custkey")
    return rows.select("proven", F.when(F.col("c_custkey") % 7 == 0, F.translate("proven", "01", "OI")).otherwise(F.translate("proven", "0", "O")).alias("raw"))


CONFUSED = """
WITH m AS (SELECT right(c_name, 4) AS proven, CASE WHEN c_custkey % 7 = 0 THEN translate(right(c_name, 4), '01', 'OI') ELSE translate(right(c_name, 4), '0', 'O') END AS raw FROM customer),
p AS (SELECT raw, proven, unnest(range(1, 5)) AS i FROM m),
f AS (SELECT raw, proven, upper(substr(raw, i, 1)) AS seen, upper(substr(proven, i, 1)) AS truth FROM p),
k AS (SELECT *, count(*) FILTER (seen <> truth) OVER (PARTITION BY raw, proven) AS d FROM f),
c AS (SELECT seen, truth, count(*)::BIGINT AS n FROM k WHERE seen <> truth AND d <= 3 GROUP BY ALL)"""


@query(CONFUSED.replace("count(*) FILTER (seen <> truth) OVER (PARTITION BY raw, proven)", "list_sum([(substr(raw, j, 1) <> substr(proven, j, 1))::INT FOR j IN range(1, 5)])") + " SELECT * FROM c")
def q_confusion_counts(spark, sf_dir):
    return learning.confusion_counts(misread(spark, sf_dir))


_C = CONFUSED.replace("count(*) FILTER (seen <> truth) OVER (PARTITION BY raw, proven)", "list_sum([(substr(raw, j, 1) <> substr(proven, j, 1))::INT FOR j IN range(1, 5)])")


@query(_C + """,
a(seen, truth) AS (VALUES ('O', '0'), ('O', 'O'), ('I', '1'), ('X', 'Y')),
s AS (SELECT a.seen, a.truth, coalesce((SELECT sum(n) FROM c WHERE c.seen = a.seen), 0) AS mass, coalesce((SELECT n FROM c WHERE c.seen = a.seen AND c.truth = a.truth), 0) AS n,
  (SELECT count(*) FROM (SELECT truth FROM c WHERE c.seen = a.seen UNION SELECT a.seen UNION SELECT a.truth)) AS kinds FROM a)
SELECT seen, truth, round((n + 1 + (seen = truth)::INT) / (mass + kinds + 1), 9) AS p FROM s""")
def q_confusion_probability(spark, sf_dir):
    asked = spark.createDataFrame([("o", "0"), ("O", "O"), ("I", "1"), ("X", "Y")], "seen string, truth string")
    out = learning.confusion_probability(learning.confusion_counts(misread(spark, sf_dir)), asked)
    return out.withColumn("p", F.round("p", 9))


@query(_C + " SELECT seen, truth, round(n / sum(n) OVER (PARTITION BY seen), 9) AS p, row_number() OVER (PARTITION BY seen ORDER BY n DESC, truth)::INT AS rank FROM c QUALIFY rank <= 3 AND sum(n) OVER (PARTITION BY seen) >= 3")
def q_plausible_truths(spark, sf_dir):
    return learning.plausible_truths(learning.confusion_counts(misread(spark, sf_dir))).withColumn("p", F.round("p", 9))


@query("SELECT p_partkey, replace(p_brand, '#', '') AS text, round(0.9, 6) AS confidence FROM part")
def q_ctc_greedy(spark, sf_dir):
    """Brands as lattices (each character twice, a blank between) and back."""
    ch = F.filter(F.split(F.replace("p_brand", F.lit("#"), F.lit("")), ""), lambda x: x != "")
    step = lambda c, p: F.array(F.struct(c.alias("ch"), F.lit(p).alias("p")), F.struct(F.lit("?").alias("ch"), F.lit(1 - p).alias("p")))
    lattice = F.flatten(F.transform(ch, lambda c: F.array(step(c, 0.9), step(c, 0.8), step(F.lit(""), 0.7))))
    rows = table(spark, sf_dir, "part").select("p_partkey", decode.greedy(lattice).alias("g"))
    return rows.select("p_partkey", "g.text", F.round("g.confidence", 6).alias("confidence"))


# --- workspace ------------------------------------------------------------------------------------------


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def q_exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return workspace.content_classes(docs, F.coalesce("text", F.lit("")), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id > first")
def q_known_duplicates(spark, sf_dir):
    """The first document of every text is known; all others come in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    known = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return workspace.known_duplicates(docs.join(known, ["sha256", "doc_id"], "left_anti"), known).select("doc_id")


@query("""
WITH h AS (SELECT vec_id, label, [(x >= 0)::INT FOR x IN embedding[1:64]] AS b FROM embeddings),
d AS (SELECT b, label, min(vec_id) AS id FROM h GROUP BY b, label)
SELECT x.label::VARCHAR AS family_id, x.id AS a, y.id AS b, list_sum([abs(p[1] - p[2]) FOR p IN list_zip(x.b, y.b)])::INT AS distance
FROM d x JOIN d y ON x.label = y.label AND x.id < y.id WHERE list_sum([abs(p[1] - p[2]) FOR p IN list_zip(x.b, y.b)]) <= 8""")
def q_near_duplicates(spark, sf_dir):
    """Sign bits of the embeddings as 64-bit hashes: pairs within 8 bits, by label, of the first ids of equal hashes."""
    return workspace.near_duplicates(sign_hashes(spark, sf_dir))


@query("""
WITH h AS (SELECT vec_id, label, [(x >= 0)::INT FOR x IN embedding[1:64]] AS b FROM embeddings),
d AS (SELECT b, label, min(vec_id) AS id, count(*) AS copies FROM h GROUP BY b, label),
l AS (SELECT x.id, sum(y.copies) AS n FROM d x JOIN d y ON x.label = y.label AND list_sum([abs(p[1] - p[2]) FOR p IN list_zip(x.b, y.b)]) <= 8 GROUP BY x.id)
SELECT h.label::VARCHAR AS family_id, h.vec_id AS id, d.id AS representative, d.copies::BIGINT AS copies, (l.n - 1)::BIGINT AS n_links
FROM h JOIN d ON h.label = d.label AND h.b = d.b JOIN l ON l.id = d.id""")
def q_near_duplicate_members(spark, sf_dir):
    """Every embedding with the first id of its sign bits and the number of others within 8 bits, by label."""
    return workspace.near_duplicate_members(sign_hashes(spark, sf_dir))


def sign_hashes(spark, sf_dir) -> DataFrame:
    bit = F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x >= 0, "1").otherwise("0"))
    half = lambda a, b: F.lpad(F.lower(F.conv(F.array_join(F.slice("bits", a, b), ""), 2, 16)), 8, "0")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("family_id"), F.col("vec_id").alias("id"), bit.alias("bits"))
    return rows.select("family_id", "id", F.concat(half(1, 32), half(33, 32)).alias("phash"))


@query("SELECT lower(replace(p_type, ' ', '_')) AS field_id, min(p_partkey) AS first FROM part GROUP BY 1")
def q_first_wins(spark, sf_dir):
    """Part types as labels of one document: the first hypothesis of each field id."""
    rows = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("label"), F.lit(None).cast("string").alias("canonical_label"), F.lit("text").alias("value_type"), F.col("p_name").alias("value"), F.lit("needs_review").alias("status"), F.lit(False).alias("rejected"), F.lit(False).alias("required"), F.lit(0.5).alias("confidence"))
    return workspace.form_fields(rows).select("field_id", F.col("ord").alias("first"))


@query("""
WITH a AS (SELECT c_nationkey::VARCHAR AS family_id, c_mktsegment AS field_id, min(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY k) - 1 AS ord FROM a),
b AS (SELECT c_nationkey::VARCHAR AS family_id, c_mktsegment AS field_id, min(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL),
n AS (SELECT b.* FROM b LEFT JOIN a USING (family_id, field_id) WHERE a.k IS NULL),
m AS (SELECT family_id, field_id, coalesce((SELECT max(ord) FROM x WHERE x.family_id = n.family_id), -1) + row_number() OVER (PARTITION BY family_id ORDER BY k) AS ord FROM n)
SELECT family_id, ord::INT AS ord, field_id FROM x UNION ALL SELECT family_id, ord::INT, field_id FROM m""")
def q_schema_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("family_id"), F.col("c_mktsegment").alias("field_id"), (F.col("c_custkey") % 2).alias("odd")).agg(F.min("c_custkey").alias("k"))
    order = F.row_number().over(W.partitionBy("family_id").orderBy("k")) - 1
    old, new = (rows.filter(f"odd = {o}").select("family_id", "field_id", F.col("field_id").alias("label"), order.alias("ord")) for o in (0, 1))
    return workspace.merge_schema(old, new).select("family_id", "ord", "field_id")


@query("SELECT event_id, round(avg(value) OVER w * count(*) OVER w, 2) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_rolling_means(spark, sf_dir):
    out = workspace.rolling_means(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], {"mean": "value"})
    return out.select("event_id", F.round(F.col("mean") * F.col("n_so_far"), 2).alias("total"), F.col("n_so_far").alias("n"))


@query("""
WITH q AS (SELECT l_orderkey::VARCHAR AS doc_id, lpad(l_linenumber::VARCHAR, 3, '0') AS field_id, l_returnflag = 'A' AS critical, l_linestatus = 'O' AS required, l_discount AS confidence, l_returnflag = 'R' AS clash FROM lineitem WHERE l_tax > 0),
p AS (SELECT *, CASE WHEN critical THEN 3 WHEN required THEN 2 ELSE 1 END * 100 + CASE WHEN clash THEN 50 ELSE 0 END + (1 - confidence) * 40 AS priority FROM q)
SELECT doc_id, field_id, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, field_id)::INT AS rank, CASE WHEN clash THEN 'conflict' ELSE 'low_confidence' END AS kind, round(priority, 6) AS priority FROM p QUALIFY rank <= 3""")
def q_question_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("field_id"),
        F.when(F.col("l_tax") <= 0, "confirmed").when(F.col("l_returnflag") == "R", "conflict").otherwise("needs_review").alias("status"), F.col("l_discount").alias("confidence"),
        (F.col("l_returnflag") == "A").alias("critical"), (F.col("l_linestatus") == "O").alias("required"), F.lit(True).alias("is_column"), F.lit(2).alias("n_candidates"),
    )
    return workspace.rank_questions(rows).select("doc_id", "field_id", "rank", "kind", F.round("priority", 6).alias("priority"))


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("total").alias("label"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("needs_review").alias("status"), (F.col("o_orderkey") % 10).alias("k"))
    late = rows.filter("k <> 1").withColumn("value", F.when(F.col("k") == 2, "0.00").otherwise(F.col("value"))).withColumn("status", F.when(F.col("k") == 3, "confirmed").when(F.col("k") == 4, "needs_review").otherwise(F.col("status")))
    return rows.filter("k <> 5").drop("k"), late.drop("k")


DIFF = """
WITH d AS (SELECT o_orderkey::VARCHAR AS doc_id, 'total' AS label, o_orderkey % 10 AS k, o_orderstatus = 'F' AS sure FROM orders),
x AS (SELECT doc_id, label, CASE WHEN k = 5 THEN 'new_field' WHEN sure AND k = 1 THEN 'field_lost' WHEN sure AND k = 2 THEN 'value_changed' WHEN sure AND k = 4 THEN 'status_downgraded' WHEN NOT sure AND k = 3 THEN 'status_upgraded' END AS kind FROM d)"""


@query(DIFF + " SELECT *, CASE WHEN kind IN ('new_field', 'status_upgraded') THEN 'improvement' ELSE 'regression' END AS side FROM x WHERE kind IS NOT NULL")
def q_replay_diff(spark, sf_dir):
    return workspace.diff_fields(*snapshots(spark, sf_dir))


@query(DIFF + " SELECT 'regressed' AS verdict, count(*) FILTER (kind NOT IN ('new_field', 'status_upgraded'))::BIGINT AS regressions, count(*) FILTER (kind IN ('new_field', 'status_upgraded'))::BIGINT AS improvements FROM x WHERE kind IS NOT NULL")
def q_replay_verdict(spark, sf_dir):
    return workspace.replay_verdict(workspace.diff_fields(*snapshots(spark, sf_dir)))


@query("""SELECT c_custkey || ',' || c_name || ',' || CASE WHEN c_custkey % 2 = 0 THEN '"a ""b"", c"' ELSE c_mktsegment END AS line FROM customer""")
def q_csv_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("note", F.when(F.col("c_custkey") % 2 == 0, 'a "b", c').otherwise(F.col("c_mktsegment")))
    return workspace.csv_lines(rows, [F.col("c_custkey"), F.col("c_name"), F.col("note")])


def records(spark, sf_dir) -> DataFrame:
    """Customers as records of two fields."""
    value = lambda c, status: F.struct(c.cast("string").alias("value"), status.alias("status"), F.lit(0.5).alias("confidence"))
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").cast("string").alias("family_id"), F.create_map(F.lit("name"), value(F.col("c_name"), F.lit("confirmed")), F.lit("segment"), value(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "conflict").otherwise("confirmed"))).alias("values"))


@query("SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'segment' ELSE '' END AS open, CASE WHEN c_custkey % 6 = 0 THEN 'FIXED' ELSE c_mktsegment END AS segment FROM customer")
def q_edits(spark, sf_dir):
    """Records after user edits: two of each sixth record's segment, the later one counts."""
    rows = records(spark, sf_dir)
    edits = rows.filter("record_id % 6 = 0").select("record_id", F.lit("segment").alias("field_id"), F.explode(F.array(F.struct(F.lit("OLD").alias("value"), F.lit(1).alias("at")), F.struct(F.lit("FIXED").alias("value"), F.lit(2).alias("at")))).alias("e")).select("record_id", "field_id", "e.*")
    out = workspace.apply_edits(rows, edits)
    return out.select("record_id", F.array_join(workspace.open_fields(F.col("values")), ",").alias("open"), F.col("values")["segment"]["value"].alias("segment"))


@query("SELECT c_nationkey::VARCHAR AS family_id, count(*)::BIGINT AS records, '1.0' AS engine_version, '2026-01-01' AS exported_at FROM customer GROUP BY 1")
def q_manifest(spark, sf_dir):
    return workspace.manifest(records(spark, sf_dir), "1.0", NOW)


@query("SELECT o_custkey AS k, max_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q_latest(spark, sf_dir):
    return workspace.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], "o_orderkey")


# --- layout and tables ----------------------------------------------------------------------------------


def page_items(spark, sf_dir) -> DataFrame:
    """The lines of each order as boxes on a page: three columns, a row for each line."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    y = F.col("r") * 0.04
    cell = lambda k, text: F.struct(F.lit(k).alias("k"), text.cast("string").alias("text"), F.lit(0.1 + 0.3 * k).alias("x1"), F.lit(0.3 + 0.3 * k).alias("x2"))
    lines = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(order))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), "r", y.alias("y1"), (y + 0.025).alias("y2"), F.explode(F.array(cell(0, F.col("l_returnflag")), cell(1, F.col("l_quantity")), cell(2, F.col("l_partkey")))).alias("c"))
    return rows.select("doc_id", F.lit(1).alias("page"), F.concat_ws("-", F.lpad(F.col("r").cast("string"), 2, "0"), "c.k").alias("node_id"), "c.text", F.lit(0.9).alias("confidence"), "c.x1", "y1", "c.x2", "y2", F.lit(None).cast("string").alias("region_id"), F.col("r").alias("row"), F.col("c.k").alias("col"))


ITEMS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
i AS (SELECT l_orderkey::VARCHAR AS doc_id, r, c, CASE c WHEN 0 THEN l_returnflag WHEN 1 THEN l_quantity::VARCHAR ELSE l_partkey::VARCHAR END AS text, lpad(r::VARCHAR, 2, '0') || '-' || c AS node_id FROM n, range(3) t(c))"""


#: Rows by whole numbers alone; a label (column 0) reaches the cells of columns 1 and 2 whose row is its own.
PLACES = """
WITH n AS MATERIALIZED (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
v AS MATERIALIZED (SELECT k, r, 1 AS c FROM n UNION ALL SELECT k, r, 2 FROM n)
SELECT n.k::VARCHAR AS doc_id, lpad(n.r::VARCHAR, 2, '0') || '-0' AS label_id, lpad(v.r::VARCHAR, 2, '0') || '-' || v.c AS value_id"""


@query(PLACES + ", 'same_row_right' AS relation FROM n JOIN v ON n.k = v.k AND n.r = v.r")
def q_label_values(spark, sf_dir):
    items = page_items(spark, sf_dir)
    return layout.label_values(items.filter("col = 0"), items.filter("col > 0")).select("doc_id", "label_id", "value_id", "relation")


@query(PLACES + " FROM n JOIN v ON n.k = v.k AND n.r = v.r WHERE v.c = 1")
def q_nearest_values(spark, sf_dir):
    items = page_items(spark, sf_dir)
    return layout.nearest_values(layout.label_values(items.filter("col = 0"), items.filter("col > 0"))).select("doc_id", "label_id", "value_id")


@query("SELECT c_custkey::VARCHAR AS doc_id, 1 AS page, c_mktsegment = 'FURNITURE' OR (c_custkey >= 1000 AND c_acctbal >= 0) AS admitted FROM customer")
def q_page_admission(spark, sf_dir):
    """Pages of a name, a segment and two numbers, short ones being stamp debris; some have a caption, some are tilted every way."""
    caption = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("Segment:"))
    texts = F.array("c_name", "c_mktsegment", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), caption)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), "c_acctbal", F.posexplode(texts).alias("node_id", "text"))
    angle = F.when(F.col("c_acctbal") < 0, 20 * (F.col("node_id") + 1)).otherwise(0)
    box = {c: F.lit(0.5) for c in ("confidence", "x1", "y1", "x2", "y2")}
    return generic.admitted_pages(rows.withColumns({**box, "confidence": F.lit(0.9), "region_id": F.lit(None), "angle": angle}).drop("c_acctbal"))


def card_items(spark, sf_dir) -> DataFrame:
    """Each customer as a card: a number beside its caption, an amount below its own, and lines that hold their fields."""
    key = F.col("c_custkey").cast("string")
    line = lambda k, text, x, y: F.struct(F.lit(k).alias("node_id"), text.alias("text"), F.lit(x).alias("x1"), F.lit(y).alias("y1"))
    code = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("AC-"), F.lpad(key, 12, "0")))  # cards in debt have none
    lines = [line("a", F.lit("Account Code"), 0.1, 0.1), line("b", code, 0.32, 0.1), line("c", F.lit("Balance / Saldo"), 0.1, 0.3), line("d", F.concat(F.lit("$"), key, F.lit(".50")), 0.1, 0.33), line("e", F.concat(F.lit("Nation: "), F.lit("NATION NUMBER "), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "ABCDEFGHIJ")), 0.1, 0.6), line("f", F.concat(F.lit("Phone +1 555 "), F.lpad(key, 8, "0")), 0.1, 0.7)]
    rows = table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.explode(F.array(*lines)).alias("l")).select("doc_id", F.lit(1).alias("page"), "l.*")
    return rows.select("*", (F.col("x1") + 0.2).alias("x2"), (F.col("y1") + 0.02).alias("y2"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("region_id"))


@query("""
SELECT c_custkey::VARCHAR AS doc_id, f.canonical_label, f.value_type, f.value FROM customer, unnest([
  {'canonical_label': 'account_code', 'value_type': 'id_number', 'value': CASE WHEN c_acctbal >= 0 THEN 'AC-' || lpad(c_custkey::VARCHAR, 12, '0') END},
  {'canonical_label': 'balance', 'value_type': 'amount', 'value': '$' || c_custkey || '.50'},
  {'canonical_label': 'nation', 'value_type': 'text', 'value': 'NATION NUMBER ' || translate(c_nationkey::VARCHAR, '0123456789', 'ABCDEFGHIJ')},
  {'canonical_label': 'phone', 'value_type': 'phone', 'value': '+1 555 ' || lpad(c_custkey::VARCHAR, 8, '0')}]) u(f) WHERE f.value IS NOT NULL""")
def q_generic_fields(spark, sf_dir):
    return generic.generic_fields(card_items(spark, sf_dir)).select("doc_id", "canonical_label", "value_type", "value")


@query(ITEMS + " SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, c)::INT AS ord FROM i")
def q_reading_order(spark, sf_dir):
    return layout.reading_order(page_items(spark, sf_dir)).select("doc_id", "node_id", "ord")


@query(ITEMS + " SELECT doc_id, string_agg(text, ' ' ORDER BY r) AS text FROM i WHERE c = 0 GROUP BY doc_id")
def q_region_texts(spark, sf_dir):
    items = page_items(spark, sf_dir)
    regions = items.select("doc_id", "page").distinct().withColumns({"region": F.lit("left"), "x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(0.35), "y2": F.lit(1.0)})
    return layout.region_texts(regions, items).select("doc_id", "text")


@query(ITEMS + " SELECT doc_id, (r - 1)::BIGINT AS r, c::INT AS c, text FROM i WHERE c < 2 AND doc_id IN (SELECT doc_id FROM i GROUP BY doc_id HAVING max(r) >= 3)")
def q_aligned_cells(spark, sf_dir):
    cells = layout.aligned_cells(page_items(spark, sf_dir)).filter("c < 2")
    return cells.select("doc_id", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), "text")


@query("SELECT p_partkey, (dense_rank() OVER (PARTITION BY p_brand ORDER BY g) - 1)::BIGINT AS cluster FROM (SELECT *, sum(o) OVER (PARTITION BY p_brand ORDER BY p_size RANGE UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce((p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) > 3)::INT, 0) AS o FROM part))")
def q_clusters(spark, sf_dir):
    return layout.clusters(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 3.0).select("p_partkey", "cluster")


@query("""
WITH i AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
x AS (SELECT vec_id, least(a, b) AS x1, greatest(a, b) + 0.5 AS x2, least(c, d) AS y1, greatest(c, d) + 0.5 AS y2 FROM i),
s AS (SELECT vec_id, greatest(least(x2, 0.5) - greatest(x1, -0.5), 0) * greatest(least(y2, 0.5) - greatest(y1, -0.5), 0) AS m, (x2 - x1) * (y2 - y1) AS own FROM x)
SELECT vec_id, round(m / (own + 1 - m), 4) AS iou, round(m / 1.0, 4) AS covered FROM s""")
def q_box_overlap(spark, sf_dir):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    mine = geometry.box(F.least(e[0], e[1]), F.least(e[2], e[3]), F.greatest(e[0], e[1]) + 0.5, F.greatest(e[2], e[3]) + 0.5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mine.alias("a"), geometry.box(-0.5, -0.5, 0.5, 0.5).alias("b"))
    return rows.select("vec_id", F.round(geometry.iou(F.col("a"), F.col("b")), 4).alias("iou"), F.round(geometry.covered(F.col("a"), F.col("b")), 4).alias("covered"))


def order_cells(spark, sf_dir) -> DataFrame:
    """Orders as tables: quantity, unit price, line price; under the line prices their sum, wrong on every fourth order."""
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", unit.alias("unit"), F.round(F.col("l_quantity") * unit, 2).alias("price"))
    row = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    lines = lines.withColumn("r", row)
    text = lambda c: F.format_number(c, 2)
    body = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), "r", F.explode(F.array(*(F.struct(F.lit(k).alias("c"), text(c).alias("raw")) for k, c in enumerate(("l_quantity", "unit", "price"))))).alias("x")).select("doc_id", "r", "x.*")
    total = lines.groupBy("l_orderkey").agg(F.sum("price").alias("t"), (F.max("r") + 1).alias("r"))
    foot = total.select(F.col("l_orderkey").cast("string").alias("doc_id"), "r", F.lit(2).alias("c"), text(F.when(F.col("l_orderkey") % 4 == 0, F.col("t") * 1.5 + 1).otherwise(F.col("t"))).alias("raw"))
    return body.unionByName(foot).withColumn("alternates", F.array().cast("array<string>"))


LINES = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice / l_quantity, 2) AS unit FROM lineitem),
p AS (SELECT *, round(l_quantity * unit, 2) AS price FROM l)"""


@query(LINES + " SELECT l_orderkey::VARCHAR AS doc_id, l_orderkey % 4 <> 0 AS holds FROM p GROUP BY l_orderkey HAVING count(*) >= 2")
def q_column_sums(spark, sf_dir):
    return tables.column_sums(order_cells(spark, sf_dir)).filter("c = 2 and result_row > 2").select("doc_id", "holds")


@query(LINES + " SELECT l_orderkey::VARCHAR AS doc_id, count(*)::BIGINT AS n, true AS holds FROM p GROUP BY l_orderkey HAVING count(*) >= 2")
def q_row_products(spark, sf_dir):
    return tables.row_products(order_cells(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("holds").alias("holds"))


def pages_of(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text"))


@query(r"WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents), k AS (SELECT doc_id, CASE WHEN length(regexp_replace(t, '[ \t\n\r\f\v]+', '', 'g')) >= 32 THEN 'digital' ELSE 'scanned' END AS kind FROM p) SELECT doc_id::VARCHAR AS doc_id, CASE WHEN count(DISTINCT kind) > 1 THEN 'hybrid' ELSE min(kind) END AS kind FROM k GROUP BY doc_id")
def q_document_kinds(spark, sf_dir):
    """Each line of a document as a page of its own."""
    return layout.document_kinds(layout.page_kinds(pages_of(spark, sf_dir)))


# --- zones, templates, gates ----------------------------------------------------------------------------


def passports(spark, sf_dir) -> DataFrame:
    """Passports of the customers, with right check digits on even keys and a wrong one on odd ones."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("L"), F.lpad((F.col("c_custkey") % 100000000).cast("string"), 8, "0")).alias("n"))
    d = C.icao_check(F.col("n")).cast("int")
    wrong = F.when(F.col("c_custkey") % 2 == 0, d).otherwise((d + 1) % 10).cast("string")
    head = F.concat("n", wrong)
    comp = F.concat(head, F.lit("7408122"), F.lit("1204159"), F.lit("ZE184226B<<<<<1"))
    second = F.concat(head, F.lit("UTO7408122F1204159ZE184226B<<<<<1"), C.icao_check(comp).cast("string"))
    zone = F.concat(F.lit("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\n"), second)
    return rows.select("c_custkey", zone.alias("zone"))


@query("""
WITH c AS (SELECT c_custkey, 'L' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') AS n FROM customer),
g AS (SELECT c_custkey, n, unnest(range(9)) AS i FROM c),
v AS (SELECT c_custkey, n, sum(CASE WHEN i = 0 THEN 21 ELSE substr(n, i + 1, 1)::INT END * [7, 3, 1][i % 3 + 1]) % 10 AS d FROM g GROUP BY ALL)
SELECT c_custkey, 'TD3' AS format, CASE WHEN c_custkey % 2 = 0 THEN 'valid' ELSE 'invalid' END AS status, n AS document_number, d::VARCHAR AS computed, 'ERIKSSON' AS surname, 'ANNA MARIA' AS given_names, '1974-08-12' AS date_of_birth FROM v""")
def q_mrz_zones(spark, sf_dir):
    read = passports(spark, sf_dir).select("c_custkey", mrz.parse_mrz(F.col("zone"), 2026).alias("m"))
    return read.select("c_custkey", "m.format", "m.status", "m.fields.document_number", F.get("m.checks", 0)["computed"].alias("computed"), "m.fields.surname", "m.fields.given_names", "m.fields.date_of_birth")


@query("""
WITH a AS (SELECT c_nationkey AS template_id, lower(trim(c_mktsegment)) AS t FROM customer GROUP BY ALL),
n AS (SELECT template_id, count(*) AS n FROM a GROUP BY 1),
i AS (SELECT DISTINCT o_custkey AS doc_id, lower(trim(c_mktsegment)) AS t FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT doc_id, template_id, count(*) AS m FROM a JOIN i USING (t) GROUP BY ALL)
SELECT doc_id::VARCHAR AS doc_id, template_id::VARCHAR AS template_id, round((m / n * 0.5 + CASE WHEN template_id % 2 = doc_id % 2 THEN 0.1 ELSE 0.05 END) / 0.6, 6) AS score FROM h JOIN n USING (template_id)""")
def q_template_scores(spark, sf_dir):
    """The orders of a customer as one document, against the segments of each nation."""
    c = table(spark, sf_dir, "customer")
    anchors = c.select(F.col("c_nationkey").cast("string").alias("template_id"), F.col("c_mktsegment").alias("anchor_id"), F.col("c_mktsegment").alias("value")).distinct()
    zones = anchors.select("template_id").distinct().withColumns({"has_mrz": F.col("template_id").cast("int") % 2 == 0, "has_table": F.lit(False)})
    items = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("text"))
    own = items.select("doc_id").distinct().withColumns({"has_mrz": F.col("doc_id").cast("int") % 2 == 0, "has_table": F.lit(False)})
    return layout.template_scores(anchors, zones, items, own).select("doc_id", "template_id", F.round("score", 6).alias("score"))


@query("SELECT label AS family, count(*)::BIGINT AS entries, count(*) FILTER (vec_id % 5 <> 0)::BIGINT AS passed, sum((vec_id % 50 = 0)::INT)::BIGINT AS silent_errors, round(count(*) FILTER (vec_id % 3 = 0 AND vec_id % 2 = 0) / greatest(count(*) FILTER (vec_id % 2 = 0), 1), 6) AS mrz_valid_rate FROM embeddings GROUP BY 1")
def q_gate_summary(spark, sf_dir):
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("family"), v.alias("entry"), F.when(v % 2 == 0, "passport").otherwise("receipt").alias("class"), (v % 5 != 0).alias("passed"), (v % 50 == 0).cast("int").alias("silent_errors"), (v % 3 == 0).alias("mrz_valid"), F.lit(1).alias("field_hits"), F.lit(2).alias("field_total"))
    return gate.summary(rows, ["family"]).select("family", "entries", "passed", F.col("silent_errors").cast("long").alias("silent_errors"), F.round("mrz_valid_rate", 6).alias("mrz_valid_rate"))


@query("SELECT label::VARCHAR AS family, (vec_id % 2)::VARCHAR AS class, count(*)::BIGINT AS entries, count(*) FILTER (vec_id % 5 <> 0)::BIGINT AS passed FROM embeddings GROUP BY ROLLUP (family, class)")
def q_gate_rollup(spark, sf_dir):
    v = F.col("vec_id")
    return gate.rolled_up(table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("family"), (v % 2).cast("string").alias("class"), (v % 5 != 0).alias("passed")))


# --- events ---------------------------------------------------------------------------------------------

KINDS = ["SHA256_MISS", "BUNDLE_READY", "TEMPLATE_SCORED", "RECORD_APPENDED", "REVIEW_RESOLVED", "DRAFT_CREATED", "FAMILY_APPROVED"]
_KIND = "CASE " + " ".join(f"WHEN event_id % 7 = {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END"
_MOVES = ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in routing.MOVES.items())


def route_events(spark, sf_dir) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.lit("f").alias("family_id"), (F.col("value") / 100).alias("score"), F.col("event_id").cast("int").alias("open_fields"))


@query(f"""
WITH RECURSIVE moves(s, e, t) AS (VALUES {_MOVES}),
ev AS (SELECT user_id::VARCHAR AS file_id, event_id, {_KIND} AS type, value / 100 AS score, event_id AS opened, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT file_id, 0::BIGINT AS i, 'hashing' AS state, 0::BIGINT AS open, 0 AS applied, 0 AS illegal FROM ev
  UNION ALL SELECT file_id, i, coalesce(t, state), CASE WHEN t = 'record_appended' THEN opened ELSE open END, applied + (t IS NOT NULL)::INT, illegal + (t IS NULL)::INT FROM
  (SELECT f.file_id, ev.i, f.state, f.open, f.applied, f.illegal, ev.opened, CASE WHEN f.state = 'identifying' AND ev.type = 'TEMPLATE_SCORED' THEN CASE WHEN score < 0.55 THEN 'discovery' WHEN score >= 0.75 THEN 'known_family' ELSE 'confirm_family' END
    WHEN f.state = 'record_appended' AND ev.type = 'REVIEW_RESOLVED' THEN CASE WHEN f.open > 0 THEN 'review_lane' ELSE 'done' END ELSE m.t END AS t
   FROM f JOIN ev ON ev.file_id = f.file_id AND ev.i = f.i + 1 LEFT JOIN moves m ON m.s = f.state AND m.e = ev.type))
SELECT file_id, state, applied, illegal FROM f QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i DESC) = 1""")
def q_routing_fold(spark, sf_dir):
    return routing.fold(route_events(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT *, (coalesce(ts - lag(ts) OVER w, INTERVAL '1 day') >= INTERVAL '30 minutes')::INT AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), "30 minutes", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(DISTINCT (user_id, event_type))::BIGINT AS n FROM events")
def q_first_seen(spark, sf_dir):
    return windows.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"]).agg(F.count("*").alias("n"))


SNIFFED = [(b"%PDF-1.7", "pdf"), (b"\x89PNG\r\n\x1a\n....", "image"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "legacy_office"), (b"a,b\n1,2\n", "csv"), (b"a;b\n1;2\n3;4", "csv"), (b"just words", "unsupported"), (b"PK\x03\x04broken", "unsupported"), (b"abc", "unsupported")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{r}')" for k, (_, r) in enumerate(SNIFFED)) + ") v(k, route)")
def q_sniff(spark, sf_dir):
    rows = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(SNIFFED)], "k long, content binary")
    return rows.select("k", files.route("content").alias("route"))


# --- verification -----------------------------------------------------------------------------------------


def order_fields(spark, sf_dir) -> DataFrame:
    """Orders as fields: a date that is ambiguous on some days, a price (unreadable on every fifth order), an empty required clerk."""
    k = F.col("o_orderkey")
    field = lambda name, kind, value, need: F.struct(F.lit(name).alias("label"), F.lit(kind).alias("value_type"), value.alias("value"), F.lit(need).alias("required"))
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("doc_id"), F.explode(F.array(field("date", "date", F.date_format("o_orderdate", "dd/MM/yyyy"), False), field("price", "amount", F.when(k % 5 == 0, "n/a").otherwise(F.format_number("o_totalprice", 2)), True), field("clerk", "text", F.when(k % 2 == 0, "c").otherwise(" "), True))).alias("f")).select("doc_id", "f.*")
    return rows.withColumns({"id": F.concat_ws("/", "doc_id", "label"), "canonical_label": F.col("label"), "rejected": F.lit(False), "user_edited": (F.col("label") == "price") & (F.col("doc_id").cast("long") % 10 == 0), "confidence": F.lit(0.9), "review_cap": F.lit(None).cast("string")})


@query("""
SELECT o_orderkey || '/date' AS id, 'needs_review' AS status FROM orders UNION ALL
SELECT o_orderkey || '/price', CASE WHEN o_orderkey % 10 = 0 THEN 'confirmed' WHEN o_orderkey % 5 = 0 THEN 'invalid' ELSE 'needs_review' END FROM orders UNION ALL
SELECT o_orderkey || '/clerk', CASE WHEN o_orderkey % 2 = 0 THEN 'needs_review' ELSE 'missing' END FROM orders""")
def q_verify(spark, sf_dir):
    fields = order_fields(spark, sf_dir)
    return verify.statuses(fields, verify.validate(fields)).select("id", "status")


@query("""
SELECT 'date_validity' AS validator, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'warn' ELSE 'pass' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY ALL UNION ALL
SELECT 'amount_format', CASE WHEN o_orderkey % 5 = 0 THEN 'fail' ELSE 'pass' END, count(*)::BIGINT FROM orders GROUP BY ALL UNION ALL
SELECT 'required_presence', s, sum(n)::BIGINT FROM (SELECT 'pass' AS s, count(*) AS n FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM orders GROUP BY 1) GROUP BY s""")
def q_validators(spark, sf_dir):
    return verify.validate(order_fields(spark, sf_dir)).groupBy("validator", "status").agg(F.count("*").alias("n"))


@query(INVOICES + " SELECT o_orderkey::VARCHAR || '/' || l AS id FROM t, (VALUES ('subtotal'), ('tax'), ('total')) v(l) WHERE round(100 * subtotal)::BIGINT + round(100 * tax)::BIGINT <> round(100 * total)::BIGINT")
def q_closure_caps(spark, sf_dir):
    """Invoice amounts that do not close to the cent."""
    rows = order_candidates(spark, sf_dir)
    return verify.closure_caps(rows, rows.select("doc_id").distinct().withColumn("doc_type", F.lit("invoice"))).select("id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cannot_judge' WHEN 1 THEN 'conflict' ELSE 'agree' END AS judgment FROM orders")
def q_second_reads(spark, sf_dir):
    """Prices read twice: by the same channel, with a difference, and with other separators."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("amount").alias("value_type"), F.format_number(price, 2).alias("first"), F.lit("ocr").alias("first_channel"), F.when(k % 4 == 1, F.format_number(price + 1, 2)).otherwise(F.concat(F.lit("$ "), F.format_number(price, 2))).alias("second"), F.when(k % 4 == 0, "ocr").otherwise("lattice_decode").alias("second_channel"))
    return verify.judge(rows).select("o_orderkey", "judgment")


@query("""
WITH f AS (SELECT l_orderkey::VARCHAR AS doc_id, l_returnflag AS s FROM lineitem)
SELECT doc_id, CASE WHEN count(*) FILTER (s <> 'A') = 0 THEN 'all_proven' WHEN count(*) * 0 + count(*) FILTER (s <> 'A') * 100 > 300 THEN 'budget_exceeded' ELSE 'dispatch' END AS plan, count(*) FILTER (s <> 'A')::INT AS n FROM f GROUP BY doc_id""")
def q_read_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("string").alias("label"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "refused").otherwise("review").alias("status"), F.lit("amount").alias("value_type"), F.lit(True).alias("has_box"))
    return verify.plan_reads(rows, 0, 300, 100).select("doc_id", "plan", F.size("targets").alias("n"))


# --- review, zones and samples --------------------------------------------------------------------------


@query("""
SELECT c_custkey AS doc_id, f.canonical_label, f.value, f.confidence::DOUBLE AS confidence, CASE WHEN f.passed THEN 'passed' WHEN NOT f.passed THEN 'failed' ELSE 'uncovered' END AS checked FROM (SELECT *, 'L' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') AS n FROM customer), unnest([
  {'canonical_label': 'passport_number', 'value': n, 'confidence': CASE WHEN c_custkey % 2 = 0 THEN 0.99 ELSE 0.55 END, 'passed': c_custkey % 2 = 0},
  {'canonical_label': 'full_name', 'value': 'ANNA MARIA ERIKSSON', 'confidence': 0.97, 'passed': NULL}, {'canonical_label': 'surname', 'value': 'ERIKSSON', 'confidence': 0.97, 'passed': NULL},
  {'canonical_label': 'given_names', 'value': 'ANNA MARIA', 'confidence': 0.97, 'passed': NULL}, {'canonical_label': 'nationality', 'value': 'Utopia', 'confidence': 0.97, 'passed': NULL},
  {'canonical_label': 'date_of_birth', 'value': '1974-08-12', 'confidence': 0.99, 'passed': true}, {'canonical_label': 'sex', 'value': 'F', 'confidence': 0.97, 'passed': NULL},
  {'canonical_label': 'date_of_expiry', 'value': '2012-04-15', 'confidence': 0.99, 'passed': true}, {'canonical_label': 'document_type', 'value': 'P', 'confidence': 0.97, 'passed': NULL},
  {'canonical_label': 'country_code', 'value': 'UTO', 'confidence': 0.97, 'passed': NULL}, {'canonical_label': 'personal_number', 'value': 'ZE184226B', 'confidence': 0.99, 'passed': true}]) u(f)""")
def q_zone_fields(spark, sf_dir):
    """What the zones of the customers' passports state, and which of it a check digit covers."""
    read = passports(spark, sf_dir).select("c_custkey", F.explode(mrz.derived_fields(mrz.parse_mrz(F.col("zone"), 2026), {"UTO": "Utopia"})).alias("f"))
    return read.select(F.col("c_custkey").alias("doc_id"), "f.canonical_label", "f.value", "f.confidence", F.when(F.col("f.checksum_passed"), "passed").when(~F.col("f.checksum_passed"), "failed").otherwise("uncovered").alias("checked"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey % 2 = 0 AS identity FROM customer)
SELECT k AS doc_id, 'number' AS id, CASE WHEN k % 2 <> 0 THEN 'unattested identifier' END AS review_cap FROM c UNION ALL
SELECT k, 'name', CASE WHEN NOT identity THEN 'unattested name' WHEN k % 3 <> 2 THEN 'name without a proven zone' WHEN k % 5 <> 0 THEN 'name differs from the zone' END FROM c UNION ALL
SELECT k, 'date', CASE WHEN k % 7 = 0 THEN 'ambiguous' WHEN identity AND k % 3 = 1 THEN 'date beside a refused zone' END FROM c UNION ALL
SELECT k, 'vendor', 'unattested generic read' FROM c UNION ALL
SELECT k, 'total', 'continuation page' FROM c""")
def q_review_caps(spark, sf_dir):
    """Five fields of each customer; every other nation's are on identity documents, whose zones are absent, refused or proven."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    no = F.lit(False)
    field = lambda name, label, kind, value, origin, ambiguous, proven: F.struct(F.lit(name).alias("id"), F.lit(label).alias("canonical_label"), F.lit(kind).alias("value_type"), value.alias("value"), F.lit(origin).alias("origin"), ambiguous.alias("ambiguous"), proven.alias("proven"))
    fields = [field("number", "passport_number", "id_number", F.lit("A1"), "registry", no, k % 2 == 0), field("name", "full_name", "name", F.when(k % 5 == 0, "Anna  O'Neill").otherwise("Ann O Neill"), "registry", no, no), field("date", "date_of_birth", "date", F.lit("2024-01-01"), "registry", k % 7 == 0, no), field("vendor", "vendor", "text", F.lit("x"), "generic", no, no), field("total", "total", "amount", F.lit("1"), "continuation", no, no)]
    rows = c.select(k.alias("doc_id"), F.explode(F.array(*fields)).alias("f")).select("doc_id", "f.*")
    docs = c.select(k.alias("doc_id"), (F.col("c_nationkey") % 2 == 0).alias("identity"), F.get(F.array(*map(F.lit, ("none", "refused", "proven"))), (k % 3).cast("int")).alias("zone"), F.lit("O NEILL").alias("surname"), F.lit("ANNA").alias("given_names"))
    return verify.review_caps(rows, docs)


@query("SELECT c_custkey::VARCHAR AS doc_id, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' OFFICE NORTH' || CASE WHEN c_custkey % 2 = 0 THEN ' CITY' ELSE '' END END AS value, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 - c_custkey % 2 END::INT AS n FROM customer")
def q_continued(spark, sf_dir):
    """An authority with two lines below: the first is a date on every third card, the second stands apart on odd ones."""
    k = F.col("c_custkey")
    line = lambda node, text, x, y: F.struct(F.lit(node).alias("node_id"), text.alias("text"), x.alias("x1"), F.lit(y).alias("y1"))
    lines = [line("a", F.col("c_mktsegment"), F.lit(0.1), 0.1), line("b", F.when(k % 3 == 0, "2024-01-01").otherwise("OFFICE  NORTH"), F.lit(0.1), 0.14), line("c", F.lit("CITY"), F.when(k % 2 == 0, 0.1).otherwise(0.5), 0.18)]
    cards = table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(*lines)).alias("l")).select("doc_id", "page", "l.*")
    items = cards.select("*", (F.col("x1") + 0.2).alias("x2"), (F.col("y1") + 0.03).alias("y2"), F.lit(None).cast("string").alias("region_id"))
    fields = items.filter("node_id = 'a'").select("doc_id", F.lit(1).alias("ord"), F.lit("issuing_authority").alias("canonical_label"), F.col("node_id").alias("value_id"), F.col("text").alias("value"))
    return extraction.continued(fields, items).select("doc_id", "value", F.size("continuation").alias("n"))


SAMPLES, SEED = 3, 7
_X = layout.draws(SAMPLES, SEED)


@query(f"""
WITH r AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem GROUP BY 1),
a AS (SELECT k, m, floor({_X[0]!r} * m)::BIGINT AS a, floor({_X[1]!r} * (m - 1))::BIGINT AS y, floor({_X[2]!r} * (m - 2))::BIGINT AS z FROM r),
b AS (SELECT k, m, a, y + (y >= a)::BIGINT AS b, z FROM a),
c AS (SELECT k, m, a, b, z + (z >= least(a, b))::BIGINT AS z FROM b),
d AS (SELECT k, m, a, b, z + (z >= greatest(a, b))::BIGINT AS c FROM c)
SELECT k::VARCHAR AS doc_id, CASE WHEN m <= 3 THEN i + 1 ELSE [a, b, c][i + 1] + 1 END::INT AS ord, i::INT AS draw FROM d, range(3) t(i) WHERE i < m""")
def q_seeded_samples(spark, sf_dir):
    """Three lines of each order, drawn without replacement by a seed."""
    r = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), r.alias("ord")).withColumn("text", F.concat(F.lit("line "), "ord"))
    return layout.seeded_samples(rows, SAMPLES, SEED).select("doc_id", "ord", "draw")


@query("""
WITH f AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer),
x AS (SELECT *, n % 3 = 0 AS approved, s = 'BUILDING' AND n IN (SELECT n FROM f WHERE s = 'MACHINERY') AS building FROM f)
SELECT n::VARCHAR AS family_id, approved, CASE WHEN NOT approved THEN 'empty label' END AS error, s AS field_id, CASE WHEN s = 'AUTOMOBILE' THEN 'Cars' ELSE s END AS label, CASE WHEN s = 'FURNITURE' AND NOT approved THEN 'amount' ELSE 'text' END AS value_type, s = 'FURNITURE' AND n % 2 = 1 AS required, building AS deleted
FROM x WHERE NOT (approved AND building)""")
def q_schema_edits(spark, sf_dir):
    """Segments of each nation as fields, edited alike; every third nation approves before the last edits."""
    fields = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("field_id")).distinct()
    events = [(1, "DELETE", "BUILDING", None, None, 1), (2, "DELETE", "MACHINERY", None, None, 1), (3, "UNDO_DELETE", None, None, None, 1), (4, "RENAME", "AUTOMOBILE", " Cars ", None, 1), (5, "TOGGLE_REQUIRED", "FURNITURE", None, None, 2), (6, "APPROVE", None, None, None, 3), (7, "RETYPE", "FURNITURE", None, "amount", 1), (8, "RENAME", "AUTOMOBILE", " ", None, 1)]
    said = spark.createDataFrame(events, "seq int, type string, field_id string, label string, value_type string, every int")
    told = fields.select("n").distinct().join(F.broadcast(said), F.when(F.col("every") == 2, F.col("n") % 2 == 1).otherwise(F.col("n") % F.col("every") == 0))
    rows = fields.select(F.col("n").cast("string").alias("family_id"), F.col("field_id").alias("ord"), "field_id", F.col("field_id").alias("label"), F.lit("text").alias("value_type"), F.lit(False).alias("required"), F.lit(False).alias("is_column"))
    out = review.edit_schemas(rows, told.withColumn("family_id", F.col("n").cast("string")))
    return out.select("family_id", "approved", "error", F.explode("fields").alias("f")).select("family_id", "approved", "error", "f.field_id", "f.label", "f.value_type", "f.required", "f.deleted")


@query("""
WITH o AS (SELECT o_custkey AS k, array_agg(o_orderkey ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1)
SELECT k::VARCHAR AS lane_id, (n - 1)::INT AS open, CASE WHEN n > 2 THEN 1 ELSE 0 END AS cursor, n > 1 AS editing, n = 1 AS done, ids[1]::VARCHAR AS accepted, CASE WHEN n > 1 THEN ids[least(n, 3)]::VARCHAR END AS edited FROM o""")
def q_review_lanes(spark, sf_dir):
    """The orders of each customer as questions: the first is accepted, the one after next edited, and keys during the save do nothing."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("lane_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_totalprice").cast("string").alias("value"))
    keys = [("KEY", "Enter", None), ("KEY", "ArrowDown", None), ("ACTION_DONE", None, None), ("KEY", "ArrowDown", None), ("KEY", "e", None), ("EDIT_INPUT", None, "x"), ("KEY", "ArrowUp", None), ("KEY", "Enter", None), ("KEY", "ArrowUp", None)]
    event = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(a).alias("type"), F.lit(b).cast("string").alias("key"), F.lit(c).cast("string").alias("value")) for i, (a, b, c) in enumerate(keys))))
    out = review.review_lanes(orders, orders.select("lane_id").distinct().select("lane_id", event.alias("e")).select("lane_id", "e.*"))
    item = lambda kind: F.get(F.filter("actions", lambda a: a["kind"] == kind), 0)["item_id"]
    return out.select("lane_id", "open", "cursor", "editing", "done", item("accept").alias("accepted"), item("save_edit").alias("edited"))
