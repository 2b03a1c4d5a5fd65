"""Field verification: validators, status precedence, review caps, second reads.

fields: doc_id, id, label, canonical_label, value_type, value, required, rejected, user_edited, confidence, review_cap.
Statuses by precedence: rejected, confirmed by the user, missing, conflict, invalid, needs_review. No rule here
confirms: only proof does (``consensus``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import mrz
from attestry.functions import scalars as S
from attestry.functions.checksums import bare

Validator = Callable[[], Column]
NOW_YEAR = 2026
# Value types that a second read must settle.
CRITICAL = ["amount", "date", "id_number"]
ROUNDS = 2


def empty(c: Column) -> Column:
    return c.isNull() | (S.strip(c) == "")


def told(validator: str, applies: Column, status: Column, severity: str, suggested: Column) -> Column:
    return F.when(applies, F.struct(F.lit(validator).alias("validator"), status.alias("status"), F.lit(severity).alias("severity"), suggested.alias("suggested")))


def passes(ok: Column, otherwise: str) -> Column:
    return F.when(ok, "pass").otherwise(otherwise)


def suggests(ok: Column, status: str) -> Column:
    return F.when(~ok, status)


def validators(now_year: int = NOW_YEAR) -> list[Column]:
    """The registry: one struct for each rule, null where it does not apply. Callers may append their own."""
    value, kind, some = F.col("value"), F.col("value_type"), ~empty(F.col("value"))
    date, amount = S.parse_date(value), S.parse_amount(value)
    zone = F.coalesce(mrz.parse_mrz(value, now_year)["status"], F.lit("none"))
    return [
        told("required_presence", F.coalesce("required", F.lit(False)), passes(some, "fail"), "high", suggests(some, "missing")),
        S.let(date, lambda d: told("date_validity", (kind == "date") & some, F.when(~d["valid"], "fail").when(d["ambiguous"], "warn").otherwise("pass"), "high", F.when(~d["valid"], "invalid").when(d["ambiguous"], "needs_review"))),
        S.let(amount["valid"], lambda ok: told("amount_format", kind.isin("amount", "currency") & some, passes(ok, "fail"), "high", suggests(ok, "invalid"))),
        S.let(S.is_valid_email(S.strip(value)), lambda ok: told("email_format", (kind == "email") & some, passes(ok, "fail"), "medium", suggests(ok, "invalid"))),
        S.let(S.is_plausible_phone(value), lambda ok: told("phone_format", (kind == "phone") & some, passes(ok, "warn"), "low", suggests(ok, "needs_review"))),
        S.let(F.upper(S.strip(value)).isin("M", "F", "X"), lambda ok: told("sex_token", F.coalesce("label", F.lit("")).rlike(r"(?i)\bsex\b|gender|\bsexe\b") & some, passes(ok, "fail"), "medium", suggests(ok, "needs_review"))),
        S.let(zone, lambda z: told("mrz_checksum", (kind == "mrz") & some, F.when(z == "invalid", "fail").when(z == "valid", "pass").otherwise("warn"), "critical", F.when(z == "invalid", "invalid").when(z != "valid", "needs_review"))),
    ]


def id_pattern(patterns: dict[str, str]) -> Column:
    """A rule for identifiers whose label has a pattern."""
    ok = F.lit(None).cast("boolean")
    for label, pattern in patterns.items():
        ok = F.when(F.col("canonical_label") == label, S.matches_id_pattern(F.col("value"), pattern)).otherwise(ok)
    return S.let(ok, lambda x: told("id_pattern", (F.col("value_type") == "id_number") & x.isNotNull(), passes(x, "fail"), "medium", suggests(x, "invalid")))


def table_arithmetic(lines: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """A rule for totals: the numbers of ``lines`` (null counts nothing) sum to ``expected``, else the field is in conflict."""
    total = F.aggregate(lines, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    return S.let(F.abs(total - expected) <= tolerance, lambda ok: told("table_arithmetic", ok.isNotNull(), passes(ok, "fail"), "high", suggests(ok, "conflict")))


def validate(fields: DataFrame, rules: list[Column] | None = None) -> DataFrame:
    """(doc_id, id, validator, status, severity, suggested): one row for each rule that applies to a field that is not rejected.

    Without ``rules`` the registry is used; an empty list is no rule at all. Fields without printed labels may lack that column."""
    rows = fields.filter("not coalesce(rejected, false)" if rules is None or rules else "false")
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    out = F.filter(F.array(*(rules or validators())), lambda v: v.isNotNull())
    return rows.select("doc_id", "id", F.explode(out).alias("v")).select("doc_id", "id", "v.*")


def statuses(fields: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, id, status): the precedence over each field's failures."""
    worst = results.groupBy("doc_id", "id").agg(F.bool_or(F.col("suggested") == "missing").alias("m"), F.bool_or(F.col("suggested") == "conflict").alias("c"), F.bool_or((F.col("status") == "fail") & (F.col("suggested") == "invalid")).alias("i"))
    rows = fields.join(worst, ["doc_id", "id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(yes("rejected"), "rejected").when(yes("user_edited"), "confirmed").when(yes("m"), "missing").when(yes("c"), "conflict").when(yes("i"), "invalid").otherwise("needs_review")
    return rows.select("doc_id", "id", status.alias("status"))


def confidence(lowest: Column, penalties: Column) -> Column:
    """The lowest confidence of what a value rests on, less the sum of its penalties, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lowest - F.aggregate(penalties, F.lit(0.0), lambda a, p: a + p)))


def safe_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, safe): no page is known to be unsafe."""
    return pages.groupBy("doc_id").agg(F.bool_and(F.coalesce("safe_to_extract", F.lit(True))).alias("safe"))


def cents(c: Column) -> Column:
    """A printed amount in whole cents: digits, point and minus only."""
    number = F.regexp_extract(F.regexp_replace(c, r"[^\d.-]", ""), r"^-?\d*\.?\d+", 0).try_cast("double")
    return F.floor(number * 100 + 0.5).cast("long")


# Equations that hold to the cent, by document type: terms with their sign, and the result.
FAMILIES = {
    "bank_statement": ([("opening_balance", 1), ("total_credits", 1), ("total_debits", -1)], "closing_balance"),
    "payslip": ([("gross_pay", 1), ("total_deductions", -1)], "net_pay"),
    "invoice": ([("subtotal", 1), ("tax", 1)], "total"),
}


def closure_caps(fields: DataFrame, doc_types: DataFrame) -> DataFrame:
    """(doc_id, id): amounts whose document's equation is not complete and exact; they stay in review."""
    rows = fields.join(doc_types, "doc_id")
    terms = rows.groupBy("doc_id", "doc_type").agg(F.map_from_entries(F.collect_list(F.struct("canonical_label", cents(F.col("value"))))).alias("t"))
    get = lambda label: F.try_element_at(F.col("t"), F.lit(label))
    holds = F.lit(None).cast("boolean")
    wanted = F.array().cast("array<string>")
    for kind, (parts, result) in FAMILIES.items():
        holds = F.when(F.col("doc_type") == kind, F.coalesce(sum((get(p) * s for p, s in parts), F.lit(0)) == get(result), F.lit(False))).otherwise(holds)
        wanted = F.when(F.col("doc_type") == kind, F.array(*(F.lit(p) for p, _ in parts), F.lit(result))).otherwise(wanted)
    broken = terms.select("doc_id", holds.alias("holds"), wanted.alias("wanted")).filter("not holds")
    return rows.join(broken, "doc_id").filter(F.array_contains("wanted", F.col("canonical_label"))).select("doc_id", "id")


# Labels that hold a name whatever their type, by what read them.
NAMES = {"registry": ["vendor"], "generic": ["vendor", "full_name"]}


def witnessed(label: Column, value: Column, surname: Column, given: Column) -> Column:
    """Whether a proven zone states this name."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"['’-]", " "), r"\s+", " "))
    v, s, g = plain(value), plain(surname), plain(given)
    full = v.isin(F.concat_ws(" ", g, s), F.concat_ws(" ", s, g)) & s.isNotNull() & g.isNotNull()
    return F.coalesce(F.when(label == "surname", v == s).when(label.isin("given_names", "given_name"), v == g).when(label == "full_name", full), F.lit(False))


def review_caps(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, id, review_cap): why a field may not be confirmed without a person; null where nothing speaks against it.

    fields: doc_id, id, canonical_label, value_type, value, origin (registry, generic, continuation), ambiguous, proven (a zone's
    checks prove it). documents: doc_id, identity, zone (none, refused, proven), surname, given_names, one row each; a field
    without one is on no identity document. Pixels alone prove no identifier and no name; only a proven zone that states a name
    frees it. A date beside a refused zone and everything on continuation pages is a question too."""
    rows = fields.join(documents.select("doc_id", "identity", "zone", "surname", "given_names"), "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    label, kind, origin = F.coalesce("canonical_label", F.lit("")), F.coalesce("value_type", F.lit("")), F.col("origin")
    zone = F.coalesce("zone", F.lit("none"))
    name = lambda where: (kind == "name") | label.isin(NAMES[where])
    vouched = (kind == "name") & witnessed(label, F.col("value"), F.col("surname"), F.col("given_names"))
    name_cap = F.when(~yes("identity"), "unattested name").when(zone != "proven", "name without a proven zone").when(~vouched, "name differs from the zone")
    registry = F.coalesce(
        F.when((kind == "id_number") & ~yes("proven"), "unattested identifier"),
        F.when(name("registry"), name_cap),
        F.when(yes("ambiguous"), "ambiguous"),
        F.when((kind == "date") & yes("identity") & (zone == "refused"), "date beside a refused zone"),
    )
    generic = F.when((kind == "id_number") | name("generic"), "unattested generic read")
    cap = F.when(origin == "continuation", "continuation page").when(origin == "generic", generic).otherwise(registry)
    return rows.select("doc_id", "id", cap.alias("review_cap"))


# --- second reads -------------------------------------------------------------------------------------


def reads_agree(kind: Column, a: Column, b: Column) -> Column:
    amounts = F.abs(S.closure_amount(a) - S.closure_amount(b)) < 0.005
    return F.when(kind == "amount", F.coalesce(amounts, F.lit(False))).when(kind == "date", F.arrays_overlap(S.plausible_iso_dates(a), S.plausible_iso_dates(b))).otherwise(bare(a) == bare(b))


def judge(reads: DataFrame) -> DataFrame:
    """reads (.., value_type, first, first_channel, second, second_channel) with ``judgment``: agree (a proof of 0.9), conflict or cannot_judge.

    The same channel, or none, cannot judge itself."""
    blind = (F.col("first_channel") == F.col("second_channel")) | empty(F.col("second"))
    return reads.withColumn("judgment", F.when(blind, "cannot_judge").when(reads_agree(F.col("value_type"), F.col("first"), F.col("second")), "agree").otherwise("conflict"))


def plan_reads(solved: DataFrame, completed: int, remaining_ms: float, ms_per_read: float) -> DataFrame:
    """(doc_id, plan, round, dpi_scale, targets): whether and where each document is read again.

    solved: doc_id, label, status, value_type, has_box. Critical values in review and refused ones are targets, if they have a box."""
    target = F.col("has_box") & (((F.col("status") == "review") & F.col("value_type").isin(CRITICAL)) | (F.col("status") == "refused"))
    docs = solved.groupBy("doc_id").agg(F.count_if(F.col("status") != "confirmed").alias("open"), F.array_sort(F.collect_list(F.when(target, F.col("label")))).alias("targets"))
    n = F.size("targets")
    plan = F.when(F.col("open") == 0, "all_proven").when(n == 0, "no_actionable_targets").when(F.lit(completed >= ROUNDS), "rounds_exhausted").when(n * ms_per_read > remaining_ms, "budget_exceeded").otherwise("dispatch")
    rows = docs.withColumn("plan", plan)
    go = F.col("plan") == "dispatch"
    return rows.select("doc_id", "plan", F.when(go, completed + 1).alias("round"), F.when(go, 2 ** (completed + 1)).alias("dpi_scale"), "targets")
