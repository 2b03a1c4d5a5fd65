"""Dates, amounts, identifiers and labels as Column builders. A null input gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as document text has it: Java's \s and the Unicode spaces.
WS = r"[\s   -     　﻿]"
#: Anything else.
INK = WS[0] + "^" + WS[1:]

# English month names.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}
# Currency signs, in the order in which they are looked for.
CURRENCIES = {"$": "USD", "₹": "INR", "€": "EUR", "£": "GBP"}


def let(value: Column, body) -> Column:
    """body(value), with value computed once: keeps nested expressions from multiplying."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def group(c: Column, pattern: str, k: int) -> Column:
    """The k-th group as an integer, null where the pattern does not match."""
    return F.regexp_extract(c, pattern, k).try_cast("int")


def calendar_iso(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd of a date that exists in the Gregorian calendar, else null."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(month.between(1, 12) & day.between(1, last), F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)))


YEAR_FIRST = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$"
YEAR_LAST = r"^(\d{1,2})[-./ ](\d{1,2})[-./ ](\d{4})$"
DAY_NAME = r"^(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{4})$"
NAME_DAY = r"^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$"
SIX_DIGITS = r"^(\d{2})(\d{2})(\d{2})$"


def parse_date(raw: Column, locale: str | None = None) -> Column:
    """struct<iso, ambiguous, valid, candidates>: every reading of the date that the calendar allows, ascending.

    Year first is certain. Day and month without a ``locale`` ('dmy', 'mdy') give both readings where both exist.
    Six bare digits are a date only under 'ymd'."""
    return F.when(raw.isNotNull(), let(strip(raw), lambda s: date_readings(s, locale)))


def date_readings(s: Column, locale: str | None) -> Column:
    y1, m1, d1 = (group(s, YEAR_FIRST, k) for k in (1, 2, 3))
    a, b, y2 = (group(s, YEAR_LAST, k) for k in (1, 2, 3))
    months = literal_map(MONTHS)
    month_of = lambda pattern, k: F.try_element_at(months, F.lower(F.regexp_extract(s, pattern, k)))
    two = {"dmy": [calendar_iso(y2, b, a)], "mdy": [calendar_iso(y2, a, b)]}.get(locale or "", [calendar_iso(y2, b, a), calendar_iso(y2, a, b)])
    six = [calendar_iso(2000 + group(s, SIX_DIGITS, 1), group(s, SIX_DIGITS, 2), group(s, SIX_DIGITS, 3))] if locale == "ymd" else [F.lit(None).cast("string")]
    readings = (
        F.when(s.rlike(YEAR_FIRST), F.array(calendar_iso(y1, m1, d1)))
        .when(s.rlike(YEAR_LAST), F.array(*two))
        .when(s.rlike(DAY_NAME), F.array(calendar_iso(group(s, DAY_NAME, 3), month_of(DAY_NAME, 2), group(s, DAY_NAME, 1))))
        .when(s.rlike(NAME_DAY), F.array(calendar_iso(group(s, NAME_DAY, 3), month_of(NAME_DAY, 1), group(s, NAME_DAY, 2))))
        .when(s.rlike(SIX_DIGITS), F.array(*six))
        .otherwise(F.array().cast("array<string>"))
    )
    found = F.array_sort(F.array_distinct(F.filter(readings, lambda x: x.isNotNull())))
    return let(found, lambda found: F.struct(F.when(F.size(found) == 1, F.get(found, 0)).alias("iso"), (F.size(found) > 1).alias("ambiguous"), (F.size(found) > 0).alias("valid"), found.alias("candidates")))


def is_expiry_after_issue(issue_iso: Column, expiry_iso: Column) -> Column:
    return expiry_iso > issue_iso


def round4(c: Column) -> Column:
    """Four decimals, halves upwards."""
    return F.floor(c * 10000 + 0.5) / 10000


def normalize_numeric(s: Column) -> Column:
    """Digits with one decimal point: of two separators the later is decimal; a lone one is decimal unless three digits follow or it repeats."""
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    last = lambda mark: F.length(s) - F.instr(F.reverse(s), mark)
    drop = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    swap = lambda x: F.replace(x, F.lit(","), F.lit("."))
    mark = F.when(comma, ",").otherwise(".")
    repeats = F.length(s) - F.length(F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("."), F.lit("")))
    behind = F.length(s) - F.when(comma, F.instr(s, ",")).otherwise(F.instr(s, "."))
    return (
        F.when(comma & dot, F.when(last(",") > last("."), swap(drop(s, "."))).otherwise(drop(s, ",")))
        .when(comma | dot, F.when((repeats > 1) | (behind == 3), F.replace(s, mark, F.lit(""))).otherwise(swap(s)))
        .otherwise(s)
    )


def parse_amount(raw: Column) -> Column:
    """struct<value, currency, negative, valid>: the printed-amount reader (one lone separator may be decimal)."""

    def amount(work: Column, enclosed: Column) -> Column:
        negative = enclosed | F.contains(work, F.lit("-"))
        code = F.regexp_extract(F.upper(work), r"\b([A-Z]{3})\b", 1)
        sign = F.coalesce(*(F.when(F.contains(work, F.lit(k)), F.lit(v)) for k, v in CURRENCIES.items()), F.when(code != "", code), F.lit("USD"))
        number = let(F.regexp_replace(work, "[^0-9.,]", ""), lambda s: F.regexp_extract(normalize_numeric(s), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double"))
        value = let(number, lambda n: round4(F.when(negative, -n).otherwise(n)))
        return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), sign).alias("currency"), negative.alias("negative"), v.isNotNull().alias("valid")))

    inner = lambda s: F.when(s.rlike(r"^\(.*\)$"), strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    return F.when(raw.isNotNull(), let(strip(raw), lambda s: let(inner(s), lambda work: amount(work, s.rlike(r"^\(.*\)$")))))


def closure_amount(raw: Column) -> Column:
    """The amount reader of closure equations: only two digits after the last separator are decimals; three after a lone one are thousands."""

    def number(s: Column) -> Column:
        seps, plain = F.regexp_replace(s, "[^.,]", ""), F.regexp_replace(s, "[.,]", "")
        tail = F.length(F.regexp_extract(s, r"[.,]([^.,]*)$", 1))
        cents = F.concat(F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - 3), "[.,]", ""), F.lit("."), F.right(s, F.lit(2)))
        digits = F.when((seps != "") & (tail == 2), cents).when((F.length(seps) == 1) & (tail == 3), plain).otherwise(F.replace(s, F.lit(","), F.lit("")))
        return let(digits, lambda d: F.when(d.rlike(r"^(\d+\.?\d*|\.\d+)$"), d.try_cast("double")))

    def signed(cleaned: Column) -> Column:
        negative = cleaned.rlike(r"^\(.*\)$") | F.contains(cleaned, F.lit("-"))
        value = let(F.regexp_replace(cleaned, "[()-]", ""), number)
        return F.when(cleaned.rlike(r"\d"), let(value, lambda v: F.when(negative, -v).otherwise(v)))

    return let(F.regexp_replace(raw, r"[^\d.,()-]", ""), signed)


def normalize_id(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")


def matches_id_pattern(raw: Column, pattern: str) -> Column:
    return normalize_id(raw).rlike(pattern)


def is_valid_email(raw: Column) -> Column:
    return raw.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_plausible_phone(raw: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(strip(raw), r"^\+", ""), rf"{WS}|[\-().]", "")
    return digits.rlike(r"^\d{7,15}$")


def clean_text(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, f"{WS}+", " "))


def slug(label: Column, default: str = "field") -> Column:
    """Lower-case words joined by underscores: a field id."""
    s = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", default).otherwise(s)


def infer_value_type(raw: Column) -> Column:
    """The type a value shows by itself: email, date, amount, phone, id_number or text."""
    s = strip(raw)
    money = s.rlike(r"[$₹€£]") | s.rlike(r"^\(?-?[\d.,]*\d[.,]\d{2}\)?$")
    return (
        F.when(is_valid_email(s), "email")
        .when(parse_date(s)["valid"], "date")
        .when(money & parse_amount(s)["valid"], "amount")
        .when(s.rlike(r"^\+?[\d\s\-().]+$") & is_plausible_phone(s) & s.rlike(r"[\s\-()+]"), "phone")
        .when(s.rlike(r"\d") & s.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-/]{4,}$"), "id_number")
        .when(raw.isNotNull(), "text")
    )


def normalize_field_value(value: Column, value_type: Column) -> Column:
    """A value in the normal form of its type; text where it cannot be read as that type."""
    date, amount = parse_date(value), parse_amount(value)
    return (
        F.when(value_type == "date", F.coalesce(date["iso"], clean_text(value)))
        .when((value_type == "amount") & amount["valid"], amount["value"].cast("string"))
        .when(value_type == "id_number", normalize_id(value))
        .when(value_type == "email", F.lower(strip(value)))
        .otherwise(clean_text(value))
    )


def clean_label_text(raw: Column) -> Column:
    """Of a bilingual label's segments, the one with most Latin letters, the first among equals."""
    bare = lambda p: strip(F.regexp_replace(strip(p), r"[:：*]+$", ""))
    parts = F.transform(F.split(raw, "/"), lambda p, i: F.struct((-F.length(F.regexp_replace(p, "[^A-Za-z]", ""))).alias("k"), i.alias("i"), bare(p).alias("p")))
    return F.when(F.contains(raw, F.lit("/")), F.array_min(parts)["p"]).otherwise(bare(raw))


FOLD_FROM = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøōőřśšťùúûüūůűýÿźżž"
FOLD_TO = "aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorsstuuuuuuuyyzzz"


def normalize_label_text(raw: Column) -> Column:
    """Lower case without accents or punctuation, single spaces."""
    folded = F.translate(F.replace(F.lower(raw), F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)
    return strip(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def split_inline_label(raw: Column) -> Column:
    """struct<label, value> of a 'Label: value' line, else null."""
    label, value = strip(F.regexp_extract(raw, r"^([^:：]{2,40})[:：](.+)$", 1)), strip(F.regexp_extract(raw, r"^([^:：]{2,40})[:：](.+)$", 2))
    return F.when((label != "") & (value != "") & label.rlike("[A-Za-z]"), F.struct(label.alias("label"), value.alias("value")))


def family_name(doc_type: Column) -> Column:
    """'bank_statement' as 'Bank Statement'; the rest of each word keeps its case."""
    words = F.filter(F.split(doc_type, r"[_\s-]+"), lambda w: w != "")
    pretty = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(pretty == "", "Documents").otherwise(pretty)


def plausible_iso_dates(raw: Column, date_order: Column | None = None) -> Column:
    """All calendar dates that a printed numeric date may mean (date_order: 'DMY', 'MDY' or null)."""
    pattern = r"(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})"
    a, b, c = (F.regexp_extract(raw, pattern, k) for k in (1, 2, 3))
    i = lambda x: x.try_cast("int")
    order = F.coalesce(date_order, F.lit("")) if date_order is not None else F.lit("")
    dmy, mdy = calendar_iso(i(c), i(b), i(a)), calendar_iso(i(c), i(a), i(b))
    found = (
        F.when(F.length(a) == 4, F.array(calendar_iso(i(a), i(b), i(c))))
        .when(F.length(c) == 4, F.array(F.when(order != "MDY", dmy), F.when(order != "DMY", mdy)))
        .otherwise(F.array().cast("array<string>"))
    )
    real = F.filter(found, lambda x: x.isNotNull() & (F.length(x) == 10))
    return F.when(raw.isNotNull(), F.array_distinct(real))


def string_hash_hex(raw: Column) -> Column:
    """31-based 32-bit hash of the characters, as signed hexadecimal."""
    codes = F.transform(F.filter(F.split(raw, ""), lambda ch: ch != ""), F.ascii)
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, ch: wrap(h * 31 + ch))
    return F.when(total < 0, F.concat(F.lit("-"), F.lower(F.hex(-total)))).otherwise(F.lower(F.hex(total)))
