"""Machine-readable zones (ICAO 9303): formats, normalisation, fields, check digits, status."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checksums import icao_check
from .scalars import calendar_iso, let, normalize_id, parse_date

# Lines and their length by format.
LENGTHS = {"TD1": 30, "TD2": 36, "TD3": 44, "MRV_A": 44, "MRV_B": 36}
# Letters read in digit places, digits read in letter places.
TO_DIGIT = ("OIBSZQD", "0185200")
TO_ALPHA = ("01852", "OIBSZ")
# Places (line, from, to) that hold digits and letters, by format; from 0, to exclusive.
NUMERIC = {
    "TD3": [(1, 9, 10), (1, 13, 20), (1, 21, 28), (1, 42, 44)],
    "TD2": [(1, 9, 10), (1, 13, 20), (1, 21, 28), (1, 35, 36)],
    "MRV_A": [(1, 9, 10), (1, 13, 20), (1, 21, 28)],
    "MRV_B": [(1, 9, 10), (1, 13, 20), (1, 21, 28)],
    "TD1": [(0, 14, 15), (1, 0, 7), (1, 8, 15), (1, 29, 30)],
}
ALPHA = {
    "TD3": [(0, 0, 1), (0, 2, 44), (1, 10, 13), (1, 20, 21)],
    "TD2": [(0, 0, 1), (0, 2, 36), (1, 10, 13), (1, 20, 21)],
    "MRV_A": [(0, 0, 1), (0, 2, 44), (1, 10, 13), (1, 20, 21)],
    "MRV_B": [(0, 0, 1), (0, 2, 36), (1, 10, 13), (1, 20, 21)],
    "TD1": [(0, 0, 5), (1, 7, 8), (1, 15, 18), (2, 0, 30)],
}
# Fields as (line, from, to), check digits as (parts, place).
VIZ = {"document_type": [(0, 0, 2)], "issuing_country": [(0, 2, 5)], "document_number": [(1, 0, 9)], "nationality": [(1, 10, 13)], "dob": [(1, 13, 19)], "sex": [(1, 20, 21)], "expiry": [(1, 21, 27)]}
FIELDS = {
    "TD3": VIZ | {"optional_data": [(1, 28, 42)], "name": [(0, 5, 44)]},
    "TD2": VIZ | {"optional_data": [(1, 28, 35)], "name": [(0, 5, 36)]},
    "MRV_A": VIZ | {"optional_data": [(1, 28, 44)], "name": [(0, 5, 44)]},
    "MRV_B": VIZ | {"optional_data": [(1, 28, 36)], "name": [(0, 5, 36)]},
    "TD1": {"document_type": [(0, 0, 2)], "issuing_country": [(0, 2, 5)], "document_number": [(0, 5, 14)], "nationality": [(1, 15, 18)], "dob": [(1, 0, 6)], "sex": [(1, 7, 8)], "expiry": [(1, 8, 14)], "optional_data": [(0, 15, 30), (1, 18, 29)], "name": [(2, 0, 30)]},
}
THREE = {"document_number": ([(1, 0, 9)], (1, 9)), "date_of_birth": ([(1, 13, 19)], (1, 19)), "expiry_date": ([(1, 21, 27)], (1, 27))}
CHECKS = {
    "TD3": THREE | {"optional_data": ([(1, 28, 42)], (1, 42)), "composite": ([(1, 0, 10), (1, 13, 20), (1, 21, 43)], (1, 43))},
    "TD2": THREE | {"composite": ([(1, 0, 10), (1, 13, 20), (1, 21, 35)], (1, 35))},
    "MRV_A": THREE,
    "MRV_B": THREE,
    "TD1": {"document_number": ([(0, 5, 14)], (0, 14)), "date_of_birth": ([(1, 0, 6)], (1, 6)), "expiry_date": ([(1, 8, 14)], (1, 14)), "composite": ([(0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)], (1, 29))},
}
#: The only check that may fail without making the zone invalid.
OPTIONAL = "optional_data"


def clean_lines(raw: Column) -> Column:
    lines = F.transform(F.split(F.upper(raw), r"\r?\n"), lambda x: F.regexp_replace(x, r"\s", ""))
    return F.filter(lines, lambda x: x != "")


def detect_format(lines: Column) -> Column:
    """The format whose number of lines fits and whose length is nearest, at most 3 off."""
    n, longest = F.size(lines), F.array_max(F.transform(lines, F.length))
    off = lambda f: F.abs(longest - LENGTHS[f])
    visa = F.startswith(F.get(lines, 0), F.lit("V"))
    return (
        F.when((n == 3) & (off("TD1") <= 3), "TD1")
        .when((n == 2) & visa & (off("MRV_A") <= 3) & (off("MRV_A") <= off("MRV_B")), "MRV_A")
        .when((n == 2) & visa & (off("MRV_B") <= 3), "MRV_B")
        .when((n == 2) & (off("TD3") <= 3) & (off("TD3") <= off("TD2")), "TD3")
        .when((n == 2) & (off("TD2") <= 3), "TD2")
        .otherwise("unknown")
    )


def by_kind(make) -> Column:
    """A literal map from each format to what ``make`` gives for it."""
    return F.create_map(*[x for kind in LENGTHS for x in (F.lit(kind), make(kind))])


def masks(kind: str) -> Column:
    """For each line of a format a string of m (either), a (letter) and n (digit)."""
    rows = []
    for k in range(3 if kind == "TD1" else 2):
        row = ["m"] * LENGTHS[kind]
        for table, mark in ((ALPHA, "a"), (NUMERIC, "n")):
            for at, lo, hi in table[kind]:
                if at == k:
                    row[lo:hi] = [mark] * (hi - lo)
        rows.append("".join(row))
    return F.array(*map(F.lit, rows))


def spans(parts: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(lo + 1).alias("at"), F.lit(hi - lo).alias("n")) for k, lo, hi in parts))


def normalized(lines: Column, kind: Column) -> Column:
    """Lines cut or filled to length, digits and letters put right where the format knows which stands."""

    def fix(line: Column, mask: Column) -> Column:
        chars = F.split(F.rpad(line, F.length(mask), F.lit("<")), "")
        put = lambda ch, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "n", F.translate(ch, *TO_DIGIT)).when(F.substring(mask, i + 1, F.lit(1)) == "a", F.translate(ch, *TO_ALPHA)).otherwise(ch)
        return F.array_join(F.slice(F.transform(chars, put), F.lit(1), F.length(mask)), "")

    return F.transform(F.try_element_at(by_kind(masks), kind), lambda mask, k: fix(F.get(lines, k), mask))


def bare(c: Column) -> Column:
    return F.nullif(F.replace(c, F.lit("<"), F.lit("")), F.lit(""))


def words(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, "<+", " ")), F.lit(""))


def short_date(c: Column, now_year: int, expiry: bool) -> Column:
    """YYMMDD; a birth that would lie after the current year was a century earlier."""
    y, m, d = (F.substring(c, at, 2).try_cast("int") for at in (1, 3, 5))
    year = 2000 + y if expiry else F.when(2000 + y > now_year, 1900 + y).otherwise(2000 + y)
    return F.when(c.rlike(r"^\d{6}$"), calendar_iso(year, m, d))


def read_zone(lines: Column, kind: Column, now_year: int) -> Column:
    """The parts of all formats are one literal table, so that one expression reads them all."""
    piece = lambda parts: F.array_join(F.transform(parts, lambda p: F.substring(F.get(lines, p["k"]), p["at"], p["n"])), "")
    names = [*VIZ, "optional_data", "name"]
    table = by_kind(lambda k: F.array(*(spans(FIELDS[k][n]) for n in names)))
    digits = by_kind(lambda k: F.array(*(F.struct(F.lit(n).alias("field"), spans(parts).alias("parts"), spans([(at[0], at[1], at[1] + 1)]).alias("at")) for n, (parts, at) in CHECKS[k].items())))
    checks = F.transform(F.try_element_at(digits, kind), lambda c: F.struct(c["field"].alias("field"), piece(c["at"]).alias("expected"), icao_check(piece(c["parts"])).cast("string").alias("computed")))

    def fields(raw: Column) -> Column:
        get = lambda n: F.get(raw, names.index(n))
        return F.struct(
            *(bare(get(n)).alias(n) for n in ("document_type", "issuing_country", "document_number", "nationality")),
            short_date(get("dob"), now_year, False).alias("date_of_birth"), short_date(get("expiry"), now_year, True).alias("date_of_expiry"),
            F.when(get("sex").isin("M", "F", "X"), get("sex")).alias("sex"), bare(get("optional_data")).alias("optional_data"),
            words(F.regexp_replace(get("name"), "<<.*$", "")).alias("surname"), words(F.when(F.contains(get("name"), F.lit("<<")), F.regexp_replace(get("name"), "^.*?<<", ""))).alias("given_names"),
        )

    read = let(F.transform(F.try_element_at(table, kind), piece), fields)
    return let(checks, lambda c: F.struct(kind.alias("format"), lines.alias("lines"), read.alias("fields"), c.alias("checks"), status_of(c).alias("status")))


def status_of(checks: Column) -> Column:
    failed = F.filter(checks, lambda c: c["expected"] != c["computed"])
    return F.when(F.exists(failed, lambda c: c["field"] != OPTIONAL), "invalid").when(F.size(failed) > 0, "partial").otherwise("valid")


def parse_mrz(raw: Column, now_year: int) -> Column:
    """struct<format, lines, fields, checks, status>; null where no format fits."""
    read = lambda lines: let(detect_format(lines), lambda kind: F.when(kind != "unknown", let(normalized(lines, kind), lambda fixed: read_zone(fixed, kind, now_year))))
    return let(clean_lines(raw), read)


def line_score(text: Column) -> Column:
    """How much a line looks like part of a zone, 0 to 1; without fillers 0.4 less."""
    t = F.regexp_replace(text, r"\s", "")
    ratio = F.regexp_count(t, F.lit("[A-Z0-9<]")) / F.length(t)
    return F.when(F.length(t) < 10, 0.0).when(F.contains(t, F.lit("<")), ratio).otherwise(F.greatest(F.lit(0.0), ratio - 0.4))


def is_zone_line(text: Column) -> Column:
    t = F.regexp_replace(text, r"\s", "")
    return (F.length(t) >= 15) & (line_score(text) >= 0.85) & F.contains(t, F.lit("<"))


# --- fields derived from a zone -------------------------------------------------------------------

# Canonical label, printed label, type, field of the zone, its check digit. Names, countries and sex have none.
DERIVED = [
    ("passport_number", "Passport Number", "id_number", "document_number", "document_number"),
    ("full_name", "Full Name", "name", None, None),
    ("surname", "Surname", "name", "surname", None),
    ("given_names", "Given Names", "name", "given_names", None),
    ("nationality", "Nationality", "country", "nationality", None),
    ("date_of_birth", "Date of Birth", "date", "date_of_birth", "date_of_birth"),
    ("sex", "Sex", "text", "sex", None),
    ("date_of_expiry", "Date of Expiry", "date", "date_of_expiry", "expiry_date"),
    ("document_type", "Type", "text", "document_type", None),
    ("country_code", "Country Code", "text", "issuing_country", None),
    ("personal_number", "Personal Number", "id_number", "optional_data", "optional_data"),
]


def literal_names(countries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in (countries or {"": ""}).items() for x in pair])


def derived_fields(zone: Column, countries: dict[str, str] | None = None) -> Column:
    """array<struct<canonical_label, label, value_type, value, confidence, checksum_passed>> of what parse_mrz read; empty for null.

    checksum_passed: of the field's own check digit, null for those that have none: the composite does not cover them either.
    ``countries``: code to name; without a name the code stands. Optional data is a personal number in passports only."""

    def of(z: Column) -> Column:
        f = z["fields"]
        passed = lambda name: F.get(F.transform(F.filter(z["checks"], lambda c: c["field"] == name), lambda c: c["expected"] == c["computed"]), 0)
        whole, out = passed("composite"), []
        for canonical, label, kind, field, check in DERIVED:
            value = F.trim(F.concat_ws(" ", f["given_names"], f["surname"])) if field is None else f[field]
            if kind == "country":
                value = F.coalesce(F.try_element_at(literal_names(countries or {}), value), value)
            if canonical == "personal_number":
                value = F.when(z["format"] == "TD3", value)
            own = passed(check) if check else F.lit(None).cast("boolean")
            sure = F.when(own, 0.99).when(~own, 0.55).when(whole, 0.97).when(~whole, 0.6).otherwise(0.9)
            sure = F.when(z["status"] == "valid", F.greatest(sure, F.lit(0.95))).otherwise(sure)
            out.append(F.struct(F.lit(canonical).alias("canonical_label"), F.lit(label).alias("label"), F.lit(kind).alias("value_type"), F.nullif(F.trim(value), F.lit("")).alias("value"), sure.alias("confidence"), own.alias("checksum_passed")))
        return F.filter(F.array(*out), lambda x: x["value"].isNotNull())

    none = "array<struct<canonical_label:string,label:string,value_type:string,value:string,confidence:double,checksum_passed:boolean>>"
    return F.coalesce(let(zone, lambda z: F.when(z.isNotNull(), of(z))), F.array().cast(none))


# The zone's field under each label that a page box is asked for.
PLACED = {"document_type": "document_type", "country_code": "issuing_country", "issuing_country": "issuing_country", "full_name": "name", "surname": "name", "given_names": "name", "passport_number": "document_number", "document_number": "document_number", "nationality": "nationality", "date_of_birth": "dob", "sex": "sex", "date_of_expiry": "expiry", "personal_number": "optional_data"}


def field_place(kind: Column, label: Column) -> Column:
    """struct<line, from, to> of a field's characters, from 0, to exclusive; null for labels that the format has not."""
    rows = {f"{k}|{name}": FIELDS[k][field][0] for k in LENGTHS for name, field in PLACED.items() if name != "personal_number" or k == "TD3"}
    table = F.create_map(*[x for key, (line, lo, hi) in rows.items() for x in (F.lit(key), F.struct(F.lit(line).alias("line"), F.lit(lo).alias("from"), F.lit(hi).alias("to")))])
    return F.try_element_at(table, F.concat(kind, F.lit("|"), label))


def field_box(kind: Column, label: Column, boxes: Column, lengths: Column) -> Column:
    """struct<x1, y1, x2, y2> of a field on the page, by the share of its characters in the line's box; null where the line is too short.

    boxes: array<struct<x1, y1, x2, y2>>, lengths: array<int>, both by line."""

    def of(p: Column) -> Column:
        box, n = F.get(boxes, p["line"]), F.get(lengths, p["line"])
        x = lambda at: box["x1"] + (box["x2"] - box["x1"]) * at / n
        return F.when((n > 0) & (p["to"] <= n) & box.isNotNull(), F.struct(x(p["from"]).alias("x1"), box["y1"].alias("y1"), x(p["to"]).alias("x2"), box["y2"].alias("y2")))

    return let(field_place(kind, label), of)


def agrees_with_print(kind: Column, value: Column, printed: Column, countries: dict[str, str] | None = None) -> Column:
    """Whether a zone's field says what the page prints. Countries agree by one common code; names of unknown countries agree with nothing."""
    code_of = literal_names({name.upper(): code for code, name in (countries or {}).items()} | {code: code for code in countries or {}})
    codes = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.upper(c), "/"), lambda x: F.try_element_at(code_of, F.trim(x))), lambda x: x.isNotNull()))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"['’\-,]", " "), r"\s+", " "))
    country = let(codes(value), lambda a: let(codes(printed), lambda b: (F.size(a) == 1) & (F.size(b) == 1) & (F.get(a, 0) == F.get(b, 0))))
    date = F.array_contains(parse_date(printed)["candidates"], value)
    same = F.when(kind == "id_number", normalize_id(value) == normalize_id(printed)).when(kind == "date", date).when(kind == "country", country).otherwise(plain(value) == plain(printed))
    return F.coalesce(same, F.lit(False))


# --- repair, one zone at a time -------------------------------------------------------------------

# Pairs of characters that are read for one another.
CONFUSED = [("0", "O"), ("0", "Q"), ("0", "D"), ("1", "I"), ("1", "L"), ("2", "Z"), ("5", "S"), ("6", "G"), ("8", "B"), ("4", "A"), ("7", "T"), ("9", "G")]
BUDGET = 512


def check_digit(text: str) -> int:
    value = lambda ch: int(ch, 36) if ch.isalnum() else 0
    return sum(value(ch) * (7, 3, 1)[i % 3] for i, ch in enumerate(text)) % 10


def failures(lines: list[str], kind: str) -> list[str]:
    cut = lambda parts: "".join(lines[k][lo:hi] for k, lo, hi in parts)
    return [name for name, (parts, (k, at)) in CHECKS[kind].items() if lines[k][at] != str(check_digit(cut(parts)))]


def repair_zone(lines: list[str], kind: str) -> list[str] | None:
    """The lines that one confused character, else one pair, makes valid, if exactly one reading does; None if none or several do,
    or if two parts fail on their own: that is more than a misread character."""
    failed = failures(lines, kind)
    if not failed:
        return lines
    if sum(name != "composite" for name in failed) > 1:
        return None
    spots = sorted({(k, i) for parts, (ck, at) in CHECKS[kind].values() for k, lo, hi in [*parts, (ck, at, at + 1)] for i in range(lo, hi)})
    alts = [(k, i, ch) for k, i in spots for pair in CONFUSED if lines[k][i] in pair for ch in pair if ch != lines[k][i]]
    put = lambda ls, k, i, ch: [x[:i] + ch + x[i + 1 :] if n == k else x for n, x in enumerate(ls)]
    digits = {(k, i) for k, lo, hi in NUMERIC[kind] for i in range(lo, hi)}
    alts = [a for a in alts if (a[0], a[1]) not in digits or a[2].isdigit()]
    for size in (1, 2):
        found, tried = {}, 0
        for combo in itertools.combinations(alts, size):
            if len({(k, i) for k, i, _ in combo}) < size:
                continue
            tried += 1
            if tried > BUDGET:
                return None
            now = lines
            for k, i, ch in combo:
                now = put(now, k, i, ch)
            if not failures(now, kind):
                found["\n".join(now)] = now
        if found:
            return next(iter(found.values())) if len(found) == 1 else None
    return None


@F.pandas_udf(T.StringType())
def repaired_mrz(raw: pd.Series, kind: pd.Series) -> pd.Series:
    """Normalised lines (joined by newlines) after repair; null where the repair is not unique."""

    def one(text, k):
        if text is None or k not in LENGTHS:
            return None
        lines = repair_zone(text.split("\n"), k)
        return "\n".join(lines) if lines else None

    return pd.Series([one(t, k) for t, k in zip(raw, kind)], dtype="object")


# --- parts of a line ------------------------------------------------------------------------------

# Fields of a passport's second line that have a check digit: from, to (its check follows), digits only, least length.
WINDOWS = {"passport_number": (0, 9, False, 5), "date_of_birth": (13, 19, True, 0), "date_of_expiry": (21, 27, True, 0), "personal_number": (28, 42, False, 3)}


def window_value(label: str, data: Column) -> Column:
    """What a field's characters say, null where they cannot be its: dates by fixed century pivots, without a calendar."""
    _, _, digits, least = WINDOWS[label]
    if not digits:
        plain = F.replace(data, F.lit("<"), F.lit(""))
        return F.when(F.length(plain) >= least, plain)
    y, m, d = (F.substring(data, at, 2).try_cast("int") for at in (1, 3, 5))
    pivot = 50 if label == "date_of_birth" else 80
    iso = F.concat(F.when(y >= pivot, "19").otherwise("20"), F.substring(data, 1, 2), F.lit("-"), F.substring(data, 3, 2), F.lit("-"), F.substring(data, 5, 2))
    return F.when(data.rlike(r"^\d{6}$") & m.between(1, 12) & d.between(1, 31), iso)


def partial_fields(fragment: Column, edge: str = "unknown") -> Column:
    """array<struct<label, value>> that a part of a passport's second line proves.

    The part is laid at every place it may have (at one, if it is known to be the line's 'left' or 'right' end that is cut off). A place is
    possible if every whole field there passes its check digit; a value counts if all possible places that show its field agree."""
    size = LENGTHS["TD3"]

    def at(clean: Column, offset: Column) -> Column:
        """Map of the fields at one place; null where the place is impossible."""
        end = offset + F.length(clean)
        reads = []
        for label, (lo, hi, digits, _) in WINDOWS.items():
            inside = (offset <= lo) & (end > hi)
            data, check = F.substring(clean, lo + 1 - offset, F.lit(hi - lo)), F.substring(clean, hi + 1 - offset, F.lit(1))
            value = F.when(check.rlike("^[0-9]$") & (icao_check(data).cast("string") == check) & (data.rlike("^[0-9<]*$") if digits else F.lit(True)), window_value(label, data))
            reads.append(F.struct(F.lit(label).alias("label"), inside.alias("inside"), F.when(inside, value).alias("value")))
        return let(F.array(*reads), lambda r: F.when(F.exists(r, lambda x: x["inside"]) & ~F.exists(r, lambda x: x["inside"] & x["value"].isNull()), F.filter(r, lambda x: x["inside"])))

    def over(clean: Column) -> Column:
        n = F.length(clean)
        offsets = {"left": F.array(size - n), "right": F.array(F.lit(0))}.get(edge, F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))))
        found = F.flatten(F.filter(F.transform(offsets, lambda o: at(clean, o)), lambda x: x.isNotNull()))

        def settled(found: Column) -> Column:
            values = lambda label: F.array_distinct(F.transform(F.filter(found, lambda x: x["label"] == label), lambda x: x["value"]))
            all_fields = F.array(*(F.struct(F.lit(label).alias("label"), values(label).alias("v")) for label in WINDOWS))
            return F.transform(F.filter(all_fields, lambda x: F.size(x["v"]) == 1), lambda x: F.struct(x["label"].alias("label"), F.get(x["v"], 0).alias("value")))

        return F.when((n >= 8) & (n < size), let(found, settled)).otherwise(F.array().cast("array<struct<label:string,value:string>>"))

    return let(F.regexp_replace(F.upper(fragment), "[^A-Z0-9<]", ""), over)
