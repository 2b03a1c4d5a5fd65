"""Machine-readable zones read from recognition lattices: check digits steer the beam, and what they cannot see stays in doubt.

A zone comes as one lattice for each printed line. It is refused (null) where no text of a format passes its checks, where
that text is too far from what the lattice says, or where a clear print contradicts a computed check digit.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F

from attestry.functions import mrz

from .decode import beam, entries, span_posterior, spelled

BREAK, FILLER = "\n", "<"
DIGITS = frozenset("0123456789<")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ<")
# Formats tried by number of lines, in order.
KINDS = {2: ["TD3", "TD2"], 3: ["TD1"]}
# Log-probability below the lattice's best at which a text is invented; characters a line may read too long.
GAP, EXCESS = -20.0, 2
# Posterior of a printed digit that contradicts the computed one, and how much weaker that one's must be.
PRINTED, WEAKER = 0.85, 0.25
# A rival's share of the chosen probability; least posterior where checks are blind; least mean of a field.
RIVAL, BLIND, SPAN = 0.43, 0.85, 0.45

DOUBTS = "array<struct<field:string,place:int,chosen:string,alternative:string,ratio:double,kind:string>>"
DOUBT = pa.struct([("field", pa.string()), ("place", pa.int32()), ("chosen", pa.string()), ("alternative", pa.string()), ("ratio", pa.float64()), ("kind", pa.string())])
OUT = pa.struct([("format", pa.string()), ("zone", pa.string()), ("logp", pa.float64()), ("doubts", pa.list_(DOUBT))])


def alike(a: str, b: str) -> bool:
    """Whether a check digit cannot tell two characters apart: values equal modulo 10."""
    value = lambda ch: 0 if ch == FILLER else int(ch, 36)
    return a != b and (value(a) - value(b)) % 10 == 0


class ZoneGrammar:
    """Lines of one format joined by BREAK. State: characters so far without breaks, and the number of breaks."""

    def __init__(self, kind: str):
        self.width, self.lines = mrz.LENGTHS[kind], 3 if kind == "TD1" else 2
        self.size = self.width * self.lines
        flat = lambda k, i: k * self.width + i
        self.allowed = [DIGITS | LETTERS] * self.size
        for places, allowed in ((mrz.ALPHA[kind], LETTERS), (mrz.NUMERIC[kind], DIGITS)):
            for k, lo, hi in places:
                self.allowed[flat(k, lo) : flat(k, hi)] = [allowed] * (hi - lo)
        self.checks = {flat(*at): (name, [(flat(k, lo), flat(k, hi)) for k, lo, hi in parts]) for name, (parts, at) in mrz.CHECKS[kind].items()}
        self.pairs = {}  # place of a date's second month or day digit: the largest number
        for name in ("dob", "expiry"):
            k, lo, _ = mrz.FIELDS[kind][name][0]
            self.pairs |= {flat(k, lo) + 3: 12, flat(k, lo) + 5: 31}

    def covered(self, text: str, place: int) -> str:
        return "".join(text[lo:hi] for lo, hi in self.checks[place][1])

    def start(self) -> tuple[str, int]:
        return ("", 0)

    def step(self, state: tuple[str, int], ch: str) -> tuple[str, int] | None:
        text, breaks = state
        at = len(text)
        due = 0 < at < self.size and at == self.width * (breaks + 1)
        if ch == BREAK:
            return (text, breaks + 1) if due else None
        if due or at == self.size or not self.fits(text, at, ch):
            return None
        return (text + ch, breaks)

    def fits(self, text: str, at: int, ch: str) -> bool:
        if at in self.checks:
            data = self.covered(text, at)
            unused = self.checks[at][0] == mrz.OPTIONAL and not data.strip(FILLER)
            return ch == str(mrz.check_digit(data)) or (unused and ch == FILLER)
        if ch not in self.allowed[at]:
            return False
        if at + 1 in self.pairs:
            return ch == FILLER or int(ch) <= self.pairs[at + 1] // 10
        if at in self.pairs and ch != FILLER and text[-1] != FILLER:
            return 1 <= int(text[-1] + ch) <= self.pairs[at]
        return True

    def accepts(self, state: tuple[str, int]) -> bool:
        return len(state[0]) == self.size and state[1] == self.lines - 1


def doubts_of(grammar: ZoneGrammar, text: str, seen: list[tuple[int, float]], steps: list) -> list[dict]:
    """Places of checked fields where another text would pass the same checks: a likely rival, a weak read, or a whole weak field."""
    out = []
    for name, parts in grammar.checks.values():
        if name == "composite":
            continue
        places = [i for lo, hi in parts for i in range(lo, hi) if i not in grammar.checks]
        mean = span_posterior([seen[i][1] for i in places])
        if mean < SPAN:
            out.append({"field": name, "place": places[0], "chosen": "".join(text[i] for i in places), "alternative": "", "ratio": mean, "kind": "weak_span"})
            continue
        for i in places:
            at, p = seen[i]
            same = [ch for ch in sorted(grammar.allowed[i]) if alike(ch, text[i])]
            near = [(ch, q / p) for ch, q in steps[at] if ch in same and q >= RIVAL * p]
            if not near and p < BLIND and same:
                out.append({"field": name, "place": i, "chosen": text[i], "alternative": same[0], "ratio": 0.0, "kind": "low_posterior"})
            out += [{"field": name, "place": i, "chosen": text[i], "alternative": ch, "ratio": ratio, "kind": "near_tie"} for ch, ratio in near]
    return out


def contradicted(grammar: ZoneGrammar, seen: list[tuple[int, float]], text: str, steps: list) -> bool:
    """Whether another digit stands clearly printed where a check digit was computed."""
    for place in grammar.checks:
        at, p = seen[place]
        top, q = max(steps[at], key=lambda e: e[1])
        if top != text[place] and top.isdigit() and q >= PRINTED and p < WEAKER * q:
            return True
    return False


def greedy_length(steps: list) -> int:
    best = [max(step, key=lambda e: e[1])[0] for step in steps]
    return sum(ch != "" and (i == 0 or ch != best[i - 1]) for i, ch in enumerate(best))


def decode_zone(lines: list[list[list[tuple[str, float]]]], width: int = 50) -> dict | None:
    """format, zone (lines joined by newlines), logp and doubts of the first format that gives a provable text."""
    steps = []
    for k, line in enumerate(lines):
        steps += [[(BREAK, 1.0)]] * (k > 0) + list(line)
    for kind in KINDS.get(len(lines), []):
        grammar = ZoneGrammar(kind)
        if sum(map(len, lines)) < grammar.size or any(greedy_length(line) > grammar.width + EXCESS for line in lines):
            continue
        found = beam(steps, grammar, width)
        ceiling = sum(math.log(max(p for _, p in step)) for step in steps) if found else 0.0
        if not found or found[0][1] - ceiling < GAP:
            continue
        zone, logp = found[0]
        seen = [place for place, ch in zip(spelled(steps, zone), zone) if ch != BREAK]
        text, rows = zone.replace(BREAK, ""), zone.split(BREAK)
        # A second opinion by the parser's own rules; an unused optional part may have a filler for its check.
        if contradicted(grammar, seen, text, steps) or set(mrz.failures(rows, kind)) - {mrz.OPTIONAL}:
            continue
        return {"format": kind, "zone": zone, "logp": logp, "doubts": doubts_of(grammar, text, seen, steps)}
    return None


def zone_decoder(width: int = 50):
    """A vectorised function from array<lattice> (a lattice for each line) to struct<format, zone, logp, doubts>; nulls where refused."""

    @F.arrow_udf(f"struct<format:string,zone:string,logp:double,doubts:{DOUBTS}>")
    def decode(zones: pa.Array) -> pa.Array:
        rows = []
        for zone in zones.to_pylist():
            lines = [entries(line) for line in zone or []]
            usable = lines and all(line and all(step and max(p for _, p in step) > 0 for step in line) for line in lines)
            rows.append((decode_zone(lines, width) if usable else None) or dict.fromkeys(("format", "zone", "logp", "doubts")))
        return pa.array(rows, OUT)

    return decode
