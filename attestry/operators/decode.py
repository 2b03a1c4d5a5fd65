"""Decoding of recognition lattices: greedy, and beams under a grammar.

A lattice is array<array<struct<ch, p>>>: the most probable characters of each step, '' for blank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LATTICE = "array<array<struct<ch:string,p:double>>>"


def top_k(step: Column, k: int = 5) -> Column:
    """The k most probable entries of a step, the earlier first among equals."""
    ranked = F.array_sort(F.transform(step, lambda e, i: F.struct((-e["p"]).alias("np"), i.alias("i"), e["ch"].alias("ch"), e["p"].alias("p"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["ch"].alias("ch"), e["p"].alias("p")))


def valid_lattice(lattice: Column) -> Column:
    """Every step has entries, probabilities in 0..1, in descending order."""
    fine = lambda s: (F.size(s) > 0) & F.forall(s, lambda e: e["p"].between(0, 1)) & F.forall(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i)["p"] <= F.get(s, i - 1)["p"], F.lit(True)))
    return (F.size(lattice) > 0) & F.forall(lattice, fine)


def greedy(lattice: Column) -> Column:
    """struct<text, confidence>: the best entry of each step, repeats merged, blanks dropped; the mean of what was emitted."""
    best = F.transform(lattice, lambda s: F.get(s, 0))
    emitted = F.filter(F.transform(best, lambda e, i: F.struct(e["ch"].alias("ch"), e["p"].alias("p"), (e["ch"] == F.get(F.transform(lattice, lambda s: F.get(s, 0)), i - 1)["ch"]).alias("again"))), lambda e: (e["ch"] != "") & ~F.coalesce(e["again"], F.lit(False)))
    total = F.aggregate(emitted, F.lit(0.0), lambda a, e: a + e["p"])
    return F.struct(F.array_join(F.transform(emitted, lambda e: e["ch"]), "").alias("text"), F.when(F.size(emitted) > 0, total / F.size(emitted)).otherwise(0.0).alias("confidence"))


class Grammar(Protocol):
    """A set of allowed texts, walked one character at a time."""

    def start(self) -> object: ...
    def step(self, state: object, ch: str) -> object | None: ...
    def accepts(self, state: object) -> bool: ...


class Positional:
    """One set of characters for each place."""

    def __init__(self, places: list[str]):
        self.places = [frozenset(p) for p in places]

    def start(self) -> int:
        return 0

    def step(self, state: int, ch: str) -> int | None:
        return state + 1 if state < len(self.places) and ch in self.places[state] else None

    def accepts(self, state: int) -> bool:
        return state == len(self.places)


class OneOf:
    """One of some texts."""

    def __init__(self, texts: Iterable[str]):
        self.texts = frozenset(texts)
        self.starts = frozenset(t[:k] for t in self.texts for k in range(len(t) + 1))

    def start(self) -> str:
        return ""

    def step(self, state: str, ch: str) -> str | None:
        return state + ch if state + ch in self.starts else None

    def accepts(self, state: str) -> bool:
        return state in self.texts


class Checked:
    """Texts of a grammar that a predicate accepts in the end: a checksum as a constraint."""

    def __init__(self, inner, valid: Callable[[str], bool]):
        self.inner, self.valid = inner, valid

    def start(self):
        return (self.inner.start(), "")

    def step(self, state, ch: str):
        inner = self.inner.step(state[0], ch)
        return None if inner is None else (inner, state[1] + ch)

    def accepts(self, state) -> bool:
        return self.inner.accepts(state[0]) and self.valid(state[1])


DIGITS = "0123456789"


def date_grammar() -> Checked:
    """dd/mm/yyyy that a calendar may hold."""
    return Checked(Positional(["0123", DIGITS, "/.-", "01", DIGITS, "/.-", "12", DIGITS, DIGITS, DIGITS]), lambda t: 1 <= int(t[:2]) <= 31 and 1 <= int(t[3:5]) <= 12 and t[2] == t[5])


def sex_grammar() -> OneOf:
    return OneOf("MFX")


def entries(lattice: list | None) -> list[list[tuple[str, float]]]:
    """A lattice as it comes from a row; none for null."""
    return [[(e["ch"], e["p"]) for e in step] for step in lattice or []]


def beam(lattice: list[list[tuple[str, float]]], grammar, width: int = 50, prior: Callable[[str, int], float] | None = None) -> list[tuple[str, float]]:
    """Accepted texts with their log-probability, best first: paths that spell the same text with the same last symbol are summed.

    ``prior(ch, step)`` weighs every symbol of a path, blanks and repeats as well, for the ranking of the beam only; it
    never changes a reported probability."""
    beams: dict[tuple[str, str], tuple[float, float, object]] = {("", ""): (0.0, 0.0, grammar.start())}
    for at, step in enumerate(lattice):
        now: dict[tuple[str, str], tuple[float, float, object]] = {}
        for (text, last), (lp, rank, state) in beams.items():
            for ch, p in step:
                if p <= 0:
                    continue
                if ch == "" or ch == last:
                    key, to = (text, ch), state
                else:
                    to = grammar.step(state, ch)
                    if to is None:
                        continue
                    key = (text + ch, ch)
                add = lp + math.log(p)
                score = rank + math.log(p) + (math.log(prior(ch, at)) if prior else 0.0)
                old = now.get(key)
                now[key] = (add, score, to) if old is None else (log_add(old[0], add), log_add(old[1], score), to)
        beams = dict(sorted(now.items(), key=lambda kv: (-kv[1][1], kv[0]))[:width])
    out: dict[str, float] = {}
    for (text, _), (lp, _, state) in beams.items():
        if grammar.accepts(state):
            out[text] = log_add(out[text], lp) if text in out else lp
    return sorted(out.items(), key=lambda kv: (-kv[1], kv[0]))


def spelled(lattice: list[list[tuple[str, float]]], text: str) -> list[tuple[int, float]]:
    """For each character of a text the step that shows it best, and its probability there, on the likeliest path that spells the text."""
    slots = ["", *(x for ch in text for x in (ch, ""))]  # a blank may stand before, between and after the characters
    log = lambda step, ch: max((math.log(p) for c, p in step if c == ch and p > 0), default=-math.inf)
    best, back = [-math.inf] * len(slots), []
    for t, step in enumerate(lattice):
        seen = {ch: log(step, ch) for ch in set(slots)}
        now, came = [], []
        for j, ch in enumerate(slots):
            ways = [j, *([j - 1] if j else []), *([j - 2] if j > 1 and ch not in ("", slots[j - 2]) else [])]
            k = max(ways, key=lambda i: best[i]) if t else j
            now.append((best[k] if t else (0.0 if j < 2 else -math.inf)) + seen[ch])
            came.append(k)
        best = now
        back.append(came)
    at = max(range(max(0, len(slots) - 2), len(slots)), key=lambda j: best[j])
    found: dict[int, tuple[int, float]] = {}
    for t in range(len(lattice) - 1, -1, -1):
        if slots[at]:
            p = math.exp(log(lattice[t], slots[at]))
            if p > found.get(at, (0, -1.0))[1]:
                found[at] = (t, p)
        at = back[t][at]
    return [found.get(2 * i + 1, (0, 0.0)) for i in range(len(text))]


def span_posterior(probabilities: list[float]) -> float:
    """The geometric mean of a span's characters; 0 for none."""
    return math.exp(sum(math.log(max(p, 1e-9)) for p in probabilities) / len(probabilities)) if probabilities else 0.0


#: Fixed value: mean posterior under which a text read again under a grammar is no reading.
READ_FLOOR = 0.45


def redecoder(make: Callable[[], object], width: int = 50, floor: float = READ_FLOOR):
    """A vectorised function from lattices to the text that a grammar finds there; null where it finds none or only a weak one."""

    @F.arrow_udf("string")
    def decode(lattices: pa.Array) -> pa.Array:
        grammar, out = make(), []
        for steps in map(entries, lattices.to_pylist()):
            found = beam(steps, grammar, width) if steps else []
            text = found[0][0] if found else None
            sure = text is not None and span_posterior([p for _, p in spelled(steps, text)]) >= floor
            out.append(text if sure else None)
        return pa.array(out, pa.string())

    return decode


def log_add(a: float, b: float) -> float:
    hi, lo = max(a, b), min(a, b)
    return hi + math.log1p(math.exp(lo - hi))


def beam_decoder(make: Callable[[], object], width: int = 50):
    """A vectorised function from lattices to struct<text, logp, runner_up> under a grammar; null text where nothing is accepted."""

    @F.arrow_udf("struct<text:string,logp:double,runner_up:string>")
    def decode(lattices: pa.Array) -> pa.Array:
        grammar, rows = make(), []
        for steps in map(entries, lattices.to_pylist()):
            found = beam(steps, grammar, width) if steps else []
            best = found[0] if found else (None, None)
            rows.append({"text": best[0], "logp": best[1], "runner_up": found[1][0] if len(found) > 1 else None})
        return pa.array(rows, pa.struct([("text", pa.string()), ("logp", pa.float64()), ("runner_up", pa.string())]))

    return decode


def projected(lattice: Column, alphabet: str) -> Column:
    """A lattice on an alphabet: upper-case forms are summed, others dropped, blanks kept."""
    fold = lambda s: F.transform(F.filter(s, lambda e: (e["ch"] == "") | F.contains(F.lit(alphabet), F.upper(e["ch"]))), lambda e: F.struct(F.upper(e["ch"]).alias("ch"), e["p"].alias("p")))

    def summed(s: Column) -> Column:
        kinds = F.array_distinct(F.transform(s, lambda e: e["ch"]))
        return F.transform(kinds, lambda ch: F.struct(ch.alias("ch"), F.aggregate(F.filter(s, lambda e: e["ch"] == ch), F.lit(0.0), lambda a, e: a + e["p"]).alias("p")))

    return F.transform(lattice, lambda s: top_k(summed(fold(s))))
