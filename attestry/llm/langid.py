"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the
sum, over all ways to cut it into pieces, of the product of their probabilities; the forward
algorithm forms that sum position by position, in numpy for thousands of words at once. A text's
score in a language is the sum of its words' logarithms; the prediction is the language with the
highest score, and its posterior under equal priors is reported.

Probabilities are fitted by expectation maximisation (forward and backward sums give each piece's
expected count) on a bounded sample of labelled rows: about ROWS different texts of each language, drawn by a hash
of the text, so that copies count once. Prediction reads the text alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow_map, release, sliced, small_batches, texts, tidy
from .words import SPACES, mix, words

#: Labelled texts of a language in the sample, about; rounds of expectation maximisation; languages that a model may have.
ROWS, ROUNDS, LANGS = 600, 3, 1000
#: Characters of the longest piece a vocabulary may have; characters from which a word's sums are formed in logarithms.
LONGEST, PART = 16, 34
#: Long words, and their characters, that are looked up at once.
LONG, STEP = 64, 4096
#: Added to every piece's expected count; the probability of a character outside the vocabulary.
PRIOR, UNKNOWN = 0.05, 1e-8
#: Distinct words whose scores a worker keeps.
CACHE = 2_000_000
START = "▁"
BASE = np.uint64(0x100000001B3)

BREAKS = SPACES.copy()
BREAKS[[b for b in range(128) if not chr(b).isalpha()]] = True


def letters(word: str) -> list[str]:
    """A word's runs of letters and marks, lower case, each whole."""
    word = unicodedata.normalize("NFC", word).lower()
    runs, now = [], ""
    for ch in word + " ":
        if ch.isalpha() or (now and unicodedata.category(ch)[0] == "M"):
            now += ch
        elif now:
            runs.append(now)
            now = ""
    return [START + r for r in runs]


@dataclass
class Pieces:
    """The vocabulary, findable by hash. Piece number len(names) stands for a character outside it."""

    names: list[str]
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Pieces:
        keys = np.array([int(mix(np.array([hash_of(n)], np.uint64))[0]) for n in names], np.uint64)
        order = np.argsort(keys)
        return cls(names, keys[order], order)

    def tables(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, number): number[k, n, i] is the piece that ends before character i + 1 of word n and has k + 1 characters, or -1."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        wide = int(size.max())
        points = np.frombuffer("".join(p.ljust(wide, "\0") for p in parts).encode("utf-32-le"), "<u4").reshape(len(parts), wide).astype(np.uint64)
        upto = np.zeros((len(parts), wide + 1), np.uint64)
        for i in range(wide):
            upto[:, i + 1] = upto[:, i] * BASE + points[:, i] + np.uint64(1)
        number = np.full((min(max(map(len, self.names)), wide), len(parts), wide), -1, np.int32)
        power = 1
        for k in range(number.shape[0]):
            power = power * int(BASE) & 0xFFFFFFFFFFFFFFFF
            key = mix(upto[:, k + 1 :] - upto[:, : wide - k] * np.uint64(power))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            number[k, :, k:] = np.where(self.keys[at] == key, self.order[at], -1)
        number[0][number[0] < 0] = len(self.names)
        return size, number


def hash_of(text: str) -> np.uint64:
    h = 0
    for ch in text:
        h = (h * int(BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h)


def vocabulary(model_file: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    used = sorted(n for n in names if n == n.lower() and (n == START or n.removeprefix(START).isalpha()))
    if max(map(len, used)) > LONGEST:
        raise ValueError(f"{model_file}: pieces of more than {LONGEST} characters")
    return used


def forward(size: np.ndarray, number: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[i, n, ...]: summed probability of all segmentations of word n's first i characters. p: by piece, 0 at the end."""
    depth, n, wide = number.shape
    alpha = np.zeros((wide + 1, n, *p.shape[1:]))
    alpha[0] = 1
    for i in range(1, wide + 1):
        for k in range(min(depth, i)):
            some = np.flatnonzero(number[k, :, i - 1] >= 0)
            if len(some) == n:
                alpha[i] += alpha[i - k - 1] * p[number[k, :, i - 1]]
            elif len(some):
                alpha[i, some] += alpha[i - k - 1, some] * p[number[k, some, i - 1]]
    return alpha


def log_of(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(0)
    return top + np.log(np.exp(terms - top).sum(0))


def log_forward(words: list[str], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Logarithm of forward's sum for whole words of any length; the state goes on from one STEP of characters to the next."""
    size, depth = np.array([len(w) for w in words]), max(map(len, pieces.names))
    state = np.full((depth, len(words), *logs.shape[1:]), -np.inf)
    state[0] = 0
    out = np.zeros(state.shape[1:])
    for lo in range(0, int(size.max()), STEP):
        back = min(lo, depth - 1)
        _, number = pieces.tables([w[lo - back : lo + STEP] for w in words])
        for i in range(back, number.shape[2]):
            now = log_sum(state[: len(number)] + logs[number[:, :, i]])
            state = np.concatenate([now[None], state[:-1]])
            done = size == lo - back + i + 1
            out[done] = now[done]
    return out


def log_expected(size: np.ndarray, number: np.ndarray, logs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of any length, by forward and backward sums in logarithms."""
    depth, n, wide = number.shape
    row, v = np.arange(n), len(logs)
    alpha, beta = np.full((wide + 1, n), -np.inf), np.full((wide + 1, n), -np.inf)
    alpha[0] = 0
    for i in range(1, wide + 1):
        k = np.arange(min(depth, i))
        alpha[i] = log_sum(alpha[i - k - 1] + logs[number[k, :, i - 1]])
    total = alpha[size, row]
    beta[size, row] = 0
    expected = np.zeros(v)
    for i in range(wide, 0, -1):
        for k in range(min(depth, i)):
            idx = number[k, :, i - 1]
            flow = beta[i] + logs[idx]
            beta[i - k - 1] = np.logaddexp(beta[i - k - 1], flow)
            expected += np.bincount(idx + (idx < 0) * v, np.exp(alpha[i - k - 1] + flow - total) * w, v)
    return expected


def fit(counts: dict[str, int], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language, with the unknown character's and a closing 0."""
    parts = sorted(counts, key=lambda w: (len(w), w))
    weight = np.array([counts[w] for w in parts], float)
    first = sum(len(x) < PART for x in parts)
    blocks = [(pieces.tables(parts[k : min(k + 8192, first)]), weight[k : min(k + 8192, first)]) for k in range(0, first, 8192)]
    v = len(pieces.names)
    p = np.concatenate([np.full(v, 1 / v), [UNKNOWN, 0.0]])
    for _ in range(rounds):
        expected = np.zeros(v + 2)
        for (size, number), w in blocks:
            alpha = forward(size, number, p)
            depth, n, wide = number.shape
            row = np.arange(n)
            total = alpha[size, row]
            beta = np.zeros((wide + 1, n))
            beta[size, row] = 1
            for i in range(wide, 0, -1):
                for k in range(min(depth, i)):
                    some = np.flatnonzero(number[k, :, i - 1] >= 0)
                    if len(some):
                        idx = number[k, some, i - 1]
                        flow = beta[i, some] * p[idx]
                        beta[i - k - 1, some] += flow
                        expected += np.bincount(idx, alpha[i - k - 1, some] * flow * w[some] / total[some], v + 2)
        for k in range(first, len(parts), LONG):
            expected += log_expected(*pieces.tables(parts[k : k + LONG]), log_of(p), weight[k : k + LONG])
        p[:v] = (expected[:v] + PRIOR) / (expected[:v] + PRIOR).sum()
    return p


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    p: np.ndarray  # piece x language, with the rows of the unknown character and of no piece

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """Logarithm of each word's probability in every language; a row of 0 for a word without letters."""
        flat = [(len(x), k, x) for k, xs in enumerate(parts) for x in xs]
        flat.sort(key=lambda t: t[0])
        out = np.zeros((len(parts), len(self.langs)))
        first = sum(size < PART for size, _, _ in flat)
        for lo in range(0, first, 8192):
            some = flat[lo : min(lo + 8192, first)]
            size, number = self.pieces.tables([x for _, _, x in some])
            alpha = forward(size, number, self.p)
            np.add.at(out, [k for _, k, _ in some], np.log(alpha[size, np.arange(len(some))]))
        for lo in range(first, len(flat), LONG):
            some = flat[lo : lo + LONG]
            np.add.at(out, [k for _, k, _ in some], log_forward([x for _, _, x in some], self.pieces, log_of(self.p)))
        return out


def train(docs: DataFrame, model_file: str, lang_col: str = "lang", text_col: str = "text", rows: int = ROWS) -> Model:
    """Fit on rows with a text and a language; without any, a model that predicts nothing. The vocabulary and LANGS bound
    what reaches the driver; a column of more names is none of languages, and is refused."""
    named = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    named = named.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in named.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(LANGS + 1).collect()}
    if len(sizes) > LANGS:
        raise ValueError(f"more than {LANGS} values in {lang_col}")
    langs = sorted(sizes)
    names = vocabulary(model_file)
    pieces = Pieces.of(names)
    if not langs:
        return Model([], pieces, np.zeros((len(names) + 2, 0)))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 31, int(rows / sizes[lang] * (1 << 31)) + 1))).otherwise(share)
    sample = named.filter(F.pmod("h", F.lit(1 << 31)) < share).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches):
        for batch in batches:
            for part in sliced(batch):
                found: dict[str, Counter] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    found.setdefault(lang, Counter()).update(word_bytes(text))
                keys = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for word, n in zip(pdf["word"], pdf["n"]):
            for part in letters(word):
                counts[part] += int(n)
        p = fit(dict(counts), pieces) if counts else np.concatenate([np.full(len(names), 1 / len(names)), [UNKNOWN, 0.0]])
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "p": [p.tolist()]})

    fitted = {r["lang"]: r["p"] for r in counted.groupBy("lang").applyInPandas(fit_one, "lang string, p array<double>").collect()}
    flat = np.concatenate([np.full(len(names), 1 / len(names)), [UNKNOWN, 0.0]])
    return Model(langs, pieces, np.array([fitted.get(lang, flat) for lang in langs]).T.copy())


def word_bytes(text: str) -> list[str]:
    cut = words([text.encode()], lower=True, space=BREAKS)
    data = cut.data.tobytes()
    return [data[s:e].decode() for s, e in zip(cut.start.tolist(), cut.end.tolist())]


class Predictor:
    """(language, posterior, mean logarithm) of texts, with a cache of word scores for the worker that holds it."""

    def __init__(self, model: Model):
        self.model, self.names = model, [*model.langs, "und"]
        self.known, self.kept = np.zeros(0, np.uint64), np.zeros((0, len(model.langs) + 1))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs = self.model.langs
        cut = words([(t or "").encode() for t in texts], lower=True, space=BREAKS)
        keys, first, back = np.unique(cut.hash, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known, self.kept = self.known[:0], self.kept[:0]
        at = np.searchsorted(self.known, keys)
        new = self.known[np.minimum(at, len(self.known) - 1)] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            parts = [letters(cut.bytes_of(i).decode()) for i in first[new].tolist()]
            rows = np.concatenate([self.model.scores(parts), np.array([[len(x)] for x in parts], float)], 1)
            self.known, self.kept = np.insert(self.known, at[new], keys[new]), np.insert(self.kept, at[new], rows, axis=0)
            at = np.searchsorted(self.known, keys)
        rows = self.kept[at]
        total = np.stack([cut.per_doc(rows[back, k]) for k in range(rows.shape[1])], 1)
        logs, n = total[:, :-1], total[:, -1]
        some = (n > 0.5) & bool(langs)
        best = np.full(len(n), len(langs))
        score, mean = np.zeros(len(n)), np.zeros(len(n))
        if some.any():
            best[some] = logs[some].argmax(1)
            top = logs[some].max(1)
            score[some] = 1 / np.exp(logs[some] - top[:, None]).sum(1)
            mean[some] = top / n[some]
        return [self.names[b] for b in best], score, mean


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, fit) of every row: the language, its posterior, and the mean logarithm of a word's
    probability in it. A text that is null or has no letter is 'und' with score 0 and fit 0. Of languages of equal
    posterior the first by name is predicted. Texts of any length are read whole; repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored, so their names cannot clash."""

    def make():
        tell = Predictor(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, mean = tell(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(mean)], ["doc_id", "lang_pred", "score", "fit"])

        return step

    return arrow_map(texts(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double, fit double")


def told(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """docs, all columns, whose language is told with a posterior of at least ``least``. Only the texts travel to Python."""

    @F.pandas_udf("boolean")
    def sure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tell = Predictor(model)
        for batch in batches:
            out = []
            for part in text_slices(batch.tolist()):
                lang, score, _ = tell(part)
                out += [name != "und" and s >= least for name, s in zip(lang, score)]
            yield pd.Series(out, dtype=bool)
        release()

    small_batches(docs.sparkSession)
    return docs.filter(sure(F.col(text_col)))


def text_slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if size >= SLICE_BYTES:
            yield now
            now, size = [], 0
    if now:
        yield now


def held_out(doc_id):
    """Rows kept out of the fit: crc32 of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
