"""Cached byte-pair encoding, equal to the tokenizers library.

Neither supported pre-tokenizer lets a token cross from a non-space character to a following space,
so a text is cut there into units whose ids do not depend on their neighbours. Units repeat far more
often than texts: a bounded cache from a unit's 64-bit hash to its ids does most of the work, and
new units are merged a batch at a time in numpy. Units outside a plain character range go to the library.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np
import regex

from .words import Words, units, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept in a worker's cache before it is emptied (about 40 bytes each).
CACHE_UNITS = 2_000_000
#: Longer words are merged by the library.
LONGEST = 64
NO_PAIR = np.int32(2**31 - 1)

#: Stands between units while several are split at once.
MARK = b"\xff" * 4
# The split patterns of the two public tokenizer files, with a zero byte kept apart.
BYTE_SPLIT = r"\x00|'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x00]+"

PLAIN = re.compile("[\0\t\n\r\x20-\x7eÀ-ɏ]*")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.keeps_space = not suffix
        self.split = regex.compile(WORD_SPLIT if suffix else BYTE_SPLIT)
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.empty()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word: lowest rank first, leftmost at ties."""
        out: list[bytes] = [b""] * len(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= LONGEST).sum())
        for r in order[short:].tolist():
            out[r] = self.plainly(tokens[r].decode())
        order = order[:short]
        for lo in range(0, short, 1 << 14):
            rows = order[lo : lo + (1 << 14)]
            size = lengths[rows]
            wide = int(size.max())
            raw = np.frombuffer(b"".join(tokens[r].ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
            ids = self.first[raw]
            ids[np.arange(len(rows)), size - 1] = self.last[raw[np.arange(len(rows)), size - 1]]
            ids[np.arange(wide) >= size[:, None]] = -1
            ids = self.merge_rows(ids)
            keep = ids >= 0
            ends = np.cumsum(keep.sum(1)) * 4
            flat, start = ids[keep].astype("<u4").tobytes(), 0
            for r, end in zip(rows.tolist(), ends.tolist()):
                out[r] = flat[start:end]
                start = end
        return out

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        done, live = ids.copy(), np.arange(len(ids))
        if ids.shape[1] < 2:
            return done
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            going = best < NO_PAIR
            if not going.all():
                done[live[~going]] = -1
                done[live[~going], : ids.shape[1]] = ids[~going]
                live, ids, rank, at, best = live[going], ids[going], rank[going], at[going], best[going]
                if not len(live):
                    break
            n, wide = ids.shape
            row = np.arange(n)
            ids[row, at] = self.merged[best]
            cols = np.arange(wide - 1)
            keep = cols + (cols > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            if wide - 1 < 2:
                rank = np.full((n, 1), NO_PAIR, np.int32)
                ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1)
                continue
            cols = np.arange(wide - 2)
            rank = np.take_along_axis(rank, cols + (cols > at[:, None]), 1)
            here, before = at < wide - 2, at > 0
            rank[row[here], at[here]] = self.rank_of(ids[row[here], at[here]], ids[row[here], at[here] + 1])
            rank[row[before], at[before] - 1] = self.rank_of(ids[row[before], at[before] - 1], ids[row[before], at[before]])
        return done

    def learn(self, units: list[bytes]) -> list[bytes]:
        """The ids of new units; plain ones are split together and their words merged together."""
        plain = [k for k, u in enumerate(units) if u and u[-1] > 32]
        text = "\0".join([units[k].decode() for k in plain])
        if not PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            plain = [k for k in plain if PLAIN.fullmatch(t := units[k].decode()) and not any(s in t for s in self.specials)]
            text = "\0".join([units[k].decode() for k in plain])
        pieces = self.split.findall(text if self.keeps_space else text.lower())
        known = dict.fromkeys(pieces)
        known.pop("\0", None)
        known = dict(zip(known, self.merge([w.encode() for w in known])))
        known["\0"] = MARK
        blob = b"".join(map(known.__getitem__, pieces)) + MARK
        ends = (np.flatnonzero(np.frombuffer(blob, "<u4") == 0xFFFFFFFF) * 4).tolist()
        out: list[bytes | None] = [None] * len(units)
        for k, s, e in zip(plain, [0, *(e + 4 for e in ends[:-1])], ends):
            out[k] = blob[s:e]
        return [self.plainly(u.decode()) if x is None else x for u, x in zip(units, out)]

    def plainly(self, text: str) -> bytes:
        """The library's own ids."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, parts: list[bytes]) -> Encoded:
        cut = units(parts) if self.keeps_space else words(parts)
        keys, first, back = np.unique(cut.hash, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self.empty()
        at = np.searchsorted(self.known, keys)
        new = self.known[np.minimum(at, len(self.known) - 1)] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            ids = self.learn([cut.bytes_of(i) for i in first[new].tolist()])
            count = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
            start = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
            self.known, self.start, self.count = (np.insert(x, at[new], y) for x, y in ((self.known, keys[new]), (self.start, start), (self.count, count)))
            at = np.searchsorted(self.known, keys)
        return Encoded(cut, self.count[at][back], self.start[at][back], self.ids)

    def empty(self) -> None:
        self.known, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")


@dataclass
class Encoded:
    """Ids of a batch: unit i of ``units`` has ids[start[i]:start[i]+count[i]]."""

    units: Words
    count: np.ndarray
    start: np.ndarray
    ids: np.ndarray

    def counts(self) -> np.ndarray:
        return self.units.per_doc(self.count)

    def flat(self) -> np.ndarray:
        """Little-endian 32-bit ids of all texts, one after another."""
        ends = np.cumsum(self.count)
        shift = np.repeat(self.start - (ends - self.count), self.count)
        return self.ids[np.arange(len(shift)) + shift]


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder, with its cache, for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
