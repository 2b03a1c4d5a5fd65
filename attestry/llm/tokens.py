"""Token counts by overlap resynchronisation.

A huge document is encoded, with offsets, in chunks that overlap. Two neighbouring chunks are spliced at a place that
lies in both and where both begin a token behind a proven edge: a letter or digit before a character of another kind,
or any character before white space, which no pre-token of the byte-level pattern crosses whatever stands around it.
The ids between the first and the last such place must be the same. Where the overlap holds no common edge, it is
doubled, down to the last settled place; where that is not enough, the two chunks become one and the next is longer
than both, so that text without any edge costs its length a constant number of times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe
from .common import arrow_map, texts
from .words import BLOCK

#: Bytes from which a document is cut; characters of a chunk and of the overlap that is tried first.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 1 << 8
#: Places behind which a pre-token surely ends: the kinds are letters, digits, white space and the rest.
EDGE = regex.compile(r"(?<=\p{L})[^\p{L}]|(?<=\p{N})[^\p{N}]|(?<=[^\s])\s")


class Chunk:
    """Characters begin to end of a text: ids, and the proven edges at which a token begins (characters of the text, tokens before each)."""

    def __init__(self, library, text: str, begin: int, end: int):
        encoded = library.encode(text[begin:end], add_special_tokens=False)
        self.ids, self.begin, self.end = np.array(encoded.ids, np.int64), begin, end
        spans = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        edges = np.fromiter((m.start() for m in EDGE.finditer(text, begin, end, overlapped=True)), np.int64) - begin
        at = np.searchsorted(spans[:, 0], edges)
        clean = (at > 0) & (at < len(spans))
        edges, at = edges[clean], at[clean]
        clean = (spans[at, 0] == edges) & (spans[at - 1, 1] == edges)
        self.edges, self.before = edges[clean] + begin, at[clean]


def splice(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one huge text."""
    total, settled, skipped = 0, 0, 0  # tokens before the settled place; tokens of the open chunk before it
    least, left = chunk, Chunk(library, text, 0, chunk)
    while left.end < len(text):
        wide = overlap
        end = left.end + chunk
        edges = left.edges[left.edges > settled]
        while len(edges):
            begin = max(settled, min(left.end - wide, int(edges[-1]) - overlap))
            right = Chunk(library, text, begin, end)
            common, i, j = np.intersect1d(left.edges, right.edges, return_indices=True)
            if len(common):
                a, b = left.before[i], right.before[j]
                if np.array_equal(left.ids[a[0] : a[-1]], right.ids[b[0] : b[-1]]):
                    total += int(a[-1]) - skipped
                    settled, skipped, left, chunk = int(common[-1]), int(b[-1]), right, least
                    break
            if begin == settled:
                edges = edges[:0]  # all there is
            wide *= 2
        else:  # both become one, and the next one is three times as long
            chunk = 3 * (end - settled)
            left, skipped = Chunk(library, text, settled, end), 0
    return total + len(left.ids) - skipped


def counts(encoder: bpe.Bpe, parts: list[bytes], huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    out = np.zeros(len(parts), np.int64)
    small, held = [], 0

    def flush() -> None:
        nonlocal small, held
        if small:
            out[small] = encoder.encode([parts[k] for k in small]).counts()
        small, held = [], 0

    for k, data in enumerate(parts):
        if len(data) > huge:
            out[k] = splice(encoder.library, data.decode(), chunk, overlap)
            continue
        small.append(k)
        held += len(data) + 1
        if held > BLOCK:
            flush()
    flush()
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and tokens. Texts of any length are counted whole, in time in proportion to it.
    Repeated rows give repeated rows; an empty table gives an empty result. Other columns
    are ignored, so their names cannot clash. ``tokenizer``: path of a byte-level .json file.
    """

    def make():
        encoder = bpe.load(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [t.encode() for t in batch.column("text").to_pylist()]
            tokens = counts(encoder, parts)
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return arrow_map(texts(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
