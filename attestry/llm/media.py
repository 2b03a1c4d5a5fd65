"""Media columns: payloads stored as PNG images in a binary column, read back and hashed.

Writing: 8-bit grey samples, 64 to a row, each row under the filter (none, sub or up) with the least
sum of absolute differences, zlib stream cut into IDAT chunks of bounded size, a CRC on every chunk.
Reading: every chunk's CRC and zlib's own checksum are tested, then the rows are unfiltered in numpy
(runs of rows under one filter at a time; all five filters). The feature is the sign pattern of the
8 x 8 lowest frequencies of a cosine transform of the image brought to 32 x 32 means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts

WIDTH = 64
#: Bytes of zlib stream in one IDAT chunk.
IDAT = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with their filter byte in front."""
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tries = np.stack([rows, rows - left, rows - above])
    cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(2)
    kind = cost.argmin(0)
    return np.concatenate([kind[:, None].astype(np.uint8), tries[kind, np.arange(len(rows))]], 1)


def write_png(payload: bytes, level: int = 1) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    stream = zlib.compress(filtered(rows).tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", stream[k : k + IDAT]) for k in range(0, len(stream), IDAT)) + chunk(b"IEND", b"")


def chunks(media: bytes):
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"checksum of chunk {kind!r} at byte {at}")
        yield kind, body
        at += 12 + size


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        kind = kinds[lo]
        run = out[lo:hi]
        above = out[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=run)
        elif kind == 2:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kind in (3, 4):
            for y in range(len(run)):
                a = c = 0
                for x in range(rows.shape[1]):
                    b = int(above[x])
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    a, c = (int(run[y, x]) + guess) & 255, b
                    run[y, x] = a
                above = run[y]
        elif kind:
            raise ValueError(f"row filter {kind}")
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples, rows x width. ValueError where a checksum, a size or a filter is wrong."""
    stream, shape, ended = [], None, False
    for kind, body in chunks(media):
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError(f"unsupported header {rest}")
            shape = (height, width)
        elif kind == b"IDAT":
            stream.append(body)
        ended |= kind == b"IEND"
    if shape is None or not ended:
        raise ValueError("a chunk is missing")
    rows = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    if rows.size != shape[0] * (shape[1] + 1):
        raise ValueError("image size")
    rows = rows.reshape(shape[0], shape[1] + 1)
    return unfiltered(rows[:, 0], rows[:, 1:])


def cosines() -> np.ndarray:
    n = np.arange(SIDE)
    return np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def thumbnail(image: np.ndarray) -> np.ndarray:
    """SIDE x SIDE means; an image of fewer rows repeats them."""
    height, width = image.shape
    wide = image.reshape(height, SIDE, width // SIDE).mean(2)
    if height < SIDE:
        return wide[np.arange(SIDE) * height // SIDE]
    edges = np.arange(SIDE) * height // SIDE
    return np.add.reduceat(wide, edges, axis=0) / np.diff([*edges, height])[:, None]


def cosine_hashes(images: list[np.ndarray]) -> list[str]:
    """64 bits of each image, as 16 hex digits: which low frequencies lie above their median."""
    if not images:
        return []
    c = cosines()
    low = (c @ np.stack([thumbnail(x) for x in images]) @ c.T).reshape(len(images), -1).round(6)
    bits = low > np.median(low[:, 1:], axis=1)[:, None]
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def padded(data: bytes) -> bytes:
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with zero bytes to a positive multiple of 64, as a PNG.

    A null text is stored as an empty one: 64 zero bytes. Rows are neither merged nor dropped, so repeated rows give
    repeated rows and an empty table an empty result; texts of any length are stored whole; other columns are ignored,
    so their names cannot clash."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [t.encode() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, parts)), pa.int64()), pa.array([write_png(padded(p)) for p in parts], pa.binary())], ["doc_id", "n_bytes", "media"])

        return step

    return arrow_map(texts(docs, id_col, text_col), make, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: digests of the payload read back, of the stored form, and the feature.

    Media whose checksums fail raise; a null medium gives nulls."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = batch.column("media").to_pylist()
            images = [None if m is None else read_png(m) for m in media]
            payloads = [None if x is None else x.tobytes() for x in images]
            hashes = iter(cosine_hashes([x for x in images if x is not None]))
            null = lambda f, xs: [None if x is None else f(x) for x in xs]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array(null(len, payloads), pa.int64()),
                    pa.array(null(sha, payloads), pa.string()),
                    pa.array(null(lambda x: zlib.crc32(x[-64:]), payloads), pa.int64()),
                    pa.array(null(len, media), pa.int64()),
                    pa.array(null(sha, media), pa.string()),
                    pa.array(null(lambda _: next(hashes), images), pa.string()),
                ],
                [f.split()[0] for f in READ.split(", ")],
            )

        return step

    return arrow_map(stored, make, READ)
