"""Pixel arithmetic on luma grids held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grid_means(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means of the cells of a high x wide grid; a cell without pixels is 0."""
    rows, cols = pixels.shape
    cell = (np.arange(rows) * high // rows)[:, None] * wide + (np.arange(cols) * wide // cols)[None, :]
    n = np.bincount(cell.ravel(), minlength=high * wide)
    return (np.bincount(cell.ravel(), pixels.ravel().astype(float), high * wide) / np.maximum(n, 1)).reshape(high, wide)


def dhash(pixels: np.ndarray) -> str:
    """64 bits, as 16 hexadecimal digits: where a cell of 8 x 9 is lighter than its right neighbour."""
    g = grid_means(pixels, 8, 9)
    return np.packbits(g[:, :-1] > g[:, 1:]).tobytes().hex()


@F.pandas_udf(T.StringType())
def dhash64(luma: pd.Series, width: pd.Series) -> pd.Series:
    """The hash of a row-wise luma array of the given width; null where the size is no rectangle."""

    def one(values, w):
        if values is None or not w or len(values) % w or not len(values):
            return None
        return dhash(np.asarray(values, float).reshape(-1, int(w)))

    return pd.Series([one(v, w) for v, w in zip(luma, width)], dtype="object")
