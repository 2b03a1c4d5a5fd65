"""Boxes as four columns or structs x1, y1, x2, y2 in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Column


def box(x1, y1, x2, y2) -> Box:
    cast = lambda c: (F.lit(c) if not isinstance(c, Column) else c).cast("double")
    return F.struct(cast(x1).alias("x1"), cast(y1).alias("y1"), cast(x2).alias("x2"), cast(y2).alias("y2"))


def area(b: Box) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def shared(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return wide * high


def iou(a: Box, b: Box) -> Column:
    both = area(a) + area(b) - shared(a, b)
    return F.when(both > 0, shared(a, b) / both).otherwise(0.0)


def covered(a: Box, b: Box) -> Column:
    """Share of b that a covers."""
    return F.when(area(b) > 0, shared(a, b) / area(b)).otherwise(0.0)


def holds_point(b: Box, x: Column, y: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def holds_box(a: Box, b: Box) -> Column:
    return (b["x1"] >= a["x1"]) & (b["y1"] >= a["y1"]) & (b["x2"] <= a["x2"]) & (b["y2"] <= a["y2"])


def scaled(b: Box, wide: Column, high: Column) -> Box:
    return box(b["x1"] * wide, b["y1"] * high, b["x2"] * wide, b["y2"] * high)


def normalized(b: Box, wide: Column, high: Column) -> Box:
    return box(b["x1"] / wide, b["y1"] / high, b["x2"] / wide, b["y2"] / high)


def center(b: Box) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def overlap_ratio(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Overlap of two intervals over the shorter of them."""
    shorter = F.least(hi_a - lo_a, hi_b - lo_b)
    return F.when(shorter > 0, F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b), F.lit(0.0)) / shorter).otherwise(0.0)


def vertical_overlap(a: Box, b: Box) -> Column:
    return overlap_ratio(a["y1"], a["y2"], b["y1"], b["y2"])


def horizontal_overlap(a: Box, b: Box) -> Column:
    return overlap_ratio(a["x1"], a["x2"], b["x1"], b["x2"])


def sub_box(b: Box, start: Column, end: Column, length: Column) -> Box:
    """The part of a line's box that characters start..end of length take, by even advance."""
    wide = b["x2"] - b["x1"]
    n = F.greatest(length, F.lit(1))
    return box(b["x1"] + wide * start / n, b["y1"], b["x1"] + wide * end / n, b["y2"])


def bounding(b: Box) -> Column:
    """Aggregate: the box around all boxes of the group."""
    return F.struct(F.min(b["x1"]).alias("x1"), F.min(b["y1"]).alias("y1"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2"))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def project(h: list[Column], b: Box) -> Box:
    """A box through a homography (nine columns, row-wise): the clamped box around its four corners."""

    def at(x: Column, y: Column) -> tuple[Column, Column]:
        w = h[6] * x + h[7] * y + h[8]
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    corners = [at(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return box(clamp(F.least(*xs)), clamp(F.least(*ys)), clamp(F.greatest(*xs)), clamp(F.greatest(*ys)))
