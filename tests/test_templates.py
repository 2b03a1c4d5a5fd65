"""Alignment, projection and image hashes."""

import numpy as np
import pytest

from attestry.functions import images
from attestry.operators import templates


@pytest.mark.parametrize("n, kind", [(8, "homography"), (3, "affine"), (2, "similarity"), (1, "failed")])
def test_alignment_ladder(spark, n, kind):
    rng = np.random.default_rng(n)
    src = rng.random((n, 2))
    angle = 0.1
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    dst = src @ turn.T * 0.9 + [0.05, 0.02]
    if n == 8:
        dst[0] += 0.4  # an outlier
    rows = [("d", "t", *map(float, a), *map(float, b)) for a, b in zip(src, dst)]
    got = templates.align(spark.createDataFrame(rows, "doc_id string, template_id string, tx double, ty double, px double, py double")).first()
    assert got.kind == kind
    if got.h:
        probe = np.array([[0.3, 0.4]])
        assert np.allclose(templates.apply(np.array(got.h), probe), probe @ turn.T * 0.9 + [0.05, 0.02], atol=1e-3)


def test_projection(spark):
    shift = [1.0, 0.0, 0.1, 0.0, 1.0, 0.2, 0.0, 0.0, 1.0]
    aligned = spark.createDataFrame([("d", "t", "affine", shift, 0.0), ("e", "t", "failed", None, 0.0)], "doc_id string, template_id string, kind string, h array<double>, error double")
    regions = spark.createDataFrame([("t", "total", 0.1, 0.1, 0.95, 0.3)], "template_id string, region string, x1 double, y1 double, x2 double, y2 double")
    rows = templates.project(aligned, regions).collect()
    assert len(rows) == 1 and np.allclose(rows[0][3:], [0.2, 0.3, 1.0, 0.5])


def test_learned_template(spark):
    fields = spark.createDataFrame([("n1", "total", "confirmed", 0.5, 0.1, 0.6, 0.2), ("n2", "date", "needs_review", 0.5, 0.3, 0.6, 0.4)], "label_node string, field_id string, status string, x1 double, y1 double, x2 double, y2 double")
    items = spark.createDataFrame([("n1", "Total", 0.1, 0.1, 0.2, 0.2), ("n2", "Date", 0.1, 0.3, 0.2, 0.4)], "node_id string, text string, x1 double, y1 double, x2 double, y2 double")
    anchors, regions = templates.learn(fields, items, "t")
    assert {r.value for r in anchors.collect()} == {"Total", "Date"} and [r.region for r in regions.collect()] == ["total"]


def test_dhash(spark):
    falling = np.tile(np.arange(90, 0, -10), (16, 1))
    assert images.dhash(falling) == "f" * 16 and images.dhash(falling[:, ::-1]) == "0" * 16
    df = spark.createDataFrame([(falling.ravel().astype(float).tolist(), 9), ([1.0, 2.0, 3.0], 2), (None, 3)], "luma array<double>, w int")
    assert [r[0] for r in df.select(images.dhash64("luma", "w")).collect()] == ["f" * 16, None, None]
