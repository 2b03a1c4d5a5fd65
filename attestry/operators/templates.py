"""Templates: learning a layout from a settled document, aligning pages to it, projecting its regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import geometry

#: Tries, inlier distance and least share of inliers of the robust fit.
TRIES, NEAR, SHARE, SEED = 200, 0.02, 0.5, 12345


def learn(fields: DataFrame, items: DataFrame, template_id: str) -> tuple[DataFrame, DataFrame]:
    """(anchors, regions) of a template from one settled document: labels that were found are anchors, boxes of settled values regions.

    fields: label_node, field_id, status, x1 .. y2 of the value; items: node_id, text, x1 .. y2."""
    anchors = fields.join(items.select(F.col("node_id").alias("label_node"), "text", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2"))), "label_node")
    anchors = anchors.select(F.lit(template_id).alias("template_id"), F.col("label_node").alias("anchor_id"), F.col("text").alias("value"), *(F.col(f"a_{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))).distinct()
    regions = fields.filter("status = 'confirmed'").select(F.lit(template_id).alias("template_id"), F.col("field_id").alias("region"), "x1", "y1", "x2", "y2")
    return anchors, regions


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Nine numbers that take src to dst, by least squares of the direct linear equations."""
    rows = []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    _, s, vt = np.linalg.svd(np.array(rows))
    h = vt[-1]
    return h / h[8] if abs(h[8]) > 1e-9 and s[7] > 1e-9 else None


def solve_affine(src: np.ndarray, dst: np.ndarray, similar: bool = False) -> np.ndarray | None:
    """An affine map, or a similarity, by least squares."""
    rows, right = [], dst.reshape(-1)
    for x, y in src:
        rows += [[x, -y, 1, 0], [y, x, 0, 1]] if similar else [[x, y, 1, 0, 0, 0], [0, 0, 0, x, y, 1]]
    a = np.array(rows)
    if np.linalg.matrix_rank(a) < a.shape[1]:
        return None
    p = np.linalg.lstsq(a, right, rcond=None)[0]
    return np.array([p[0], -p[1], p[2], p[1], p[0], p[3], 0, 0, 1]) if similar else np.array([*p, 0, 0, 1])


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    m = np.c_[points, np.ones(len(points))] @ h.reshape(3, 3).T
    return m[:, :2] / m[:, 2:]


def fit(src: np.ndarray, dst: np.ndarray) -> tuple[str, np.ndarray | None, float]:
    """(kind, map, mean error) of the best map the pairs allow: homography by seeded sampling, affine, similarity, or failed."""
    rng = np.random.default_rng(SEED)
    n = len(src)
    if n >= 4:
        best: np.ndarray | None = None
        for _ in range(TRIES):
            pick = rng.choice(n, 4, replace=False)
            h = solve_homography(src[pick], dst[pick])
            if h is None:
                continue
            with np.errstate(all="ignore"):
                near = np.linalg.norm(apply(h, src) - dst, axis=1) < NEAR
            if best is None or near.sum() > best.sum():
                best = near
        if best is not None and best.sum() >= max(4, SHARE * n):
            h = solve_homography(src[best], dst[best])
            if h is not None:
                return "homography", h, float(np.linalg.norm(apply(h, src[best]) - dst[best], axis=1).mean())
    for kind, least, similar in (("affine", 3, False), ("similarity", 2, True)):
        h = solve_affine(src, dst, similar) if n >= least else None
        if h is not None and (error := float(np.linalg.norm(apply(h, src) - dst, axis=1).mean())) < 2 * NEAR:
            return kind, h, error
    return "failed", None, float("nan")


def align(pairs: DataFrame) -> DataFrame:
    """(doc_id, template_id, kind, h, error) from matched anchor centres (doc_id, template_id, tx, ty, px, py)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tx", "ty", "px", "py"])
        kind, h, error = fit(pdf[["tx", "ty"]].to_numpy(float), pdf[["px", "py"]].to_numpy(float))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "template_id": pdf["template_id"].iloc[:1], "kind": [kind], "h": [None if h is None else h.tolist()], "error": [error]})

    return pairs.groupBy("doc_id", "template_id").applyInPandas(one, "doc_id string, template_id string, kind string, h array<double>, error double")


def project(aligned: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, template_id, region, x1, y1, x2, y2): a template's regions on each aligned page, clamped to it."""
    rows = aligned.filter("h is not null").join(regions, "template_id")
    h = [F.col("h")[k] for k in range(9)]
    to = geometry.project(h, geometry.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return rows.select("doc_id", "template_id", "region", to.alias("b")).select("doc_id", "template_id", "region", "b.*")
