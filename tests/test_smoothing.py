"""Local regression by moments against weighting every point, and kernel smoothing of dense cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import loess


def direct(x, y, w, vertices, widths, degree):
    value, slope = [], []
    for v, h in zip(vertices, widths):
        u = (x - v) / h
        near = u * u < loess.WEIGHT_ENDS
        own = w * np.where(np.abs(u) > loess.WEIGHT_STARTS, (1 - np.abs(u) ** 3) ** 3, 1.0)
        a = np.vander(u[near], degree + 1, increasing=True) * np.sqrt(own[near])[:, None]
        solved = np.linalg.lstsq(a, y[near] * np.sqrt(own[near]), rcond=None)[0]
        value.append(solved[0])
        slope.append(solved[1] / h if degree else 0.0)
    return value, slope


@pytest.mark.parametrize("degree", [0, 1, 2])
@pytest.mark.parametrize("shape", ["flat", "dense", "steps"])
def test_moments_equal_direct_fits(spark, degree, shape):
    rng = np.random.default_rng(degree)
    x = {"flat": rng.uniform(-3, 8, 900), "dense": np.append(rng.normal(2, 0.001, 700), rng.uniform(-3, 8, 200)), "steps": rng.integers(0, 30, 900).astype(float)}[shape]
    y, w = np.sin(x) * 1000 + rng.normal(size=len(x)), rng.uniform(size=len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())), "x double, y double, w double")
    grid = loess.Grid(float(x.min()), float(x.max() - x.min()) / loess.CELLS)
    vertices = [float(v) for v in np.quantile(x, [0, 0.1, 0.4, 0.5, 0.8, 1])]
    vertices = sorted(set(vertices))
    widths = [3.0 + k for k in range(len(vertices))]
    curve = loess._fit_vertices(df.withColumn("cell", grid.cell()), F.col("w"), vertices, widths, degree, grid)
    value, slope = direct(x, y, w, vertices, widths, degree)
    assert curve.value == pytest.approx(value, rel=1e-6, abs=1e-5) and curve.slope == pytest.approx(slope, rel=1e-5, abs=1e-4)


def test_most_points_count_by_their_cell_alone():
    grid, cells = loess.Grid(0.0, 1 / loess.CELLS), np.arange(loess.CELLS)
    for v in (0.0, 0.3, 1.0):
        whole, edge = loess._inside(grid, cells, v, 0.5)
        assert edge.sum() <= 8 and whole.sum() >= 0.4 * loess.CELLS


@pytest.mark.parametrize("refs_limit,queries_limit", [(3, 2), (4096, 1 << 16)])
def test_dense_cells_are_smoothed_alike(spark, monkeypatch, refs_limit, queries_limit):
    monkeypatch.setattr(loess, "DENSE_REFS", refs_limit)
    monkeypatch.setattr(loess, "DENSE_QUERIES", queries_limit)
    rng = random.Random(6)
    refs = [(rng.choice([5.0, 5.001, 5.5, rng.uniform(0, 20)]), float(rng.randrange(9))) for _ in range(150)]
    queries = [(k, rng.choice([5.0, 5.2, rng.uniform(-3, 30)])) for k in range(60)]
    r, q = spark.createDataFrame(refs, "x double, y double"), spark.createDataFrame(queries, "query_id int, x double")
    got = {row["query_id"]: row["y"] for row in loess.kernel_smooth(r, q, 0.4).collect()}
    for k, x in queries:
        same = [y for rx, y in refs if rx == x]
        near = [(math.exp(-(((x - rx) / 0.4) ** 2)), y) for rx, y in refs if abs(x - rx) <= 0.4 * 3.0]
        first = min(refs, key=lambda p: (abs(p[0] - x), p[0], p[1]))[1]
        want = min(same) if same else sum(w * y for w, y in near) / sum(w for w, _ in near) if near else first
        assert got[k] == pytest.approx(want), (k, x)


def test_nearest_refs_are_found_in_one_pass_over_each_bucket(spark):
    refs = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (4.0, 7.0)], "rx double, ry double")
    asked = spark.createDataFrame([(k, x) for k, x in enumerate([0.0, 1.5, 2.0, 3.0, 3.1, 9.0])], "query_id int, x double")
    found = loess._nearest(refs, asked, "query_id")
    assert {r["query_id"]: r["ny"] for r in found.collect()} == {0: 5.0, 1: 5.0, 2: 6.0, 3: 6.0, 4: 7.0, 5: 7.0}
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().optimizedPlan().toString()
