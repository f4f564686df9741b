"""Local regression in one dimension, and Gaussian kernel smoothing.

The curve is fitted at a few vertices (about 33 for any large table) and evaluated by
cubic Hermite interpolation in between.  Away from the ends and the middle of a vertex's
window its weights are one polynomial, so sums for all vertices come from moments of a
fixed number of cells, in one aggregation; points of other cells are weighted one by one.
Only these sums reach the driver, and the fitted curve is a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dropped, stored
from .reshape import bucketed, global_rank
from .selection import at_ranks

#: Fixed values of the method: the share of the points below which a cell is not cut again, the padding of
#: the range, and where the weight functions count as 0 and as 1.
CELL_SHARE, PADDING, WEIGHT_ENDS, WEIGHT_STARTS = 0.05, 0.005, 0.999, 0.001


@dataclass(frozen=True)
class Curve:
    """Vertices with value and slope; none: the identity (every point is its own fit)."""

    at: tuple[float, ...] = ()
    value: tuple[float, ...] = ()
    slope: tuple[float, ...] = ()

    def column(self, x: Column, y: Column | None = None) -> Column:
        """The curve at x (``y`` if the curve is the identity); beyond the vertices the last cell goes on."""
        if not self.at:
            return y
        at, width = np.array(self.at), np.diff(self.at)
        low, high = np.array(self.value[:-1]), np.array(self.value[1:])
        rise, end = np.array(self.slope[:-1]) * width, np.array(self.slope[1:]) * width
        # Cubic of t, the place within a cell, from values and slopes at both ends.
        parts = (low, rise, 3 * (high - low) - 2 * rise - end, 2 * (low - high) + rise + end)
        listed = lambda numbers: F.array(*(F.lit(float(v)) for v in numbers))
        cell = F.size(F.filter(listed(at[1:-1]), lambda border: border < x))
        t = (x - F.get(listed(at[:-1]), cell)) / F.get(listed(width), cell)
        c0, c1, c2, c3 = (F.get(listed(p), cell) for p in parts)
        return c0 + t * (c1 + t * (c2 + t * c3))


def _vertices(ranked: DataFrame, n: int, low: float, high: float) -> list[float]:
    """Cell borders: the padded range, cut at medians until a cell has few points.

    ``ranked`` has the sorted x with their ranks ``r``; a cell is a run of ranks, so its
    median takes two rows.
    """
    pad = PADDING * max(high - low, 1e-10 * max(abs(low), abs(high)) + 1e-30)
    most = max(int(CELL_SHARE * n), 1)
    cells, borders = [(low, high, low - pad, high + pad, 0, n)], {low - pad, high + pad}
    while todo := [c for c in cells if c[5] - c[4] > most]:
        places = {c: (c[4] + (m + 1) // 2, c[4] + min((m + 1) // 2 + 1, m)) for c in todo for m in (c[5] - c[4],)}
        wanted = sorted({r for pair in places.values() for r in pair})
        at = {r["r"]: r["x"] for r in ranked.where(F.col("r").isin(wanted)).collect()}  # two rows per cell
        cuts = {}
        for cell in todo:
            a, b, left, right, *_ = cell
            one, two = (at[r] for r in places[cell])
            cut = (one + two) / 2
            if not (cut <= left or cut >= right or cut in borders or one == two and cut in (a, b)):
                borders.add(cut)
                cuts[cell] = cut
        cells = []
        if cuts:
            upto = ranked.agg(*(F.count_if(F.col("x") <= cut) for cut in cuts.values())).first()
            for (cell, cut), k in zip(cuts.items(), upto):
                a, b, left, right, start, end = cell
                cells += [(a, cut, left, cut, start, k), (cut, b, cut, right, k, end)]
    return sorted(borders)


def _bandwidths(ranked: DataFrame, vertices: list[float], near: int) -> list[float]:
    """The distance of each vertex to its ``near``-th nearest point: the best run of that many sorted points."""
    ends = ranked.select((F.col("r") - (near - 1)).alias("r"), F.col("x").alias("z"))
    runs = ranked.join(ends, "r")
    return list(runs.agg(*(F.min(F.greatest(F.abs(F.col("x") - v), F.abs(F.col("z") - v))) for v in vertices)).first())


#: Refs, and queries, of a cell of the kernel that stay together.
DENSE_REFS, DENSE_QUERIES = 4096, 1 << 16
#: Cells of equal width of which moments are kept; the power of the tricube weight.
CELLS, POWER = 1024, 9


@dataclass(frozen=True)
class Grid:
    """Cells of equal width; a point's ``z`` is its place in its cell, from -1 to 1."""

    low: float
    width: float

    def cell(self) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((F.col("x") - self.low) / self.width))).cast("int")

    def middle(self, cell):
        return self.low + (cell + 0.5) * self.width

    def z(self) -> Column:
        return (F.col("x") - (self.low + (F.col("cell") + 0.5) * self.width)) / (self.width / 2)


def _inside(grid: Grid, cells: np.ndarray, v: float, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells lie, for a vertex, wholly where its weight is one polynomial, and which reach its window otherwise."""
    left, right = grid.middle(cells) - grid.width * 0.5000001, grid.middle(cells) + grid.width * 0.5000001
    near = np.where((left <= v) & (v <= right), 0.0, np.minimum(np.abs(left - v), np.abs(right - v))) / h
    far = np.maximum(np.abs(left - v), np.abs(right - v)) / h
    whole = (near > WEIGHT_STARTS) & (far * far < WEIGHT_ENDS) & ((left > v) | (right < v))
    return whole, ~whole & (near * near < WEIGHT_ENDS * 1.000001)


def _from_moments(grid: Grid, cells: np.ndarray, plain: np.ndarray, with_y: np.ndarray, v: float, h: float, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight * u**k, and with y, of cells where the weight is (1 - |u|**3)**3, from moments of z."""
    alpha, beta = (grid.middle(cells) - v) / h, grid.width / 2 / h
    sign = np.sign(alpha)
    out = np.zeros(2 * degree + 1), np.zeros(degree + 1)
    u = np.zeros((len(cells), 2))
    u[:, 0], u[:, 1] = alpha, beta

    def times(p: np.ndarray, q: np.ndarray) -> np.ndarray:  # products of polynomials, row by row
        r = np.zeros((len(p), p.shape[1] + q.shape[1] - 1))
        for k in range(q.shape[1]):
            r[:, k : k + p.shape[1]] += p * q[:, k : k + 1]
        return r

    cube = times(times(u, u), u)
    rest = -sign[:, None] * cube
    rest[:, 0] += 1
    power = times(times(rest, rest), rest)
    for k in range(2 * degree + 1):
        out[0][k] = (power * plain[:, : power.shape[1]]).sum()
        if k <= degree:
            out[1][k] = (power * with_y[:, : power.shape[1]]).sum()
        power = times(power, u)
    return out


def _fit_vertices(points: DataFrame, weight: Column, vertices: list[float], widths: list[float], degree: int, grid: Grid) -> Curve:
    """The curve from points (x, y, cell): moments of each cell, combined at each vertex; only points of cells at an
    end or in the middle of a vertex's window are weighted one by one."""
    top = POWER + 2 * degree
    z = grid.z()
    rows = points.select("cell", "x", "y", weight.alias("rw")).withColumn("z", z)
    sums = [F.sum(F.col("rw") * F.pow("z", p)).alias(f"m{p}") for p in range(top + 1)]
    sums += [F.sum(F.col("rw") * F.col("y") * F.pow("z", p)).alias(f"y{p}") for p in range(POWER + degree + 1)]
    found = rows.groupBy("cell").agg(*sums).collect()  # a row per cell
    cells = np.array([r["cell"] for r in found])
    plain = np.array([[r[f"m{p}"] for p in range(top + 1)] for r in found])
    with_y = np.array([[r[f"y{p}"] for p in range(POWER + degree + 1)] + [0.0] * degree for r in found])
    edges, totals = [], []
    for k, (v, h) in enumerate(zip(vertices, widths)):
        whole, edge = _inside(grid, cells, v, h)
        totals.append(_from_moments(grid, cells[whole], plain[whole], with_y[whole], v, h, degree))
        edges += [(int(c), k, v, h) for c in cells[edge]]
    near = rows.join(F.broadcast(points.sparkSession.createDataFrame(edges, "cell int, k int, v double, h double")), "cell")
    near = near.withColumn("u", (F.col("x") - F.col("v")) / F.col("h")).where(F.col("u") * F.col("u") < WEIGHT_ENDS)
    size = F.abs(F.col("u"))
    tricube = F.when(size * size > WEIGHT_STARTS * WEIGHT_STARTS, F.pow(1 - size * size * size, 3)).otherwise(1.0)
    near = near.withColumn("w", F.col("rw") * tricube)
    sums = [F.sum(F.col("w") * F.pow("u", k)).alias(f"s{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(F.col("w") * F.col("y") * F.pow("u", k)).alias(f"t{k}") for k in range(degree + 1)]
    exact = {r["k"]: r for r in near.groupBy("k").agg(*sums).collect()}  # one row per vertex
    value, slope = [], []
    for k, h in enumerate(widths):
        s, t = totals[k]
        if k in exact:
            s = s + [exact[k][f"s{j}"] for j in range(2 * degree + 1)]
            t = t + [exact[k][f"t{j}"] for j in range(degree + 1)]
        normal = np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
        solved = np.linalg.pinv(normal, rcond=1e-12, hermitian=True) @ t
        value.append(float(solved[0]))
        slope.append(float(solved[1] / h) if degree else 0.0)
    return Curve(tuple(vertices), tuple(value), tuple(slope))


def fit_loess(df: DataFrame, x: str, y: str, span: float = 0.7, degree: int = 2, robust: bool = False, rounds: int = 3) -> Curve:
    """The local regression of y on x over all rows (rows with null or NaN are left out).

    Few points (one, a range of x up to 1e-12, or fewer than min(4, degree + 2) distinct x)
    give the identity.  max(2, ceil(span * n)) must reach degree + 3.  ``robust`` fits
    ``rounds`` times with bisquare weights of the residuals of the fit before.
    """
    if not 0 < span <= 1 or degree not in (0, 1, 2):
        raise ValueError("span must be in (0, 1] and degree 0, 1 or 2")
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points, path = stored(points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"))
    seen = points.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.approx_count_distinct("x").alias("d")).first()
    n = seen["n"]
    few = min(4, degree + 2)
    if n <= 1 or seen["high"] - seen["low"] <= 1e-12 or seen["d"] < 2 * few and points.select("x").distinct().limit(few).count() < few:
        return Curve()
    if max(2, math.ceil(span * n)) < degree + 3:
        raise ValueError("too few points for this span and degree")
    ranked, ranked_path = stored(global_rank(points.select("x"), "x", [], out="r"))
    vertices = _vertices(ranked, n, seen["low"], seen["high"])
    near = min(n, max(2, int(span * n + 1e-5)))
    widths = [max(h, 1e-300) for h in _bandwidths(ranked, vertices, near)]
    dropped(df.sparkSession, ranked_path)
    grid = Grid(seen["low"], (seen["high"] - seen["low"]) / CELLS)
    rows, weight, curve = points.withColumn("cell", grid.cell()), F.lit(1.0), Curve()
    for k in range(rounds if robust else 1):
        curve = _fit_vertices(rows, weight, vertices, widths, degree, grid)
        if robust and k + 1 < rounds:
            missed, next_path = stored(rows.select("x", "y", "cell", F.abs(F.col("y") - curve.column(F.col("x"))).alias("miss")))
            dropped(df.sparkSession, path)
            rows, path = missed, next_path
            middle = at_ranks(rows.select(F.col("miss").alias("value")), [(n + 1) // 2, n // 2 + 1], n)
            scale = 3 * (middle[(n + 1) // 2] + middle[n // 2 + 1])  # six medians
            if scale < 1e-300:
                break
            ratio = F.col("miss") / scale
            weight = F.when(ratio <= WEIGHT_STARTS, 1.0).when(ratio > WEIGHT_ENDS, 0.0).otherwise(F.pow(1 - ratio * ratio, 2))
    dropped(df.sparkSession, path)
    return curve


def loess(df: DataFrame, x: str, y: str, out: str = "fitted", **options) -> DataFrame:
    """``df`` with the fitted value of each row."""
    return df.withColumn(out, fit_loess(df, x, y, **options).column(F.col(x).cast("double"), F.col(y).cast("double")))


def kernel_smooth(refs: DataFrame, queries: DataFrame, sigma: float, cutoff: float = 3.0, query_id: str = "query_id") -> DataFrame:
    """(query_id, x, y): refs (x, y) smoothed at the queries' x by weights exp(-(dx / sigma)^2).

    Refs count up to ``cutoff * sigma`` away.  A query at the x of refs gets their y (of
    several: the smallest); one without any ref in reach, and all for sigma 0, the y of the
    nearest ref (ties: the smaller x, then y).
    """
    reach = cutoff * sigma
    refs = refs.select(F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry"))
    asked = queries.select(query_id, F.col("x").cast("double").alias("x"))
    nearest = _nearest(refs, asked, query_id)
    if sigma <= 0:
        return nearest.select(query_id, "x", F.col("ny").alias("y"))
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    # Equal x count once, with their number and sum.
    merged = refs.groupBy("rx").agg(F.count("ry").alias("n"), F.sum("ry").alias("sy"), F.min("ry").alias("low")).withColumn("cell", cell("rx"))
    asked = asked.withColumn("visit", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)))
    # Dense cells are cut into blocks of refs, and their queries into parts.
    blocks = merged.groupBy("cell").agg(F.ceil(F.count("*") / DENSE_REFS).cast("int").alias("blocks"))
    parts = asked.groupBy(F.col("visit").alias("cell")).agg(F.ceil(F.count("*") / DENSE_QUERIES).cast("int").alias("parts"))
    dense, _ = stored(blocks.join(parts, "cell").where("blocks > 1 OR parts > 1"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    wide = merged.join(dense, "cell", "left").withColumn("block", own("rx", F.col("blocks"))).withColumn("part", spread(F.col("parts"))).drop("blocks", "parts")
    asked = asked.withColumnRenamed("visit", "cell").join(dense, "cell", "left").withColumn("part", own(query_id, F.col("parts"))).withColumn("block", spread(F.col("blocks"))).drop("blocks", "parts")
    pairs = asked.join(wide, ["cell", "block", "part"]).where(F.abs(F.col("x") - F.col("rx")) <= reach)
    w = F.exp(-F.pow((F.col("x") - F.col("rx")) / sigma, 2))
    sums = pairs.groupBy(query_id).agg((F.sum(w * F.col("sy")) / F.sum(w * F.col("n"))).alias("sy"), F.min(F.when(F.col("x") == F.col("rx"), F.col("low"))).alias("ey"))
    return nearest.join(sums, query_id, "left").select(query_id, "x", F.coalesce("ey", "sy", "ny").alias("y"))


def _nearest(refs: DataFrame, asked: DataFrame, query_id: str) -> DataFrame:
    """Each query with the y of its nearest ref, found by sorting inside of value buckets."""
    ref = F.when(F.col("is_ref"), F.struct("x", "ry"))
    refs = refs.groupBy("rx").agg(F.min("ry").alias("ry"))
    both = refs.select(F.col("rx").alias("x"), "ry", F.lit(True).alias("is_ref"), F.lit(None).cast(asked.schema[query_id].dataType).alias(query_id))
    both = both.unionByName(asked.select("x", F.lit(None).cast("double").alias("ry"), F.lit(False).alias("is_ref"), query_id))
    parts = bucketed(both, "x")
    edges = parts.groupBy("bucket").agg(F.max(ref).alias("high"), F.min(ref).alias("low"))
    over = Window.orderBy("bucket")  # a row per bucket: at most 64
    edges = edges.select(
        "bucket",
        F.max("high").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # Both look back only, as a frame up to the end is gone through anew for every row.
    up, down = (Window.partitionBy("bucket").orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (("x", "ry"), (F.desc("x"), F.desc("ry"))))
    left, right = F.last(ref, ignorenulls=True).over(up), F.last(ref, ignorenulls=True).over(down)
    placed = parts.withColumn("l", left).withColumn("r", right).where(~F.col("is_ref")).join(F.broadcast(edges), "bucket")
    l, r = F.coalesce("l", "before"), F.coalesce("r", "after")
    use_left = r["x"].isNull() | (F.col("x") - l["x"] <= r["x"] - F.col("x"))
    return placed.select(query_id, "x", F.when(use_left & l["x"].isNotNull(), l["ry"]).otherwise(r["ry"]).alias("ny"))
