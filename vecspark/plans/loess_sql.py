"""Local regression as SQL, by the normal equations at its vertices, for comparison with the operators."""

from __future__ import annotations

from ..operators.loess import CELL_SHARE, PADDING, WEIGHT_ENDS, WEIGHT_STARTS

#: Which cell of the curve ``cv`` an x lies in, and the curve there.
IN_CELL = "(cv.i = 1 OR {x} > cv.lo) AND (cv.last OR {x} <= cv.hi)"
VALUE = "cv.c0 + (({x} - cv.lo) / cv.w) * (cv.c1 + (({x} - cv.lo) / cv.w) * (cv.c2 + (({x} - cv.lo) / cv.w) * cv.c3))"


def _fit(k: int, weights: str) -> str:
    """CTEs of the curve cv{k} from points with weights (x, y, rw)."""
    return f"""
u{k} AS (SELECT v, h, y, rw, (x - v) / h AS u FROM {weights}, hs WHERE ((x - v) / h) * ((x - v) / h) < {WEIGHT_ENDS}),
w{k} AS (SELECT v, h, y, u, rw * CASE WHEN u * u > {WEIGHT_STARTS} * {WEIGHT_STARTS} THEN power(1 - power(abs(u), 3), 3) ELSE 1 END AS w FROM u{k}),
s{k} AS (SELECT v, any_value(h) AS h, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
         sum(w * y) AS t0, sum(w * y * u) AS t1, sum(w * y * u * u) AS t2 FROM w{k} GROUP BY v),
d{k} AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s{k}),
b{k} AS (SELECT v, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS b0,
         (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det / h AS b1 FROM d{k}),
n{k} AS (SELECT row_number() OVER o AS i, v AS lo, lead(v) OVER o AS hi, lead(v) OVER o - v AS w, b0, b1 * (lead(v) OVER o - v) AS r, lead(b0) OVER o AS e0, lead(b1) OVER o * (lead(v) OVER o - v) AS e1,
         count(*) OVER () AS n FROM b{k} WINDOW o AS (ORDER BY v)),
cv{k} AS (SELECT i, i = n - 1 AS last, lo, hi, w, b0 AS c0, r AS c1, 3 * (e0 - b0) - 2 * r - e1 AS c2, 2 * (b0 - e0) + r + e1 AS c3 FROM n{k} WHERE hi IS NOT NULL)"""


def loess_ctes(points: str, span: float = 0.7, rounds: int = 3) -> str:
    """CTEs up to ``cv``, the curve of a table (x, y), fitted ``rounds`` times; the query must be WITH RECURSIVE."""
    parts = [
        f"""pts AS (SELECT x, y FROM {points}),
ends AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high, {PADDING} * greatest(max(x) - min(x), 1e-10 * greatest(abs(min(x)), abs(max(x))) + 1e-30) AS pad, greatest(CAST(floor({CELL_SHARE} * count(*)) AS BIGINT), 1) AS most FROM pts),
rk AS (SELECT x, row_number() OVER (ORDER BY x) AS r FROM pts),
cells AS (SELECT low AS a, high AS b, low - pad AS l, high + pad AS h, CAST(0 AS BIGINT) AS s, n AS e FROM ends
  UNION ALL
  SELECT CASE side WHEN 0 THEN a ELSE cut END, CASE side WHEN 0 THEN cut ELSE b END, CASE side WHEN 0 THEN l ELSE cut END, CASE side WHEN 0 THEN cut ELSE h END, CASE side WHEN 0 THEN s ELSE k END, CASE side WHEN 0 THEN k ELSE e END
  FROM (SELECT c.*, (one.x + two.x) / 2 AS cut, one.x = two.x AS same, (SELECT count(*) FROM pts WHERE pts.x <= (one.x + two.x) / 2) AS k
        FROM cells c JOIN ends ON e - s > most JOIN rk one ON one.r = s + (e - s + 1) // 2 JOIN rk two ON two.r = s + least((e - s + 1) // 2 + 1, e - s)) q, (VALUES (0), (1)) sides(side)
  WHERE cut > l AND cut < h AND NOT (same AND cut IN (a, b))),
vs AS (SELECT l AS v FROM cells UNION SELECT h FROM cells),
hs AS (SELECT v, greatest(max(d), 1e-300) AS h FROM (SELECT v, abs(x - v) AS d, row_number() OVER (PARTITION BY v ORDER BY abs(x - v)) AS k FROM vs, pts), ends
       WHERE k <= least(n, greatest(2, CAST(floor({span} * n + 1e-5) AS BIGINT))) GROUP BY v),
p0 AS (SELECT x, y, 1.0 AS rw FROM pts)"""
    ]
    for k in range(rounds):
        parts.append(_fit(k, f"p{k}"))
        if k + 1 < rounds:
            value, cell = VALUE.replace("cv.", f"cv{k}.").format(x="x"), IN_CELL.replace("cv.", f"cv{k}.").format(x="x")
            parts.append(
                f"""m{k} AS (SELECT x, y, abs(y - ({value})) AS miss FROM pts JOIN cv{k} ON {cell}),
g{k} AS (SELECT 6 * quantile_cont(miss, 0.5) AS scale FROM m{k}),
p{k + 1} AS (SELECT x, y, CASE WHEN miss / scale <= {WEIGHT_STARTS} THEN 1.0 WHEN miss / scale > {WEIGHT_ENDS} THEN 0.0 ELSE power(1 - (miss / scale) * (miss / scale), 2) END AS rw FROM m{k}, g{k})"""
            )
    return ",\n".join([*parts, f"cv AS (SELECT * FROM cv{rounds - 1})"])


def curve(x: str) -> str:
    """The curve at an expression, of rows joined with ``cv`` ON ``in_cell`` of it."""
    return f"({VALUE.format(x=x)})"


def in_cell(x: str) -> str:
    return IN_CELL.format(x=x)
