"""One registered query per operator, with its SQL where SQL can express it.

Vector results are given in long form (pos, value), rounded to six digits, so that two
engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, vectors as V
from ..operators import clustering, families, integration, loess, neighbors, normalize, outliers, paralogs, quality, reshape, trajectories
from ..sources import io
from ..sources.storage import shared_dir
from . import tables as T
from .loess_sql import curve, in_cell, loess_ctes
from .tables import with_sql as W

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(x) -> Column:
    return (F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)).alias(x if isinstance(x, str) else "value")


def single(x: str) -> Column:
    """Values to single precision, which engines agree on where decimals can be exact halves; below a millionth 0."""
    return (F.when(F.abs(x) < 1e-6, 0.0).otherwise(F.col(x).cast("float").cast("double")) + F.lit(0.0)).alias(x)


def _single(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-6 THEN 0.0 ELSE CAST(CAST({x} AS FLOAT) AS DOUBLE) END + 0.0"


def flat(df: DataFrame, key: str, vector) -> DataFrame:
    """(key, pos, value): a vector column in long form."""
    long = df.select(key, F.posexplode(vector).alias("pos", "value"))
    return long.select(key, F.col("pos").cast("int").alias("pos"), r6("value"))


def _vector_sql(expression: str, ctes: tuple = ("vec",), source: str = "vec") -> str:
    return f"{W(*ctes)}, o AS (SELECT gene_id, {expression} AS w FROM {source}) SELECT gene_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, round(unnest(w), 6) + 0.0 AS value FROM o"


_WITH_C = "(SELECT gene_id, v, c FROM vec JOIN cenv USING (family_id))"
_C = ("vec", "comp", "cen", "cenv")
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _with_centroid(spark: SparkSession, d: str) -> DataFrame:
    vec = T.vectors(spark, d)
    return families.with_centroid(vec, families.group_centroid(vec))


# --- families -----------------------------------------------------------------------------


@query(f"{W('vec', 'comp', 'cen')} SELECT family_id, CAST(pos AS INTEGER) AS pos, round(value, 6) + 0.0 AS value FROM cen")
def group_centroid(spark, d):
    return flat(families.group_centroid(T.vectors(spark, d)), "family_id", "c")


@query(f"{W('vec', 'comp')} SELECT family_id, CAST(pos AS INTEGER) AS pos, round(coalesce(avg(value) FILTER (is_ortholog), 0), 6) + 0.0 AS value FROM comp GROUP BY family_id, pos")
def group_centroid_orthologs(spark, d):
    return flat(families.group_centroid(T.vectors(spark, d), orthologs="is_ortholog"), "family_id", "c")


@query(f"{W('vec', 'comp')} SELECT 1 AS one, CAST(pos AS INTEGER) AS pos, round(avg(value) FILTER (is_ortholog), 6) + 0.0 AS value FROM comp GROUP BY pos")
def mean_vector(spark, d):
    return flat(families.mean_vector(T.vectors(spark, d), where=F.col("is_ortholog")).withColumn("one", F.lit(1)), "one", "v")


@query(f"{W(*_C)} SELECT gene_id, family_id, round({_NORM.format('list_transform(list_zip(v, c), lambda z: z[1] - z[2])')}, 6) AS distance FROM vec JOIN cenv USING (family_id)")
def distance_to_centroid(spark, d):
    vec = T.vectors(spark, d)
    found = families.distance_to_centroid(vec, families.group_centroid(vec))
    return found.select("gene_id", "family_id", r6("distance"))


@query(f"{W('vec', 'comp', 'cen')} SELECT gene_id, CAST(pos AS INTEGER) AS pos, round(cen.value, 6) + 0.0 AS origin, round(comp.value - cen.value, 6) + 0.0 AS shift FROM comp JOIN cen USING (family_id, pos)")
def shift_field(spark, d):
    vec = T.vectors(spark, d)
    found = families.shift_field(vec, families.group_centroid(vec))
    long = found.select("gene_id", F.posexplode(F.arrays_zip("origin", "shift")).alias("pos", "x"))
    return long.select("gene_id", "pos", F.col("x.origin").alias("origin"), F.col("x.shift").alias("shift")).select("gene_id", "pos", r6("origin"), r6("shift"))


@query(f"{W('vec')} SELECT gene_id, family_id FROM (SELECT gene_id, CASE WHEN family_id < 8 THEN family_id END AS family_id FROM vec) WHERE family_id IS NOT NULL")
def filter_unassigned(spark, d):
    vec = T.vectors(spark, d).withColumn("family_id", F.when(F.col("family_id") < 8, F.col("family_id")))
    return families.filter_unassigned(vec).select("gene_id", "family_id")


@query(f"{W('vec')} SELECT a.gene_id, family_id, family_id IS NOT NULL AS found FROM (SELECT DISTINCT l_suppkey * 3 AS gene_id FROM lineitem) a LEFT JOIN vec USING (gene_id)")
def lookup_family(spark, d):
    ids = T.read(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("gene_id")).distinct()
    return families.lookup(T.vectors(spark, d).select("gene_id", "family_id"), ids, "gene_id").select("gene_id", "family_id", "found")


# --- vector functions ---------------------------------------------------------------------


@query(f"{W('vec')} SELECT gene_id, round({_NORM.format('v')}, 6) AS norm FROM vec")
def vec_norm(spark, d):
    return T.vectors(spark, d).select("gene_id", V.vec_norm("v").alias("norm")).select("gene_id", r6("norm"))


@query(_vector_sql("list_transform(list_zip(v, c), lambda z: z[1] + z[2])", _C, _WITH_C))
def vec_add(spark, d):
    return flat(_with_centroid(spark, d), "gene_id", V.vec_add("v", "c"))


@query(_vector_sql("list_transform(list_zip(v, c), lambda z: z[1] - z[2])", _C, _WITH_C))
def vec_subtract(spark, d):
    return flat(_with_centroid(spark, d), "gene_id", V.vec_subtract("v", "c"))


@query(f"{W(*_C)} SELECT gene_id, round({_NORM.format('list_transform(list_zip(v, c), lambda z: z[1] - z[2])')}, 6) AS d FROM {_WITH_C}")
def euclidean_distance(spark, d):
    return _with_centroid(spark, d).select("gene_id", V.euclidean_distance("v", "c").alias("d")).select("gene_id", r6("d"))


@query(f"{W(*_C)} SELECT gene_id, round(acos(greatest(-1, least(1, {_DOT.format('v', 'c')} / ({_NORM.format('v')} * {_NORM.format('c')})))), 6) AS angle FROM {_WITH_C}")
def angle_between(spark, d):
    return _with_centroid(spark, d).select("gene_id", V.angle_between("v", "c").alias("angle")).select("gene_id", r6("angle"))


@query(_vector_sql(f"list_transform(v, lambda x: x / {_NORM.format('v').replace('lambda x: x * x', 'lambda q: q * q')})"))
def unit_normalize(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.unit_normalize("v"))


@query(_vector_sql(f"list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda q: q * q)) / len(v)))"))
def rms_normalize(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.rms_normalize("v"))


@query(_vector_sql("list_transform(v, lambda x: log2(x + 1))"))
def log2p1(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.log2p1("v"))


@query("SELECT p_partkey, round(ln(p_retailprice) / ln(p_size), 6) AS y FROM (SELECT p_partkey, p_retailprice, CASE WHEN p_size > 1 THEN p_size END AS p_size FROM part)")
def log_base(spark, d):
    t = T.read(spark, d, "part")
    return t.select("p_partkey", V.log_base(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("y")).select("p_partkey", F.round("y", 6).alias("y"))


@query("SELECT event_id, greatest(10.0, least(value, 50.0)) AS y FROM events")
def clamp(spark, d):
    return T.read(spark, d, "events").select("event_id", V.clamp("value", F.lit(10.0), F.lit(50.0)).alias("y"))


@query("SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) <= 1e-12 AS same FROM lineitem")
def is_close(spark, d):
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.is_close("l_discount", "l_tax").alias("same"))


@query("SELECT event_id, round(radians(value * 10 - floor(value * 10 / 360) * 360), 6) AS y FROM events")
def radians_positive(spark, d):
    return T.read(spark, d, "events").select("event_id", F.round(V.radians_positive(F.col("value") * 10), 6).alias("y"))


@query(f"{W('vec')} SELECT gene_id, unnest(list_filter(list_transform(range(len(v)), lambda k: CASE WHEN v[k + 1] > 0.1 THEN CAST(k + 1 AS INTEGER) END), lambda x: x IS NOT NULL)[1:5]) AS place FROM vec")
def true_positions(spark, d):
    mask = F.transform("v", lambda x: x > 0.1)
    return T.vectors(spark, d).select("gene_id", F.explode(V.true_positions(mask, 5)).alias("place"))


@query(_vector_sql("[v[4], v[1], v[8]]"))
def select_axes(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.select_axes("v", [3, 0, 7]))


@query(f"""{W('vec')}, s AS (SELECT gene_id, list_sum(v) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(len(v))) AS c, len(v) AS k FROM vec)
SELECT gene_id, round((1 - c) / (1 - 1 / sqrt(k)), 6) AS versatility, round(degrees(acos(c)), 6) AS angle_deg FROM s""")
def versatility(spark, d):
    return T.vectors(spark, d).select("gene_id", V.versatility("v").alias("x")).select("gene_id", "x.*").select("gene_id", r6("versatility"), r6("angle_deg"))


@query(_vector_sql("list_transform(v, lambda x: x - list_avg(v))"))
def rap_project(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.rap_project("v"))


@query(_vector_sql("list_transform(list_zip(v, c), lambda z: z[1] - z[2] - (list_avg(v) - list_avg(c)))", _C, _WITH_C))
def rap_project_field(spark, d):
    return flat(_with_centroid(spark, d), "gene_id", V.rap_project_field("v", "c"))


@query(f"""{W('vec')}, p AS (SELECT gene_id, v[1] AS a1, v[2] AS a2, v[3] AS b1, v[4] AS b2 FROM vec),
q AS (SELECT gene_id, a1, a2, b1, b2, sqrt(a1 * a1 + a2 * a2) * sqrt(b1 * b1 + b2 * b2) AS n FROM p)
SELECT gene_id, round(acos(greatest(-1, least(1, (a1 * b1 + a2 * b2) / n))) * CASE WHEN a1 * b2 - a2 * b1 < 0 THEN -1 ELSE 1 END, 6) AS angle FROM q""")
def clock_hand_angle(spark, d):
    a, b = (V.unit_normalize(V.select_axes("v", x)) for x in ([0, 1], [2, 3]))
    return T.vectors(spark, d).select("gene_id", V.clock_hand_angle(a, b).alias("angle")).select("gene_id", r6("angle"))


@query(f"""{W('vec')}, p AS (SELECT gene_id, v[1:32] AS a, v[33:64] AS b FROM vec),
q AS (SELECT gene_id, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM p),
s AS (SELECT gene_id, a, b, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) AS n,
      a[2] * b[3] - a[3] * b[2] + a[3] * b[1] - a[1] * b[3] + a[1] * b[2] - a[2] * b[1] AS turn FROM q)
SELECT gene_id, round(acos(greatest(-1, least(1, list_dot_product(a, b) / n))) * CASE WHEN turn < 0 THEN -1 ELSE 1 END, 6) AS angle FROM s""")
def clock_hand_angle_oriented(spark, d):
    a, b = (V.unit_normalize(V.rap_project("v", range(k, k + 32))) for k in (0, 32))
    return T.vectors(spark, d).select("gene_id", V.clock_hand_angle(a, b, normal=(1, 1, 1)).alias("angle")).select("gene_id", r6("angle"))


@query(_vector_sql("list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda q: abs(q))))"))
def axis_contributions(spark, d):
    return flat(T.vectors(spark, d), "gene_id", V.axis_contributions("v"))


@query("SELECT p_partkey, regexp_replace(p_name || '_rep' || CAST(p_size AS VARCHAR), '_(replicate|rep)?[0-9]+$', '') AS axis FROM part")
def axis_group(spark, d):
    name = F.concat("p_name", F.lit("_rep"), F.col("p_size").cast("string"))
    return T.read(spark, d, "part").select("p_partkey", names.axis_group(name).alias("axis"))


# --- orders, ranks, distributions -----------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def range_filter(spark, d):
    return reshape.range_filter(T.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1000.0, 50000.0)


@query("SELECT o_totalprice AS value FROM orders ORDER BY 1 LIMIT 1 OFFSET 99")
def nth_sorted_value(spark, d):
    return reshape.nth_value(T.read(spark, d, "orders"), "o_totalprice", 100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def global_rank(spark, d):
    t = T.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reshape.global_rank(t, "o_totalprice", ["o_orderkey"]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.37), 6) AS percentile FROM lineitem")
def percentile(spark, d):
    return outliers.percentile(T.read(spark, d, "lineitem"), "l_extendedprice", 37.0).select(r6("percentile"))


@query("""WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)
SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 6) AS frequency FROM c""")
def edf(spark, d):
    return outliers.edf(T.read(spark, d, "lineitem"), "l_quantity").select("value", "n", "cumulative", r6("frequency"))


@query(f"""{W('dist')} SELECT gene_id, round((count(*) OVER (ORDER BY distance DESC) + 1) / (count(*) OVER () + 1), 6) AS p_value FROM dist""")
def empirical_p_values(spark, d):
    return outliers.empirical_p_values(T.distances(spark, d), "distance").select("gene_id", r6("p_value"))


@query(f"{W('dist')} SELECT family_id, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_samp(distance), 6) AS sd FROM dist GROUP BY 1 HAVING count(*) > 1")
def family_stats(spark, d):
    return outliers.family_stats(T.distances(spark, d)).select("family_id", "n", r6("mean"), r6("sd"))


@query("SELECT quantile_disc(o_totalprice, 0.95) AS threshold FROM orders")
def top_percentile_threshold(spark, d):
    return outliers.top_percentile_threshold(T.read(spark, d, "orders"), "o_totalprice", 95.0)


def _recursive(*names: str) -> str:
    return W(*names).replace("WITH ", "WITH RECURSIVE ", 1)


def _scaling_sql(source: str) -> str:
    """CTEs up to ``scaled`` (family_id, dscale) from a table (family_id, distance)."""
    return f"""s AS (SELECT family_id, avg(abs(distance)) AS mean, stddev_samp(abs(distance)) AS sd FROM {source} WHERE distance >= 0 AND family_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT greatest(quantile_cont(mean, 0.05), 1e-12) AS em, greatest(1e-13 * quantile_cont(sd, 0.5), 1e-12) AS es FROM s),
l AS (SELECT family_id, log2(mean + em) AS x, log2(sd + es) AS y FROM s, e),
used AS (SELECT x, y FROM l WHERE y >= (SELECT quantile_cont(y, 0.01) FROM l)),
reach AS (SELECT min(x) AS lowest, max(x) AS highest FROM used),
{loess_ctes('used')},
at_ AS (SELECT family_id, greatest(lowest, least(l.x, highest)) AS z FROM l, reach),
fit AS (SELECT family_id, greatest(power(2.0, {curve('z')}) - es, 0) AS dscale FROM at_ JOIN cv ON {in_cell('z')}, e),
scaled AS (SELECT family_id, coalesce(dscale, 0) AS dscale FROM (SELECT DISTINCT family_id FROM {source} WHERE family_id IS NOT NULL) LEFT JOIN fit USING (family_id))"""


def _outliers_sql(head: str, source: str) -> str:
    return f"""{head}, {_scaling_sql(source)},
r AS (SELECT gene_id, d.family_id, distance, CASE WHEN d.family_id IS NULL OR distance = -1 THEN -1 WHEN dscale <= 1e-12 THEN 0 ELSE abs(distance) / dscale END AS rdi FROM {source} d LEFT JOIN scaled USING (family_id)),
t AS (SELECT quantile_disc(greatest(rdi, 0), 0.95) AS threshold FROM r)
SELECT gene_id, family_id, {_single('distance')} AS distance, {_single('rdi')} AS rdi, {_single('threshold')} AS threshold, rdi >= threshold AND rdi > 0 AS is_outlier,
       round(CASE WHEN rdi < 0 THEN 1 ELSE (count(*) OVER (ORDER BY greatest(rdi, 0) DESC) + 1) / (count(*) OVER () + 1) END, 6) AS p_value FROM r, t"""


def _outlier_row(found: DataFrame) -> DataFrame:
    return found.select("gene_id", "family_id", single("distance"), single("rdi"), single("threshold"), "is_outlier", r6("p_value"))


@query(f"{_recursive('dist')}, {_scaling_sql('dist')} SELECT family_id, {_single('dscale')} AS dscale FROM scaled")
def family_scaling(spark, d):
    return outliers.family_scaling(T.distances(spark, d)).select("family_id", single("dscale"))


@query(f"""{W('dist')}, s AS (SELECT family_id, count(*) AS n, avg(distance) AS mean, stddev_samp(distance) AS sd FROM dist WHERE distance >= 0 GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT greatest(quantile_cont(mean, 0.05), 1e-12) AS em, greatest(1e-13 * quantile_cont(sd, 0.5), 1e-12) AS es FROM s),
l AS (SELECT family_id, n, mean, sd, log2(mean + em) AS x, log2(sd + es) AS y FROM s, e), c AS (SELECT quantile_cont(y, 0.01) AS low FROM l)
SELECT family_id, n, round(mean, 6) AS mean, round(sd, 5) AS sd, round(x, 6) AS x, round(y, 5) AS y, coalesce(y >= low, false) AS used
FROM (SELECT DISTINCT family_id FROM dist WHERE family_id IS NOT NULL) LEFT JOIN l USING (family_id), c""")
def family_scaling_points(spark, d):
    t = outliers.family_scaling_details(T.distances(spark, d))
    return t.select("family_id", "n", r6("mean"), F.round("sd", 5).alias("sd"), r6("x"), F.round("y", 5).alias("y"), "used")


@query(f"""{W('dist')}, s AS (SELECT family_id, avg(distance) AS dscale FROM dist GROUP BY 1)
SELECT gene_id, round(CASE WHEN dscale <= 1e-12 THEN 0 ELSE distance / dscale END, 6) AS rdi FROM dist JOIN s USING (family_id)""")
def rdi(spark, d):
    t = T.distances(spark, d)
    scale = t.groupBy("family_id").agg(F.avg("distance").alias("dscale"))
    return outliers.rdi(t, scale).select("gene_id", r6("rdi"))


@query(f"""{W('dist')}, t AS (SELECT quantile_disc(distance, 0.95) AS threshold FROM dist)
SELECT gene_id, round(threshold, 6) AS threshold, distance >= threshold AND distance > 0 AS is_outlier,
       round((count(*) OVER (ORDER BY distance DESC) + 1) / (count(*) OVER () + 1), 6) AS p_value FROM dist, t""")
def identify_outliers(spark, d):
    return outliers.identify_outliers(T.distances(spark, d), "distance").select("gene_id", r6("threshold"), "is_outlier", r6("p_value"))


_FAR = "far AS (SELECT gene_id, vec.family_id, coalesce(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), -1) AS distance FROM vec LEFT JOIN cenv USING (family_id))"


@query(_outliers_sql(f"{_recursive('vec', 'comp', 'cen', 'cenv')}, {_FAR}", "far"))
def detect_outliers(spark, d):
    vec = T.vectors(spark, d)
    far = families.distance_to_centroid(vec, families.group_centroid(vec)).select("gene_id", "family_id", "distance")
    return _outlier_row(outliers.detect_outliers(far))


@query(_outliers_sql(_recursive("dist"), "dist"))
def detect_outliers_orders(spark, d):
    return _outlier_row(outliers.detect_outliers(T.distances(spark, d)))


# --- normalisation --------------------------------------------------------------------------


@query(f"{W('rep')} SELECT gene_id, axis, round(avg(value), 6) AS value FROM rep GROUP BY ALL")
def axis_average(spark, d):
    return normalize.axis_average(T.replicates(spark, d)).select("gene_id", "axis", r6("value"))


@query(f"{W('rep')} SELECT gene_id, {_single('avg(value)')} AS mean, round(stddev_pop(value), 5) AS sd FROM rep GROUP BY ALL")
def mean_and_sd(spark, d):
    return normalize.spread(T.replicates(spark, d), "gene_id").select("gene_id", single("mean"), F.round("sd", 5).alias("sd"))


@query(f"{W('rep')} SELECT gene_id, {_single('avg(value)')} AS mean FROM rep GROUP BY ALL")
def gene_means(spark, d):
    return normalize.gene_means(T.replicates(spark, d)).select("gene_id", single("mean"))


@query(f"{W('rep')} SELECT gene_id, replicate, {_single('value - avg(value) OVER (PARTITION BY gene_id)')} AS resid FROM rep")
def residuals(spark, d):
    return normalize.residuals(T.replicates(spark, d)).select("gene_id", "replicate", single("resid"))


@query(f"""{W('vec', 'comp')}, r AS (SELECT gene_id, pos, row_number() OVER (PARTITION BY pos ORDER BY value, gene_id) AS k, value FROM comp),
m AS (SELECT k, avg(value) AS mean FROM r GROUP BY k) SELECT gene_id, CAST(pos AS INTEGER) AS pos, round(mean, 6) + 0.0 AS value FROM r JOIN m USING (k)""")
def quantile_normalize(spark, d):
    return normalize.quantile_normalize(T.components(spark, d), replicate="pos").select("gene_id", "pos", r6("value"))


@query(f"{W('rep')} SELECT gene_id, replicate, round(log2(value + 1), 6) AS value FROM rep")
def log2_transform(spark, d):
    return normalize.log2_transform(T.replicates(spark, d)).select("gene_id", "replicate", r6("value"))


@query(f"""{W('rep')}, a AS (SELECT gene_id, axis, avg(value) AS value FROM rep GROUP BY ALL)
SELECT x.gene_id, x.axis || '_logFC' AS label, round(x.value - y.value, 5) + 0.0 AS fold_change FROM a x JOIN a y ON x.gene_id = y.gene_id AND y.axis = 'N' AND x.axis IN ('A', 'R')""")
def fold_change(spark, d):
    pairs = spark.createDataFrame([("N", "A", "A_logFC"), ("N", "R", "R_logFC")], "control string, condition string, label string")
    found = normalize.fold_change(normalize.axis_average(T.replicates(spark, d)), pairs)
    return found.select("gene_id", "label", (F.round("fold_change", 5) + F.lit(0.0)).alias("fold_change"))


@query("""WITH n AS (SELECT DISTINCT event_type || '_' || CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'late' END AS name FROM events)
SELECT a.name AS control, b.name AS condition, b.name || '_logFC' AS label FROM n a JOIN n b ON a.name LIKE '%control' AND b.name = replace(a.name, '_control', '_late')""")
def fold_change_pairs(spark, d):
    kind = F.when(F.col("user_id") % 2 == 0, "control").otherwise("late")
    axes = T.read(spark, d, "events").select(F.concat_ws("_", "event_type", kind).alias("axis"))
    return names.fold_change_pairs(axes, "control", ["late"])


@query(f"""WITH RECURSIVE part_ AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), {loess_ctes('part_')}
SELECT p_partkey, {_single(curve('x'))} AS fitted FROM part_ JOIN cv ON {in_cell('x')}""")
def loess_curve(spark, d):
    t = T.read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return loess.loess(t, "x", "y", robust=True).select("p_partkey", single("fitted"))


_SCALED = f"""{_recursive('rep')}, st AS (SELECT gene_id, avg(value) AS mean, stddev_pop(value) AS sd FROM rep GROUP BY 1), used AS (SELECT mean AS x, sd AS y FROM st WHERE sd > 1e-12), {loess_ctes('used')},
by_ AS (SELECT gene_id, CASE WHEN sd <= 1e-12 THEN 1 WHEN abs({curve('mean')}) <= 1e-12 THEN sd ELSE {curve('mean')} END AS by_ FROM st JOIN cv ON {in_cell('mean')}),
nv AS (SELECT rep.gene_id, axis, replicate, value / by_ AS value FROM rep JOIN by_ USING (gene_id))"""


@query(f"{_SCALED} SELECT gene_id, axis, replicate, {_single('value')} AS value FROM nv")
def sd_normalize(spark, d):
    return normalize.sd_normalize(T.replicates(spark, d)).select("gene_id", "axis", "replicate", single("value"))


@query(f"{_SCALED} SELECT gene_id, axis, {_single('log2(avg(value) + 1)')} AS value FROM nv GROUP BY gene_id, axis")
def normalize_pipeline(spark, d):
    return normalize.normalize_pipeline(T.replicates(spark, d)).select("gene_id", "axis", single("value"))


@query("""WITH q AS (SELECT o_orderkey AS query_id, o_totalprice AS x FROM orders), r AS (SELECT p_retailprice * 100 AS rx, CAST(p_size AS DOUBLE) AS ry FROM part),
w AS (SELECT query_id, x, rx, ry, exp(-1 * power((x - rx) / 500.0, 2)) AS w FROM q JOIN r ON abs(x - rx) <= 1500.0),
s AS (SELECT query_id, sum(w * ry) / sum(w) AS sy, min(ry) FILTER (x = rx) AS ey FROM w GROUP BY query_id),
n AS (SELECT query_id, x, min(struct_pack(d := abs(x - rx), rx := rx, ry := ry)) AS b FROM q, r GROUP BY ALL)
SELECT query_id, x, round(coalesce(ey, sy, b.ry), 6) AS y FROM n LEFT JOIN s USING (query_id)""")
def kernel_smooth(spark, d):
    refs = T.read(spark, d, "part").select((F.col("p_retailprice") * 100).alias("x"), F.col("p_size").cast("double").alias("y"))
    asked = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_totalprice").alias("x"))
    return loess.kernel_smooth(refs, asked, 500.0).select("query_id", "x", r6("y"))


# --- quality --------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_suppkey, count(*) FILTER (l_discount = 0) AS z, count(*) AS n, sum(l_discount) AS s FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(z) AS BIGINT) AS n_zero, count(*) FILTER (z = n) AS genes_all_zero, round(sum(s) / sum(n), 6) AS mean FROM g""")
def data_quality_report(spark, d):
    found = quality.data_quality_report(T.read(spark, d, "lineitem"), "l_suppkey", "l_discount")
    return found.select("n", "n_zero", "genes_all_zero", r6("mean"))


@query("""WITH x AS (SELECT l_partkey AS gene_id, l_orderkey * 10 + l_linenumber AS sample, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount END AS value FROM lineitem),
g AS (SELECT gene_id, avg(value) AS m FROM x GROUP BY 1 HAVING count(*) FILTER (value IS NULL) / count(*) <= 0.5), f AS (SELECT gene_id, sample, coalesce(value, m, 0) AS value FROM x JOIN g USING (gene_id))
SELECT gene_id, sample, round(value, 6) AS value FROM f WHERE gene_id NOT IN (SELECT gene_id FROM f GROUP BY 1 HAVING max(abs(value)) = 0)""")
def clean_matrix(spark, d):
    sample = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    value = F.when(F.col("l_discount") > 0.08, float("nan")).otherwise(F.col("l_discount"))
    long = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_id"), sample.alias("sample"), value.alias("value"))
    return quality.clean_matrix(long, "smart_impute").select("gene_id", "sample", r6("value"))


def _gaps(spark, d) -> DataFrame:
    """Discounts of parts and lines; large ones are missing."""
    sample = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    value = F.when(F.col("l_discount") > 0.08, float("nan")).otherwise(F.col("l_discount"))
    return T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_id"), sample.alias("sample"), value.alias("value"))


_GAPS = "WITH x AS (SELECT l_partkey AS gene_id, l_orderkey * 10 + l_linenumber AS sample, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount END AS value FROM lineitem)"
_CLEAN = "SELECT gene_id, sample, round(value, 6) AS value FROM f WHERE gene_id NOT IN (SELECT gene_id FROM f GROUP BY 1 HAVING max(abs(value)) = 0)"


@query(f"{_GAPS}, f AS (SELECT * FROM x WHERE gene_id NOT IN (SELECT gene_id FROM x WHERE value IS NULL)) {_CLEAN}")
def clean_matrix_without_genes(spark, d):
    return quality.clean_matrix(_gaps(spark, d), "remove_genes").select("gene_id", "sample", r6("value"))


@query(f"{_GAPS}, f AS (SELECT * FROM x WHERE sample NOT IN (SELECT sample FROM x WHERE value IS NULL)) {_CLEAN}")
def clean_matrix_without_samples(spark, d):
    return quality.clean_matrix(_gaps(spark, d), "remove_samples").select("gene_id", "sample", r6("value"))


@query(f"{_GAPS}, f AS (SELECT gene_id, sample, coalesce(value, 0) AS value FROM x) {_CLEAN}")
def clean_matrix_of_zeros(spark, d):
    return quality.clean_matrix(_gaps(spark, d), "impute_zero").select("gene_id", "sample", r6("value"))


@query(f"{_GAPS}, f AS (SELECT gene_id, sample, coalesce(value, avg(value) OVER (PARTITION BY gene_id), 0) AS value FROM x) {_CLEAN}")
def clean_matrix_of_means(spark, d):
    return quality.clean_matrix(_gaps(spark, d), "impute_mean").select("gene_id", "sample", r6("value"))


@query('SELECT \'unique\' AS "check", CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM orders GROUP BY o_custkey HAVING count(*) > 1')
def check_unique(spark, d):
    return quality.check_unique(T.read(spark, d, "orders"), "o_custkey")


@query('SELECT \'nonempty\' AS "check", coalesce(x, \'\') AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT CASE WHEN p_size > 25 THEN \' \' ELSE p_name END AS x FROM part) WHERE trim(x) = \'\' GROUP BY x')
def check_nonempty(spark, d):
    return quality.check_nonempty(T.read(spark, d, "part").select(F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_name")).alias("x")), "x")


@query(f'{W("vec")} SELECT \'mapping\' AS "check", CAST(gene_id AS VARCHAR) AS key, CAST(family_id AS VARCHAR) AS detail FROM vec WHERE family_id NOT IN (SELECT n_nationkey % 5 FROM nation)')
def check_mapping(spark, d):
    known = T.read(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("int").alias("family_id")).distinct()
    return quality.check_mapping(T.vectors(spark, d), known)


@query(f'{W("vec")} SELECT \'values\' AS "check", CAST(gene_id AS VARCHAR) AS key, \'not finite or negative\' AS detail FROM vec WHERE list_min(v) < 0')
def check_values(spark, d):
    return quality.check_values(T.vectors(spark, d), non_negative=True)


@query(f'{W("vec", "comp")} SELECT \'centroids\' AS "check", CAST(family_id AS VARCHAR) AS key, \'not finite\' AS detail FROM comp GROUP BY family_id HAVING family_id % 3 = 0 OR NOT bool_and(isfinite(value))')
def check_centroids(spark, d):
    centroids = families.group_centroid(T.vectors(spark, d))
    broken = F.when(F.col("family_id") % 3 == 0, F.transform("c", lambda x, k: F.when(k == 1, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("c"))
    return quality.check_centroids(centroids.withColumn("c", broken))


@query(f'{W("vec")} SELECT \'shift_field\' AS "check", CAST(gene_id AS VARCHAR) AS key, \'shift\' AS detail FROM vec WHERE gene_id % 11 = 0')
def check_shift_field(spark, d):
    vec = T.vectors(spark, d)
    centroids = families.group_centroid(vec)
    wrong = F.when(F.col("gene_id") % 11 == 0, F.transform("shift", lambda x: x + 1)).otherwise(F.col("shift"))
    return quality.check_shift_field(families.shift_field(vec, centroids).withColumn("shift", wrong), vec, centroids)


@query(f'{W("vec")} SELECT \'structure\' AS "check", CAST(gene_id AS VARCHAR) AS key, CAST(len(v) AS VARCHAR) AS detail FROM vec WHERE len(v) <> 32')
def check_structure(spark, d):
    return quality.check_structure(T.vectors(spark, d), 32)


@query(f'{W("vec")} SELECT \'mapping\' AS "check", CAST(gene_id AS VARCHAR) AS key, CAST(family_id AS VARCHAR) AS detail FROM vec WHERE family_id >= 5')
def validate_all(spark, d):
    vec = T.vectors(spark, d)
    centroids = families.group_centroid(vec)
    known = centroids.where("family_id < 5").select("family_id")
    return quality.validate_all(vec, known, centroids, 64, families.shift_field(vec, centroids))


@query("""WITH e AS (SELECT o_custkey AS i, o_orderkey AS j, o_totalprice - 5000 AS d FROM orders)
SELECT 'distances' AS "check", i || ',' || j AS key, CASE WHEN d < 0 THEN 'value' WHEN i = j THEN 'diagonal' END AS detail FROM e WHERE d < 0 OR (i = j AND d <> 0)
UNION ALL SELECT 'distances', a.i || ',' || a.j, 'symmetry' FROM e a JOIN e b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j AND abs(a.d - b.d) > 1e-12""")
def check_distance_matrix(spark, d):
    t = T.read(spark, d, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j"), (F.col("o_totalprice") - 5000).alias("d"))
    return quality.check_distance_matrix(t)


# --- trajectories ---------------------------------------------------------------------------


@query(f"{W('traj')} SELECT sample, factor, t, round(value - p, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY sample, factor ORDER BY t) AS p FROM traj) WHERE p IS NOT NULL")
def velocity(spark, d):
    return trajectories.velocity(T.trajectories(spark, d)).select("sample", "factor", "t", r6("value"))


_ACC = "v AS (SELECT sample, factor, t, value - p AS value FROM (SELECT *, lag(value) OVER (PARTITION BY sample, factor ORDER BY t) AS p FROM traj) WHERE p IS NOT NULL), a AS (SELECT sample, factor, t, value - p AS value FROM (SELECT *, lag(value) OVER (PARTITION BY sample, factor ORDER BY t) AS p FROM v) WHERE p IS NOT NULL)"


@query(f"{W('traj')}, {_ACC} SELECT sample, factor, t, round(value, 6) + 0.0 AS value FROM a")
def acceleration(spark, d):
    return trajectories.acceleration(T.trajectories(spark, d)).select("sample", "factor", "t", r6("value"))


@query(f"""{W('traj')}, m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM traj WINDOW w AS (PARTITION BY sample, factor))
SELECT sample, factor, t, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS value, CASE WHEN hi = lo THEN 'constant' ELSE 'ok' END AS status FROM m""")
def minmax_trajectory(spark, d):
    return trajectories.minmax_trajectory(T.trajectories(spark, d)).select("sample", "factor", "t", r6("value"), "status")


@query(f"{W('traj')} SELECT sample, factor, round(min(value), 6) AS baseline FROM traj GROUP BY ALL")
def baselines(spark, d):
    return trajectories.baselines(T.trajectories(spark, d), "min").select("sample", "factor", r6("baseline"))


@query(f"{W('traj')} SELECT sample, factor, round(avg(value), 6) AS baseline FROM traj GROUP BY ALL")
def baselines_of_means(spark, d):
    return trajectories.baselines(T.trajectories(spark, d), "mean").select("sample", "factor", r6("baseline"))


@query(f"{W('traj')} SELECT DISTINCT sample, factor, 0.0::DOUBLE AS baseline FROM traj")
def baselines_of_zero(spark, d):
    return trajectories.baselines(T.trajectories(spark, d), "raw").select("sample", "factor", r6("baseline"))


@query("""WITH e AS (SELECT o_custkey % 40 AS i, o_orderkey % 40 AS j, max(o_totalprice) AS d FROM orders GROUP BY ALL)
SELECT 'distances' AS "check", i || ',' || j AS key, 'diagonal' AS detail FROM e WHERE i = j AND d <> 0
UNION ALL SELECT 'distances', a.i || ',' || a.j, 'symmetry' FROM e a JOIN e b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j AND abs(a.d - b.d) > 1e-12""")
def check_distance_matrix_symmetry(spark, d):
    t = T.read(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 40).alias("j")).agg(F.max("o_totalprice").alias("d"))
    return quality.check_distance_matrix(t)


_CON = "c AS (SELECT sample, factor, t, value - avg(value) OVER (PARTITION BY sample, factor) AS value FROM {0})"


@query(f"{W('traj')}, {_CON.format('traj')} SELECT x.sample, x.factor, y.factor AS dependent, x.t, {_single('x.value * y.value')} AS contribution FROM c x JOIN c y ON x.sample = y.sample AND x.t = y.t")
def contributions(spark, d):
    return trajectories.contributions(T.trajectories(spark, d)).select("sample", "factor", "dependent", "t", single("contribution"))


@query(f"{W('traj')}, {_CON.format('traj')} SELECT x.sample, x.factor, y.factor AS dependent, {_single('sum(x.value * y.value)')} AS total FROM c x JOIN c y ON x.sample = y.sample AND x.t = y.t GROUP BY ALL")
def total_contributions(spark, d):
    found = trajectories.total_contributions(trajectories.contributions(T.trajectories(spark, d)))
    return found.select("sample", "factor", "dependent", single("total"))


@query(f"""{W('traj')}, {_ACC}, cv AS (SELECT sample, factor, t, value - avg(value) OVER (PARTITION BY sample, factor) AS value FROM v), ca AS (SELECT sample, factor, t, value - avg(value) OVER (PARTITION BY sample, factor) AS value FROM a)
SELECT x.sample, x.factor, y.factor AS dependent, x.t, {_single('coalesce(v1.value * v2.value, 0)')} AS velocity, {_single('coalesce(a1.value * a2.value, 0)')} AS acceleration
FROM traj x JOIN traj y ON x.sample = y.sample AND x.t = y.t LEFT JOIN cv v1 ON v1.sample = x.sample AND v1.factor = x.factor AND v1.t = x.t LEFT JOIN cv v2 ON v2.sample = y.sample AND v2.factor = y.factor AND v2.t = y.t
LEFT JOIN ca a1 ON a1.sample = x.sample AND a1.factor = x.factor AND a1.t = x.t LEFT JOIN ca a2 ON a2.sample = y.sample AND a2.factor = y.factor AND a2.t = y.t""")
def velocity_acceleration_contributions(spark, d):
    return trajectories.velocity_acceleration_contributions(T.trajectories(spark, d)).select("sample", "factor", "dependent", "t", single("velocity"), single("acceleration"))


@query()
def contribution_permutation_test(spark, d):
    return trajectories.contribution_permutation_tests(T.trajectories(spark, d))[1]


# --- studies --------------------------------------------------------------------------------

_MEANS = "m AS (SELECT study, gene_id, avg(value) AS mean FROM stu GROUP BY ALL)"


def _study_means(spark, d) -> DataFrame:
    return T.studies(spark, d).groupBy("study", "gene_id").agg(F.avg("value").alias("mean"))


_SHARES = ", ".join(f"{j}/11.0" for j in range(1, 11))


@query(f"{W('stu')}, {_MEANS}, q AS (SELECT quantile_cont(mean, [{_SHARES}]) AS q, count(*) AS n_pool FROM m) SELECT CAST(generate_subscripts(q, 1) AS INTEGER) AS point, round(unnest(q), 6) AS x, n_pool FROM q")
def pool_means(spark, d):
    return integration.pool_means(_study_means(spark, d), 10).select("point", r6("x"), "n_pool")


@query(f"{W('stu')}, {_MEANS} SELECT greatest(0, least(greatest(100, least((SELECT count(*) FROM m) // 20, 1000)), count(*))) AS size FROM m WHERE study = 'O'")
def neighborhood_size(spark, d):
    means = _study_means(spark, d)
    size = integration.neighborhood_size(means.where("study = 'O'"), means.count(), 10)
    return means.select(F.lit(size).cast("long").alias("size")).limit(1)


_KNN = "q AS (SELECT CAST(j AS INTEGER) AS point, 20.0 + 2 * j AS x FROM (SELECT unnest(range(1, 6)) AS j)), k AS (SELECT study, point, gene_id, CAST(row_number() OVER (PARTITION BY study, point ORDER BY abs(mean - x), gene_id) AS INTEGER) AS rank FROM m, q)"


def _points(spark) -> DataFrame:
    return spark.createDataFrame([(j, 20.0 + 2 * j) for j in range(1, 6)], "point int, x double")


@query(f"{W('stu')}, {_MEANS.replace('avg(value)', 'round(avg(value), 6)')}, {_KNN} SELECT * FROM k WHERE rank <= 20")
def knn_1d(spark, d):
    means = _study_means(spark, d).select("study", "gene_id", r6("mean"))
    return integration.knn_1d(_points(spark), means, 20, study="study")


@query(f"{W('stu')}, {_MEANS.replace('avg(value)', 'round(avg(value), 6)')}, {_KNN} SELECT study, point, gene_id, k.rank, row_ AS row, value FROM k JOIN stu USING (study, gene_id) WHERE k.rank <= 20")
def construct_neighborhoods(spark, d):
    means = _study_means(spark, d).select("study", "gene_id", r6("mean"))
    found = integration.construct_neighborhoods(_points(spark), means, T.studies(spark, d).drop("family_id"), 20, study="study")
    return found.select("study", "point", "gene_id", "rank", "row", "value")


@query(f"{W('stu', 'res')} SELECT round(quantile_cont(abs(resid), 0.95), 6) AS reach FROM res")
def shared_residual_range(spark, d):
    t = T.residual_points(spark, d)
    reach = integration.shared_residual_range(t)
    return t.select(F.lit(round(reach, 6)).alias("reach")).limit(1)


_REACH, _BINS = 20.0, 16
_HIST = f"h AS (SELECT {{0}}study, point, least({_BINS}, CAST(floor((greatest(-{_REACH}, least(resid, {_REACH})) + {_REACH}) / ({2 * _REACH} / {_BINS})) AS INTEGER) + 1) AS bin FROM (SELECT study, point, family_id, round(resid, 9) AS resid FROM res))"
_JSD = f"""c AS (SELECT {{0}}study, point, bin, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT {{0}}point, bin, coalesce(max(n) FILTER (study = 'F'), 0) AS n0, coalesce(max(n) FILTER (study = 'O'), 0) AS n1 FROM c GROUP BY ALL),
p AS (SELECT *, coalesce(n0 / nullif(sum(n0) OVER w, 0), 0) AS p0, coalesce(n1 / nullif(sum(n1) OVER w, 0), 0) AS p1 FROM s WINDOW w AS (PARTITION BY {{0}}point)),
j AS (SELECT {{0}}point, sum(CASE WHEN p0 > 0 THEN p0 * ln(p0 / ((p0 + p1) / 2)) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1 / ((p0 + p1) / 2)) ELSE 0 END) / 2 AS jsd, CAST(sum(n0 + n1) AS BIGINT) AS support FROM p GROUP BY ALL)"""


def _rounded_residuals(spark, d) -> DataFrame:
    return T.residual_points(spark, d).withColumn("resid", F.round("resid", 9))


@query(f"{W('stu', 'res')}, {_HIST.format('')}, g AS (SELECT DISTINCT study, point, b AS bin FROM res, (SELECT CAST(unnest(range(1, {_BINS + 1})) AS INTEGER) AS b)), c AS (SELECT study, point, bin, count(*) AS n FROM h GROUP BY ALL) SELECT study, point, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY study, point), 6) AS p FROM g LEFT JOIN c USING (study, point, bin)")
def residual_histogram(spark, d):
    return integration.residual_histogram(_rounded_residuals(spark, d), ["study", "point"], _REACH, _BINS).select("study", "point", "bin", "n", r6("p"))


@query(f"{W('stu', 'res')}, {_HIST.format('')}, {_JSD.format('')} SELECT point, round(jsd, 6) AS jsd, support FROM j")
def js_divergence(spark, d):
    pmf = integration.residual_histogram(_rounded_residuals(spark, d), ["study", "point"], _REACH, _BINS)
    return integration.js_divergence(pmf, ["point"], ("F", "O")).select("point", r6("jsd"), "support")


@query(f"{W('stu', 'res')}, {_HIST.format('')}, {_JSD.format('')} SELECT round(sum(jsd * support) / sum(support), 6) AS jsd, CAST(sum(support) AS BIGINT) AS support FROM j")
def global_js_divergence(spark, d):
    return integration.jct(_rounded_residuals(spark, d), ("F", "O"), _REACH, _BINS).select(r6("jsd"), "support")


@query()
def jct_permutation_test(spark, d):
    return integration.jct_permutation_test(_rounded_residuals(spark, d), ("F", "O"), _REACH, _BINS)[0]


_FAM = f"{W('stu', 'res')}, {_HIST.format('family_id, ')}, {_JSD.format('family_id, ')}, f AS (SELECT family_id, sum(jsd * support) / sum(support) AS jsd, CAST(sum(support) AS BIGINT) AS support FROM j GROUP BY 1)"


@query(f"{_FAM} SELECT family_id, round(jsd, 6) AS jsd, support FROM f")
def family_jsd(spark, d):
    return integration.family_jsd(_rounded_residuals(spark, d), ("F", "O"), _REACH, _BINS).select("family_id", r6("jsd"), "support")


@query(f"{_FAM} SELECT family_id, round(support / sum(support) OVER (), 6) AS weight, round(jsd * support / sum(support) OVER (), 6) AS score FROM f")
def family_contribution_scores(spark, d):
    found = integration.family_jsd(_rounded_residuals(spark, d), ("F", "O"), _REACH, _BINS)
    return integration.family_contribution_scores(found).select("family_id", r6("weight"), r6("score"))


# --- paralogs -------------------------------------------------------------------------------


@query(f"{W('vec', 'comp', 'cen')} SELECT gene_id, CAST(pos AS INTEGER) AS pos, abs(cen.value - comp.value) > 0.15 AS neofunc FROM comp JOIN cen USING (family_id, pos)")
def neofunctionalization(spark, d):
    vec = T.vectors(spark, d)
    ancestors = families.group_centroid(vec).withColumnRenamed("c", "a")
    found = paralogs.neofunctionalization(vec, ancestors, [0.15] * 64)
    return found.select("gene_id", F.posexplode("neofunc").alias("pos", "neofunc"))


_ANGLE = f"ang AS (SELECT gene_id, family_id, v, c, round(acos(greatest(-1, least(1, {_DOT.format('v', 'c')} / ({_NORM.format('v')} * {_NORM.format('c')})))), 9) AS angle FROM vec JOIN cenv USING (family_id))"


def _angles(spark, d) -> DataFrame:
    found = _with_centroid(spark, d)
    return found.withColumn("angle", F.round(V.angle_between("v", "c"), 9))


@query(f"{W(*_C)}, {_ANGLE} SELECT family_id, count(*) AS n, min(gene_id) AS low, max(gene_id) AS high FROM ang WHERE angle <= 1.4 GROUP BY family_id")
def filter_paralogs(spark, d):
    found = paralogs.filter_paralogs(_angles(spark, d), 1.4, "dosage")
    return found.select("family_id", F.size("members").cast("long").alias("n"), F.array_min("members").alias("low"), F.array_max("members").alias("high"))


def _few(spark, d) -> tuple[DataFrame, DataFrame]:
    """Families of eight vectors (by id), with the family's first vector as ancestor."""
    vec = T.vectors(spark, d).withColumn("family_id", F.floor(F.col("gene_id") / 8))
    ancestors = vec.where(F.col("gene_id") % 8 == 0).select("family_id", F.col("v").alias("a"))
    return vec.where(F.col("gene_id") % 8 != 0), ancestors


_FEW = "few AS (SELECT gene_id, gene_id // 8 AS f, v FROM vec WHERE gene_id % 8 <> 0), anc AS (SELECT gene_id // 8 AS f, v AS a FROM vec WHERE gene_id % 8 = 0)"
_SUM2 = "list_transform(list_zip(x.v, y.v), lambda z: z[1] + z[2])"
_COS2 = f"acos(greatest(-1, least(1, {_DOT.format('s', 'a')} / ({_NORM.format('s')} * {_NORM.format('a')}))))"


@query(f"""{W('vec')}, {_FEW}, p AS (SELECT x.f AS family_id, x.gene_id || ',' || y.gene_id AS members, {_SUM2} AS s, a FROM few x JOIN few y ON x.f = y.f AND x.gene_id < y.gene_id JOIN anc ON anc.f = x.f)
SELECT family_id, members FROM p WHERE {_COS2} <= 1.5 AND {_NORM.format('s')} >= 1.3 * {_NORM.format('a')}""")
def dosage_effect(spark, d):
    genes, ancestors = _few(spark, d)
    found = paralogs.dosage_effect(genes, ancestors, 2, gain=0.3, max_angle=1.5)
    return found.select("family_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


_TWO_AND_THREE = f"""{W('vec')}, {_FEW}, later AS (SELECT gene_id, min({_NORM.format('v')}) OVER (PARTITION BY f ORDER BY gene_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM few),
p AS (SELECT x.f, y.gene_id AS last, x.gene_id || ',' || y.gene_id AS members, {_SUM2} AS s, a FROM few x JOIN few y ON x.f = y.f AND x.gene_id < y.gene_id JOIN anc ON anc.f = x.f),
two AS (SELECT *, {{judge}} FROM p),
q AS (SELECT x.f, x.members || ',' || y.gene_id AS members, list_transform(list_zip(x.s, y.v), lambda z: z[1] + z[2]) AS s, a FROM two x JOIN few y ON x.f = y.f AND x.last < y.gene_id JOIN later ON later.gene_id = x.last WHERE {{go_on}}),
three AS (SELECT *, {{judge}} FROM q)
SELECT f AS family_id, members FROM two WHERE {{hit}} UNION ALL SELECT f, members FROM three WHERE {{hit}}"""
_REST = _NORM.format("list_transform(list_zip(s, a), lambda z: z[1] - z[2])")


@query(_TWO_AND_THREE.format(judge=f"{_COS2} <= 1.5 AS near, {_NORM.format('s')} >= 1.3 * {_NORM.format('a')} AS large", go_on="near AND NOT large", hit="near AND large"))
def dosage_effect_of_three(spark, d):
    genes, ancestors = _few(spark, d)
    found = paralogs.dosage_effect(genes, ancestors, 3, gain=0.3, max_angle=1.5)
    return found.select("family_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""{W('vec')}, {_FEW}, p AS (SELECT x.f AS family_id, x.gene_id || ',' || y.gene_id AS members, {_SUM2} AS s, a FROM few x JOIN few y ON x.f = y.f AND x.gene_id < y.gene_id JOIN anc ON anc.f = x.f)
SELECT family_id, members FROM p WHERE {_NORM.format('list_transform(list_zip(s, a), lambda z: z[1] - z[2])')} <= 1.6""")
def subfunctionalization(spark, d):
    genes, ancestors = _few(spark, d)
    found = paralogs.subfunctionalization(genes, ancestors, 2, 1.6)
    return found.select("family_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(_TWO_AND_THREE.format(judge=f"{_REST} AS rest", go_on="rest > 1.6 AND least <= rest", hit="rest <= 1.6"))
def subfunctionalization_of_three(spark, d):
    genes, ancestors = _few(spark, d)
    found = paralogs.subfunctionalization(genes, ancestors, 3, 1.6)
    return found.select("family_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("""SELECT o_custkey AS family_id, n AS n_candidates, CAST(3 AS INTEGER) AS max_size, CAST(n * (n - 1) / 2 + n * (n - 1) * (n - 2) / 6 AS BIGINT) AS subsets FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def subset_bound(spark, d):
    return paralogs.subset_bound(T.distances(spark, d), 3)


# --- neighbours and clusters -------------------------------------------------------------------

_NB = f"n AS (SELECT q.gene_id AS query_id, p.gene_id AS id, {{0}} AS distance FROM vec q, vec p WHERE q.gene_id % 50 = 0)"
_UNIT = "list_transform({0}.v, lambda x: x / sqrt(list_sum(list_transform({0}.v, lambda y: y * y))))"


@query(f"{W('vec')}, {_NB.format('sqrt(list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))')} SELECT query_id, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM n QUALIFY rank <= 10")
def cart_neighbors(spark, d):
    vec = T.vectors(spark, d)
    asked = vec.where("gene_id % 50 = 0").withColumnRenamed("gene_id", "query_id")
    return neighbors.cart_neighbors(asked, vec, 10).select("query_id", "id", r6("distance"), "rank")


@query(f"{W('vec')}, {_NB.format(f'sqrt(list_sum(list_transform(list_zip({_UNIT.format("q")}, {_UNIT.format("p")}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))')} SELECT query_id, id, round(distance, 6) AS distance FROM n WHERE distance <= 1.2")
def sphere_neighbors(spark, d):
    vec = T.vectors(spark, d)
    asked = vec.where("gene_id % 50 = 0").withColumnRenamed("gene_id", "query_id")
    return neighbors.sphere_neighbors(asked, vec, radius=1.2, ranked=False).select("query_id", "id", r6("distance"))


def _first_centers(spark, d, k: int) -> list[list[float]]:
    return [r["v"] for r in T.vectors(spark, d).orderBy("gene_id").limit(k).select("v").collect()]  # k given centres


_D2 = "list_sum(list_transform(list_zip(v, {0}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"""{W('vec')}, c0 AS (SELECT CAST(row_number() OVER (ORDER BY gene_id) AS INTEGER) AS k, v AS c FROM vec ORDER BY gene_id LIMIT 3),
l1 AS (SELECT gene_id, v, arg_min(k, struct_pack(d := {_D2.format('c')}, k := -k)) AS k FROM vec, c0 GROUP BY gene_id, v),
c1 AS (SELECT k, list(m ORDER BY pos) AS c FROM (SELECT k, pos, avg(x) AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM l1) GROUP BY k, pos) GROUP BY k)
SELECT gene_id, CAST(arg_min(k, struct_pack(d := {_D2.format('c')}, k := -k)) AS INTEGER) AS label FROM vec, c1 GROUP BY gene_id""")
def kmeans_two_rounds(spark, d):
    return clustering.kmeans(T.vectors(spark, d), _first_centers(spark, d, 3), max_iterations=2)[0].select("gene_id", "label")


@query()
def kmeans(spark, d):
    return clustering.kmeans(T.vectors(spark, d), _first_centers(spark, d, 5))[1].select("label", "n")


@query()
def kmeans_trajectories(spark, d):
    t = T.trajectories(spark, d)
    factors = sorted(r["factor"] for r in t.select("factor").distinct().collect())  # the axes of a point
    return clustering.kmeans_trajectories(t, factors, [[10.0] * len(factors), [50.0] * len(factors)])[0].select("sample", "t", "label")


@query()
def linkage(spark, d):
    t = families.group_centroid(T.vectors(spark, d))
    a, b = t.select(F.col("family_id").alias("i"), F.col("c").alias("x")), t.select(F.col("family_id").alias("j"), F.col("c").alias("y"))
    edges = a.join(b, F.col("i") < F.col("j")).select("i", "j", V.euclidean_distance("x", "y").alias("d"))
    return clustering.linkage(edges, "average")


@query()
def linkage_ward(spark, d):
    return clustering.ward_linkage(T.vectors(spark, d))


# --- bundles ----------------------------------------------------------------------------------


@query(f"{W('vec')} SELECT gene_id, family_id FROM vec")
def bundle_round_trip(spark, d):
    vec = T.vectors(spark, d)
    path = shared_dir(spark)
    io.save_bundle({"gene_to_family": vec.select("gene_id", "family_id"), "gene_ids": vec.select("gene_id")}, path)
    return io.load_bundle(spark, path)[0]["gene_to_family"]


@query(f"""{W('vec', 'comp', 'cen')} SELECT 'gene_ids' AS name, count(*) AS n, CAST(sum(gene_id) AS BIGINT) AS ids FROM vec UNION ALL SELECT 'gene_to_family', count(*), CAST(sum(gene_id) AS BIGINT) FROM vec
UNION ALL SELECT 'expression', count(*), CAST(sum(gene_id) AS BIGINT) FROM vec UNION ALL SELECT 'shift_vectors', count(*), CAST(sum(gene_id) AS BIGINT) FROM vec
UNION ALL SELECT 'family_ids', count(*), CAST(sum(family_id) AS BIGINT) FROM (SELECT DISTINCT family_id FROM vec) UNION ALL SELECT 'family_centroids', count(*), CAST(sum(family_id) AS BIGINT) FROM (SELECT DISTINCT family_id FROM cen)""")
def bundle_of_all_tables(spark, d):
    vec = T.vectors(spark, d)
    centroids = families.group_centroid(vec)
    tables = {
        "gene_ids": vec.select("gene_id"),
        "gene_to_family": vec.select("gene_id", "family_id"),
        "expression": vec.select("gene_id", "v"),
        "shift_vectors": families.shift_field(vec, centroids).select("gene_id", "shift"),
        "family_ids": vec.select("family_id").distinct(),
        "family_centroids": centroids,
    }
    path = shared_dir(spark)
    io.save_bundle(tables, path)
    found = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(io.sort_key(t)).cast("long").alias("ids")) for name, t in io.load_bundle(spark, path)[0].items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(f"{W('vec')}, a AS (SELECT DISTINCT l_suppkey * 3 AS gene_id FROM lineitem) SELECT gene_id, family_id FROM vec JOIN a USING (gene_id)")
def bundle_lookup(spark, d):
    path = shared_dir(spark)
    io.save_bundle({"gene_to_family": T.vectors(spark, d).select("gene_id", "family_id")}, path)
    return io.lookup_in_bundle(spark, path, "gene_to_family", _asked(spark, d))


def _as_text(lines: DataFrame) -> str:
    """The path of a table's lines as text files."""
    path = shared_dir(lines.sparkSession)
    lines.write.text(path)
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id FROM part")
def read_gene_ids(spark, d):
    t = T.read(spark, d, "part")
    path = _as_text(t.select(F.concat_ws("\t", "p_brand", F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).alias("value")))
    return io.read_gene_ids(spark, path, header_rows=0, gene_col=2)


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id, 1 AS sample, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, p_retailprice FROM part WHERE p_partkey % 2 = 0")
def read_expression(spark, d):
    t = T.read(spark, d, "part")
    path = _as_text(t.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("p_partkey", "p_size", "p_retailprice"))).alias("value")))
    ids = t.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("gene_id"))
    return io.read_expression(spark, [path], ids, [2, 3], header_rows=0)[0]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS gene_id, CAST(o_custkey AS VARCHAR) AS family_id FROM orders")
def read_orthogroups(spark, d):
    lists = [F.concat_ws(", ", F.collect_list(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderkey").cast("string")))) for k in (0, 1)]
    lines = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws("\t", F.first(F.col("o_custkey").cast("string")), *lists).alias("value"))
    return io.read_orthogroups(spark, _as_text(lines.select("value")), header_rows=0)


@query(f"{W('vec', 'comp', 'cen')} SELECT family_id, CAST(pos AS INTEGER) AS pos, round(value, 6) + 0.0 AS value FROM cen")
def save_and_load_table(spark, d):
    path = shared_dir(spark)
    io.save_table(families.group_centroid(T.vectors(spark, d)), path)
    return flat(io.load_table(spark, path), "family_id", "c")


def _asked(spark, d) -> DataFrame:
    return T.read(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("gene_id")).distinct()


_ASKED = "a AS (SELECT DISTINCT l_suppkey * 3 AS gene_id FROM lineitem)"


@query(f"{W('vec')}, {_ASKED} SELECT a.gene_id, round({_NORM.format('v')}, 6) AS norm, family_id IS NOT NULL AS found FROM a LEFT JOIN vec USING (gene_id)")
def lookup_vector(spark, d):
    found = families.lookup(T.vectors(spark, d), _asked(spark, d), "gene_id")
    return found.select("gene_id", V.vec_norm("v").alias("norm"), "found").select("gene_id", r6("norm"), "found")


@query(f"{W(*_C)}, a AS (SELECT DISTINCT l_linenumber * 2 AS family_id FROM lineitem) SELECT a.family_id, round({_NORM.format('c')}, 6) AS norm, c IS NOT NULL AS found FROM a LEFT JOIN cenv USING (family_id)")
def lookup_centroid(spark, d):
    ids = T.read(spark, d, "lineitem").select((F.col("l_linenumber") * 2).alias("family_id")).distinct()
    found = families.lookup(families.group_centroid(T.vectors(spark, d)), ids, "family_id")
    return found.select("family_id", V.vec_norm("c").alias("norm"), "found").select("family_id", r6("norm"), "found")


@query(f"{W(*_C)}, {_ASKED}, s AS (SELECT gene_id, {_NORM.format('list_transform(list_zip(v, c), lambda z: z[1] - z[2])')} AS n FROM vec JOIN cenv USING (family_id)) SELECT a.gene_id, round(n, 6) AS norm, n IS NOT NULL AS found FROM a LEFT JOIN s USING (gene_id)")
def lookup_shift(spark, d):
    vec = T.vectors(spark, d)
    shifts = families.shift_field(vec, families.group_centroid(vec))
    found = families.lookup(shifts, _asked(spark, d), "gene_id")
    return found.select("gene_id", V.vec_norm("shift").alias("norm"), "found").select("gene_id", r6("norm"), "found")
