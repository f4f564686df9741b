"""The roles that the given tables play for the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import to_long


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, family_id, v, is_ortholog) from ``embeddings``."""
    t = read(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("gene_id"), F.col("label").alias("family_id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 == 0).alias("is_ortholog"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, family_id, pos, value): the vectors in long form."""
    return to_long(vectors(spark, sf_dir), keep=("family_id",))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, axis, replicate, value) from ``lineitem``: part, return flag, line, price."""
    t = read(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.select(F.col("l_partkey").alias("gene_id"), F.col("l_returnflag").alias("axis"), line.alias("replicate"), F.col("l_extendedprice").alias("value"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, factor, t, value) from ``events``: user, event type, day from the first event's on, mean value (no event: 0)."""
    t = read(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
    t = t.select(F.col("user_id").alias("sample"), F.col("event_type").alias("factor"), F.to_date("ts").alias("day"), "value")
    means = t.groupBy("sample", "factor", "day").agg(F.avg("value").alias("value"))
    # Users meet all types and days after the last shuffle, so that it has their events only, and what follows finds them by user.
    series = means.groupBy("sample").agg(F.collect_list(F.struct("factor", "day", "value")).alias("s"))
    span = F.broadcast(t.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.collect_set("factor").alias("factors")))
    of = lambda f: F.map_from_entries(F.transform(F.filter("s", lambda x: x["factor"] == f), lambda x: F.struct(x["day"], x["value"])))
    each = series.crossJoin(span).select("sample", "first", "last", F.explode(F.transform("factors", lambda f: F.struct(f.alias("factor"), of(f).alias("known")))).alias("e"))
    filled = each.select("sample", "e.factor", "e.known", "first", F.explode(F.sequence("first", "last")).alias("day"))
    return filled.select("sample", "factor", F.date_diff("day", "first").alias("t"), F.coalesce(F.try_element_at("known", F.col("day")), F.lit(0.0)).alias("value"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, gene_id, family_id, row, value) from ``lineitem``: line status, part, group of parts, line, quantity."""
    t = read(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.select(F.col("l_linestatus").alias("study"), F.col("l_partkey").alias("gene_id"), (F.col("l_partkey") % 7).alias("family_id"), line.alias("row"), F.col("l_quantity").alias("value"))


def residual_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, point, family_id, row, resid): quantities minus their part's mean in the study; a point is a tenth of the parts."""
    t = studies(spark, sf_dir)
    means = t.groupBy("study", "gene_id").agg(F.avg("value").alias("mean"))
    return t.join(means, ["study", "gene_id"]).select("study", (F.col("gene_id") % 10).alias("point"), "family_id", "row", (F.col("value") - F.col("mean")).alias("resid"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, family_id, distance) from ``orders``: how far a price is from its customer's mean."""
    t = read(spark, sf_dir, "orders")
    means = t.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return t.join(means, "o_custkey").select(F.col("o_orderkey").alias("gene_id"), F.col("o_custkey").alias("family_id"), F.abs(F.col("o_totalprice") - F.col("mean")).alias("distance"))


#: The same roles as SQL, to put before a query.
SQL = {
    "vec": "vec AS (SELECT vec_id AS gene_id, label AS family_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 3 = 0 AS is_ortholog FROM embeddings)",
    "comp": "comp AS (SELECT gene_id, family_id, is_ortholog, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS pos FROM vec)",
    "cen": "cen AS (SELECT family_id, pos, avg(value) AS value FROM comp GROUP BY family_id, pos)",
    "cenv": "cenv AS (SELECT family_id, list(value ORDER BY pos) AS c FROM cen GROUP BY family_id)",
    "rep": "rep AS (SELECT l_partkey AS gene_id, l_returnflag AS axis, l_orderkey * 10 + l_linenumber AS replicate, l_extendedprice AS value FROM lineitem)",
    "traj": """ev AS (SELECT user_id AS sample, event_type AS factor, CAST(ts AS DATE) AS day, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
span AS (SELECT min(day) AS first_, CAST(max(day) - min(day) AS INTEGER) AS n FROM ev),
grid AS (SELECT sample, factor, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT sample FROM ev), (SELECT DISTINCT factor FROM ev), (SELECT unnest(range(n + 1)) AS t FROM span)),
dm AS (SELECT sample, factor, CAST(day - first_ AS INTEGER) AS t, avg(value) AS value FROM ev, span GROUP BY ALL),
traj AS (SELECT sample, factor, t, coalesce(value, 0) AS value FROM grid LEFT JOIN dm USING (sample, factor, t))""",
    "stu": "stu AS (SELECT l_linestatus AS study, l_partkey AS gene_id, l_partkey % 7 AS family_id, l_orderkey * 10 + l_linenumber AS row_, l_quantity AS value FROM lineitem)",
    "res": "res AS (SELECT study, gene_id % 10 AS point, family_id, value - avg(value) OVER (PARTITION BY study, gene_id) AS resid FROM stu)",
    "dist": "dist AS (SELECT o_orderkey AS gene_id, o_custkey AS family_id, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) AS distance FROM orders)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
