"""Distributions, scale-adjusted outliers and empirical p-values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .loess import fit_loess
from .reshape import cumulative_counts, quantile_values, quantiles
from .selection import order_statistics


def percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """(percentile): linear interpolation on (n - 1) p / 100; NaN and null are left out."""
    return quantiles(df, value, [p / 100]).select(F.col("q")[0].alias("percentile"))


def edf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, cumulative, frequency): distinct values with their cumulative share in (0, 1]."""
    counts = cumulative_counts(df.where(F.col(value).isNotNull()), value)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("frequency", F.col("cumulative") / F.col("total")).drop("total")


def empirical_p_values(df: DataFrame, value: str, c: float = 1.0, out: str = "p_value") -> DataFrame:
    """``df`` with P(d) = (rows with a value of at least d + c) / (n + c).

    Negative values count as 0 among the others and have p 1 themselves; null and NaN are
    left out and have p null.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value)
    placed = F.when(known, F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    tails = cumulative_counts(df.select(placed.alias("d")).where("d IS NOT NULL"), "d", descending=True)
    n = tails.agg(F.sum("n").alias("total"))
    tails = tails.crossJoin(F.broadcast(n)).select(F.col("value").alias("__d"), ((F.col("cumulative") + c) / (F.col("total") + c)).alias("__p"))
    joined = df.withColumn("__d", placed).join(tails, "__d", "left")
    return joined.withColumn(out, F.when(F.col(value) < 0, F.lit(1.0)).otherwise(F.col("__p"))).drop("__d", "__p")


def family_stats(df: DataFrame, family_col: str = "family_id", distance_col: str = "distance") -> DataFrame:
    """(family, n, mean, sd): of the absolute distances of families with at least two rows (sample sd)."""
    size = F.abs(distance_col)
    rows = df.where(F.col(family_col).isNotNull() & (F.col(distance_col) >= 0) & ~F.isnan(distance_col))
    stats = rows.groupBy(family_col).agg(F.count(distance_col).alias("n"), F.avg(size).alias("mean"), F.stddev_samp(size).alias("sd"))
    return stats.where("n > 1")


def top_percentile_threshold(df: DataFrame, value: str, p: float = 95.0) -> DataFrame:
    """(threshold): the value at position ceil(n p / 100), from 1 to n, of the ascending values (NaN last, nulls left out)."""
    place = lambda n: max(1, math.ceil(n * p / 100))
    n, _, nans, found = order_statistics(df, F.col(value).cast("double"), lambda n, _, nans: [place(n + nans)])
    limit = found.get(place(n + nans), math.nan if nans else None)
    return df.sparkSession.createDataFrame([(limit,)], "threshold double")


def family_scaling(df: DataFrame, family_col: str = "family_id", distance_col: str = "distance", span: float = 0.7, degree: int = 2) -> DataFrame:
    """(family, dscale): the spread of distances that is usual for a family's mean distance.

    A robust local regression of log2 sd on log2 mean over families of two rows or more,
    without those whose log sd is below the first percentile, evaluated at every family's mean
    (within the range of the fit).  Families of one row get 0; where all means are equal,
    every family gets the median sd.
    """
    return family_scaling_details(df, family_col, distance_col, span, degree).select(family_col, "dscale")


def family_scaling_details(df: DataFrame, family_col: str = "family_id", distance_col: str = "distance", span: float = 0.7, degree: int = 2) -> DataFrame:
    """(family, n, mean, sd, x, y, low_sd_cutoff, used, fitted, dscale): ``family_scaling`` and what it rests on.

    ``x`` and ``y`` are log2 of mean and sd as fitted; ``used`` families have a ``y`` of
    ``low_sd_cutoff`` or more; ``fitted`` is the curve's y (null where there is no curve).
    Families of one row have null but for ``used`` (false) and ``dscale`` (0).
    """
    stats, _ = stored(family_stats(df, family_col, distance_col))
    every = df.where(F.col(family_col).isNotNull()).select(family_col).distinct()
    if stats.isEmpty():
        none = {c: F.lit(None).cast(t) for c, t in (("n", "long"), *((c, "double") for c in ("mean", "sd", "x", "y", "low_sd_cutoff")))}
        return every.withColumns(none).withColumns({"used": F.lit(False), "fitted": F.lit(None).cast("double"), "dscale": F.lit(0.0)})
    p5, mid = (quantile_values(stats, c, [share])[0][0] for c, share in (("mean", 0.05), ("sd", 0.5)))
    eps_mean, eps_sd = max(p5, 1e-12), max(1e-13 * mid, 1e-12)
    logs = stats.withColumns({"x": F.log2(F.col("mean") + eps_mean), "y": F.log2(F.col("sd") + eps_sd)})
    low_sd = quantile_values(logs, "y", [0.01])[0][0]
    logs = logs.withColumns({"low_sd_cutoff": F.lit(float(low_sd)), "used": F.col("y") >= low_sd})
    used = logs.where("used")
    reach = used.agg(F.min("x"), F.max("x")).first()
    if reach[1] - reach[0] <= 1e-12:
        scaled = logs.withColumns({"fitted": F.lit(None).cast("double"), "dscale": F.lit(float(mid))})
    else:
        curve = fit_loess(used, "x", "y", span=span, degree=degree, robust=True)
        at = F.greatest(F.lit(reach[0]), F.least(F.col("x"), F.lit(reach[1])))
        scaled = logs.withColumn("fitted", curve.column(at, F.col("y")))
        scaled = scaled.withColumn("dscale", F.greatest(F.pow(F.lit(2.0), "fitted") - eps_sd, F.lit(0.0)))
    full = every.join(scaled, family_col, "left")
    return full.withColumns({"used": F.coalesce("used", F.lit(False)), "dscale": F.coalesce("dscale", F.lit(0.0))})


def rdi(df: DataFrame, scaling: DataFrame, family_col: str = "family_id", distance_col: str = "distance", out: str = "rdi") -> DataFrame:
    """``df`` with abs(distance) over its family's dscale.

    A dscale of about 0 gives 0, a row without a family (or with distance -1, the mark of
    one) -1, a NaN distance NaN.
    """
    d, scale = F.col(distance_col), F.col("dscale")
    bad = F.col(family_col).isNull() | scale.isNull() | (d == -1)
    value = F.when(F.isnan(d), F.lit(float("nan"))).when(bad, F.lit(-1.0)).when(scale <= 1e-12, F.lit(0.0)).otherwise(F.abs(d) / scale)
    return df.join(scaling.select(family_col, "dscale"), family_col, "left").withColumn(out, value).drop("dscale")


def identify_outliers(df: DataFrame, rdi_col: str = "rdi", p: float = 95.0) -> DataFrame:
    """``df`` with ``threshold``, ``is_outlier`` and ``p_value``.

    The threshold is ``top_percentile_threshold`` of the index with negatives as 0; outliers
    reach it and are above 0.  NaN rows are no outliers and have no p-value.
    """
    known = df.select(F.greatest(F.col(rdi_col), F.lit(0.0)).alias("d")).where("NOT isnan(d)")
    limit = top_percentile_threshold(known, "d", p)
    value = F.col(rdi_col)
    flagged = df.crossJoin(F.broadcast(limit)).withColumn("is_outlier", F.coalesce((value >= F.col("threshold")) & (value > 0) & ~F.isnan(value), F.lit(False)))
    return empirical_p_values(flagged, rdi_col, 1.0)


def detect_outliers(df: DataFrame, family_col: str = "family_id", distance_col: str = "distance", p: float = 95.0) -> DataFrame:
    """Family scaling, then index, then outliers: ``df`` with ``rdi``, ``threshold``, ``is_outlier`` and ``p_value``."""
    indexed, _ = stored(rdi(df, family_scaling(df, family_col, distance_col), family_col, distance_col))
    return identify_outliers(indexed, "rdi", p)

