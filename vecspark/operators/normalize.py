"""Normalisation of replicate measurements: gene, axis, replicate, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite
from ..sources.storage import stored
from .loess import fit_loess
from .reshape import global_rank


def axis_average(long: DataFrame, gene: str = "gene_id", axis: str = "axis", value: str = "value") -> DataFrame:
    """(gene, axis, value): the mean over replicates."""
    return long.groupBy(gene, axis).agg(F.avg(value).alias(value))


def gene_means(long: DataFrame, gene: str = "gene_id", value: str = "value") -> DataFrame:
    """(gene, mean): over finite values; a gene without any gets NaN."""
    mean = F.avg(F.when(is_finite(value), F.col(value)))
    return long.groupBy(gene).agg(F.coalesce(mean, F.lit(float("nan"))).alias("mean"))


def residuals(long: DataFrame, gene: str = "gene_id", value: str = "value", out: str = "resid") -> DataFrame:
    """``long`` with value minus the gene's mean; NaN stays NaN."""
    return long.join(gene_means(long, gene, value), gene).withColumn(out, F.col(value) - F.col("mean")).drop("mean")


def spread(long: DataFrame, *keys: str, value: str = "value", sample: bool = False) -> DataFrame:
    """(keys, mean, sd): mean and standard deviation, of the population or a ``sample``."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), sd.alias("sd"))


def quantile_normalize(long: DataFrame, gene: str = "gene_id", replicate: str = "replicate", value: str = "value") -> DataFrame:
    """``long`` with each value replaced by the mean, over replicates, of the values of its rank.

    Ranks are by value, then gene.
    """
    ranked = global_rank(long, value, [gene], [replicate])
    means = ranked.groupBy("rank").agg(F.avg(value).alias("__mean"))
    return ranked.join(means, "rank").withColumn(value, F.col("__mean")).drop("rank", "__mean")


def log2_transform(long: DataFrame, value: str = "value") -> DataFrame:
    """``long`` with log2(value + 1) and ``status``: ``ok``, or ``out_of_range`` for values of -1 or less (then null)."""
    fine = F.col(value) > -1
    return long.withColumns({value: F.when(fine, F.log2(F.col(value) + 1)), "status": F.when(fine, "ok").otherwise("out_of_range")})


def fold_change(long: DataFrame, pairs: DataFrame, gene: str = "gene_id", axis: str = "axis", value: str = "value") -> DataFrame:
    """(gene, label, fold_change): condition minus control of each pair (log values)."""
    wanted = F.broadcast(pairs.select("control", "condition", "label"))  # pairs of axes, a few
    condition = long.join(wanted, F.col(axis) == F.col("condition")).select(gene, "label", "control", F.col(value).alias("__a"))
    control = long.select(gene, F.col(axis).alias("control"), F.col(value).alias("__b"))
    return condition.join(control, [gene, "control"]).select(gene, "label", (F.col("__a") - F.col("__b")).alias("fold_change"))


def sd_normalize(long: DataFrame, gene: str = "gene_id", value: str = "value", span: float = 0.7, degree: int = 2) -> DataFrame:
    """``long`` with values over the standard deviation that is usual for their gene's mean.

    A robust local regression of sd on mean over genes with an sd; where the fit is about 0,
    the gene's own sd counts, and genes without spread stay as they are.  At least five genes
    must have an sd.
    """
    stats, _ = stored(spread(long, gene, value=value))
    used = stats.where("sd > 1e-12")
    if used.limit(5).count() < 5:
        raise ValueError("at least five genes must vary")
    curve = fit_loess(used, "mean", "sd", span=span, degree=degree, robust=True)
    fitted = curve.column(F.col("mean"), F.col("sd"))
    by = F.when(F.col("sd") <= 1e-12, 1.0).when(F.abs(fitted) <= 1e-12, F.col("sd")).otherwise(fitted)
    scale = stats.select(gene, by.alias("__by"))
    return long.join(scale, gene).withColumn(value, F.col(value) / F.col("__by")).drop("__by")


def normalize_pipeline(
    long: DataFrame,
    gene: str = "gene_id",
    axis: str = "axis",
    replicate: str = "replicate",
    value: str = "value",
    span: float = 0.7,
    degree: int = 2,
    quantile: bool = False,
) -> DataFrame:
    """(gene, axis, value): scaling by spread, optional quantile normalisation, axis means, log2(x + 1)."""
    scaled = sd_normalize(long, gene, value, span, degree)
    if quantile:
        scaled = quantile_normalize(scaled, gene, replicate, value)
    return log2_transform(axis_average(scaled, gene, axis, value), value).drop("status")
