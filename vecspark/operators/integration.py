"""Compatibility of two studies: residuals near reference points, and their divergence."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_finite
from .draws import multivariate_hypergeometric
from .reshape import quantiles


def pool_means(means: DataFrame, points: int, mean: str = "mean") -> DataFrame:
    """(point, x): the quantiles j / (points + 1) of all studies' gene means, NaN left out; ``n_pool`` as a column."""
    pooled = quantiles(means.where(is_finite(mean)), mean, [j / (points + 1) for j in range(1, points + 1)])
    return pooled.select(F.posexplode("q").alias("point", "x"), F.col("n").alias("n_pool")).withColumn("point", F.col("point") + 1)


def neighborhood_size(means: DataFrame, n_pool: int, points: int, mean: str = "mean", desired: int | None = None) -> int:
    """Genes of a study that belong to a reference point.

    floor(n_pool / (2 points)), at least 100 and at most ``desired`` (1,000), at most the
    genes of the study, less its genes without a mean, and never below 0.
    """
    genes, missing = means.agg(F.count("*"), F.count_if(~is_finite(mean))).first()
    size = max(100, min(n_pool // (2 * points), desired or 1000))
    return max(0, min(size, genes) - missing)


def knn_1d(points: DataFrame, means: DataFrame, k: int, gene: str = "gene_id", mean: str = "mean", study: str | None = None) -> DataFrame:
    """(study, point, gene, rank): the ``k`` genes whose means are nearest to each point (ties: by gene).

    Reference points are few (quantiles that the caller asked for) and meet every gene in
    its own row; each partition keeps its best ``k`` before anything is shuffled.
    """
    keys = [study] if study else []
    targets = points.agg(F.collect_list(F.struct("point", "x")).alias("targets"))
    near = means.where(is_finite(mean)).crossJoin(F.broadcast(targets)).select(*keys, gene, mean, F.explode("targets").alias("p"))
    order = Window.partitionBy(*keys, "p.point").orderBy(F.abs(F.col(mean) - F.col("p.x")), gene)
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*keys, F.col("p.point").alias("point"), gene, "rank")


def construct_neighborhoods(points: DataFrame, means: DataFrame, resid: DataFrame, k: int, gene: str = "gene_id", study: str | None = None) -> DataFrame:
    """All residuals of the genes near each point: (study, point, gene, rank, ...)."""
    keys = [study, gene] if study else [gene]
    return knn_1d(points, means, k, gene, study=study).join(resid, keys)


def shared_residual_range(resid: DataFrame, value: str = "resid", p: float = 95.0) -> float:
    """The percentile of the absolute residuals of both studies, NaN left out; 0 without any."""
    found = quantiles(resid.where(is_finite(value)).select(F.abs(value).alias("size")), "size", [p / 100]).first()["q"][0]
    return float(found or 0.0)


def residual_bin(value: Column, reach: float, bins: int) -> Column:
    """Bin (from 1) of a residual on [-reach, reach], clamped; with reach 0 all are in the middle bin."""
    if reach <= 0:
        return F.lit((bins + 1) // 2)
    inside = F.greatest(F.lit(-reach), F.least(value, F.lit(reach)))
    return F.least(F.lit(bins), F.floor((inside + reach) / (2 * reach / bins)).cast("int") + 1)


def residual_histogram(resid: DataFrame, keys: list[str], reach: float, bins: int, value: str = "resid", mask: str | None = None) -> DataFrame:
    """(keys, bin, n, p): counts of residuals per bin, every bin of every key, and their shares.

    NaN and null are skipped, and so are residuals whose ``mask`` column is not true (a gene
    that is no neighbour of the point); a key without any residual has shares 0.
    """
    counted = is_finite(value) if mask is None else is_finite(value) & F.col(mask)
    kept = resid.withColumn("bin", F.when(counted, residual_bin(F.col(value), reach, bins)))
    counts = kept.groupBy(*keys, "bin").agg(F.count("bin").alias("n"))
    grid = kept.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    full = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def js_divergence(pmf: DataFrame, keys: list[str], studies: tuple, study: str = "study") -> DataFrame:
    """(keys, jsd, support): the Jensen-Shannon divergence (natural log) of two studies' shares.

    ``pmf`` has keys, study, bin, n and p.  ``support`` is how many residuals both have.
    """
    part = lambda s, c: F.coalesce(F.max(F.when(F.col(study) == F.lit(s), F.col(c))), F.lit(0))
    both = pmf.groupBy(*keys, "bin").agg(*(part(s, c).alias(f"{c}{k}") for k, s in enumerate(studies) for c in ("p", "n")))
    mid = (F.col("p0") + F.col("p1")) / 2
    term = lambda p: F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p) / mid)).otherwise(0.0)
    return both.groupBy(*keys).agg((F.sum(term("p0") + term("p1")) / 2).alias("jsd"), F.sum(F.col("n0") + F.col("n1")).alias("support"))


def global_js_divergence(divergences: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, jsd, support): the mean of points' divergences weighted by support; 0 without data."""
    whole = F.coalesce(F.sum(F.col("jsd") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0))
    found = divergences.groupBy(*(keys or [])).agg(whole.alias("jsd"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    return found


def jct(resid: DataFrame, studies: tuple, reach: float, bins: int, extra: list[str] | None = None, study: str = "study") -> DataFrame:
    """(extra, jsd, support): histograms of both studies, divergence per point, weighted mean."""
    extra = extra or []
    pmf = residual_histogram(resid, [*extra, study, "point"], reach, bins)
    return global_js_divergence(js_divergence(pmf, [*extra, "point"], studies, study), extra)


def _null_divergences(bins: int, permutations: int, seed: int):
    """Draws of a point's first study from the counts of all bins (the last: residuals that no bin holds)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for point, first, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                draw = np.random.default_rng([seed, zlib.crc32(str(point).encode())])
                counts = np.array(counts, np.int64)
                one = multivariate_hypergeometric(draw, counts, first, permutations)[:, :bins]
                two = counts[:bins] - one
                p0, p1 = (n / np.maximum(n.sum(axis=1, keepdims=True), 1) for n in (one, two))
                mid = np.where(p0 + p1 > 0, (p0 + p1) / 2, 1)
                jsd = sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / mid), 0).sum(axis=1) for p in (p0, p1)) / 2
                support = np.full(permutations, counts[:bins].sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, permutations + 1, dtype=np.int32)), pa.array(jsd), pa.array(support)], names=["perm", "jsd", "support"])

    return run


def jct_permutation_test(resid: DataFrame, studies: tuple, reach: float, bins: int, permutations: int = 1000, seed: int = 0, study: str = "study", mask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((observed, p_value), (perm, jsd)): residuals are dealt anew to the studies within each point.

    Every point keeps the studies' sizes (residuals that are NaN or null are dealt too).  Only
    the number of residuals of each bin matters, so the data are counted to (point, bin)
    once and a permutation draws a point's first study from these counts (multivariate
    hypergeometric), which has the distribution of dealing the rows themselves, for any number
    of residuals.  Draws depend on the seed and the point only.
    p = (1 + permutations that reach the observed) / (B + 1).  Rows whose ``mask`` column is
    not true take no part.
    """
    if mask:
        resid = resid.where(F.col(mask))
    observed = jct(resid, studies, reach, bins, study=study).select(F.col("jsd").alias("observed"))
    slot = F.coalesce(F.when(is_finite("resid"), residual_bin(F.col("resid"), reach, bins)), F.lit(bins + 1))
    counts = resid.groupBy("point", slot.alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col(study) == F.lit(studies[0])).alias("first"))
    in_slot = [F.coalesce(F.sum(F.when(F.col("slot") == k, F.col("n"))), F.lit(0)) for k in range(1, bins + 2)]
    points = counts.groupBy("point").agg(F.sum("first").alias("first"), F.array(*in_slot).alias("counts"))
    drawn = points.select("point", "first", "counts").mapInArrow(_null_divergences(bins, permutations, seed), "perm int, jsd double, support long")
    null = global_js_divergence(drawn, ["perm"]).select("perm", "jsd")
    reached = F.count_if((F.col("jsd") >= F.col("observed") - 1e-12) & ~F.isnan("jsd"))
    test = null.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), ((1 + reached) / (permutations + 1)).alias("p_value"))
    return test, null


def family_jsd(resid: DataFrame, studies: tuple, reach: float, bins: int, family: str = "family_id", study: str = "study") -> DataFrame:
    """(family, jsd, support): the weighted divergence of each family's residuals, all families at once."""
    return jct(resid.where(F.col(family).isNotNull()), studies, reach, bins, [family], study)


def family_contribution_scores(families: DataFrame) -> DataFrame:
    """``families`` (jsd, support) with ``weight`` (share of all support) and ``score`` = weight * jsd; 0 without support."""
    total = families.agg(F.sum("support").alias("__total"))
    weighed = families.crossJoin(F.broadcast(total))
    weight = F.coalesce(F.col("support") / F.nullif("__total", F.lit(0)), F.lit(0.0))
    return weighed.withColumn("weight", weight).withColumn("score", F.col("weight") * F.col("jsd")).drop("__total")


#: The largest divergence there is.
MAX_JSD = math.log(2)
