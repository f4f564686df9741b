"""Patterns of subsets of a family's genes against its ancestor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subsets import Dosage, Subfunctionalization, later_minimum, run_search


def neofunctionalization(vectors: DataFrame, ancestors: DataFrame, thresholds: list[float], family: str = "family_id", vector: str = "v") -> DataFrame:
    """``vectors`` with ``neofunc``: per axis whether abs(ancestor - gene) is above the axis's threshold."""
    joined = vectors.join(ancestors.select(family, "a"), family, "left")
    limits = F.array(*map(F.lit, map(float, thresholds)))
    moved = F.zip_with(F.zip_with("a", vector, lambda x, y: F.abs(x - y)), limits, lambda x, y: x > y)
    return joined.withColumn("neofunc", moved).drop("a")


def filter_paralogs(genes: DataFrame, threshold: float, pattern: str, family: str = "family_id", gene: str = "gene_id", angle: str = "angle") -> DataFrame:
    """(family, members): the genes that can take part in a pattern.

    ``dosage``: angle to the ancestor up to the threshold; ``subfunctionalization``: from it.
    """
    if pattern not in ("dosage", "subfunctionalization"):
        raise ValueError("pattern must be dosage or subfunctionalization")
    fits = F.col(angle) <= threshold if pattern == "dosage" else (F.col(angle) >= threshold) & ~F.isnan(angle)
    return genes.where(fits).groupBy(family).agg(F.sort_array(F.collect_set(gene)).alias("members"))


def _search(genes: DataFrame, ancestors: DataFrame, max_size: int, limit: float, family: str, gene: str, vector: str, rule) -> DataFrame:
    """(family, members, searched_size) of all families; see ``subsets``.

    A family whose subsets are too many (``subset_bound``) stops at the size that its number
    allows, which ``searched_size`` tells.
    """
    marked = genes if "candidate" in genes.columns else genes.withColumn("candidate", F.lit(True))
    ranked = later_minimum(marked.where(F.col(family).isNotNull()), family, gene, vector)
    candidates = ranked.where("candidate").join(ancestors.select(family, F.col("a").alias("ancestor")), family)
    most = subset_bound(candidates, max_size, family, limit).select(family, F.col("max_size").alias("most"), "subsets")
    parts = int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return run_search(candidates.join(most, family), family, gene, rule, parts)


def dosage_effect(genes: DataFrame, ancestors: DataFrame, max_size: int, gain: float = 0.1, max_angle: float = math.pi, limit: float = 2.0**31 - 1, family: str = "family_id", gene: str = "gene_id", vector: str = "v") -> DataFrame:
    """(family, members, searched_size): subsets of 2 to ``max_size`` genes whose sum outgrows the ancestor.

    The sum's angle to the ancestor (``a``) must be at most ``max_angle`` (else the subset
    and all its extensions are dropped) and its length (1 + gain) times the ancestor's or
    more; such subsets are not extended.  A ``candidate`` column, if there, restricts the genes.
    A family with more than ``limit`` subsets stops at a smaller size: ``searched_size``.
    """
    return _search(genes, ancestors, max_size, limit, family, gene, vector, Dosage(gain, max_angle))


def subfunctionalization(genes: DataFrame, ancestors: DataFrame, max_size: int, threshold: float, limit: float = 2.0**31 - 1, family: str = "family_id", gene: str = "gene_id", vector: str = "v") -> DataFrame:
    """(family, members, searched_size): subsets of 2 to ``max_size`` genes whose sum is within ``threshold`` of the ancestor.

    Others are extended only while some later gene of the family (candidate or not) is not
    longer than what remains.  A family with more than ``limit`` subsets stops at a smaller
    size: ``searched_size``.
    """
    return _search(genes, ancestors, max_size, limit, family, gene, vector, Subfunctionalization(threshold))


def subset_bound(candidates: DataFrame, max_size: int, family: str = "family_id", limit: float = 2.0**31 - 1) -> DataFrame:
    """(family, n_candidates, max_size, subsets): how many subsets of 2 to max_size genes a family has.

    The size goes down until the number is within ``limit``.
    """
    counts = candidates.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n_candidates"))
    n, term, total = F.col("n_candidates").cast("double"), F.col("n_candidates").cast("double"), F.lit(0.0)
    steps = []
    for size in range(2, max_size + 1):
        term = F.greatest(F.lit(0.0), F.round(term * (n - (size - 1)) / size))
        total = total + term
        steps.append(F.struct(F.lit(size).alias("max_size"), total.alias("subsets")))
    fitting = F.filter(F.array(*steps), lambda s: s["subsets"] <= limit)
    best = F.element_at(fitting, -1) if steps else F.lit(None)
    return counts.select(family, "n_candidates", F.when(F.size(fitting) > 0, best).otherwise(F.struct(F.lit(1).alias("max_size"), F.lit(0.0).alias("subsets"))).alias("b")).select(family, "n_candidates", "b.max_size", F.col("b.subsets").cast("long").alias("subsets"))
