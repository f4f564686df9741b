"""Checks and cleaning of measurement tables.

Every check gives violations as rows (check, key, detail); no row means the table passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite, vec_subtract


def _violations(df: DataFrame, check: str, key, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def data_quality_report(long: DataFrame, gene: str = "gene_id", value: str = "value") -> DataFrame:
    """One row: counts of null, NaN, infinite, zero and negative values, of genes that have null, NaN or
    infinite values, of all-zero genes, and smallest, largest and mean finite value."""
    v = F.col(value)
    finite = is_finite(value)
    genes = long.groupBy(gene).agg(
        F.count("*").alias("n"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
        F.count_if(v == 0).alias("n_zero"),
        F.count_if(v < 0).alias("n_negative"),
        F.min(F.when(finite, v)).alias("low"),
        F.max(F.when(finite, v)).alias("high"),
        F.sum(F.when(finite, v)).alias("total"),
        F.count_if(finite).alias("n_finite"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_null", "n_nan", "n_inf", "n_zero", "n_negative")]
    bad = [F.count_if(F.col(c) > 0).alias(f"genes_{c[2:]}") for c in ("n_null", "n_nan", "n_inf")]
    return genes.agg(*sums, *bad, F.count_if(F.col("n_zero") == F.col("n")).alias("genes_all_zero"), F.min("low").alias("min"), F.max("high").alias("max"), (F.sum("total") / F.nullif(F.sum("n_finite"), F.lit(0))).alias("mean"))


STRATEGIES = ("remove_genes", "remove_samples", "impute_zero", "impute_mean", "smart_impute")


def clean_matrix(long: DataFrame, strategy: str = "remove_genes", small: float | None = None, drop_zero_genes: bool = True, gene: str = "gene_id", sample: str = "sample", value: str = "value") -> DataFrame:
    """``long`` without missing values.

    Values up to ``small`` in size become 0; NaN and infinite ones are missing.  Then genes
    or samples with missing values go, or these become 0 or their gene's mean; ``smart_impute``
    drops genes that miss over half of their values before.  Genes of zeros go at last.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    v = F.when(is_finite(value), F.col(value))
    if small is not None:
        v = F.when(F.abs(v) <= small, F.lit(0.0)).otherwise(v)
    kept = long.withColumn(value, v)
    missing = F.col(value).isNull()
    if strategy == "remove_genes":
        # One row per gene tells both what is missing and what is zero.  Its hash table is small beside the genes' rows, which need no sort.
        size = F.max(F.abs(value)) == 0 if drop_zero_genes else F.lit(False)
        bad = kept.groupBy(gene).agg(F.count_if(missing).alias("__missing"), size.alias("__zero")).where("__missing > 0 OR __zero").select(gene)
        return kept.join(bad.hint("shuffle_hash"), gene, "left_anti")
    if strategy == "remove_samples":
        kept = kept.join(kept.where(missing).select(sample).distinct(), sample, "left_anti")
    elif strategy == "impute_zero":
        kept = kept.withColumn(value, F.coalesce(value, F.lit(0.0)))
    else:
        stats = kept.groupBy(gene).agg(F.avg(value).alias("__mean"), (F.count_if(missing) / F.count("*")).alias("__share"))
        if strategy == "smart_impute":
            stats = stats.where("__share <= 0.5")
        kept = kept.join(stats, gene).withColumn(value, F.coalesce(value, "__mean", F.lit(0.0))).drop("__mean", "__share")
    if drop_zero_genes:
        zero = kept.groupBy(gene).agg(F.max(F.abs(value)).alias("__m")).where("__m = 0")
        kept = kept.join(zero, gene, "left_anti")
    return kept


def check_unique(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that occur more than once."""
    return _violations(df.groupBy(id_col).count().where("count > 1"), "unique", F.col(id_col), F.col("count"))


def check_nonempty(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that are null or blank, and how many rows have each."""
    blank = df.where(F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == ""))
    return _violations(blank.groupBy(id_col).count(), "nonempty", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("count"))


def check_mapping(vectors: DataFrame, families: DataFrame, gene: str = "gene_id", family: str = "family_id") -> DataFrame:
    """Genes whose family is not in the table of families (null is allowed: unassigned)."""
    unknown = vectors.where(F.col(family).isNotNull()).join(families.select(family), family, "left_anti")
    return _violations(unknown, "mapping", F.col(gene), F.col(family))


def check_values(vectors: DataFrame, id_col: str = "gene_id", vector: str = "v", non_negative: bool = False, check: str = "values") -> DataFrame:
    """Vectors with a null, NaN or infinite component, or a negative one if that is not allowed."""
    bad = F.exists(vector, lambda x: F.coalesce(~is_finite(x) | (x < 0 if non_negative else F.lit(False)), F.lit(True)))
    return _violations(vectors.where(F.col(vector).isNull() | bad), check, F.col(id_col), F.lit("not finite or negative" if non_negative else "not finite"))


def check_centroids(centroids: DataFrame, family: str = "family_id", vector: str = "c") -> DataFrame:
    """Centroids with a component that is not finite."""
    return check_values(centroids, family, vector, check="centroids")


def check_shift_field(shifts: DataFrame, vectors: DataFrame, centroids: DataFrame, gene: str = "gene_id", family: str = "family_id", tolerance: float = 1e-10) -> DataFrame:
    """Shifts whose origin is not their family's centroid, or that are not vector minus centroid."""
    known = vectors.select(gene, family, "v").join(centroids.select(family, "c"), family, "left").withColumnRenamed(family, "__family")
    both = shifts.select(gene, "origin", "shift").join(known, gene, "left")
    far = lambda a, b: F.coalesce(F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) > tolerance, F.lit(True))), lambda x: x), F.lit(True))
    detail = F.when(F.col("c").isNull(), "no family").when(far("origin", "c"), "origin").when(far("shift", vec_subtract("v", "c")), "shift")
    return _violations(both.withColumn("detail", detail).where("detail IS NOT NULL"), "shift_field", F.col(gene), F.col("detail"))


def check_structure(vectors: DataFrame, n_axes: int, id_col: str = "gene_id", vector: str = "v") -> DataFrame:
    """Vectors that do not have the given number of axes."""
    return _violations(vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != n_axes), "structure", F.col(id_col), F.size(vector))


def check_distance_matrix(distances: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Entries (i, j, d) that are negative or not finite, not zero at i = j, or unlike their mirror image."""
    d = F.col("d")
    single = F.when(F.coalesce(~is_finite(d) | (d < 0), F.lit(True)), "value").when((F.col("i") == F.col("j")) & (d != 0), "diagonal")
    name = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"))
    alone = _violations(distances.withColumn("detail", single).where("detail IS NOT NULL"), "distances", name, F.col("detail"))
    mirror = distances.select(F.col("j").alias("i"), F.col("i").alias("j"), d.alias("e"))
    unlike = distances.join(mirror, ["i", "j"]).where((F.col("i") < F.col("j")) & (F.abs(d - F.col("e")) > tolerance))
    return alone.unionByName(_violations(unlike, "distances", name, F.lit("symmetry")))


def validate_all(vectors: DataFrame, families: DataFrame, centroids: DataFrame, n_axes: int, shifts: DataFrame | None = None, non_negative: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """All violations of a bundle's tables, but for the checks in ``skip``."""
    checks = {
        "structure": lambda: check_structure(vectors, n_axes),
        "unique": lambda: check_unique(vectors, "gene_id").unionByName(check_unique(families, "family_id")),
        "nonempty": lambda: check_nonempty(vectors, "gene_id").unionByName(check_nonempty(families, "family_id")),
        "mapping": lambda: check_mapping(vectors, families),
        "values": lambda: check_values(vectors, non_negative=non_negative),
        "centroids": lambda: check_centroids(centroids),
    }
    if shifts is not None:
        checks["shift_field"] = lambda: check_shift_field(shifts, vectors, centroids)
    out = None
    for name, check in checks.items():
        if name not in skip:
            out = check() if out is None else out.unionByName(check())
    if out is None:
        raise ValueError("every check is skipped")
    return out

