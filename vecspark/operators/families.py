"""Families of vectors: centroids, distances and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean_distance, vec_subtract
from .reshape import to_long, to_vector


def mean_vector(vectors: DataFrame, vector_col: str = "v", where: Column | None = None) -> DataFrame:
    """(v): the component-wise mean of the selected vectors; none selected: zeros of the same length."""
    long = vectors.select(F.posexplode(vector_col).alias("pos", "value"), *([] if where is None else [where.alias("chosen")]))
    chosen = F.col("value") if where is None else F.when(F.col("chosen"), F.col("value"))
    means = long.groupBy("pos").agg(F.coalesce(F.avg(chosen), F.lit(0.0)).alias("value"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v"))


def group_centroid(vectors: DataFrame, family_col: str = "family_id", vector_col: str = "v", orthologs: str | None = None) -> DataFrame:
    """(family, c): each family's centroid, over all genes or those whose ``orthologs`` column is true.

    Every family of the table has a row; one without a selected gene has a zero vector.
    Genes without a family (null) are left out.
    """
    long = to_long(vectors.where(F.col(family_col).isNotNull()), family_col, vector_col, (orthologs,) if orthologs else ())
    value = F.when(F.col(orthologs), F.col("value")) if orthologs else F.col("value")
    means = long.groupBy(family_col, "pos").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("value"))
    return to_vector(means, family_col, out="c")


def with_centroid(vectors: DataFrame, centroids: DataFrame, family_col: str = "family_id") -> DataFrame:
    """``vectors`` with their family's centroid ``c`` (null where the family is unknown)."""
    return vectors.join(centroids.select(family_col, "c"), family_col, "left")


def distance_to_centroid(vectors: DataFrame, centroids: DataFrame, family_col: str = "family_id", vector_col: str = "v", out: str = "distance") -> DataFrame:
    """``vectors`` with each vector's distance to its family's centroid; -1 for an unknown family."""
    joined = with_centroid(vectors, centroids, family_col)
    far = F.when(F.col("c").isNull(), F.lit(-1.0)).otherwise(euclidean_distance(vector_col, "c"))
    return joined.withColumn(out, far).drop("c")


def shift_field(vectors: DataFrame, centroids: DataFrame, family_col: str = "family_id", vector_col: str = "v") -> DataFrame:
    """``vectors`` with ``origin`` (the centroid), ``shift`` (vector minus centroid) and ``status``.

    ``status`` is ``ok``, or ``no_family`` where no centroid is known (both vectors null).
    """
    joined = with_centroid(vectors, centroids, family_col)
    status = F.when(F.col("c").isNull(), "no_family").otherwise("ok")
    return joined.withColumns({"shift": vec_subtract(vector_col, "c"), "status": status}).withColumnRenamed("c", "origin")


def filter_unassigned(vectors: DataFrame, family_col: str = "family_id") -> DataFrame:
    """Vectors that have a family."""
    return vectors.where(F.col(family_col).isNotNull())


def lookup(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The row of each asked id, with ``found``; columns are null for unknown ids."""
    hit = F.coalesce(F.col("found"), F.lit(False))
    return ids.select(id_col).join(df.withColumn("found", F.lit(True)), id_col, "left").withColumn("found", hit)
