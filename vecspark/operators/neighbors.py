"""Neighbours of given query vectors among all points, by distance or by direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit_normalize
from .metric_index import MetricIndex, build_index, nearest, within
from .reshape import global_rank


def cart_neighbors(queries: DataFrame, points: DataFrame | MetricIndex, k: int | None = None, radius: float | None = None, query_id: str = "query_id", point_id: str = "gene_id", vector: str = "v", ranked: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): each query's ``k`` nearest points, or all within ``radius``, or both.

    ``points`` may be an index of them (``metric_index.build_index``), which then serves any
    number of calls.  Ties go by id.  Distances that are null (vectors of unequal length)
    take no part.  Without ``k`` a query may have any number of neighbours; they are ranked
    over range partitions, unless they need not be ``ranked``.
    """
    if k is None and radius is None:
        raise ValueError("give k, radius or both")
    index = points if isinstance(points, MetricIndex) else build_index(points, point_id, vector)
    if k is not None:
        return nearest(queries, index, k, radius, query_id, vector)
    if not ranked:
        return within(queries, index, radius, query_id, vector)
    return global_rank(within(queries, index, radius, query_id, vector), "distance", ["id"], [query_id]).withColumn("rank", F.col("rank").cast("int"))


def sphere_neighbors(queries: DataFrame, points: DataFrame, k: int | None = None, radius: float | None = None, query_id: str = "query_id", point_id: str = "gene_id", vector: str = "v", ranked: bool = True) -> DataFrame:
    """``cart_neighbors`` of unit vectors: neighbours by cosine.  Vectors of length 0 take no part."""
    scaled = [df.withColumn(vector, unit_normalize(vector)).where(F.col(vector).isNotNull()) for df in (queries, points)]
    return cart_neighbors(*scaled, k, radius, query_id, point_id, vector, ranked)
