"""Changes of shape, and ranks and cumulative counts over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored
from .selection import order_statistics, selectable


def to_long(vectors: DataFrame, id_col: str = "gene_id", vector_col: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per component: the id, kept columns, ``pos`` (from 0) and ``value``."""
    return vectors.select(id_col, *keep, F.posexplode(vector_col).alias("pos", "value"))


def to_vector(long: DataFrame, *keys: str, pos_col: str = "pos", value_col: str = "value", out: str = "v") -> DataFrame:
    """One row per key with its values as a vector in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(value_col).alias("x"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda s: s["x"]).alias(out))


def bucketed(df: DataFrame, *by: str, bucket_col: str = "bucket") -> DataFrame:
    """``df`` with a bucket number that grows with the ``by`` columns (nulls first, NaN last); equal rows share one.

    A bucket is a range partition of about equal size, so buckets are as many as shuffle
    partitions.  The table is stored, as ranges would be drawn anew at another evaluation.
    """
    return stored(df.repartitionByRange(*by).withColumn(bucket_col, F.spark_partition_id()))[0]


def _offsets(sized: DataFrame, descending: bool = False) -> DataFrame:
    """(bucket, offset): rows in earlier buckets (a row per bucket: small)."""
    order = F.desc("bucket") if descending else F.asc("bucket")
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def global_rank(df: DataFrame, value: str, ties: list[str], by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row by value, then tie columns, within the ``by`` columns.

    Rows are sorted inside range partitions only, and counts of earlier partitions are
    added; a frequent value is parted by the tie columns.  No task sorts the whole table.
    """
    by = by or []
    keys = [*by, value, *ties]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    parts, _ = stored(ranges)
    bucket, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = F.broadcast(_offsets(parts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("size"))))
    ranked = parts.withColumn("bucket", bucket).join(offsets, "bucket").withColumn(out, place + F.col("offset") + 1).drop("bucket", "offset", "__at")
    if by:
        starts = ranked.groupBy(*by).agg(F.min(out).alias("__start"))
        ranked = ranked.join(starts, by).withColumn(out, F.col(out) - F.col("__start") + 1).drop("__start")
    return ranked


def cumulative_counts(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """(value, n, cumulative): each distinct value, how often it is there, and how many rows are up to it.

    Copies of a value are counted before anything is sorted.
    """
    counts = bucketed(df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")), "value")
    offsets = _offsets(counts.groupBy("bucket").agg(F.sum("n").alias("size")), descending)
    order = F.desc("value") if descending else F.asc("value")
    inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("cumulative", F.sum("n").over(inside)).join(F.broadcast(offsets), "bucket")
    return running.select("value", "n", (F.col("cumulative") + F.col("offset")).alias("cumulative"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(q, n): exact quantiles by linear interpolation on (n - 1) share, as one array, and the number of values.

    Null and NaN are left out; without any value ``q`` holds nulls.  The values are selected
    (see ``selection``), not sorted; this runs at once, and only the result is returned.
    """
    q, n = quantile_values(df, value, shares)
    return df.sparkSession.createDataFrame([(q, n)], "q array<double>, n long")


def quantile_values(df: DataFrame, value: str, shares: list[float]) -> tuple[list[float | None], int]:
    """``quantiles`` as plain values."""

    def ends(n: int, share: float) -> tuple[int, int, float]:
        at = (n - 1) * float(share)
        low = math.floor(at)
        return low + 1, min(low + 2, n), at - low

    n, _, _, found = order_statistics(df, F.col(value).cast("double"), lambda n, *_: [r for share in shares for r in ends(n, share)[:2]])
    if not n:
        return [None] * len(shares), 0
    places = [ends(n, share) for share in shares]
    return [found[low] + (found[high] - found[low]) * part for low, high, part in places], n


def nth_value(df: DataFrame, value: str, position: int) -> DataFrame:
    """The row or rows at a 1-based position of the sorted values (nulls first, NaN last).

    Numbers, dates and times are selected at once, values of other kinds are sorted.
    """
    if not selectable(df, F.col(value)):
        return cumulative_counts(df, value).where((F.col("cumulative") >= position) & (F.col("cumulative") - F.col("n") < position)).select("value")
    n, nulls, nans, found = order_statistics(df, F.col(value), lambda n, nulls, nans: [position - nulls])
    row = [(None,)] if position <= nulls else [(found.get(position - nulls, math.nan),)]
    schema = T.StructType([T.StructField("value", df.schema[value].dataType)])
    return df.sparkSession.createDataFrame(row if 1 <= position <= nulls + n + nans else [], schema)


def range_filter(df: DataFrame, value: str, lower: float, upper: float) -> DataFrame:
    """Rows with lower <= value <= upper, ascending; lower > upper is an error."""
    if lower > upper:
        raise ValueError("lower bound above upper bound")
    return df.where(F.col(value).between(lower, upper)).orderBy(value)


def first_true(df: DataFrame, mask: Column, order: list[str], at_most: int) -> DataFrame:
    """The first ``at_most`` rows, by order, that a mask holds for."""
    return df.where(mask).orderBy(*order).limit(at_most)
