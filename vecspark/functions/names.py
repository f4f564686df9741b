"""Expressions on sample names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis_group(name) -> Column:
    """A sample's name without a trailing ``_<n>``, ``_rep<n>`` or ``_replicate<n>``."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"_(replicate|rep)?[0-9]+$", "")


def fold_change_pairs(axes: DataFrame, control_pattern: str, conditions: list[str], axis_col: str = "axis") -> DataFrame:
    """(control, condition, label): which axes to compare, from their names.

    A control's name contains the pattern; its prefix is what stands before ``_pattern``.
    A condition's name starts with ``<prefix>_<condition>``.  The label is
    ``<condition axis>_logFC``.  No pair at all is an error, found when the pairs are made.
    """
    names = axes.select(F.col(axis_col).alias("name")).distinct()
    controls = names.where(F.col("name").contains(control_pattern))
    controls = controls.select(F.col("name").alias("control"), F.regexp_replace("name", rf"_?\Q{control_pattern}\E.*$", "").alias("prefix"))
    wanted = names.select(F.col("name").alias("condition"), F.explode(F.array(*map(F.lit, conditions))).alias("cond"))
    wanted = wanted.withColumn("prefix", F.regexp_extract("condition", r"^(.*?)_", 1))
    pairs = controls.join(wanted, "prefix").where(F.col("condition").startswith(F.concat_ws("_", "prefix", "cond")))
    pairs = pairs.select("control", "condition", F.concat("condition", F.lit("_logFC")).alias("label")).distinct()
    if pairs.isEmpty():
        raise ValueError("no axis pair fits the patterns")
    return pairs
