"""Search of subsets of a family's genes by inner products.

A task gets a family's candidates and some of the first members of subsets; the inner
products of all candidates, with each other and with the ancestor, then give length and
angle of every sum, so no sums of vectors are made, and a level of subsets is a few array
operations.  Families of many subsets are searched by many tasks, each from its own first
members.  A subset that not even the longest later genes can bring to a result is not
extended; decisions within rounding of a limit are made from the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import vec_norm
from .reshape import bucketed

#: Subsets of a task, about; entries of a level held at once; and the share within which limits are checked exactly.
TASK_SUBSETS, HELD, CLOSE = 2_000_000, 1 << 20, 1e-9


@dataclass(frozen=True)
class Family:
    """Candidates in order: vectors, their smallest later length of the family, and the ancestor."""

    vectors: np.ndarray
    suffix_min: np.ndarray
    ancestor: np.ndarray


def later_minimum(genes: DataFrame, family: str, gene: str, vector: str) -> DataFrame:
    """(family, gene, v, candidate, suffix_min): the smallest length among all later genes of the family.

    Families are parted by ranges of genes, so that none is sorted in one task.
    """
    rows = genes.select(family, gene, F.col(vector).alias("v"), F.coalesce("candidate", F.lit(False)).alias("candidate")).withColumn("norm", vec_norm("v"))
    parts = bucketed(rows, family, gene)
    inside = Window.partitionBy("bucket", family).orderBy(gene).rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(family).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    ends = parts.groupBy("bucket", family).agg(F.min("norm").alias("low")).withColumn("later", F.min("low").over(across)).drop("low")
    found = parts.withColumn("own", F.min("norm").over(inside)).join(ends, ["bucket", family])
    return found.select(family, gene, "v", "candidate", F.least("own", "later").alias("suffix_min"))


def _direct(family: Family, members: np.ndarray) -> tuple[float, float, float]:
    """(length of the sum, angle to the ancestor, length of what remains), component by component as for single vectors."""
    total = family.vectors[members[0]]
    for k in members[1:]:
        total = total + family.vectors[k]
    add = lambda x: float(np.cumsum(np.append(0.0, x))[-1])
    size, own = np.sqrt(add(total * total)), np.sqrt(add(family.ancestor * family.ancestor))
    angle = np.arccos(np.clip(add(total * family.ancestor) / (size * own), -1, 1)) if size * own > 0 else np.nan
    rest = family.ancestor - total
    return size, float(angle), np.sqrt(add(rest * rest))


class Dosage:
    """Sums within ``max_angle`` of the ancestor and (1 + gain) times as long or longer."""

    def __init__(self, gain: float, max_angle: float):
        self.gain, self.max_angle = gain, max_angle

    def judge(self, family: Family, size, angle, rest, last):
        own = np.sqrt(family.ancestor @ family.ancestor)
        near, large = angle <= self.max_angle, size >= (1 + self.gain) * own  # NaN is not near
        return near & large, near & ~large

    def close(self, family: Family, size, angle, rest):
        limit = (1 + self.gain) * np.sqrt(family.ancestor @ family.ancestor)
        return (np.abs(np.cos(angle) - np.cos(self.max_angle)) <= CLOSE) & (self.max_angle < np.pi) | (np.abs(size - limit) <= CLOSE * limit)

    def hopeless(self, family: Family, size, rest, reach):
        limit = (1 + self.gain) * np.sqrt(family.ancestor @ family.ancestor)
        return size + reach < limit * (1 - CLOSE)


class Subfunctionalization:
    """Sums within ``threshold`` of the ancestor; others go on while a later gene is not longer than what remains."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def judge(self, family: Family, size, angle, rest, last):
        hit = rest <= self.threshold
        return hit, ~hit & (family.suffix_min[last] <= rest)  # NaN: no later gene

    def close(self, family: Family, size, angle, rest):
        scale = np.sqrt(family.ancestor @ family.ancestor) + size
        return np.abs(rest * rest - self.threshold**2) <= CLOSE * scale * scale

    def hopeless(self, family: Family, size, rest, reach):
        return rest - reach > self.threshold + CLOSE * (rest + reach)


def search(family: Family, firsts: np.ndarray, max_size: int, rule):
    """Members (positions, ascending) of all results whose first member is one of ``firsts``."""
    m = len(family.vectors)
    gram = family.vectors @ family.vectors.T
    along, own = family.vectors @ family.ancestor, float(family.ancestor @ family.ancestor)
    lengths = np.sqrt(np.diag(gram))
    # Sums of the 0, 1, 2, ... longest later candidates.
    longest = np.zeros((m + 1, max_size + 1))
    top = np.zeros(max_size)
    for k in range(m - 1, -1, -1):
        top = np.sort(np.append(top, lengths[k]))[::-1][:max_size]
        longest[k, 1:] = np.cumsum(top)
    level = [(firsts[:, None].astype(np.int32), np.diag(gram)[firsts], along[firsts])]
    for size in range(2, max_size + 1):
        grown = []
        for members, square, dot in level:
            step = max(1, HELD // max(1, m))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                last = some[:, -1]
                row, j = np.nonzero(np.arange(m)[None, :] > last[:, None])
                cross = gram[some].sum(axis=1)[row, j]
                new_square = np.maximum(square[at : at + step][row] + 2 * cross + gram[j, j], 0.0)
                new_dot = dot[at : at + step][row] + along[j]
                length = np.sqrt(new_square)
                with np.errstate(invalid="ignore", divide="ignore"):
                    angle = np.where(length * np.sqrt(own) > 0, np.arccos(np.clip(new_dot / (length * np.sqrt(own)), -1, 1)), np.nan)
                rest = np.sqrt(np.maximum(own - 2 * new_dot + new_square, 0.0))
                for k in np.flatnonzero(rule.close(family, length, angle, rest)):
                    length[k], angle[k], rest[k] = _direct(family, np.append(some[row[k]], j[k]))
                with np.errstate(invalid="ignore"):
                    hit, go_on = rule.judge(family, length, angle, rest, j)
                full = np.concatenate([some[row], j[:, None].astype(np.int32)], axis=1)
                yield from full[hit]
                if size < max_size:
                    go_on &= ~rule.hopeless(family, length, rest, longest[j + 1, max_size - size])
                    if go_on.any():
                        grown.append((full[go_on], new_square[go_on], new_dot[go_on]))
        level = grown


def run_search(candidates: DataFrame, family: str, gene: str, rule, parts: int) -> DataFrame:
    """(family, members, searched_size) from candidates (family, gene, v, suffix_min, ancestor, most, subsets).

    Candidates with components that are null or not finite, or of another number of axes
    than the ancestor, are in no result.
    """
    row = F.struct(F.col(gene).alias("gene"), "v", "suffix_min")
    grouped = candidates.where("most >= 2").groupBy(family).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["gene"] < b["gene"], -1).when(a["gene"] > b["gene"], 1).otherwise(0)).alias("rows"), F.first("ancestor").alias("ancestor"), F.first("most").alias("most"), F.first("subsets").alias("subsets"))
    units = F.least(F.size("rows"), F.greatest(F.lit(1), F.ceil(F.col("subsets") / TASK_SUBSETS))).cast("int")
    spread = grouped.withColumn("units", units).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).repartition(parts, family, "unit")
    kinds = candidates.schema
    schema = T.StructType([kinds[family], T.StructField("members", T.ArrayType(kinds[gene].dataType)), T.StructField("searched_size", T.IntegerType())])
    columns = spread.select(family, "rows.gene", "rows.v", "rows.suffix_min", "ancestor", "most", "units", "unit")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(schema)
        for batch in batches:
            for at in range(batch.num_rows):
                key, genes, vectors, suffix, ancestor, most, units, unit = (batch.column(k)[at].as_py() for k in range(8))
                ancestor = np.array(ancestor if ancestor is not None and None not in ancestor else [np.nan], float)
                fine = [k for k, v in enumerate(vectors) if v is not None and len(v) == len(ancestor) and None not in v and np.isfinite(v).all()]
                if len(fine) < 2 or not np.isfinite(ancestor).all():
                    continue
                known = Family(np.array([vectors[k] for k in fine], float), np.array([np.nan if suffix[k] is None else suffix[k] for k in fine]), ancestor)
                found = []
                for members in search(known, np.arange(unit, len(fine), units), most, rule):
                    found.append([genes[fine[k]] for k in members])
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(found), f.type) if n != 1 else pa.array(found, f.type) for n, (x, f) in enumerate(zip((key, None, most), own))], schema=own)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(found), f.type) if n != 1 else pa.array(found, f.type) for n, (x, f) in enumerate(zip((key, None, most), own))], schema=own)

    return columns.mapInArrow(run, schema)
