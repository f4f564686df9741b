"""Exact order statistics by selection: brackets from a bounded summary, counts, and a sort of what is left in between.

No pass sorts or shuffles the column.  Each takes one aggregation: a summary of bounded
size gives values just below and above every wanted rank; counting how many values are
below them tells if the rank is in between, and only values in between go on.  When few
are left they are counted by value and read off.  Wrong guesses of the summary cost a
pass, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import dropped, stored

#: Relative size of the summary, and values of a bracket that are sorted at last.
ACCURACY, FEW = 10_000, 50_000
#: Kinds that have such summaries.
KINDS = (T.NumericType, T.DateType, T.TimestampType)


@dataclass
class Bracket:
    """Where the value of a rank is: above ``low`` and below ``high``, or at them if they are closed."""

    rank: int
    low: Any = None
    high: Any = None
    low_open: bool = False
    high_open: bool = False
    below: int = 0
    size: int = 0

    def holds(self, value: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & ((value > F.lit(self.low)) if self.low_open else (value >= F.lit(self.low)))
        if self.high is not None:
            out = out & ((value < F.lit(self.high)) if self.high_open else (value <= F.lit(self.high)))
        return out

    def narrow(self, low, high, low_lt: int, low_le: int, high_lt: int, high_le: int) -> None:
        """Takes new ends, with the numbers of all values less than, and up to, each."""
        if low_le < self.rank:
            self.low, self.low_open, self.below = low, True, low_le
        elif low_lt < self.rank:
            self.low, self.high, self.low_open, self.high_open, self.below = low, low, False, False, low_lt
        else:
            self.high, self.high_open = low, True
        if self.low is not None and self.low == self.high and not self.low_open:
            return
        if high_lt >= self.rank:
            self.high, self.high_open = high, True
        elif high_le >= self.rank:
            self.low, self.high, self.low_open, self.high_open, self.below = high, high, False, False, high_lt
        else:
            self.low, self.low_open, self.below = high, True, high_le

    @property
    def known(self) -> bool:
        return self.low is not None and self.low == self.high


def at_ranks(column: DataFrame, ranks: list[int], n: int, few: int = FEW, accuracy: int = ACCURACY) -> dict[int, Any]:
    """The values at 1-based ranks of a stored column ``value`` of ``n`` values without null and NaN."""
    value, found = F.col("value"), {}
    todo = [Bracket(rank, size=n) for rank in sorted(set(ranks))]
    while todo:
        small = [b for b in todo if b.size <= few]
        for b in small:  # what is left in between, counted by value
            place = b.below
            for r in column.where(b.holds(value)).groupBy("value").agg(F.count("*").alias("n")).orderBy("value").collect():  # ``few`` rows at most
                place += r["n"]
                if place >= b.rank:
                    found[b.rank] = r["value"]
                    break
        todo = [b for b in todo if b.size > few]
        if not todo:
            break
        ask = []
        for k, b in enumerate(todo):
            share, margin = (b.rank - b.below) / b.size, 2 / accuracy
            wanted = F.array(*(F.lit(min(1.0, max(0.0, s))) for s in (share - margin, share + margin)))
            ask.append(F.percentile_approx(F.when(b.holds(value), value), wanted, accuracy).alias(f"q{k}"))
        ends = column.agg(*ask).first()
        counts = []
        for k in range(len(todo)):
            for j, end in enumerate(ends[f"q{k}"]):
                counts += [F.count_if(value < F.lit(end)).alias(f"lt{k}_{j}"), F.count_if(value <= F.lit(end)).alias(f"le{k}_{j}")]
        seen = column.agg(*counts).first()
        for k, b in enumerate(todo):
            b.narrow(*ends[f"q{k}"], *(seen[f"{c}{k}_{j}"] for j in (0, 1) for c in ("lt", "le")))
            if b.known:
                found[b.rank] = b.low
        todo = [b for b in todo if not b.known]
        if todo:
            sizes = column.agg(*(F.count_if(b.holds(value)).alias(f"n{k}") for k, b in enumerate(todo))).first()
            for k, b in enumerate(todo):
                b.size = sizes[f"n{k}"]
    return found


def order_statistics(df: DataFrame, value: Column, ranks) -> tuple[int, int, int, dict[int, Any]]:
    """(known values, nulls, NaNs, values by rank) of a column; ``ranks`` of these three numbers lists the wanted ones among the known."""
    kind = df.select(value.alias("value")).schema["value"].dataType
    column, path = stored(df.select(value.alias("value")))
    try:
        nan = F.isnan("value") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        nulls, nans, every = column.agg(F.count_if(F.col("value").isNull()), F.count_if(F.col("value").isNotNull() & nan), F.count("*")).first()
        n = every - nulls - nans
        wanted = [r for r in ranks(n, nulls, nans) if 1 <= r <= n]
        return n, nulls, nans, at_ranks(column.where(F.col("value").isNotNull() & ~nan), wanted, n) if wanted else {}
    finally:
        dropped(df.sparkSession, path)


def selectable(df: DataFrame, value: Column) -> bool:
    """Whether values of this kind can be selected so."""
    return isinstance(df.select(value.alias("value")).schema["value"].dataType, KINDS)
