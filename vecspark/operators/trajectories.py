"""Trajectories (sample, factor, t, value): motion, contributions and their permutation test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored
from .reshape import global_rank

KEYS = ("sample", "factor")
MODES = ("raw", "min", "mean")


def _difference(traj: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy("t")
    moved = traj.withColumn("__before", F.lag("value").over(order)).withColumn("__k", F.row_number().over(order))
    return moved.where("__k > 1").withColumn("value", F.col("value") - F.col("__before")).drop("__before", "__k")


def velocity(traj: DataFrame) -> DataFrame:
    """First differences, at the later time of each step; the first time has none."""
    return _difference(traj)


def acceleration(traj: DataFrame) -> DataFrame:
    """Second differences; empty for series of fewer than three times."""
    return _difference(_difference(traj))


def minmax_trajectory(traj: DataFrame) -> DataFrame:
    """Each series scaled to [0, 1]; a constant one becomes 0 with ``status`` ``constant`` (else ``ok``)."""
    whole = Window.partitionBy(*KEYS)
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    sized = traj.withColumns({"__low": low, "__width": high - low})
    flat = F.col("__width") <= 0
    value = F.when(flat, 0.0).otherwise((F.col("value") - F.col("__low")) / F.col("__width"))
    return sized.withColumns({"value": value, "status": F.when(flat, "constant").otherwise("ok")}).drop("__low", "__width")


def _baseline(mode: str, value: str = "value") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return {"raw": F.lit(0.0), "min": F.min(value), "mean": F.avg(value)}[mode]


def baselines(traj: DataFrame, mode: str = "mean") -> DataFrame:
    """(sample, factor, baseline): 0, the smallest value or the mean of each series."""
    return traj.groupBy(*KEYS).agg(F.first("value").alias("__any"), _baseline(mode).alias("baseline")).drop("__any")


def _centred(traj: DataFrame, mode: str) -> DataFrame:
    return traj.join(baselines(traj, mode), list(KEYS)).select("sample", "factor", "t", (F.col("value") - F.col("baseline")).alias("value"))


def contributions(traj: DataFrame, factors: list[str] | None = None, dependents: list[str] | None = None, mode: str = "mean") -> DataFrame:
    """(sample, factor, dependent, t, contribution): products of the series' distances from their baselines.

    For every pair of a selected factor and a selected dependent (none given: all).
    """
    centred = _centred(traj, mode)
    left = centred if factors is None else centred.where(F.col("factor").isin(factors))
    right = centred if dependents is None else centred.where(F.col("factor").isin(dependents))
    right = right.select("sample", F.col("factor").alias("dependent"), "t", F.col("value").alias("__d"))
    return left.join(right, ["sample", "t"]).select("sample", "factor", "dependent", "t", (F.col("value") * F.col("__d")).alias("contribution"))


def total_contributions(local: DataFrame) -> DataFrame:
    """(sample, factor, dependent, total)."""
    return local.groupBy("sample", "factor", "dependent").agg(F.sum("contribution").alias("total"))


def velocity_acceleration_contributions(traj: DataFrame, mode: str = "mean") -> DataFrame:
    """(sample, factor, dependent, t, velocity, acceleration): contributions of both motions of all pairs.

    Times that have no difference yet count as 0.
    """
    keys = [*KEYS, "t"]
    # Both motions meet in the series before their pairs are made, which are many more.
    v = _centred(velocity(traj), mode).withColumnRenamed("value", "__v")
    a = _centred(acceleration(traj), mode).withColumnRenamed("value", "__a")
    both = traj.select(*keys).join(v, keys, "left").join(a, keys, "left")
    right = both.select("sample", F.col("factor").alias("dependent"), "t", F.col("__v").alias("__w"), F.col("__a").alias("__b"))
    product = lambda x, y: F.coalesce(F.col(x) * F.col(y), F.lit(0.0))
    return both.join(right, ["sample", "t"]).select("sample", "factor", "dependent", "t", product("__v", "__w").alias("velocity"), product("__a", "__b").alias("acceleration"))


def contribution_permutation_test(traj: DataFrame, factor: str, dependent: str, permutations: int = 1000, mode: str = "mean", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """p-values of the contributions of one factor and one dependent, for every sample.

    Each permutation keeps a sample's factor and takes the dependent of another sample,
    drawn by a hash of seed, sample and permutation.  Returns (sample, t, contribution,
    p_value) and (sample, total, p_value); p is the share of permutations that reach the
    observed value (NaN never does).  At least two samples are needed.  Times that either
    side lacks (no row, or null) take no part; of repeated rows the smallest value counts.
    """
    one = traj.where(F.col("factor").isin(factor, dependent))
    local, whole = _permuted(one, [factor], [dependent], permutations, mode, seed)
    return local.drop("factor", "dependent"), whole.drop("factor", "dependent", "times")


def contribution_permutation_tests(traj: DataFrame, permutations: int = 1000, mode: str = "mean", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``contribution_permutation_test`` for every pair of a factor and a dependent, which lead the columns after ``sample``.

    All pairs of a sample take the same partner in a permutation.  The second table also has
    ``times``, an array of (t, contribution, p_value), so its rows are whole results; the first
    is its rows of single times.
    """
    return _permuted(traj, None, None, permutations, mode, seed)


#: Draws of a block at most, its values at most, its counts at most, products held at once, and pairs whose totals are taken at once.
BLOCK_DRAWS, BLOCK_VALUES, BLOCK_COUNTS, HELD_PRODUCTS, PAIRS = 1 << 24, 1 << 23, 1 << 25, 1 << 21, 4096
#: Values of partners that are compared at once, of few enough pairs for their number to fit a byte.
COMPARED, BYTE = 1 << 16, 255
#: Sizes of values whose products neither overflow nor vanish.
LEAST, MOST = 1e-100, 1e100


def _series(known: DataFrame, factors: list, times: list, mode: str) -> DataFrame:
    """(sample, values, missing): each sample's distances from its baselines, and the places that have none.

    Places go factor by factor, time by time; the values are the bytes of doubles, 0 where there is none.
    """
    _baseline(mode)
    spark, span, width = known.sparkSession, len(times), len(factors) * len(times)
    f = spark.createDataFrame(list(enumerate(factors)), T.StructType([T.StructField("fi", T.LongType()), known.schema["factor"]]))
    t = spark.createDataFrame(list(enumerate(times)), T.StructType([T.StructField("ti", T.LongType()), known.schema["t"]]))
    placed = known.join(F.broadcast(f), "factor").join(F.broadcast(t), "t")
    cell = (F.col("fi") * span + F.col("ti")).alias("cell")
    whole = placed.groupBy("sample").agg(F.collect_list(F.struct(cell, F.col("value").cast("double").alias("value"))).alias("s"))
    whole = whole.select("sample", F.col("s.cell").alias("cells"), F.col("s.value").alias("values"))
    schema = T.StructType([whole.schema["sample"], T.StructField("values", T.BinaryType()), T.StructField("missing", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, cells, values = batch.num_rows, batch.column(1), batch.column(2).flatten()
            place = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy())) * width + cells.flatten().to_numpy()
            there = values.is_valid().to_numpy(zero_copy_only=False)
            place, x = place[there], values.to_numpy(zero_copy_only=False)[there]
            order = np.lexsort((x, place))  # by time, so that equal series have equal baselines
            place, x = place[order], x[order]
            base = np.zeros(n * len(factors))
            if mode == "mean":
                number = np.bincount(place // span, minlength=len(base))
                base = np.bincount(place // span, x, minlength=len(base)) / np.maximum(number, 1)
            elif mode == "min":
                base[:] = np.nan
                np.fmin.at(base, place // span, x)
            first = np.diff(place, prepend=-1) > 0
            place, x = place[first], x[first]
            out, lacks = np.zeros(n * width), np.ones(n * width, bool)
            out[place], lacks[place] = x - base[place // span], False
            row, lost = np.nonzero(lacks.reshape(n, width))
            ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            missing = pa.ListArray.from_arrays(pa.array(ends), pa.array(lost.astype(np.int32)))
            packed = pa.array([v.tobytes() for v in out.reshape(n, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, missing], names=schema.names)

    return whole.mapInArrow(run, schema)


class _Partners:
    """Series of some samples: values and which are there, by factor and time, and of which plain products will do."""

    def __init__(self, values: np.ndarray, there: np.ndarray):
        self.values, self.there = values, there
        size = np.abs(values)
        self.plain = there.all(axis=(1, 2)) & ((size == 0) | (size >= LEAST) & (size <= MOST)).all(axis=(1, 2))

    @staticmethod
    def of(values, missing, shape: tuple[int, int]) -> "_Partners":
        """From the columns of an Arrow batch."""
        n = len(values)
        start = np.frombuffer(values.buffers()[1], np.int32)[values.offset] if n else 0
        x = np.frombuffer(values.buffers()[2], np.float64, n * shape[0] * shape[1], start) if n else np.zeros(0)
        there = np.ones((n, shape[0] * shape[1]), bool)
        there[np.repeat(np.arange(n), np.diff(missing.offsets.to_numpy())), missing.flatten().to_numpy()] = False
        return _Partners(x.reshape(n, *shape), there.reshape(n, *shape))


class _Block:
    """A block of samples with all their draws; partners stream through, and only counts stay.

    Totals are always counted, single times with ``of_times``.
    """

    def __init__(self, shape: tuple[int, int], left: list[int], right: list[int], of_times: bool):
        self.shape, self.left, self.right, self.of_times = shape, left, right, of_times
        self.k, self.parts, self.draws = [], [], []
        self.own = None

    def add(self, k: np.ndarray, series: _Partners, draws) -> None:
        """Own samples, and the numbers of their partners as an Arrow column."""
        self.draws.append((draws.flatten().to_numpy(), np.diff(draws.offsets.to_numpy())))
        self.k.append(k)
        self.parts.append(series)

    def _products(self, own: _Partners, a: np.ndarray, other: _Partners, b: np.ndarray):
        """Products (rows, factor, dependent, time), which are there, totals, and which pairs have any."""
        local = own.values[a][:, self.left, None, :] * other.values[b][:, None, self.right, :]
        there = own.there[a][:, self.left, None, :] & other.there[b][:, None, self.right, :]
        total = np.zeros(local.shape[:-1])
        for t in range(self.shape[1]):  # the same order for every row, so equal series have equal totals
            total += np.where(there[..., t], local[..., t], 0.0)
        return local, there, total, there.any(axis=-1)

    def _steps(self, n: int):
        step = max(1, HELD_PRODUCTS // max(1, len(self.left) * len(self.right) * self.shape[1]))
        return (slice(at, at + step) for at in range(0, n, step))

    def _start(self) -> None:
        self.own = _Partners(np.concatenate([p.values for p in self.parts]), np.concatenate([p.there for p in self.parts]))
        self.k, n, self.parts = np.concatenate(self.k), sum(len(p.plain) for p in self.parts), []
        sample = np.repeat(np.arange(n), np.concatenate([size for _, size in self.draws]))
        self.pairs = np.concatenate([drawn for drawn, _ in self.draws]) * n + sample  # partner, then own sample
        self.draws = []
        self.pairs.sort()
        totals = [self._products(self.own, np.arange(n)[s], self.own, np.arange(n)[s])[2:] for s in self._steps(n)]
        self.seen, self.there = np.concatenate([x[0] for x in totals]), np.concatenate([x[1] for x in totals])
        self.reached = np.zeros(self.seen.shape, np.int64)
        # Totals of any order of addition differ by less than this times the largest value of the other side.
        self.slack = np.abs(self.own.values[:, self.left]).sum(axis=2) * (8 * self.shape[1] * np.finfo(float).eps)
        if self.of_times:
            self.mine = np.ascontiguousarray(self.own.values[:, self.right])
            # Products by one value can only round to the same double if the other values differ by less than this.
            self.near = np.abs(self.mine) * (4 * np.finfo(float).eps)
            self.above, self.below = (np.zeros(self.mine.shape, np.int32) for _ in range(2))
            self.plain, self.others = np.zeros(n, np.int32), None

    def _exact(self, sample: np.ndarray, other: _Partners, partner: np.ndarray) -> np.ndarray:
        _, _, total, some = self._products(self.own, sample, other, partner)
        return (total >= self.seen[sample]) & some & self.there[sample]

    def _exact_times(self, sample: np.ndarray, other: _Partners, partner: np.ndarray) -> np.ndarray:
        local, there, *_ = self._products(self.own, sample, other, partner)
        seen, known, *_ = self._products(self.own, sample, self.own, sample)
        return (local >= seen) & there & known

    def _times(self, sample: np.ndarray, other: _Partners, values: np.ndarray, partner: np.ndarray) -> None:
        """Counts the single times of some pairs, by sample; ``values`` are the partners' of the dependents.

        A product grows or falls with the partner's value, so the values are compared, once for all factors.
        Products are compared where rounding could make different ones equal, or values are not plain.
        """
        with np.errstate(all="ignore"):
            gap = values[partner] - self.mine[sample]
            more, less = gap >= 0, gap <= 0
            close = (np.abs(gap) <= self.near[sample]) != (more & less)
        alone = close.reshape(len(sample), -1).any(axis=1) | ~(self.own.plain[sample] & other.plain[partner])
        again = np.flatnonzero(alone)
        more[again] = less[again] = False
        starts = np.flatnonzero(np.diff(sample, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sample)]):
            k = sample[a]
            self.above[k] += np.add.reduce(more[a:b].view(np.uint8), axis=0, dtype=np.uint8)
            self.below[k] += np.add.reduce(less[a:b].view(np.uint8), axis=0, dtype=np.uint8)
        self.plain += np.bincount(sample[~alone], minlength=len(self.plain)).astype(np.int32) if len(again) < len(sample) else 0
        for s in self._steps(len(again)):
            if self.others is None:
                self.others = np.zeros((len(self.k), len(self.left), *self.mine.shape[1:]), np.int32)
            own = sample[again[s]]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            self.others[own[starts]] += np.add.reduceat(self._exact_times(own, other, partner[again[s]]), starts, axis=0, dtype=np.int32)

    def _totals(self, sample: np.ndarray, other: _Partners, partner: np.ndarray, turned: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which totals are reached: by products of matrices, and one by one where these are too close to tell."""
        with np.errstate(all="ignore"):
            gap = np.matmul(self.own.values[sample][:, self.left], turned[partner]) - self.seen[sample]
            close = np.abs(gap) < self.slack[sample][:, :, None] * most[partner][:, None, :]
        out = (gap >= 0) & self.there[sample]
        again = np.flatnonzero(close.any(axis=(1, 2)) | ~(self.own.plain[sample] & other.plain[partner]))
        for s in self._steps(len(again)):
            out[again[s]] = self._exact(sample[again[s]], other, partner[again[s]])
        return out

    def partners(self, k: np.ndarray, series: _Partners) -> None:
        """Counts all draws of these partners."""
        if self.own is None:
            self._start()
        n = len(self.k)
        begin, end = np.searchsorted(self.pairs, k * n), np.searchsorted(self.pairs, (k + 1) * n)
        size = end - begin
        partner = np.repeat(np.arange(len(k)), size)
        sample = self.pairs[np.arange(len(partner)) + np.repeat(begin - np.cumsum(size) + size, size)] % n
        order = np.argsort(sample, kind="stable")
        sample, partner = sample[order], partner[order]
        theirs = np.ascontiguousarray(series.values[:, self.right])
        turned, most = np.ascontiguousarray(theirs.transpose(0, 2, 1)), np.abs(theirs).max(axis=2)
        for s in (slice(at, at + PAIRS) for at in range(0, len(sample), PAIRS)):
            starts = np.flatnonzero(np.diff(sample[s], prepend=-1))
            reached = self._totals(sample[s], series, partner[s], turned, most)
            self.reached[sample[s][starts]] += np.add.reduceat(reached, starts, axis=0, dtype=np.int64)
        if self.of_times:
            step = max(1, min(BYTE, COMPARED // max(1, theirs[:1].size)))
            for s in (slice(at, at + step) for at in range(0, len(sample), step)):
                self._times(sample[s], series, theirs, partner[s])

    def finish(self) -> None:
        """Counts the draws of partners in the block itself."""
        if self.own is None:
            self._start()
        for at in range(0, len(self.k), PAIRS):
            self.partners(self.k[at : at + PAIRS], _Partners(self.own.values[at : at + PAIRS], self.own.there[at : at + PAIRS]))

    def rows(self):
        """(own sample's number, place, observed, reached) of pairs that are there; with ``of_times`` also their single times."""
        import pyarrow as pa

        step = max(1, HELD_PRODUCTS // 4 // max(1, len(self.left) * len(self.right) * self.shape[1]))
        for at in range(0, len(self.k), step):
            some = slice(at, at + step)
            there, seen, reached = (x[some].reshape(len(x[some]), -1) for x in (self.there, self.seen, self.reached))
            row, place = np.nonzero(there)
            columns = [pa.array(x) for x in (at + row, place, seen[row, place], reached[row, place])]
            if self.of_times:
                own = np.arange(at, at + len(there))
                local, known, *_ = self._products(self.own, own, self.own, own)
                factor = self.own.values[some][:, self.left, None, :]
                counts = np.where(factor > 0, self.above[some, None], np.where(factor < 0, self.below[some, None], self.plain[some, None, None, None]))
                counts = counts if self.others is None else counts + self.others[some]
                local, known, counts = (x.reshape(*there.shape, self.shape[1])[row, place] for x in (local, known, counts))
                ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))]).astype(np.int32)
                times = [pa.array(x) for x in (np.nonzero(known)[1].astype(np.int32), local[known], counts[known].astype(np.int64))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(times, ["ti", "contribution", "reached"])))
            yield columns


def _permuted(traj: DataFrame, factors: list[str] | None, dependents: list[str] | None, permutations: int, mode: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Both tables of p-values by blocks of samples.

    Every series goes once to each block, the block's own first, and meets there all samples
    that have drawn it.  Blocks are as large as a task's memory allows, so they are few.
    What a task holds is its block, a batch, and counts; partners stream through it in any number.
    """
    spark = traj.sparkSession
    known = traj.where("sample IS NOT NULL AND factor IS NOT NULL AND t IS NOT NULL").select("sample", "factor", "t", "value")
    # Every sample's series has these axes, so they fit where one series does.
    names = sorted(r[0] for r in known.select("factor").distinct().collect())
    times = sorted(r[0] for r in known.select("t").distinct().collect())
    left, right = ([k for k, x in enumerate(names) if some is None or x in some] for some in (factors, dependents))
    series, _ = stored(_series(known, names, times, mode))
    places, _ = stored(global_rank(series.select("sample"), "sample", [], out="k").withColumn("k", F.col("k") - 1))
    n = places.count()
    if n < 2:
        raise ValueError("a permutation needs at least two samples")
    cores, width = spark.sparkContext.defaultParallelism, len(names) * len(times)
    counts = len(left) * len(right) * len(times)
    blocks = -(-n // max(1, min(BLOCK_DRAWS // max(1, permutations), BLOCK_VALUES // width, BLOCK_COUNTS // max(1, counts))))
    blocks = min(n, -(-blocks // cores) * cores)
    placed = series.join(places, "sample").withColumn("block", F.floor(F.col("k") * blocks / n).cast("int"))
    everywhere = placed.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("own", F.col("block") == F.col("target"))
    streamed = everywhere.select("target", "own", "k", "sample", "values", "missing").repartitionById(blocks, "target").sortWithinPartitions(F.desc("own"))
    draw = F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda perm: F.pmod(F.col("k") + 1 + F.pmod(F.xxhash64(F.lit(seed), "sample", perm), F.lit(n - 1)), F.lit(n)))
    streamed = streamed.select("own", "k", "values", "missing", F.when(F.col("own"), draw).otherwise(F.array().cast("array<bigint>")).alias("draws"), "sample")
    shape = (len(names), len(times))
    single = T.StructType([T.StructField("ti", T.IntegerType()), T.StructField("contribution", T.DoubleType()), T.StructField("reached", T.LongType())])
    schema = T.StructType([traj.schema["sample"], T.StructField("place", T.LongType()), T.StructField("observed", T.DoubleType()), T.StructField("reached", T.LongType()), T.StructField("times", T.ArrayType(single))])

    def run(batches):
        import pyarrow as pa

        block, samples = _Block(shape, left, right, True), []
        for batch in batches:
            own, k = int(batch.column(0).to_numpy(zero_copy_only=False).sum()), batch.column(1).to_numpy()
            part = lambda a, b: _Partners.of(batch.column(2)[a:b], batch.column(3)[a:b], shape)  # noqa: B023, E731
            if own:
                block.add(k[:own], part(0, own), batch.column(4)[:own])
                samples.append(batch.column(5)[:own])
            if own < len(k):
                block.partners(k[own:], part(own, len(k)))
        if samples:
            block.finish()
            samples = pa.concat_arrays(samples)
            for number, *columns in block.rows():
                yield pa.RecordBatch.from_arrays([samples.take(number), *columns], names=schema.names)

    found, _ = stored(streamed.mapInArrow(run, schema))
    label = lambda some, place: F.element_at(F.array(*(F.lit(names[k]) for k in some)), (place + 1).cast("int")) if some else F.lit(None).cast("string")
    pair = {"factor": label(left, F.floor(F.col("place") / max(1, len(right)))), "dependent": label(right, F.col("place") % max(1, len(right)))}
    at, share = F.array(*map(F.lit, times)).cast(T.ArrayType(traj.schema["t"].dataType)), lambda x: x / permutations
    each = F.transform("times", lambda x: F.struct(F.element_at(at, x["ti"] + 1).alias("t"), x["contribution"].alias("contribution"), share(x["reached"]).alias("p_value")))
    whole = found.withColumns(pair).select("sample", "factor", "dependent", F.col("observed").alias("total"), share(F.col("reached")).alias("p_value"), each.alias("times"))
    return whole.select("sample", "factor", "dependent", F.explode("times").alias("x")).select("sample", "factor", "dependent", "x.*"), whole
