"""Selection of order statistics against sorting."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import outliers, reshape, selection

NAN = float("nan")


def values(kind, n, seed=1):
    rng = random.Random(seed)
    if kind == "flat":
        return [float(rng.gauss(0, 10)) for _ in range(n)]
    if kind == "heavy":  # half of all rows have one value, and its neighbours are close
        return [5.0 if rng.random() < 0.5 else 5.0 + rng.choice([-1, 1]) * 10.0 ** -rng.randrange(1, 9) for _ in range(n)]
    if kind == "few":
        return [float(rng.randrange(3)) for _ in range(n)]
    return [1.5] * n


@pytest.mark.parametrize("kind", ["flat", "heavy", "few", "one"])
@pytest.mark.parametrize("few,accuracy", [(20, 10), (20, 50), (100_000, 100)])
def test_ranks_equal_sorting(spark, kind, few, accuracy):
    data = values(kind, 4000)
    df = spark.createDataFrame([(x,) for x in data], "value double").repartition(5).cache()
    ranks = [1, 2, 100, 1999, 2000, 2001, 3990, 4000]
    found = selection.at_ranks(df, ranks, len(data), few, accuracy)
    data.sort()
    assert found == {r: data[r - 1] for r in ranks}
    df.unpersist()


def test_quantiles_nulls_and_nan(spark):
    data = values("flat", 500) + [None] * 7 + [NAN] * 5
    df = spark.createDataFrame([(x,) for x in data], "x double")
    known = [x for x in data if x is not None and not math.isnan(x)]
    shares = [0, 0.37, 0.5, 0.999, 1]
    row = reshape.quantiles(df, "x", shares).first()
    assert row["n"] == 500 and row["q"] == pytest.approx(np.quantile(known, shares).tolist())
    assert reshape.quantiles(df.where("x IS NULL"), "x", [0.5]).first()["q"] == [None]
    known.sort()
    for place, want in ((1, None), (7, None), (8, known[0]), (507, known[-1]), (508, NAN), (512, NAN)):
        assert repr([r["value"] for r in reshape.nth_value(df, "x", place).collect()]) == repr([want])
    assert reshape.nth_value(df, "x", 513).count() == 0 and reshape.nth_value(df, "x", 0).count() == 0
    assert outliers.top_percentile_threshold(df, "x", 50).first()["threshold"] == known[math.ceil(505 * 0.5) - 1]
    assert math.isnan(outliers.top_percentile_threshold(df, "x", 100).first()["threshold"])
    assert outliers.top_percentile_threshold(df.limit(0), "x", 100).first()["threshold"] is None


def test_other_kinds(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k * 7 % 31) for k in range(31)]
    df = spark.createDataFrame([(d, k, str(k), k * 10) for k, d in enumerate(days)], "d date, k int, s string, l long")
    assert reshape.nth_value(df, "d", 3).first()["value"] == datetime.date(2024, 1, 3)
    assert reshape.nth_value(df, "l", 4).first()["value"] == 30 and reshape.nth_value(df, "s", 2).first()["value"] == "1"
    assert reshape.nth_value(df.select(F.col("k").cast("decimal(10,2)").alias("k")), "k", 31).first()["value"] == 30


def test_no_range_shuffle_of_the_column(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda *a, **k: calls.append(a) or 1 / 0)
    assert reshape.quantiles(spark.range(1001).toDF("x"), "x", [0.25]).first()["q"] == [250]
    assert not calls
