import math

import pytest
from pyspark.sql import functions as F

from vecspark.functions import names, vectors as V


def one(spark, expression, **columns):
    df = spark.range(1)
    for name, value in columns.items():
        df = df.withColumn(name, F.array(*map(F.lit, map(float, value))) if isinstance(value, (list, tuple)) else F.lit(value))
    return df.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "v, tv, angle",
    [((1, 1, 1), 0, 0), ((0, 0, 2), 1, math.degrees(math.acos(1 / math.sqrt(3)))), ((0, 0, 0), 1, 90), ((1, 0), 1, 45), ((5,), 0, 0)],
)
def test_versatility(spark, v, tv, angle):
    r = one(spark, V.versatility("v"), v=v)
    assert r["versatility"] == pytest.approx(tv) and r["angle_deg"] == pytest.approx(angle)


def test_angles_and_norms(spark):
    assert one(spark, V.angle_between("a", "b"), a=(1, 0), b=(0, 2)) == pytest.approx(math.pi / 2)
    assert one(spark, V.angle_between("a", "b"), a=(0, 0), b=(0, 2)) is None
    assert one(spark, V.vec_norm("a"), a=(3, 4)) == 5
    assert one(spark, V.unit_normalize("a"), a=(0, 0)) is None
    assert one(spark, V.rms_normalize("a"), a=(0, 0)) == [0, 0]
    assert one(spark, V.rms_normalize("a"), a=(3, 3)) == [1, 1]
    assert one(spark, V.clock_hand_angle("a", "b"), a=(1, 0), b=(0, -1)) == pytest.approx(-math.pi / 2)
    assert one(spark, V.clock_hand_angle("a", "b"), a=(1, 0, 0), b=(0, -1, 0)) == pytest.approx(math.pi / 2)
    for normal, sign in (((0, 0, 1), -1), ((0, 0, -1), 1), ((1, 1, 1), -1), ((1, 0, 0), 1)):
        assert one(spark, V.clock_hand_angle("a", "b", normal), a=(1, 0, 0), b=(0, -1, 0)) == pytest.approx(sign * math.pi / 2)
    assert one(spark, V.clock_hand_angle("a", "b", (0, 0, 1), (2, 3, 0)), a=(0, 0, 1, 0), b=(0, 0, 0, -1)) == pytest.approx(-math.pi / 2)
    assert one(spark, V.rap_project("a"), a=(1, 2, 3)) == [-1, 0, 1]
    assert one(spark, V.rap_project_field("a", "b"), a=(1, 2), b=(1, 0)) == [-1, 1]


def test_numbers(spark):
    assert one(spark, V.clamp(F.lit(5.0), F.lit(3.0), F.lit(1.0))) == 3
    assert one(spark, V.log_base(F.lit(8.0), F.lit(2.0))) == pytest.approx(3)
    assert one(spark, V.log_base(F.lit(8.0), F.lit(1.0))) is None
    assert one(spark, V.log2p1("a"), a=(1, -1, 3)) == [1, None, 2]
    assert one(spark, V.radians_positive(F.lit(-90.0))) == pytest.approx(1.5 * math.pi)
    assert one(spark, V.is_close(F.lit(1.0), F.lit(1.0 + 1e-13)))
    assert not one(spark, V.is_close(F.lit(float("nan")), F.lit(float("nan"))))
    assert one(spark, V.is_close(F.lit(float("inf")), F.lit(float("inf"))))
    assert not one(spark, V.above(F.lit(float("nan")), F.lit(1.0))) and one(spark, V.below(F.lit(0.5), F.lit(1.0)))
    assert one(spark, V.true_positions("m", 2), m=F.array(*map(F.lit, (True, False, True, True)))) == [1, 3]
    assert one(spark, V.select_axes("a", [2, 0]), a=(1, 2, 3)) == [3, 1]
    assert one(spark, V.axis_contributions("a"), a=(1, -3)) == [0.25, 0.75]
    assert one(spark, V.axis_contributions("a"), a=(0, 1e-9)) is None
    assert one(spark, V.axis_contributions("a"), a=(1, float("nan"))) is None


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Liver_rep1", "Liver_2", "Liver_replicate13", "Liver")], "n string")
    assert {r[0] for r in df.select(names.axis_group("n")).collect()} == {"Liver"}
    axes = spark.createDataFrame([(x,) for x in ("leaf_control", "leaf_heat", "root_control", "root_cold")], "axis string")
    pairs = {tuple(r) for r in names.fold_change_pairs(axes, "control", ["heat", "cold"]).collect()}
    assert pairs == {("leaf_control", "leaf_heat", "leaf_heat_logFC"), ("root_control", "root_cold", "root_cold_logFC")}
    with pytest.raises(ValueError):
        names.fold_change_pairs(axes, "control", ["dry"])
