"""Subset search against trying every subset, gene by gene."""

import math
import random

import numpy as np
import pytest

from vecspark.operators import paralogs, subsets


def brute(genes, ancestors, size, judge):
    """(family, members) with the rules applied to sums of vectors; ``judge`` gives (result, go on)."""
    out = set()
    for family, a in ancestors.items():
        rows = sorted(g for g in genes if g[1] == family)
        norms = [math.sqrt(sum(x * x for x in g[2])) for g in rows]
        level = [([k], rows[k][2]) for k in range(len(rows)) if rows[k][3]]
        for _ in range(2, size + 1):
            grown = []
            for members, total in level:
                for k in range(members[-1] + 1, len(rows)):
                    if rows[k][3]:
                        new = [x + y for x, y in zip(total, rows[k][2])]
                        hit, go_on = judge(new, a, norms[k + 1 :])
                        if hit:
                            out.add((family, tuple(rows[i][0] for i in [*members, k])))
                        elif go_on:
                            grown.append(([*members, k], new))
            level = grown
    return out


def length(v):
    return math.sqrt(sum(x * x for x in v))


def dosage(gain, max_angle):
    def judge(total, a, later):
        size = length(total) * length(a)
        near = size > 0 and math.acos(max(-1, min(1, sum(x * y for x, y in zip(total, a)) / size))) <= max_angle
        large = length(total) >= (1 + gain) * length(a)
        return near and large, near and not large

    return judge


def remainder(threshold):
    def judge(total, a, later):
        rest = length([x - y for x, y in zip(a, total)])
        return rest <= threshold, bool(later) and min(later) <= rest

    return judge


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("per_task", [5, 2_000_000])
def test_equals_brute_force(spark, monkeypatch, seed, per_task):
    monkeypatch.setattr(subsets, "TASK_SUBSETS", per_task)
    rng = random.Random(seed)
    number = lambda: float(rng.choice([0, 1, -1, 0.5, 2])) if seed == 2 else rng.gauss(0.3, 1)
    genes = [(f"g{k:02d}", rng.randrange(4), [number() for _ in range(3)], rng.random() < 0.8) for k in range(34)]
    ancestors = {f: [number() for _ in range(3)] for f in range(4)}
    df = spark.createDataFrame(genes, "gene_id string, family_id int, v array<double>, candidate boolean").repartition(3)
    anc = spark.createDataFrame(list(ancestors.items()), "family_id int, a array<double>")
    for size, gain, angle in ((2, 0.1, math.pi), (3, 0.5, 1.2), (4, 1.0, 2.0)):
        got = {(r["family_id"], tuple(r["members"])) for r in paralogs.dosage_effect(df, anc, size, gain, angle).collect()}
        assert got == brute(genes, ancestors, size, dosage(gain, angle))
    for size, threshold in ((2, 1.0), (3, 0.8), (5, 0.5)):
        found = paralogs.subfunctionalization(df, anc, size, threshold).collect()
        assert {(r["family_id"], tuple(r["members"])) for r in found} == brute(genes, ancestors, size, remainder(threshold))
        assert {r["searched_size"] for r in found} <= {size}


def test_a_large_family_is_searched_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(subsets, "TASK_SUBSETS", 20_000)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1000, 5))
    genes = [(k, 1, v.tolist()) for k, v in enumerate(vectors)]
    a = (vectors[17] + vectors[700]).tolist()
    df = spark.createDataFrame(genes, "gene_id int, family_id int, v array<double>")
    anc = spark.createDataFrame([(1, a)], "family_id int, a array<double>")
    got = {tuple(r["members"]) for r in paralogs.subfunctionalization(df, anc, 2, 0.05).collect()}
    sums = vectors[:, None, :] + vectors[None, :, :]
    i, j = np.nonzero(np.sqrt(((sums - np.array(a)) ** 2).sum(axis=2)) <= 0.05)
    assert got == {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y} and (17, 700) in got
    found = paralogs.subfunctionalization(df, anc, 3, 0.05, limit=600_000).collect()
    assert {r["searched_size"] for r in found} == {2} and {tuple(r["members"]) for r in found} == got


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    genes = [("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.5]), ("c", 1, [nan, 1.0]), ("d", 1, [1.0]), ("e", 1, None), ("f", None, [1.0, 1.0]), ("g", 2, [1.0, 1.0]), ("b", 1, [1.0, 0.5])]
    df = spark.createDataFrame(genes, "gene_id string, family_id int, v array<double>")
    anc = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 1.0]), (3, None)], "family_id int, a array<double>")
    assert sorted(r["members"] for r in paralogs.dosage_effect(df, anc, 2, 0.1, 1.0).collect()) == [["a", "b"], ["a", "b"], ["b", "b"]]
    assert paralogs.dosage_effect(df.limit(0), anc, 3).count() == 0
