import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark.operators import clustering, families, integration, loess, neighbors, normalize, outliers, paralogs, quality, reshape, trajectories
from vecspark.plans import registry, tables

NAN = float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(g, f, list(map(float, v))) for g, f, v in rows], "gene_id string, family_id int, v array<double>")


def test_centroids_and_shifts(spark):
    vec = vectors(spark, [("a", 1, (1, 2)), ("b", 1, (3, 6)), ("c", 2, (5, 5)), ("d", None, (9, 9))])
    c = families.group_centroid(vec)
    assert {r["family_id"]: r["c"] for r in c.collect()} == {1: [2, 4], 2: [5, 5]}
    marked = vec.withColumn("o", F.col("gene_id") == "a")
    assert {r["family_id"]: r["c"] for r in families.group_centroid(marked, orthologs="o").collect()} == {1: [1, 2], 2: [0, 0]}
    far = {r["gene_id"]: r["distance"] for r in families.distance_to_centroid(vec, c).collect()}
    assert far["a"] == pytest.approx(math.sqrt(5)) and far["c"] == 0 and far["d"] == -1
    shifts = {r["gene_id"]: (r["shift"], r["status"]) for r in families.shift_field(vec, c).collect()}
    assert shifts["b"] == ([1, 2], "ok") and shifts["d"] == (None, "no_family")
    assert families.mean_vector(vec, where=F.lit(False)).first()["v"] == [0, 0]
    assert quality.check_shift_field(families.shift_field(vec.where("family_id > 0"), c), vec, c).count() == 0


def test_global_rank_and_counts(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([0, 0, 0, rng.randint(0, 50)]))) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, x double")
    got = {r["id"]: r["rank"] for r in reshape.global_rank(df, "x", ["id"]).collect()}
    assert got == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    values = sorted(x for _, x in rows)
    assert reshape.nth_value(df, "x", 500).first()[0] == values[499]
    with pytest.raises(ValueError):
        reshape.range_filter(df, "x", 2.0, 1.0)


def test_distributions(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, -1.0, 0.5, 3.0, NAN)], "d double")
    p = {str(r["d"]): r["p_value"] for r in outliers.empirical_p_values(df, "d").collect()}
    assert p == {"3.0": 3 / 5, "-1.0": 1.0, "0.5": 4 / 5, "nan": None}
    ten = spark.createDataFrame([(float(k),) for k in range(1, 11)], "x double")
    assert outliers.top_percentile_threshold(ten, "x", 95).first()[0] == 10
    assert outliers.top_percentile_threshold(ten, "x", 0.1).first()[0] == 1
    assert outliers.percentile(ten, "x", 25).first()[0] == pytest.approx(np.percentile(range(1, 11), 25))
    e = {r["value"]: r["frequency"] for r in outliers.edf(ten, "x").collect()}
    assert e[10.0] == 1 and e[1.0] == 0.1


def local_fit(x, y, span, degree, at):
    """Direct weighted regression at one place."""
    near = np.sort(np.abs(x - at))[max(2, int(span * len(x) + 1e-5)) - 1]
    u = (x - at) / near
    w = np.where(u * u < 0.999, (1 - np.abs(u) ** 3) ** 3, 0)
    a = np.vander(x - at, degree + 1, increasing=True)
    return np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]


def test_loess_matches_direct_fits_at_vertices(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 300))
    y = np.sin(x) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    curve = loess.fit_loess(df, "x", "y", span=0.5, degree=2)
    for at, value in zip(curve.at, curve.value):
        assert value == pytest.approx(local_fit(x, y, 0.5, 2, at), rel=1e-6, abs=1e-8)
    fitted = {r["x"]: r["f"] for r in loess.loess(df, "x", "y", out="f", span=0.5).collect()}
    assert np.mean([(fitted[a] - np.sin(a)) ** 2 for a in x]) < 0.05


def test_loess_robust_and_identity(spark):
    line = [(float(k), 2.0 * k + 1) for k in range(40)]
    line[20] = (20.0, 500.0)
    df = spark.createDataFrame(line, "x double, y double")
    fitted = {r["x"]: r["f"] for r in loess.loess(df, "x", "y", out="f", robust=True, rounds=5).collect()}
    assert fitted[5.0] == pytest.approx(11, abs=0.5)
    same = spark.createDataFrame([(1.0, 4.0), (1.0, 6.0)], "x double, y double")
    assert {r["y"] == r["f"] for r in loess.loess(same, "x", "y", out="f").collect()} == {True}


def test_kernel_smooth(spark):
    refs = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (10.0, 7.0)], "x double, y double")
    asked = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 5.4), (4, 30.0)], "query_id int, x double")
    got = {r["query_id"]: r["y"] for r in loess.kernel_smooth(refs, asked, 1.0, 2.0).collect()}
    assert got[1] == 3 and got[2] == pytest.approx(2) and got[3] == 3 and got[4] == 7


def test_kernel_smooth_query_smooths_every_order(spark, tmp_path):
    rng = random.Random(4)
    orders = [(k, rng.uniform(85_000, 105_000)) for k in range(1, 41)] + [(41, 91_000.0)]
    parts = [(900.0 + 2 * k, rng.randint(1, 50)) for k in range(50)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.createDataFrame(parts, "p_retailprice double, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    got = {r["query_id"]: r["y"] for r in registry.queries()["kernel_smooth"](spark, f"file://{tmp_path}").collect()}
    want = {}
    for key, x in orders:
        near = [(abs(x - p * 100), p * 100, s) for p, s in parts]
        weights = [(math.exp(-((a / 500) ** 2)), s) for a, _, s in near if a <= 1500]
        exact = [s for a, _, s in near if a == 0]
        want[key] = min(exact) if exact else sum(w * s for w, s in weights) / sum(w for w, _ in weights) if weights else min(near)[2]
    assert got == {k: pytest.approx(y, abs=1e-5) for k, y in want.items()}


def test_outliers_find_planted_rows(spark):
    rng = np.random.default_rng(42)
    rows = [(f * 100 + k, f, float(abs(rng.normal(0, 1 + f / 10)) + f / 5)) for f in range(30) for k in range(100)]
    planted = {5, 1207, 1511}
    rows = [(g, f, d + 40 if g in planted else d) for g, f, d in rows]
    df = spark.createDataFrame(rows, "gene_id int, family_id int, distance double")
    got = outliers.detect_outliers(df).collect()
    assert planted <= {r["gene_id"] for r in got if r["is_outlier"]}
    assert all(0 <= r["p_value"] <= 1 for r in got) and len(got) == len(rows)
    details = outliers.family_scaling_details(df).collect()
    cutoff = np.quantile([r["y"] for r in details], 0.01)
    assert all(r["low_sd_cutoff"] == pytest.approx(cutoff) and r["used"] == (r["y"] >= r["low_sd_cutoff"]) for r in details)
    assert sum(not r["used"] for r in details) == 1 and all(r["n"] == 100 and r["dscale"] == pytest.approx(2 ** r["fitted"]) for r in details)
    lone = spark.createDataFrame([(1, 1, 2.0), (2, None, 1.0)], "gene_id int, family_id int, distance double")
    assert [(r["n"], r["fitted"], r["used"], r["dscale"]) for r in outliers.family_scaling_details(lone).collect()] == [(None, None, False, 0.0)]
    assert [r["dscale"] for r in outliers.family_scaling(lone).collect()] == [0.0]
    assert {r["gene_id"]: r["rdi"] for r in outliers.rdi(lone, outliers.family_scaling(lone)).collect()} == {1: 0.0, 2: -1.0}


def test_quantile_normalize(spark):
    long = spark.createDataFrame([(g, r, float(v)) for r, vs in (("x", (3, 1, 2)), ("y", (6, 4, 5))) for g, v in zip("abc", vs)], "gene_id string, replicate string, value double")
    got = {(r["gene_id"], r["replicate"]): r["value"] for r in normalize.quantile_normalize(long).collect()}
    assert got == {("a", "x"): 4.5, ("b", "x"): 2.5, ("c", "x"): 3.5, ("a", "y"): 4.5, ("b", "y"): 2.5, ("c", "y"): 3.5}


def test_normalize_pipeline_equals_its_steps(spark):
    rows = [(f"g{i}", "A" if j < 3 else "B", f"r{j}", 2.0 * i + 0.5 * j * (1 + i % 3)) for i in range(10) for j in range(6)]
    long = spark.createDataFrame(rows, "gene_id string, axis string, replicate string, value double")
    got = {(r["gene_id"], r["axis"]): r["value"] for r in normalize.normalize_pipeline(long).collect()}
    steps = normalize.log2_transform(normalize.axis_average(normalize.sd_normalize(long)))
    assert got == {(r["gene_id"], r["axis"]): pytest.approx(r["value"]) for r in steps.collect()}
    with pytest.raises(ValueError):
        normalize.sd_normalize(long.withColumn("value", F.lit(0.0)))


def test_gene_means_skip_what_is_not_finite(spark):
    rows = [("a", v) for v in (1, 2, NAN, 3)] + [("b", NAN), ("b", float("inf"))]
    long = spark.createDataFrame([(g, float(v)) for g, v in rows], "gene_id string, value double")
    got = {r["gene_id"]: r["mean"] for r in normalize.gene_means(long).collect()}
    assert got["a"] == 2 and math.isnan(got["b"])


def traj(spark, rows):
    return spark.createDataFrame([(s, f, t, float(v)) for s, f, vs in rows for t, v in enumerate(vs)], "sample int, factor string, t int, value double")


def test_trajectories(spark):
    t = traj(spark, [(1, "f", (1, 3, 6, 10)), (1, "d", (2, 2, 2, 2)), (2, "f", (0, 1, 0, 1)), (2, "d", (5, 1, 5, 1))])
    v = {(r["sample"], r["factor"], r["t"]): r["value"] for r in trajectories.velocity(t).collect()}
    assert [v[1, "f", k] for k in (1, 2, 3)] == [2, 3, 4] and len(v) == 12
    a = {(r["sample"], r["factor"], r["t"]): r["value"] for r in trajectories.acceleration(t).collect()}
    assert [a[1, "f", k] for k in (2, 3)] == [1, 1]
    m = {(r["sample"], r["factor"], r["t"]): (r["value"], r["status"]) for r in trajectories.minmax_trajectory(t).collect()}
    assert m[1, "d", 2] == (0, "constant") and m[1, "f", 3] == (1, "ok")
    c = trajectories.total_contributions(trajectories.contributions(t, ["f"], ["d"], "raw"))
    assert {r["sample"]: r["total"] for r in c.collect()} == {1: 40, 2: 2}
    both = {(r["sample"], r["factor"], r["dependent"], r["t"]): r for r in trajectories.velocity_acceleration_contributions(t, "raw").collect()}
    assert both[1, "f", "f", 0]["velocity"] == 0 and both[1, "f", "f", 2]["velocity"] == 9 and both[1, "f", "f", 3]["acceleration"] == 1


def test_contribution_permutations_with_equal_partners(spark):
    rows = [(s, "f", (1, 2, 3)) for s in range(4)] + [(0, "d", (9, 9, 1))] + [(s, "d", (1, 2, 3)) for s in range(1, 4)]
    local, whole = trajectories.contribution_permutation_test(traj(spark, rows), "f", "d", 50, "raw")
    p = {r["sample"]: (r["total"], r["p_value"]) for r in whole.collect()}
    assert p[0] == (30, 0)  # 9 + 18 + 3 against 14 from any partner
    at = {(r["sample"], r["t"]): r["p_value"] for r in local.collect()}
    assert at[0, 2] == 1 and at[0, 0] == 0


def test_trajectory_table_has_every_user_and_day(spark, tmp_path):
    rows = [(u, "view" if u % 2 else "click", f"2024-01-{1 + u % 3:02d} 05:00:00", float(u)) for u in range(1, 31)] + [(1, "view", "2024-01-02 23:00:00", 3.0)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    got = {(r["sample"], r["factor"], r["t"]): r["value"] for r in tables.trajectories(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 30 * 2 * 3
    assert got[1, "view", 1] == 2 and got[21, "view", 0] == 21 and got[1, "view", 0] == 0 and got[2, "view", 2] == 0
    found = registry.queries()["contribution_permutation_test"](spark, f"file://{tmp_path}").collect()
    assert len({(r["sample"], r["factor"], r["dependent"]) for r in found}) == len(found) == 30 * 4


def test_all_pairs_equal_single_permutation_tests(spark):
    rng = random.Random(2)
    t = traj(spark, [(s, f, [rng.random() for _ in range(4)]) for s in range(5) for f in "abc"])
    every = {(r["factor"], r["dependent"], r["sample"]): (r["total"], r["p_value"]) for r in trajectories.contribution_permutation_tests(t, 40)[1].collect()}
    assert len(every) == 45
    for pair in (("a", "b"), ("b", "a"), ("c", "c")):
        for r in trajectories.contribution_permutation_test(t, *pair, 40)[1].collect():
            assert every[*pair, r["sample"]] == (pytest.approx(r["total"]), r["p_value"])


def test_histograms_and_divergence(spark):
    rows = [("F", 1, k, v) for k, v in enumerate((-2, -0.5, 0.2, 1.7, 0.9, -1.2, NAN))] + [("O", 1, 10 + k, v) for k, v in enumerate((-5, 5, 5))]
    resid = spark.createDataFrame([(s, p, k, float(v)) for s, p, k, v in rows], "study string, point int, row int, resid double")
    h = {(r["study"], r["bin"]): r["n"] for r in integration.residual_histogram(resid, ["study", "point"], 2.0, 4).collect()}
    assert [h["F", b] for b in range(1, 5)] == [2, 1, 2, 1] and [h["O", b] for b in range(1, 5)] == [1, 0, 0, 2]
    same = integration.jct(resid.withColumn("study", F.explode(F.array(F.lit("F"), F.lit("O")))), ("F", "O"), 2.0, 4).first()
    assert same["jsd"] == pytest.approx(0)
    test, null = integration.jct_permutation_test(resid, ("F", "O"), 2.0, 4, 30)
    assert 1 / 31 <= test.first()["p_value"] <= 1 and null.count() == 30
    assert all(0 <= r["jsd"] <= integration.MAX_JSD for r in null.collect())
    assert integration.shared_residual_range(resid.where("false")) == 0
    zero = integration.jct(resid.withColumn("resid", F.lit(0.0)), ("F", "O"), 0.0, 4).first()
    assert zero["jsd"] == pytest.approx(0)


def test_family_divergences_and_scores(spark):
    rows = [(s, f, 1, v) for f, one, two in ((1, (-1.5, 0.5), (-1.5, 0.5)), (2, (-1.5, -1.2, -1.1), (1.5, 1.2, 1.1)), (None, (1.0,), (0.0,))) for s, vs in (("F", one), ("O", two)) for v in vs]
    resid = spark.createDataFrame(rows, "study string, family_id int, point int, resid double")
    found = integration.family_jsd(resid, ("F", "O"), 2.0, 4)
    got = {r["family_id"]: r for r in integration.family_contribution_scores(found).collect()}
    assert set(got) == {1, 2} and got[1]["jsd"] == pytest.approx(0) and got[2]["jsd"] == pytest.approx(integration.MAX_JSD)
    assert [got[k]["weight"] for k in (1, 2)] == pytest.approx([0.4, 0.6]) and got[2]["score"] == pytest.approx(0.6 * integration.MAX_JSD)
    assert integration.family_contribution_scores(found.where("false")).count() == 0


def test_lookups_and_checks(spark):
    vec = vectors(spark, [("a", 1, (1, 2)), ("b", None, (3, 6))])
    asked = spark.createDataFrame([("a",), ("x",)], "gene_id string")
    assert {r["gene_id"]: (r["v"], r["found"]) for r in families.lookup(vec, asked, "gene_id").collect()} == {"a": ([1, 2], True), "x": (None, False)}
    assert [r["gene_id"] for r in families.filter_unassigned(vec).collect()] == ["a"]
    centroids = spark.createDataFrame([(1, [1.0, 2.0]), (2, [NAN, 0.0])], "family_id int, c array<double>")
    assert quality.check_centroids(centroids).count() == 1
    traj = spark.createDataFrame([("s", "f", k, float(v)) for k, v in enumerate((2, 4, 9))], "sample string, factor string, t int, value double")
    assert trajectories.baselines(traj).first()["baseline"] == 5


def test_neighbourhoods_hold_all_residuals_of_near_genes(spark):
    means = spark.createDataFrame([(f"g{k}", float(k)) for k in range(6)], "gene_id string, mean double")
    points = spark.createDataFrame([(1, 0.2), (2, 4.4)], "point int, x double")
    resid = spark.createDataFrame([(f"g{k}", r, k + r / 10) for k in range(6) for r in range(2)], "gene_id string, replicate int, resid double")
    got = sorted((r["point"], r["rank"], r["gene_id"], r["replicate"]) for r in integration.construct_neighborhoods(points, means, resid, 2).collect())
    assert got == [(p, k, g, r) for p, k, g in ((1, 1, "g0"), (1, 2, "g1"), (2, 1, "g4"), (2, 2, "g5")) for r in range(2)]


def test_reference_points(spark):
    means = spark.createDataFrame([("s", f"g{k:03d}", float(k)) for k in range(101)] + [("s", "gx", NAN)], "study string, gene_id string, mean double")
    points = integration.pool_means(means, 3)
    assert [r["x"] for r in points.orderBy("point").collect()] == [25, 50, 75]
    assert integration.neighborhood_size(means, 101, 3) == 99  # least 100, less one gene without a mean
    near = integration.knn_1d(points, means, 3).where("point = 2").orderBy("rank").collect()
    assert [r["gene_id"] for r in near] == ["g050", "g049", "g051"]


def test_paralog_patterns(spark):
    genes = vectors(spark, [("a", 1, (0.6, 0, 0)), ("b", 1, (0.7, 0, 0)), ("c", 1, (-1, 0, 0))])
    anc = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "family_id int, a array<double>")
    assert [r["members"] for r in paralogs.dosage_effect(genes, anc, 3, gain=0.2, max_angle=1.0).collect()] == [["a", "b"]]
    parts = vectors(spark, [("a", 1, (1, 0, 0)), ("b", 1, (0, 1, 0)), ("c", 1, (0, 0, 1)), ("d", 1, (5, 5, 5))])
    whole = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "family_id int, a array<double>")
    assert [r["members"] for r in paralogs.subfunctionalization(parts, whole, 4, 0.1).collect()] == [["a", "b", "c"]]
    moved = paralogs.neofunctionalization(vectors(spark, [("a", 1, (0.9, 0.0, 0.3))]), anc, [0.05, 0.05, 0.2]).first()
    assert moved["neofunc"] == [True, False, True]
    bound = paralogs.subset_bound(parts, 4).first()
    assert (bound["n_candidates"], bound["max_size"], bound["subsets"]) == (4, 4, 11)
    angles = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9)], "family_id int, gene_id string, angle double")
    assert paralogs.filter_paralogs(angles, 0.5, "dosage").first()["members"] == ["a"]
    assert paralogs.filter_paralogs(angles, 0.5, "subfunctionalization").first()["members"] == ["b"]


def test_neighbours(spark):
    points = vectors(spark, [("a", 1, (1, 0)), ("b", 1, (2, 0)), ("c", 1, (0, 3)), ("z", 1, (0, 0))])
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, v array<double>")
    assert [r["id"] for r in neighbors.cart_neighbors(asked, points, 3).orderBy("rank").collect()] == ["a", "b", "z"]
    assert {r["id"] for r in neighbors.sphere_neighbors(asked, points, radius=0.1).collect()} == {"a", "b"}


def test_kmeans(spark):
    pts = vectors(spark, [(str(k), 1, v) for k, v in enumerate([(1, 1), (2, 2), (8, 8), (10, 10)])])
    labelled, centers = clustering.kmeans(pts, [[1.0, 1.0], [2.0, 2.0]])
    assert {r["label"]: (r["c"], r["n"]) for r in centers.collect()} == {1: ([1.5, 1.5], 2), 2: ([9.0, 9.0], 2)}
    _, tied = clustering.kmeans(pts, [[0.0, 0.0], [0.0, 0.0]], max_iterations=1)
    assert {r["label"]: r["n"] for r in tied.collect()} == {1: 0, 2: 4}


@pytest.mark.parametrize("method, heights", [("average", [17, 22, 28, 33]), ("weighted", [17, 22, 28, 35]), ("ward", [17, 23.459, 28, 43.875])])
def test_linkage(spark, method, heights):
    d = {(1, 2): 17, (1, 3): 21, (1, 4): 31, (1, 5): 23, (2, 3): 30, (2, 4): 34, (2, 5): 21, (3, 4): 28, (3, 5): 39, (4, 5): 43}
    edges = spark.createDataFrame([(i, j, float(x)) for (i, j), x in d.items()], "i int, j int, d double")
    got = clustering.linkage(edges, method).orderBy("step").collect()
    assert [r["height"] for r in got] == pytest.approx(heights, abs=1e-3)
    assert [r["size"] for r in got] == [2, 3, 2, 5]
    assert {got[3]["merge_i"], got[3]["merge_j"]} == {-2, -3}


def test_quality(spark):
    long = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", NAN), ("b", "s1", 0.0), ("b", "s2", 0.0), ("c", "s1", None), ("c", "s2", -2.0)], "gene_id string, sample string, value double")
    r = quality.data_quality_report(long).first()
    assert (r["n"], r["n_null"], r["n_nan"], r["n_zero"], r["n_negative"], r["genes_all_zero"], r["min"]) == (6, 1, 1, 2, 1, 1, -2)
    kept = {(x["gene_id"], x["sample"]): x["value"] for x in quality.clean_matrix(long, "impute_mean").collect()}
    assert kept == {("a", "s1"): 1, ("a", "s2"): 1, ("c", "s1"): -2, ("c", "s2"): -2}
    assert quality.clean_matrix(long, "remove_genes").count() == 0
    assert quality.clean_matrix(long, "remove_samples", drop_zero_genes=False).count() == 0
    ids = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "i string")
    assert quality.check_unique(ids, "i").count() == 1 and quality.check_nonempty(ids, "i").count() == 2
    vec = vectors(spark, [("a", 1, (1, NAN)), ("b", 5, (1, -1)), ("c", None, (1, 1, 1))])
    fam = spark.createDataFrame([(1, [0.0, 0.0])], "family_id int, c array<double>")
    assert [x["key"] for x in quality.check_mapping(vec, fam).collect()] == ["b"]
    assert {x["key"] for x in quality.check_values(vec, non_negative=True).collect()} == {"a", "b"}
    assert {x["check"] for x in quality.validate_all(vec, fam, fam, 2).collect()} == {"structure", "mapping", "values"}
    m = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 1.0), (1, 3, -1.0)], "i int, j int, d double")
    assert {(x["key"], x["detail"]) for x in quality.check_distance_matrix(m).collect()} == {("1,2", "symmetry"), ("2,2", "diagonal"), ("1,3", "value")}


def test_distance_check_reads_every_order(spark, tmp_path):
    rows = [(2, 3, 9000.0), (3, 2, 8000.0), (4, 4, 6000.0), (5, 9, 100.0), (6, 8, 7000.0), (8, 6, 7000.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    found = registry.queries()["check_distance_matrix"](spark, f"file://{tmp_path}").collect()
    assert {(r["key"], r["detail"]) for r in found} == {("2,3", "symmetry"), ("4,4", "diagonal"), ("5,9", "value")}


def test_jct_permutations_are_distributed_like_dealt_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice("FO"), k % 3, k, rng.gauss(0, 1)) for k in range(300)] + [("O", 7, 900 + k, rng.gauss(0, 1)) for k in range(20)] + [("F", 0, 950, NAN), ("O", 0, 951, None)]
    resid = spark.createDataFrame(rows, "study string, point int, row int, resid double")
    test, null = integration.jct_permutation_test(resid, ("F", "O"), 3.0, 8, 400)
    got = sorted(r["jsd"] for r in null.collect())
    assert got == sorted(r["jsd"] for r in integration.jct_permutation_test(resid.repartition(5), ("F", "O"), 3.0, 8, 400)[1].collect())
    bins = lambda v: min(8, math.floor((max(-3.0, min(v, 3.0)) + 3) / 0.75) + 1)

    def jsd(labels):
        total = support = 0.0
        for p in {r[1] for r in rows}:
            n = np.zeros((2, 9))
            for s, (_, q, _, v) in zip(labels, rows):
                if q == p and v is not None and v == v:
                    n[int(s == "O"), bins(v)] += 1
            p0, p1 = (x / max(x.sum(), 1) for x in n)
            mid = (p0 + p1) / 2
            total += n.sum() * sum(np.sum(x[x > 0] * np.log(x[x > 0] / mid[x > 0])) for x in (p0, p1)) / 2
            support += n.sum()
        return total / support

    assert test.first()["observed"] == pytest.approx(jsd([r[0] for r in rows]))
    want = []
    for _ in range(400):
        labels = [r[0] for r in rows]
        for p in {r[1] for r in rows}:
            own = [k for k, r in enumerate(rows) if r[1] == p]
            dealt = [labels[k] for k in own]
            rng.shuffle(dealt)
            for k, s in zip(own, dealt):
                labels[k] = s
        want.append(jsd(labels))
    assert np.percentile(got, [10, 25, 50, 75, 90]) == pytest.approx(np.percentile(want, [10, 25, 50, 75, 90]), rel=0.1)
    masked = resid.withColumn("near", F.col("row") < 150)
    assert integration.residual_histogram(masked, ["study", "point"], 3.0, 8, mask="near").agg(F.sum("n")).first()[0] == 150
    only = integration.jct_permutation_test(masked, ("F", "O"), 3.0, 8, 5, mask="near")[0].first()["observed"]
    assert only == pytest.approx(integration.jct(resid.where("row < 150"), ("F", "O"), 3.0, 8).first()["jsd"])


def test_exact_quantiles(spark):
    rng = random.Random(8)
    values = [float(rng.choice([0, 0, 1, rng.randint(0, 90)])) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in [*values, NAN, None]], "x double").repartition(5)
    row = reshape.quantiles(df, "x", [0.0, 0.05, 0.333, 0.5, 1.0]).first()
    assert row["n"] == 501 and row["q"] == pytest.approx(np.quantile(values, [0.0, 0.05, 0.333, 0.5, 1.0]))
    assert reshape.quantiles(df.where("false"), "x", [0.5]).first()["q"] == [None]


def test_subsets_of_a_large_family_stop_at_the_limit(spark):
    genes = vectors(spark, [(f"g{k}", 1, (0.3, 0, 0)) for k in range(6)])
    anc = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "family_id int, a array<double>")
    assert paralogs.dosage_effect(genes, anc, 4, gain=0.1).count() == 15
    assert paralogs.dosage_effect(genes, anc, 4, gain=0.1, limit=40).count() == 0  # 15 + 20 subsets of 2 and 3 genes


def test_queries_use_the_operators_defaults(spark, monkeypatch):
    seen = {}

    def spy(module, name):
        def caught(*args, **given):
            seen[name] = given
            return spark.range(1).select(F.lit(1).alias("label"), F.lit(1).alias("n")), spark.range(1).select(F.lit(1).alias("label"), F.lit(1).alias("n"))

        monkeypatch.setattr(module, name, caught)

    spy(integration, "jct_permutation_test"), spy(trajectories, "contribution_permutation_tests"), spy(clustering, "kmeans")
    for name in ("jct_permutation_test", "contribution_permutation_test", "kmeans"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == {"jct_permutation_test": {}, "contribution_permutation_tests": {}, "kmeans": {}}


def test_motions_are_joined_before_their_pairs(spark):
    from vecspark.operators import trajectories

    values = {"a": [1.0, 2.0, 4.0, 8.0], "b": [0.0, 3.0, 3.0, 5.0]}
    traj = spark.createDataFrame([(1, f, t, x) for f, xs in values.items() for t, x in enumerate(xs)], "sample int, factor string, t int, value double")
    found = trajectories.velocity_acceleration_contributions(traj, "raw")
    got = {(r["factor"], r["dependent"], r["t"]): (r["velocity"], r["acceleration"]) for r in found.collect()}
    assert len(got) == 16 and got["a", "b", 0] == (0, 0) and got["a", "b", 1] == (3, 0) and got["a", "b", 3] == (8, 4) and got["b", "b", 2] == (0, 9)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("dependent#" in line for line in joins)


def test_permutations_send_every_series_once_to_a_block(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, f, [rng.choice([0.0, 0.1, 0.2, 0.3, rng.random()]) for _ in range(4)]) for s in range(40) for f in "ab"]
    t = traj(spark, rows).where("NOT (sample = 3 AND factor = 'a' AND t = 2)").withColumn("value", F.when(F.expr("sample = 4 AND factor = 'b' AND t = 1"), float("nan")).otherwise(F.col("value")))
    whole = lambda: {(r["factor"], r["dependent"], r["sample"]): (r["total"], r["p_value"]) for r in trajectories.contribution_permutation_tests(t, 30, "raw")[1].collect()}
    values = {(r["sample"], r["factor"], r["t"]): r["value"] for r in t.collect()}
    place = {r["sample"]: (r["k"], r["draws"]) for r in spark.range(40).select(F.col("id").cast(t.schema["sample"].dataType).alias("sample"), F.col("id").alias("k")).select("sample", "k", F.expr("transform(sequence(1, 30), p -> pmod(k + 1 + pmod(xxhash64(0, sample, p), 39L), 40L))").alias("draws")).collect()}

    def total(s, f, other, d):
        both = [(values[s, f, k], values[other, d, k]) for k in range(4) if (s, f, k) in values and (other, d, k) in values]
        out = 0.0
        for x, y in both:
            out += x * y
        return out

    want = {(f, d, s): (total(s, f, s, d), sum(total(s, f, o, d) >= total(s, f, s, d) for o in place[s][1]) / 30) for s in range(40) for f in "ab" for d in "ab"}
    assert {k: p for k, (_, p) in whole().items()} == {k: p for k, (_, p) in want.items()}
    monkeypatch.setattr(trajectories, "BLOCK_DRAWS", 150)  # five samples a block
    asked = []
    real = trajectories._Block.partners
    assert {k: p for k, (_, p) in whole().items()} == {k: p for k, (_, p) in want.items()}
    block = trajectories._Block((1, 2), [0], [0], False)
    monkeypatch.setattr(trajectories._Block, "_exact", lambda self, *a: asked.append(len(a[0])) or np.ones((len(a[0]), 1, 1), bool))
    import pyarrow as pa

    block.add(np.array([0, 1]), trajectories._Partners(np.array([[[1.0, 2.0]], [[0.3, 0.1]]]), np.ones((2, 1, 2), bool)), pa.array([[1, 7], [0, 7]]))
    real(block, np.array([7]), trajectories._Partners(np.array([[[4.0, 1.0]]]), np.ones((1, 1, 2), bool)))
    assert not asked and block.reached.ravel().tolist() == [1, 1]  # 6 against 5, 1.3 against 0.1: told by the products of matrices
    real(block, np.array([0]), trajectories._Partners(np.array([[[0.3, 0.1]]]), np.ones((1, 1, 2), bool)))
    assert asked == [1]  # too close to tell


def test_removed_genes_need_no_sort_of_their_rows(spark):
    nan = float("nan")
    rows = [("a", 1, 1.0), ("a", 2, nan), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 1, 0.0), ("c", 2, -3.0), (None, 1, nan)]
    long = spark.createDataFrame(rows, "gene_id string, sample int, value double")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many genes
        found, all_zero = quality.clean_matrix(long), quality.clean_matrix(long, drop_zero_genes=False)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.where("gene_id IS NOT NULL").collect()))
        assert got == [("c", 1, 0.0), ("c", 2, -3.0)]
        assert {r["gene_id"] for r in all_zero.collect()} == {"b", "c", None}  # a row without a gene is of none that goes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_permutations_count_single_times_with_the_totals(spark, monkeypatch):
    rng, up, down = random.Random(6), float(np.nextafter(0.1, 1)), float(np.nextafter(0.1, 0))
    some = [0.0, -0.0, 0.1, up, down, -0.1, -up, 3.0, 0.7, 1e-200, -2e-160, 1e200]  # products of different values may be equal, vanish or overflow
    rows = [(s, f, [rng.choice(some) for _ in range(5)]) for s in range(40) for f in "ab"]
    t = traj(spark, rows).where("NOT (sample = 3 AND factor = 'a' AND t = 2) AND NOT (sample = 5 AND factor = 'b')").withColumn("value", F.when(F.expr("sample = 4 AND factor = 'b' AND t = 1"), float("nan")).otherwise(F.col("value")))
    values = {(r["sample"], r["factor"], r["t"]): r["value"] for r in t.collect()}
    drawn = {r["s"]: r["draws"] for r in spark.range(40).select(F.col("id").cast(t.schema["sample"].dataType).alias("s"), "id").select("s", F.expr("transform(sequence(1, 30), p -> pmod(id + 1 + pmod(xxhash64(0, s, p), 39L), 40L))").alias("draws")).collect()}

    def product(s, f, other, d, k):
        return values[s, f, k] * values[other, d, k] if (s, f, k) in values and (other, d, k) in values else None

    def reached(s, f, d, k):
        own = product(s, f, s, d, k)
        return sum(x is not None and x >= own for x in (product(s, f, o, d, k) for o in drawn[s])) / 30

    want = {(s, f, d, k): (repr(product(s, f, s, d, k)), reached(s, f, d, k)) for s in range(40) for f in "ab" for d in "ab" for k in range(5) if product(s, f, s, d, k) is not None}

    def found():
        local, whole = trajectories.contribution_permutation_tests(t, 30, "raw")
        got = {(r["sample"], r["factor"], r["dependent"], x["t"]): (repr(x["contribution"]), x["p_value"]) for r in whole.collect() for x in r["times"]}
        assert got == {(r["sample"], r["factor"], r["dependent"], r["t"]): (repr(r["contribution"]), r["p_value"]) for r in local.collect()}
        return got

    assert found() == want
    monkeypatch.setattr(trajectories, "BLOCK_DRAWS", 150)  # five samples a block
    monkeypatch.setattr(trajectories, "COMPARED", 64)
    assert found() == want
