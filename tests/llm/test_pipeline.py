import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecspark.llm import shingle_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    passage = " ".join(f"shared{j}" for j in range(50))
    leak = "what is the answer to the great question of all things"
    rows = [(k, filler(k)) for k in range(20)]
    rows += [(20, filler(3)), (21, f"{filler(21)} {passage}"), (22, f"{passage} {filler(22)}"), (23, f"{filler(23)}. {leak}"), (24, None), (25, "")]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            path = f"{folder}-{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert len(kept["toxicity"]) == 26
    assert set(kept["simhash_near_dedup"]) == set(range(26)) - {20, 25}
    texts = {k: r["text"] for k, r in kept["substring_dedup"].items()}
    assert "shared1" not in texts[21] + texts[22] and texts[21].startswith("w21x0") and texts[5].startswith("w5x0")
    assert set(kept["benchmark_decontamination"]) == set(kept["simhash_near_dedup"]) - {23}
    assert set(kept["packing"]) == set(kept["benchmark_decontamination"])


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(26)) - {20, 23, 25}


def stages(spark, docs, folder):
    """(stage's name, its rows) of all stages, each reading what the one before stored."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}-odd-{docs.count()}-{k}"
        docs.write.mode("overwrite").parquet(path)
        docs = stage(spark, spark.read.parquet(path), folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == corpus_pipeline.COLUMNS
        yield name, docs.collect()


def test_stages_on_odd_rows_and_empty_tables(spark, folder):
    long = " ".join(f"z{k}" for k in range(60_000))
    rows = [(None, "no id"), (1, "same id"), (1, "another text"), (2, None), (3, ""), (4, long), (5, "one two three"), (5, "one two three")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "words", "hits", "score", "n", "key", "id")})
    got = dict(stages(spark, docs, folder))
    assert len(got["toxicity"]) == len(rows)
    for name in ("simhash_near_dedup", "substring_dedup", "benchmark_decontamination"):
        assert Counter(r["doc_id"] for r in got[name]) == Counter([None, 1, 1, 2, 4, 5])
        assert [r["text"] for r in got[name] if r["doc_id"] == 4] == [long]
    assert {r["doc_id"] for r in got["packing"]} == {None, 1, 2, 4, 5}
    assert sum(r["length"] for r in got["packing"] if r["doc_id"] == 4) == max(r["doc_tokens"] for r in got["packing"])
    assert all(not found for _, found in stages(spark, docs.where("false"), folder))


def test_near_copies_of_a_similarity_of_four_fifths_are_dropped(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 9999)}"
    texts = [None, "", "one two", "One  two", "one three"]
    for k in range(60):
        words = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(1 if k else 40):
            # One edit changes five shingles: similarities from about 0.7 to 0.95.
            near = list(words)
            for at in rng.sample(range(len(near)), max(1, int(len(near) * rng.uniform(0.005, 0.035)))):
                near[at] = word()
            texts.append(" ".join(near))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, bands = list(range(len(texts))), Counter()
    for b in range(len(texts)):
        for a in range(b):
            union = len(sets[a] | sets[b])
            s = len(sets[a] & sets[b]) / union if union else 1.0
            bands[int(s * 20)] += 1
            if s >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert all(bands[k] > 5 for k in range(15, 19))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(root))


def test_simhash_finds_near_copies_without_any_shared_minima(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.randint(0, 9999)}" for _ in range(300)] for _ in range(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(30 + k, " ".join([*t[:-1], "last"])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").withColumn("row", F.col("doc_id"))
    marks = shingle_dedup._marks(docs, "row", "doc_id", "text", 5)
    apart = marks.withColumn("bands", F.array(F.xxhash64("row"))).localCheckpoint()
    prints = {r["row"]: r["fingerprint"] for r in apart.collect()}
    near = {(k, 30 + k) for k in range(30) if ((prints[k] ^ prints[30 + k]) & (1 << 64) - 1).bit_count() <= shingle_dedup.DISTANCE}
    found, _ = shingle_dedup.links(apart, docs.select("row", "text"), "row", "text", 5, 0.8)
    assert len(near) > 20 and {(r["a"], r["b"]) for r in found.collect()} == near


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the keys of a set, and its copies for blocks, like the set itself, so it would take them for small tables."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:-1] + [f"end{k}"]) for k in range(4)] + [" ".join(words[:40] + [f"x{k}" for k in range(20)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", F.col("row"))
    leaders = shingle_dedup._marks(docs, "row", "doc_id", "text", 5).drop("digest")
    plans, real = [], shingle_dedup.stored
    monkeypatch.setattr(shingle_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    found, _ = shingle_dedup.links(leaders, docs.select("row", "text"), "row", "text", 5, 0.8)
    assert {x for r in found.collect() for x in r} == {0, 1, 2, 3}
    exploded = [[line for line in p.splitlines() if "Join" in line] for p in plans if "explode(bands" in p or "explode(sequence" in p]
    assert len(exploded) == 2 and all(any("SortMergeJoin [key" in line for line in joins) for joins in exploded)
