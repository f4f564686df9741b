"""Brute-force comparisons and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, langid, license_scan, packing, queries, sharding, simhash, substring_dedup, topk, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASH = ["row", "words", "hits", "score", "n_words", "labels", "fingerprint", "place", "shard", "start", "key"]


def docs_of(spark, texts, clash=False):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")


def corpus(seed=7, n=60):
    """Texts with shared passages, copies, near copies, blanks and nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "delta", "été", "naïve", "x1", "Ünit", "the", "of", "a"]) + str(rng.randint(0, 40))
    shared = [" ".join(word() for _ in range(rng.randint(36, 90))) for _ in range(4)]
    texts = [None, "", "  \t\n", "one", "one two", "same same " * 60]
    while len(texts) < n:
        t = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.5:
            t = f"{t}\n{rng.choice(shared)}  {' '.join(word() for _ in range(5))}"
        texts.append(t)
        if rng.random() < 0.2:
            texts.append(t)
        if rng.random() < 0.2:
            texts.append(t + " tail")
    return texts


def test_simhash_equals_brute_force(spark):
    import xxhash

    texts = corpus(n=120)
    prints = {}
    for k, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        ones = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
        prints[k] = sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = simhash.near_duplicates(docs_of(spark, texts, clash=True)).collect()
    assert {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in got} == {k: (v, find(k)) for k, v in prints.items()}
    kept = {r["doc_id"] for r in simhash.one_of_each(docs_of(spark, texts)).collect()}
    assert kept == {find(k) for k in prints}


def test_simhash_links_of_crowded_entries(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(32)) ^ (rng.getrandbits(32) << 32) for _ in range(150)} | {base, base ^ 1, base ^ 3, base ^ (1 << 63) ^ 2}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2}
    for hot in (64, 4):
        assert {tuple(r) for r in simhash.links(df, 2, hot=hot)[0].collect()} == want
    assert {tuple(r) for r in simhash.links(df, 3, hot=4)[0].collect()} == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 31)) and all(got[100 + k] == 100 for k in range(1, 20))
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_hand(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone |= set(range(p, p + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("window, prefix", [(35, 8), (5, 5), (3, 1), (1, 1)])
def test_substring_dedup_equals_brute_force(spark, window, prefix):
    texts = corpus(seed=window)
    docs, want = docs_of(spark, texts, clash=True).drop("n_words"), dict(enumerate(removed_by_hand(texts, window)))
    for group in (1024, 4, 0):  # all subtrees in memory, some, none
        got = substring_dedup.remove_repeats(docs, window=window, prefix=prefix, joiner=" ", group=group).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_nodes_of_subtrees_equal_brute_force():
    import numpy as np

    rng = random.Random(3)
    words = np.array([rng.choice([1, 2, 3]) if rng.random() < 0.6 else 4 for _ in range(600)], np.uint64)
    words[400:500] = words[100:200]
    for depth in (1, 3, 9, 40):
        begin = np.array(rng.sample(range(600 - depth), 400))
        group = np.array([rng.randint(0, 5) for _ in begin])
        seen = [(g, *words[b : b + depth].tolist()) for g, b in zip(group.tolist(), begin.tolist())]
        assert substring_dedup.deep_suffixes(words, begin, group, depth).tolist() == [k for k, x in enumerate(seen) if seen.count(x) > 1]
    none = np.zeros(0, np.int64)
    assert not len(substring_dedup.deep_suffixes(words, none, none, 5))


def test_words_of_one_kilobyte_that_differ_are_not_the_same(spark):
    # Alternating-parity texts of 1,024 letters, which sums of powers modulo 2**64 cannot tell apart.
    even = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    odd = "".join("ba"[k.bit_count() % 2] for k in range(1024))
    same = " ".join(f"w{k}" for k in range(34))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(spark, [f"{even} {same}", f"{odd} {same}"]), window=35).collect()}
    assert got == {0: (35, 0), 1: (35, 0)}
    alternating = [" ".join(("x", "y")[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]
    want = {k: x[1] for k, x in enumerate(removed_by_hand(alternating, 35))}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs_of(spark, alternating)).collect()} == want


def test_run_hashes_tell_runs_apart():
    import numpy as np

    from vecspark.llm.common import run_hashes, word_hashes

    data = np.frombuffer("ab ab ab ab cd ab ab ab ab cd \u00e9\u00e9 x".encode(), np.uint8)
    inside = np.concatenate([[0], (data != 0x20).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    for own in word_hashes(data, starts, ends):
        assert len(set(zip(words, own.tolist()))) == len(set(words)) == len(set(own.tolist()))
        for n in range(1, 8):
            runs = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            hashes = run_hashes(own, n).tolist()
            assert len(hashes) == len(runs) and len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))


def test_substring_dedup_keeps_spacing_and_clean_texts(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"a  b\t{passage}\nc   d", f"{passage} z", " clean\n text ", None]
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == {0: "a  b\nc   d", 1: "z", 2: " clean\n text ", 3: ""}


BENCH = [(1, "Q one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (4, "..."), (None, "lonely words here"), (5, "one two three four five six seven eight nine ten")]


@pytest.mark.parametrize("limits", [(20_000, 0), (0, 20_000), (0, 0)])
def test_decontamination_all_ways(spark, limits):
    limit = dict(zip(("set_limit", "broadcast_limit"), limits))
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = ["a ONE two, three four five six seven-eight nine ten!", "has a Short Item inside", None, "", "one two three four five six seven eight nine", "lonely words here; short item"]
    found = decontaminate.find_hits(docs_of(spark, texts, clash=True), items, **limit)
    out = decontaminate.with_items(found.withColumn("n_hit", F.size(decontaminate.hit_places())), decontaminate.item_grams(items), ["doc_id", "n_hit"])
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in out.collect()}
    assert got == {0: (10, [1, 5]), 1: (2, [2]), 2: (0, []), 3: (0, []), 4: (0, []), 5: (5, [2])}
    docs = docs_of(spark, texts)
    assert {r["doc_id"] for r in decontaminate.drop_documents(docs, items, **limit).collect()} == {2, 3, 4}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, items, **limit).collect()}
    assert cut[0] == "a " and cut[1] == "has a inside" and cut[4] == texts[4] and cut[2] is None


def test_decontamination_with_an_empty_benchmark(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_documents(docs_of(spark, ["a b", None]), items).count() == 2


def test_license_scan(spark):
    texts = ["Released under the MIT license. UNDER THE MIT LICENSE", "Apache License, Version 2.0", None, "", "licensed under CC BY-NC 4.0", "under the mit", "GNU General Public License, version 3"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts, clash=True)).collect()}
    assert got[0]["base_starts"] == [1, 5] and got[0]["base_labels"] == ["mit"] and got[0]["score"] == 1
    assert got[1]["base_labels"] == ["apache-2"] and got[4]["labels"] == ["cc-by-nc"]
    assert got[2]["n_words"] == 0 and got[2]["base_starts"] == [] and got[3]["score"] == 0
    assert got[5]["labels"] == [] and got[6]["labels"] == ["gpl-3"] and 0.4 < got[6]["score"] < 1
    assert license_scan.scan(docs_of(spark, []).where("false")).count() == 0


def licences_by_hand(text, templates, slack=license_scan.SLACK):
    """(label, start) of every place of every template, tried at all starts."""
    words = license_scan.words_of(text or "")
    out = set()
    for t in templates:
        for start in range(-len(t.words) + 1, len(words)):
            hits = sum(0 <= start + k < len(words) and words[start + k] == x for k, x in enumerate(t.words))
            around = range(max(start - slack, 0), max(start + len(t.words) + slack, 1))
            keys = [license_scan.words_of(k) for k in t.keys]
            if hits >= t.need and all(any(words[k : k + len(key)] == key for k in around) for key in keys):
                out.add((t.label, start, t.base))
    return out


def test_license_scan_finds_damaged_notices_like_brute_force(spark):
    rng = random.Random(5)
    templates = [*license_scan.BASE, *license_scan.NAMES, *license_scan.NOTICES]
    texts, labels = [], []
    for t in license_scan.NOTICES * 3:
        words = license_scan.words_of(t.text)
        spared = {x for k in t.keys for x in license_scan.words_of(k)}
        for k in rng.sample(range(len(words)), int(len(words) * rng.choice([0.0, 0.1, 0.15, 0.4]))):
            words[k] = words[k] if words[k] in spared else "zz"
        cut = rng.choice([0, 0, 2])  # may take a part of a key phrase
        texts.append(" ".join([*rng.choices(["the", "software", "license", "q"], k=rng.randrange(9)), *words[cut:]]))
        labels.append((t.label, not cut and words.count("zz") <= len(words) - t.need))
    texts += [None, "", "the " * 3000 + "software", "version 2 version 3 gnu general public license " * 4]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for k, text in enumerate(texts):
        by_hand = licences_by_hand(text, templates)
        assert got[k]["labels"] == sorted({label for label, *_ in by_hand})
        assert got[k]["base_starts"] == sorted(start for _, start, base in by_hand if base)
    # All uncut notices with few enough words amiss are found.
    assert sum(whole for _, whole in labels) >= 20
    assert all(label in got[k]["labels"] for k, (label, whole) in enumerate(labels) if whole)


def test_license_scan_with_own_templates(spark):
    T = license_scan.Template
    own = [T("one", "word"), T("twice", "a b a b", least=0.5), T("key", "u v w x y z", ("k k",), least=0.5), T("none", "")]
    docs = docs_of(spark, ["a word", "a b", "a b a b a", "u v w 1 2 3 k k", "u v w x y z", "word word", "word word"])
    got = [(r["labels"], r["score"]) for r in license_scan.scan(docs, own).orderBy("doc_id").collect()]
    assert got == [(["one"], 1.0), (["twice"], 0.5), (["twice"], 1.0), (["key"], 0.5), ([], 0.0), (["one"], 1.0), (["one"], 1.0)]
    assert license_scan.scan(docs, []).where("size(labels) = 0 AND score = 0").count() == 7


def top_by_hand(rows, k, step):
    import math

    known = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, a in known.items():
        if q % step == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in known.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [rng.choice([0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(5)]) for k in range(300)]
    rows += [(k, [0.5, 0.5, 0.0, 0.0, 0.0]) for k in range(300, 330)]
    rows += [(400, None), (402, [1.0, None, 0.0, 0.0, 0.0]), (404, [float("nan")] * 5), (406, [float("inf")] * 5), (408, []), (410, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for block, asked in ((65_536, 4_096), (70, 3)):
        monkeypatch.setattr(topk, "BLOCK_ROWS", block)
        monkeypatch.setattr(topk, "QUERY_ROWS", asked)
        got = defaultdict(list)
        for r in sorted(topk.top_k(df.repartition(3), df.where("vec_id % 10 = 0"), k=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got == top_by_hand(rows, 20, 10)
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (2, [0.5]), (3, [])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(twice, twice.where("vec_id = 0"), k=3).collect())
    assert got == sorted(2 * [(0, 1, 0, 4096), (0, 2, 1, 4096), (0, 3, 2, 2048)])
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_sharding(spark):
    texts = ["x" * random.Random(k).randint(0, 200) for k in range(500)] + [None, "", "y" * 5000]
    docs = docs_of(spark, texts, clash=True)
    got = sharding.assign_shards(docs, "doc_id", "text", limit=2000).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert len(got) == len(texts) and all(n <= 2000 or n == 5000 for n in size.values())
    assert all(r["shard_bytes"] == size[r["shard"]] for r in got)
    used = {s.split(".")[0] for s in size}
    assert not any(a != b and b.startswith(a) for a in used for b in used)  # a prefix code
    hot = sharding.assign_shards(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", "text", limit=3000).collect()
    hot_size = Counter()
    for r in hot:
        hot_size[r["shard"]] += r["n_bytes"]
    assert len(hot) == len(texts) and all(n <= 3000 or n == 5000 for n in hot_size.values())
    assert sharding.assign_shards(docs.where("false"), "doc_id", "text", 10).count() == 0


URLS = ["http://Example.com/en/x", "https://www.example.com/en/1", "https://a.b.net/es/2?q", "x://casino-win.org", "http://cheap-pills.example.org/", None, "no scheme", "http://com/", "http://a.com", "://net/fr/\n", "http://notexample.com/en/", "http://h.net/ES/", "a://b://c.com/en/"]


def test_url_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"rule": F.lit(1), "token": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2] == ("a.b.net", "/es/2", "net/es/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2] == "com/" and got[8][2:] == (None, "allow") and got[9][2] == "net/fr/"
    assert got[10][2] == "com/" and got[11][2] is None and got[12][:2] == ("b:", "//c.com/en/")
    assert url_filter.judge(pages.where("false"), []).count() == 0
    odd = [url_filter.Rule("block", "example.com/en"), url_filter.Rule("block", "h.net"), url_filter.Rule("allow", "a.net/es"), url_filter.Rule("allow", "b.net/es")]
    urls = ["http://example.com/english", "http://example.com/e", "http://x.h.net/q", "http://h.network/q", "http://b.net/es", "http://h.net"]
    asked = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(asked, odd).collect()} == {0: "example.com/en", 1: None, 2: "h.net", 3: None, 4: "b.net/es", 5: "h.net"}


def test_packing_is_a_lossless_cut(spark):
    import numpy as np
    from tokenizers import Tokenizer

    texts = corpus(n=80) + ["word " * 9000, "<|endoftext|> a\x1cb", "Ünïcode ΣΑΣ 日本語 İ don't"]
    whole = Tokenizer.from_file(queries.tokenizer_path())
    ids = {k: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in enumerate(texts)}
    docs = docs_of(spark, texts, clash=True)
    got = packing.pack_documents(docs, queries.tokenizer_path(), capacity=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(own) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for k, parts in pieces.items():
        assert sum(n for _, n in parts) == len(ids[k]) and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    for parts in sequences.values():
        parts.sort()
        n = parts[-1][0] + parts[-1][1]
        assert parts[0][0] == 0 and sum(x for _, x in parts) == n and (n == 256 or n & (n - 1) == 0)
    assert packing.pack_documents(docs.where("false"), queries.tokenizer_path()).count() == 0


def test_first_fit_decreasing_order():
    assert packing.first_fit_decreasing([5, 7, 3, 4, 1], 10) == [1, 0, 0, 1, 1]
    assert packing.pack([], 8) == [] and packing.pack([8, 16], 8) == [[(0, 0, 8)], [(1, 0, 8)], [(1, 8, 8)]]


def test_toxicity_on_planted_words(spark):
    rng = random.Random(1)
    vocabulary = ["tree", "house", "river", "stone", "cloud", "green", "walk", "small"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if k % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["scoundrel", "rascal"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "tree " * 50_000 + "scoundrel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(5))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (0, None), (1, 0)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in held) and got[902] >= 0.5
    assert got[900] == got[901] < 0.5
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs, none).collect())


def test_language_identification(spark):
    rng = random.Random(4)
    roots = {"aa": ["kala", "mito", "suna"], "bb": ["zwerg", "schnu", "pflitz"], "cc": ["oueau", "ième", "çoit"]}
    rows = []
    for k in range(300):
        lang = rng.choice(sorted(roots))
        rows.append((k, " ".join("".join(rng.choice(roots[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang))
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[k]["lang_pred"] == lang for k, _, lang in held)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["ambiguous"] for k in (900, 901, 902))
    unknown = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, unknown).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_are_distinct(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n
    if n > 2:
        assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= (code.shape[1] + 1) // 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op10_langid(spark, d).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_toxicity_finds_the_toxic_and_keeps_the_clean(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(labels, "doc_id", "left_semi").cache()
    partitions, models = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, rows in (("4", docs), ("9", docs.repartition(7, "text"))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            models.append(toxicity.fit(rows, labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    one, other = models
    assert (one.buckets == other.buckets).all() and (one.weights == other.weights).all() and one.intercept == other.intercept
    held = toxicity.score(docs.where(~toxicity.learnable("doc_id")), one).join(labels, "doc_id").collect()
    found = [r["toxic"] for r in held if r["score"] >= 0.5]
    assert sum(found) >= 0.9 * sum(r["toxic"] for r in held) and sum(found) >= 0.85 * len(found)


def test_queries_on_tables_with_nulls(spark, tmp_path):
    texts = corpus(n=40) + ["Under the MIT license", None]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], SCHEMA))
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(30)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame(BENCH, "item_id long, text string"), tmp_path, "benchmark")
    write(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), tmp_path, "pages")
    write(spark.createDataFrame([(k, [0.1 * k, 1.0], 0) for k in range(30)] + [(None, [1.0], 1)], "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    n = docs.count()
    for name, query in queries.queries().items():
        rows = query(spark, f"file://{tmp_path}").collect()
        if not name.startswith(("op2", "op7", "op9")):
            assert len(rows) == n, name
    assert {r["kept_sha256"] for r in queries.op3_substring_dedup(spark, f"file://{tmp_path}").where("doc_id IS NULL").collect()} == {hashlib.sha256(b"no id here").hexdigest()}


def test_queries_on_empty_tables(spark, tmp_path):
    docs = docs_of(spark, [])
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    write(spark.createDataFrame([], "page_id long, url string"), tmp_path, "pages")
    write(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    for name, query in queries.queries().items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name


def test_best_cut():
    import numpy as np

    assert toxicity.best_cut(np.array([2.0, 1.0, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0])) == 0
    assert toxicity.best_cut(np.array([-1.0, -2.0, -3.0]), np.array([1.0, 1.0, 0.0])) == -2.5


def test_more_languages_than_are_learned(spark):
    rows = [(k, f"l{k % 60:02d}", f"text number {k} of this") for k in range(300)] + [(1000 + k, "en", "the common words of english") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, at_most=3)
    assert len(model.languages) == 3 and "en" in model.languages and model.languages == langid.fit(docs.repartition(7), at_most=3).languages
    assert np.array_equal(model.weights, langid.fit(docs.repartition(7), at_most=3).weights)
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} <= set(model.languages)


def test_threshold_is_placed_with_few_labels(spark):
    docs = docs_of(spark, [f"nasty{k} bad words here" if k % 4 == 0 else f"kind{k} good words here" for k in range(24)])
    labels = [(k, int(k % 4 == 0)) for k in range(24)]
    for some in (labels, labels[:2], labels[:7]):
        model = toxicity.fit(docs, spark.createDataFrame(some, "doc_id long, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


def test_shards_are_the_shortest_prefixes_that_fit(spark):
    texts = ["x" * random.Random(k).randint(0, 300) for k in range(400)]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["shard"], r["shard_bytes"]) for r in sharding.assign_shards(docs, "doc_id", "text", limit=1500).collect()}
    bits = {r["doc_id"]: f"{int(hashlib.md5(str(r['doc_id']).encode()).hexdigest()[:15], 16):060b}" for r in docs.collect()}
    total = Counter()
    for k, t in enumerate(texts):
        for depth in range(61):
            total[bits[k][:depth]] += len(t)
    want = {k: next(bits[k][:depth] for depth in range(61) if total[bits[k][:depth]] <= 1500) for k in range(len(texts))}
    assert got == {k: (prefix + ".0", total[prefix]) for k, prefix in want.items()} and len(set(want.values())) > 30


def test_words_are_remembered_up_to_the_limit(monkeypatch):
    from vecspark.llm import packing

    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        tokens = packing.WordTokens(file.read())
    texts = ["one two three four five", "five four Éire, three two one", "six seven one"]
    whole = [tokens._whole(t).tolist() for t in texts]
    assert [x.tolist() for x in tokens.encode(texts[:1])] == whole[:1]
    assert list(tokens.known) == ["one", "two", "three"] and len(tokens.bounds) == 4  # the first words stay, though all five came at once
    learned = []
    real = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda words: learned.extend(words) or real(words))
    assert [x.tolist() for x in tokens.encode(texts[1:])] == whole[1:]
    assert learned == ["five", "four", "Éire,", "six", "seven"] and list(tokens.known) == ["one", "two", "three"]


def test_tasks_keep_words_in_few_bytes():
    """Words lie in Arrow's buffers until they are told apart, and distinct n-grams come from a sort in place."""
    import tracemalloc

    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        tokens = packing.WordTokens(file.read())
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in tokens.special]
    texts = ["", " ", "\n\n", *(f"{c}one{c}{c}two three{c}" for c in spaces), "a\u180eb\u200bc", "x\x1cy"]
    assert [x.tolist() for x in tokens.encode(texts)] == [tokens._whole(t).tolist() for t in texts]
    tokens.encode(["some words of a text"])

    def peak(run):
        tracemalloc.start()
        run()
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    text = "some words of a text " * 40_000  # 200,000 words
    assert peak(lambda: tokens.encode([text])) < 18 * len(text)  # 27 with a str for each word
    keys = np.random.default_rng(0).integers(0, 1 << 40, 300_000)
    want = np.unique(keys)
    assert peak(lambda: np.testing.assert_array_equal(toxicity._distinct(keys), want)) < 4 * keys.nbytes


def test_variants_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the 64 variants of a fingerprint like the fingerprint itself, so it would take them for a small table."""
    plans, real = [], simhash.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "stored", lambda df: plans.append(plan(df)) or real(df))
    found, _ = simhash.links(spark.createDataFrame([(1,), (2,), (255,)], "fp long"))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    plans.append(plan(found))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
