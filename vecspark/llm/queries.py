"""The registered query of each operator: thin, with the contract's parameters and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontaminate, langid, license_scan, packing, pieces, sharding, simhash, substring_dedup, topk, toxicity, url_filter
from .common import table

#: Bytes of text of a shard.
SHARD_BYTES = 16 << 20


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document: their places as digest columns."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("base_starts")
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors by integer inner product for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 35 words, as counts and a hash of the kept words."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, joiner=" ", repeatable=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document lie in 10-word windows of benchmark items, and of which items."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_hits(docs, items, n=10)
    found = found.withColumns({"n_words": F.size("words").cast("long"), "n_hit": F.size(decontaminate.hit_places()).cast("long")})
    out = decontaminate.with_items(found, decontaminate.item_grams(items, n=10), ["doc_id", "n_words", "n_hit"])
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document by extendible hashing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, "doc_id", "text", limit=SHARD_BYTES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document, learned from the labels outside of the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all tokenised documents in sequences of 2,048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), capacity=2048, end_id=1)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit fingerprint of each document, and its component of fingerprints within two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Fixed values of the contract.
URL_RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document, learned from documents outside of the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.drop("lang"), langid.fit(docs))
    return found.select("doc_id", (~langid.learnable("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def piece_model_path() -> str:
    """The model of the SentencePiece query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of each document and the text that they decode to, as hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode_pieces(docs, pieces.load_model(piece_model_path()), decoded_col="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def alignment_sides() -> dict:
    """The byte-level vocabulary and the piece model of the alignment query."""
    import public_tokenizers

    return alignment.load_sides(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, pieces.load_model(piece_model_path()))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies overlap in each document, and how usual these links are."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), alignment_sides())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of each damaged conversation and its cheapest repair."""
    found = conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("conv", "conv_id")


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_topk": op2_topk,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_simhash": op8_simhash,
        "op9_url_filter": op9_url_filter,
        "op10_langid": op10_langid,
        "op11_alignment": op11_alignment,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_sentencepiece": op13_sentencepiece,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, k, n, item_id FROM v JOIN g USING (gram, n)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id AS vec_id, coalesce(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT), 0) AS score
      FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.rid <> b.rid),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _op1_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    keys = lambda t: "[" + ", ".join(quoted(license_scan.words_of(k)) for k in t.keys) + "]::VARCHAR[][]"
    templates = [*license_scan.BASE, *license_scan.NAMES, *license_scan.NOTICES]
    rows = ",\n  ".join(f"({n}, '{t.label}', {quoted(t.words)}, {keys(t)}, {t.need}, {t.worth}, {str(t.base).lower()})" for n, t in enumerate(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
t(n, label, notice, keys, need, worth, base) AS (VALUES
  {rows}),
y AS (SELECT n, unnest(notice) AS word, unnest(range(len(notice))) AS k FROM t),
c AS (SELECT row, n, p - k AS start, count(*) AS hits FROM x JOIN y USING (word) GROUP BY ALL),
s AS (SELECT row, label, base, start, CAST(hits AS DOUBLE) / len(notice) * CAST(worth AS DOUBLE) AS score
      FROM c JOIN t USING (n) JOIN d USING (row)
      WHERE hits >= need AND len(list_filter(keys, lambda key: len(list_filter(range(greatest(start - {license_scan.SLACK}, 0), greatest(start + len(notice) + {license_scan.SLACK}, 1)),
            lambda k: w[k + 1:k + len(key)] = key)) = 0)) = 0),
g AS (SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(score) AS score,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM s GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (row)
"""


#: A bucket is the shortest prefix of the hash whose documents fit; no key of these tables fills a shard alone.
OP5_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
           lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS h FROM documents),
p AS (SELECT doc_id, n_bytes, substr(h, 1, depth) AS prefix, depth FROM d, (SELECT unnest(generate_series(0, 40)) AS depth)),
s AS (SELECT doc_id, n_bytes, depth, prefix, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS total FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE total <= {SHARD_BYTES})
SELECT doc_id, n_bytes, prefix || '.0' AS shard, CAST(total AS BIGINT) AS shard_bytes FROM m WHERE k = 1
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), '') AS host0,
                  coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rule, verdict, rhost, rpath) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
     ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
f AS (SELECT page_id, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) AS best
      FROM h, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(host || path, '(?s)\A(?:[^/]*[.-])?(casino|adult|pills|bets|spam|ads)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op2_topk": OP2_SQL, "op5_sharding": OP5_SQL, "op9_url_filter": OP9_SQL, "op4_decontamination": OP4_SQL}
