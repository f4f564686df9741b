"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents.  All but the last return the columns of
``documents`` and leave out any others.  Empty tables pass through; null and empty texts
stay (one of them, as copies of each other); rows with null or repeated ids are rows like others.
The documents that a stage is given must be a stored table, as ``run`` makes them.
Every stage lets the session send fewer rows at once to Python, as texts are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, packing, shingle_dedup, substring_dedup, toxicity
from vecspark.llm.common import dropped, small_batches, stored, table
from vecspark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, unchanged."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep_text=True).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a five-word shingle similarity of 0.8 or more, unchanged.

    Candidates come from SimHash fingerprints and, where these differ too much, from hash minima.
    """
    small_batches(spark)
    return shingle_dedup.one_of_each(docs.select(*COLUMNS), size=5, similarity=0.8, repeatable=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words or more that repeat; ``n_chars`` follows the text."""
    small_batches(spark)
    kept = substring_dedup.remove_repeats(docs.select(*COLUMNS), window=35, repeatable=True)
    changed = kept.withColumnRenamed("kept_text", "text")
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", size).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs, unchanged."""
    small_batches(spark)
    return decontaminate.drop_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 2,048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL expresses neither the trained classifier nor the tokens; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a data folder to pieces in sequences."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, next_path = stored(stage(spark, docs, sf_dir))
        if path:
            dropped(spark, path)
        path = next_path
    return STAGES[-1][1](spark, docs, sf_dir)
