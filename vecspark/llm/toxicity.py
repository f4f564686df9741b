"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams is multiplied by the log ratio of the n-gram's
smoothed document frequencies under the two labels; a logistic regression is fitted
on the scaled features.  The fit uses at most ``per_class`` labelled documents of
either label (those with the smallest id hashes, in that order, however the tables are
partitioned).  Its intercept moves to the share of toxic documents among all labels,
and then to where scores of documents that neither the choice of n-grams nor the fit
has seen part the labels best.  Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chargrams import characters, hashed_grams
from .common import dropped, freed, stored, text_slices

BITS = 20
SIZES = (4, 6, 8)
#: Parts of the sample that are left out in turn to place the threshold.
FOLDS = 3


@dataclass(frozen=True)
class Model:
    """Weights of the buckets that count, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def learnable(id_col: str, folds: int = 5) -> Column:
    """Whether a row may be learned from: all but each ``folds``-th id by CRC (null ids: none)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, float | None]:
    """(hash, id, label, text) of at most ``per_class`` learnable documents of either label, and the share of label 1.

    Conflicting labels of one document count as 1; of repeated ids the smallest text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(learnable("id") & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    # Only hashes that can be among the smallest are ranked, however many labels there are.
    known = known.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1 << 32)))
    picked = []
    for label, size in ((0, n - ones), (1, ones)):
        reach = int((2.0**32) * min(1.0, (2 * per_class + 100) / max(size, 1)))
        picked.append(known.where((F.col("label") == label) & (F.col("hash") <= reach)).orderBy("hash", "id").limit(per_class).drop("hash"))
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(picked, "id").groupBy("id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("hash"), F.col("id").cast("string").alias("id"), "label", "text"), ones / n if n else None


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct keys; sorts in place (``np.unique`` may hash, which takes many times the memory of the keys)."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _presence(batch_column):
    """(first row, rows, text numbers, buckets): the distinct n-grams of each text."""
    for at, n, data, offsets in text_slices(batch_column):
        codes, first = characters(data, offsets)
        keys = [_distinct(doc.astype(np.int64) << BITS | bucket) for doc, bucket in hashed_grams(codes, first, SIZES, BITS)]
        keys = _distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield at, n, keys >> BITS, keys & ((1 << BITS) - 1)


_COUNTS = [f"n{label}_{fold}" for fold in range(FOLDS) for label in (0, 1)]


def _label_counts(batches):
    """Of each bucket, how many documents of either label and each fold have it."""
    import pyarrow as pa

    counts = np.zeros(2 * FOLDS << BITS, np.int32)
    for batch in batches:
        kind = batch.column(0).to_numpy().astype(np.int64) + 2 * batch.column(2).to_numpy()
        for at, n, doc, bucket in _presence(batch.column(1)):
            np.add.at(counts, kind[at : at + n][doc] << BITS | bucket, 1)
    counts = counts.reshape(2 * FOLDS, 1 << BITS)
    used = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part].astype(np.int64)) for c in counts)], names=["bucket", *_COUNTS])


def _chosen(counts: DataFrame, sizes: dict, folds: list[int], features: int, smoothing: float, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose shares under the two labels differ most in some folds, and the logs of their ratios."""
    n0, n1 = (sum(sizes.get((label, k), 0) for k in folds) for label in (0, 1))
    c0, c1 = (sum((F.col(f"n{label}_{k}") for k in folds), F.lit(0)) for label in (0, 1))
    both = (c0 + c1) / max(n0 + n1, 1)
    gap = F.abs(c1 / max(n1, 1) - c0 / max(n0, 1)) / F.sqrt(both * (1 - both) + 1e-9)
    ratio = F.log((c1 + smoothing) / (n1 + 2 * smoothing)) - F.log((c0 + smoothing) / (n0 + 2 * smoothing))
    best = counts.where(c0 + c1 >= least).orderBy(gap.desc(), "bucket").limit(features).select("bucket", ratio.alias("ratio")).toArrow()
    return best.column("bucket").to_numpy().astype(np.int64), best.column("ratio").to_numpy()


def _kept_features(buckets: np.ndarray):
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, n, doc, bucket in _presence(batch.column(1)):
                kept = place[bucket] >= 0
                ends = np.searchsorted(doc[kept], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[bucket][kept]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in (0, 2, 3)), lists], names=["label", "hash", "id", "features"])

    return freed(run)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 4000,
    features: int = 4096,
    smoothing: float = 1.0,
    penalty: float = 3e-3,
    rounds: int = 200,
    beta: float = 1.0,
) -> Model:
    """The classifier, from the learnable labels (see ``learnable``).

    ``features`` n-grams count.  ``beta`` tells how much more a found toxic document counts
    than a wrongly rejected clean one where the threshold is placed (F measure), which is
    done at every size of the sample.

    Where either label has no document, the model is the share of label 1 (0 without labels).
    """
    spark = docs.sparkSession
    sample, share = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    sample, path = stored(sample.select("label", "text", "hash", "id"))
    try:
        fold = F.pmod("hash", F.lit(FOLDS)).cast("int")
        sizes = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", fold.alias("fold")).count().collect()}
        n0, n1 = (sum(n for (own, _), n in sizes.items() if own == label) for label in (0, 1))
        if not n0 or not n1:
            low = 1e-9
            p = min(max(share or 0.0, low), 1 - low)
            return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(p / (1 - p))))
        each = sample.select("label", "text", fold.alias("fold")).mapInArrow(freed(_label_counts), "bucket long, " + ", ".join(f"{c} long" for c in _COUNTS))
        counts, counts_path = stored(each.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _COUNTS)))
        every = list(range(FOLDS))
        chosen = [_chosen(counts, sizes, [k for k in every if k != out], features, smoothing) for out in [None, *every]]
        dropped(spark, counts_path)
        union = np.unique(np.concatenate([b for b, _ in chosen]))
        rows = sample.mapInArrow(_kept_features(union), "label int, hash long, id string, features array<int>").toArrow()
    finally:
        dropped(spark, path)
    rows = rows.sort_by([("hash", "ascending"), ("id", "ascending")])
    column = rows.column("features").combine_chunks()
    docs_of = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
    bucket = union[column.flatten().to_numpy()]
    order = np.lexsort((bucket, docs_of))
    docs_of, bucket = docs_of[order], bucket[order]
    label = rows.column("label").to_numpy().astype(float)
    fold = rows.column("hash").to_numpy() % FOLDS
    z = np.zeros(len(label))
    for out, (buckets, ratios) in zip([None, *every], chosen):
        place = np.full(1 << BITS, -1, np.int64)
        place[buckets] = np.arange(len(buckets))
        kept = place[bucket] >= 0
        doc, index = docs_of[kept], place[bucket[kept]]
        seen = np.ones(len(label)) if out is None else (fold != out).astype(float)
        w, b = _logistic(doc, index, ratios, label, seen, penalty, rounds)
        if out is None:
            weights, intercept = w * ratios, b
        else:
            z = np.where(fold == out, np.bincount(doc, w[index] * ratios[index], minlength=len(label)) + b, z)
    correction = float(np.log(share / (1 - share)) - np.log(n1 / n0))
    shift = best_cut(z + correction, label, float(np.exp(-correction)), beta)
    return Model(chosen[0][0].astype(np.int32), weights, intercept + correction - shift)


def best_cut(z: np.ndarray, label: np.ndarray, zeros_count: float = 1.0, beta: float = 1.0, most: float = 3.0) -> float:
    """Where to part scores so that the F measure with ``beta`` is best, in the middle of the gap there; rows of
    label 0 count ``zeros_count`` times.  At most ``most`` away from 0."""
    order = np.argsort(-z, kind="stable")
    z, label = z[order], label[order]
    hits, misses = np.cumsum(label), np.cumsum((1 - label) * zeros_count)
    f = hits / (beta * beta * label.sum() + hits + misses)
    k = int(np.argmax(np.append(np.where(np.diff(z) < 0, f[:-1], -1.0), -1.0)))
    return float(np.clip((z[k] + z[min(k + 1, len(z) - 1)]) / 2, -most, most))


def _logistic(doc: np.ndarray, index: np.ndarray, ratios: np.ndarray, label: np.ndarray, counted: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on presence times ratio, by Adam steps over all rows that count."""
    value = ratios[index]
    w, b, n = np.full(len(ratios), 1.0 / max(1, len(ratios) ** 0.5)), 0.0, len(label)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = counted / max(counted.sum(), 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[index] * value, minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        slope = np.append(np.bincount(index, error[doc] * value, minlength=len(w)) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _text_scores(intercept: float, weight: np.ndarray, texts) -> np.ndarray:
    """The score of each text of an Arrow column."""
    out = [np.zeros(0)]
    for _, n, data, offsets in text_slices(texts):
        codes, first = characters(data, offsets)
        keys = [np.zeros(0, np.int64)]
        for doc, bucket in hashed_grams(codes, first, SIZES, BITS):
            hit = np.flatnonzero(weight[bucket])
            keys.append(doc[hit].astype(np.int64) << BITS | bucket[hit])
        keys = _distinct(np.concatenate(keys))
        z = np.bincount(keys >> BITS, weight[keys & ((1 << BITS) - 1)], minlength=n) + intercept
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return np.concatenate(out)


def scorer(spark, model: Model):
    """A column function: text to score.  Only texts go to Python, and only scores come back."""
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast((model.buckets, model.weights, model.intercept))

    def score_texts(batches):
        import pyarrow as pa

        buckets, weights, intercept = shared.value
        weight = np.zeros(1 << BITS, np.float32)
        weight[buckets] = weights
        yield from freed(lambda parts: (pa.array(_text_scores(intercept, weight, texts)) for texts in parts))(batches)

    from collections.abc import Iterator

    import pyarrow as pa

    score_texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(score_texts, "double")


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher where label 1 is likelier, parted at 0.5.

    As the threshold is moved to 0.5, the score is no calibrated probability.  A null text
    scores like an empty one; repeated rows score alike; an empty table gives an empty one.

    The text column itself only stays with ``keep_text``.
    """
    rest = [c for c in docs.columns if c != "score" and (keep_text or c != text_col)]
    return docs.select(*rest, scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
