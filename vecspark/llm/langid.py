"""Language identification by error-correcting output codes.

Every language has a binary codeword.  For each bit a linear classifier on character
n-grams predicts whether a text's language has the bit set; a text gets the language
whose codeword has the smallest sum of logistic losses, weighted by each bit's
accuracy in training.  Texts whose two best codewords are too close are flagged.

The fit uses at most ``per_language`` documents of each language (those with the
smallest id hashes, and ``at_most`` in all); prediction reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chargrams import characters, hashed_grams
from .common import dropped, freed, stored, text_slices

BITS = 13
SIZES = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages, their codewords (+1, -1), and the bits' classifiers and weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    trust: np.ndarray


def learnable(id_col: str, folds: int = 3, left_out: int = 1) -> Column:
    """Whether a row may be learned from, by the CRC of its id (null ids: not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != left_out, F.lit(False))


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """Codewords of +1 and -1 for ``n`` classes, one row each.

    Up to 5 classes: all distinct splits.  More: of 200 random codes of about
    10 log2(n) bits the one with the largest smallest distance.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        rest = np.array([splits >> k & 1 for k in range(n - 1)])
        return np.vstack([np.ones(len(splits)), 1.0 - 2 * rest])
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = int(((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min())
        if gap > apart:
            best, apart = code, gap
    return best


def _features(column):
    """(first row, matrix): each text's n-gram shares as unit vectors of square roots."""
    for at, n, data, offsets in text_slices(column):
        codes, first = characters(data, offsets, letters_only=True)
        step = max(1, 1 << (22 - BITS))
        grams = list(hashed_grams(codes, first, SIZES, BITS))
        for k in range(0, n, step):
            m = min(step, n - k)
            counts = np.zeros(m << BITS)
            for doc, bucket in grams:
                a, b = np.searchsorted(doc, [k, k + m])
                counts += np.bincount(((doc[a:b] - k).astype(np.int64) << BITS) + bucket[a:b], minlength=m << BITS)
            matrix = counts.reshape(m, 1 << BITS)
            yield at + k, np.sqrt(matrix / np.maximum(matrix.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _vectors(batches):
    import pyarrow as pa

    for batch in batches:
        for at, matrix in _features(batch.column(1)):
            rows = pa.array([x.tobytes() for x in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(matrix)), rows], names=["lang", "vector"])


def _scaled(rows: np.ndarray, targets: np.ndarray, rounds: int = 200, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all target columns (0, 1) at once, by Adam steps over all rows."""
    w, b = np.zeros((rows.shape[1], targets.shape[1]), np.float32), np.zeros(targets.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(rows @ w + b, -30, 30))) - targets).astype(np.float32) / len(rows)
        gw, gb = rows.T @ error + penalty * w, error.sum(axis=0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix = 0.2 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - fix * mw / (np.sqrt(vw) + 1e-8), b - fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, at_most: int = 2000) -> Model:
    """The classifiers and codewords, from learnable documents with a language and a text.

    Without any such document the model knows no language.  ``lang_col`` may hold any
    number of values; the ``at_most`` most frequent ones (ties: the smallest) are learned and
    share that number of documents, others are never predicted.  Of repeated ids the smallest
    text counts; repeated rows are one.  The model is the same for any partitioning.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where(learnable("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = known.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("hash"))
    counts = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(at_most).collect()  # at_most rows
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = min(per_language, at_most // len(languages))
    # Only hashes that can be among the smallest are ranked, however many documents a language has.
    reach = docs.sparkSession.createDataFrame([(r["lang"], int((2.0**32) * min(1.0, (2 * each + 100) / r["n"]))) for r in counts], "lang string, reach long")
    near = keys.join(F.broadcast(reach), "lang").where("hash <= reach")
    order = Window.partitionBy("lang").orderBy("hash", "id")
    picked = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("id", "lang").distinct()
    sample = known.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    sample, path = stored(sample.select("lang", "text"))
    try:
        rows = sample.mapInArrow(freed(_vectors), "lang string, vector binary").toArrow()
        rows = rows.sort_by([("lang", "ascending"), ("vector", "ascending")])
    finally:
        dropped(docs.sparkSession, path)
    matrix = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32).reshape(-1, 1 << BITS)
    number = {lang: k for k, lang in enumerate(languages)}
    codes = codewords(len(languages))
    own = codes[[number[x] for x in rows.column("lang").to_pylist()]]
    weights, intercepts = _scaled(matrix, ((own + 1) / 2).astype(np.float32))
    right = ((matrix @ weights + intercepts > 0) == (own > 0)).mean(axis=0)
    return Model(languages, codes, weights, intercepts, np.maximum(right - 0.5, 0.01) * 2)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, lead over the second best) for rows of bit margins."""
    loss = np.stack([(np.logaddexp(0, -margins * code) * model.trust).sum(axis=1) for code in model.codes], axis=1)
    shares = np.exp(loss.min(axis=1, keepdims=True) - loss)
    shares /= shares.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1)
    top = np.sort(shares, axis=1)
    lead = top[:, -1] - top[:, -2] if shares.shape[1] > 1 else np.ones(len(shares))
    return best, top[:, -1], lead


def _predictions(model, rest: list[str], least_lead: float):
    def run(batches):
        import pyarrow as pa

        known = Model(*model.value)
        for batch in batches:
            lettered = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found: list[str] = []
            scores, leads = [np.zeros(0)], [np.zeros(0)]
            for _, matrix in _features(batch.column(0)):
                if not known.languages:
                    found += [UNKNOWN] * len(matrix)
                    scores.append(np.zeros(len(matrix)))
                    leads.append(np.zeros(len(matrix)))
                    continue
                best, score, lead = decode(known, matrix @ known.weights + known.intercepts)
                found += [known.languages[k] for k in best]
                scores.append(score)
                leads.append(lead)
            score, lead = np.concatenate(scores), np.concatenate(leads)
            names = [x if ok else UNKNOWN for x, ok in zip(found, lettered)]
            score = np.where(lettered, score, 0.0)
            unsure = ~lettered | (lead < least_lead)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=[*rest, "lang_pred", "score", "ambiguous"])

    return freed(run)


def predict(docs: DataFrame, model: Model, text_col: str = "text", least_lead: float = 0.2) -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text or one without any letter is ``und`` with score 0 and ambiguous, as is
    every text if the model knows no language.
    """
    added = {"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(True)}
    rest = [c for c in docs.columns if c != text_col and c not in added]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.weights, model.intercepts, model.trust))
    schema = docs.select(*rest).withColumns(added).schema
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(text_col).alias("__text"), lettered.alias("__lettered"), *rest).mapInArrow(_predictions(shared, rest, least_lead), schema)
