"""Near copies by the Jaccard similarity of their word shingles: SimHash and banded minima find candidates, shingle sets decide.

A document is the set of its ``size``-word shingles (64-bit hashes).  Equal sets
collapse first.  Every other set has a SimHash fingerprint; sets whose fingerprints
differ in at most ``DISTANCE`` bits are candidates (see ``simhash``).  As sets of
similarity 0.8 differ in about 10 bits, every set also gives ``BANDS`` keys of ``ROWS``
hash minima each; sets of similarity s share a key with probability
1 - (1 - s**ROWS)**BANDS (0.999997 at 0.8, more above).  Candidates are compared
exactly, in two steps:

1. those by SimHash, and of each key with one set of it (a star: no more pairs than entries);
2. of keys whose sets are not yet in one component, all pairs across components.
   Pairs inside a component cannot change the groups.

Before sets are read, the parities of ``SKETCH`` hash cells bound the symmetric
difference from below, so what they reject is not similar.  Nothing is capped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, fresh, joined, mixed, run_hashes, stored, text_slices, word_hashes, word_spans
from .simhash import components, set_fingerprints
from .simhash import links as fingerprint_links
from .substring_dedup import IS_WORD

BANDS, ROWS, SKETCH, DISTANCE = 32, 5, 512, 3
#: Sets of a key that one task compares with all others of the key, about.
BLOCK = 256

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_SALTS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mixed(_SALTS, 7) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of concatenated texts, and each text's first (one more at the end)."""
    data = _SMALL[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    words = np.diff(first)
    counts = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = first[doc] + np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    own = word_hashes(data, starts, ends)[0]
    hashes = np.zeros(len(doc), np.uint64)
    whole = at + size <= first[doc + 1]
    hashes[whole] = run_hashes(own, size)[at[whole]]
    few, n = at[~whole], words[doc[~whole]]  # texts shorter than a shingle
    total = mixed(n.astype(np.uint64), 11)
    for k in range(size - 1):
        total[n > k] = joined(total[n > k], own[few[n > k] + k], 1)
    hashes[~whole] = total
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1))


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set; no set may be empty."""
    keys = np.zeros((len(first) - 1, BANDS), np.uint64)
    for k in range(BANDS * ROWS if len(keys) else 0):
        low = np.minimum.reduceat((hashes ^ _SALTS[k]) * _ODD[k], first[:-1])
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] ^ low, k + 1)
    return keys


def parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits for each set, as longs: whether a cell holds an odd number of its shingles."""
    n = len(first) - 1
    cell = (mixed(hashes, 3) % np.uint64(SKETCH)).astype(np.int64) + np.repeat(np.arange(n), np.diff(first)) * SKETCH
    odd = np.bincount(cell, minlength=n * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(n, SKETCH // 64)


def _lists(values: np.ndarray, ends: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _marks(docs: DataFrame, row: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """(row, id, digest, n, fingerprint, sketch, bands) of each text; ``digest`` stands for the set, ``n`` is its size."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column(2)):
                hashes, first = shingle_sets(data, offsets, size)
                digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(first, first[1:])]
                full = np.flatnonzero(np.diff(first))
                bands = band_keys(hashes, np.append(first[full], len(hashes)))
                ends = np.append(0, np.cumsum((np.diff(first) > 0) * BANDS))
                sketch = parities(hashes, first)
                prints = np.zeros(n, np.int64)
                prints[full] = set_fingerprints(mixed(hashes, 5), np.append(first[full], len(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        batch.column(1).slice(at, n),
                        pa.array(digests, pa.binary()),
                        pa.array(np.diff(first)),
                        pa.array(prints),
                        _lists(sketch.ravel(), np.arange(n + 1) * sketch.shape[1]),
                        _lists(bands.ravel().view(np.int64), ends),
                    ],
                    names=["row", "id", "digest", "n", "fingerprint", "sketch", "bands"],
                )

    run = freed(run)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(row, id_col, text_col).mapInArrow(run, f"row long, id {kind}, digest binary, n long, fingerprint long, sketch array<long>, bands array<long>")


def _sets(docs: DataFrame, row: str, text_col: str, size: int) -> DataFrame:
    """(row, shingles) of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column(1)):
                hashes, first = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), _lists(hashes.view(np.int64), first)], names=["row", "shingles"])

    return docs.select(row, text_col).mapInArrow(freed(run), "row long, shingles array<long>")


def _may_be(similarity: float) -> Column:
    """Whether the sizes and sketches of two sets (na, sa, nb, sb) allow the similarity."""
    cells = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH // 64)), F.lit(0))
    total = F.col("na") + F.col("nb")
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    return sizes & (cells <= total * ((1 - similarity) / (1 + similarity)) + 1e-6)


def simhash_candidates(leaders: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of rows whose fingerprints differ in at most ``DISTANCE`` bits, and the folders they lie in.

    Rows of one fingerprint pair with the first of these, which alone pairs with those of other fingerprints.
    """
    prints = leaders.where("n > 0").select("fingerprint", "row")
    reps, path = stored(prints.groupBy("fingerprint").agg(F.min("row").alias("rep")))
    same = prints.join(reps, "fingerprint").where("row <> rep").select("row", "rep")
    near, near_path = fingerprint_links(reps, DISTANCE, "fingerprint")
    side = lambda x, out: reps.select(F.col("fingerprint").alias(x), F.col("rep").alias(out))
    other = near.join(side("a", "row"), "a").join(side("b", "rep"), "b").select("row", "rep")
    return same.unionByName(other).select(F.least("row", "rep").alias("a"), F.greatest("row", "rep").alias("b")), [path, near_path]


def links(leaders: DataFrame, texts: DataFrame, row: str, text_col: str, size: int, similarity: float) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of rows whose components are those of all candidates that reach the similarity, and the folders they lie in.

    ``leaders`` (row, n, fingerprint, sketch, bands) has one row of each distinct set, ``texts``
    the texts by ``row``.
    """
    spark = leaders.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = leaders.select("row", "n", "sketch")
    side = lambda x: sizes.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        df, path = stored(df)
        paths.append(path)
        return df

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs)
        rows = pairs.select(F.explode(F.array("a", "b")).alias(row)).distinct()
        sets, sets_path = stored(_sets(texts.join(rows, row, "left_semi"), row, text_col, size))
        both = pairs.join(sets.withColumnsRenamed({"row": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"row": "b", "shingles": "y"}), "b")
        common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        out = kept(both.where(common * (1 + similarity) >= total * similarity - 1e-6).select("a", "b"))
        dropped(spark, sets_path)
        return out

    # Few rows become many: they are spread before, or a task or two would make them all.
    entries = leaders.where("n > 0").select("row", "bands").repartition(parts, "row").select("row", F.explode("bands").alias("key"))
    # Each key's set with the smallest hash is compared with all of the key: other keys take other sets of a group.
    drawn = F.xxhash64("row", "key")
    shared = entries.groupBy("key").agg(F.count("*").alias("count"), F.min(drawn).alias("low")).where("count > 1")
    # Joins of exploded or well compressed tables are merged: Spark sizes these too low, and would broadcast them.
    shared = kept(entries.join(shared.hint("merge"), "key").select("key", "count", "row", (drawn == F.col("low")).alias("first")))
    reps = shared.where("first").groupBy("key").agg(F.min("row").alias("rep"))
    star = shared.join(reps.hint("merge"), "key").where("row <> rep").select(F.least("row", "rep").alias("a"), F.greatest("row", "rep").alias("b"))
    alike, alike_paths = simhash_candidates(leaders)
    paths.extend(alike_paths)
    near = verified(star.unionByName(alike).distinct().join(side("a"), "a").join(side("b"), "b").where(_may_be(similarity)).select("a", "b"))
    groups = kept(components(near))
    # Two sets of a key were compared already; of more, only different components are left to compare.
    named = shared.where("count > 2").join(groups.withColumnRenamed("node", "row"), "row", "left").select("key", "count", "row", F.coalesce("root", "row").alias("root"))
    named = kept(named)
    open_keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left_over = kept(named.join(open_keys, "key").join(leaders.select("row", "n", "sketch", "bands"), "row"))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    one = left_over.select("key", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), F.col("row").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("bands").alias("ka"))
    two = left_over.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("row").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("bands").alias("kb"))
    # A pair is met at the smallest key of both only (where no third set has that key, it was compared already).
    once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    cross = one.join(two.hint("merge"), ["key", "block"]).where((F.col("ra") < F.col("rb")) & _may_be(similarity) & once)
    more = verified(cross.select("a", "b"))
    return groups.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), paths


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, repeatable: bool = False) -> DataFrame:
    """The documents of which no near copy with a smaller id exists: one of each group of linked documents stays.

    A link is a Jaccard similarity of the shingle sets of ``similarity`` or more.
    A-Z is lower-cased; words are parted by ASCII white space; a text shorter than
    a shingle is one shingle.  Null, empty and blank texts are copies of each other.
    Of rows with the same smallest id the first stays; a row without an id only if
    its group has none; an empty table gives an empty one.  ``docs`` is read more than
    once: it is written to the shared storage first unless it is ``repeatable``, which
    means that every reading gives its rows in the same order (as plain reads of a
    stored table do).
    """
    if not repeatable:
        docs, _ = stored(docs)
    spark, row = docs.sparkSession, fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    marks, path = stored(_marks(numbered, row, id_col, text_col, size))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("m")
    chosen = marks.groupBy("digest").agg(first).select(F.col("m.row").alias("row"))
    leaders, leaders_path = stored(marks.join(chosen, "row", "left_semi").drop("digest"))
    dropped(spark, path)
    found, paths = links(leaders, numbered.select(row, text_col), row, text_col, size, similarity)
    groups, groups_path = stored(components(found))
    rooted = leaders.select("row", "id").join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    kept, _ = stored(rooted.groupBy("root").agg(first).select(F.col("m.row").alias(row)))
    for path in (*paths, leaders_path, groups_path):
        dropped(spark, path)
    return numbered.join(kept, row, "left_semi").drop(row)
