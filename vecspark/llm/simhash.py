"""Near-duplicate documents by SimHash fingerprints and deletion variants.

A fingerprint has one bit per position: set if over half of the document's
shingle hashes have it set.  Two fingerprints link if they differ in at most
``distance`` bits.  They are found by equality joins only: cut into
``distance // 2 + 1`` segments, one segment differs in at most one bit, so the
two share that segment with one bit deleted.  Every fingerprint is indexed by
all its one-bit-deleted segments, joined on equality, and verified.

Copies collapse first (the index holds distinct fingerprints), and an index entry
that too many fingerprints share is divided by exact pieces of the remaining bits:
with at most ``distance`` differing bits there, one of ``distance + 1`` pieces is
equal.  No entry is capped or dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, fresh, stored

BITS = 64


def shingle_fingerprint(words: list[bytes], size: int = 3) -> int:
    """The 64-bit fingerprint of a document's words (none: 0)."""
    import xxhash

    if not words:
        return 0
    if len(words) < size:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, 42) for x in joined], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def set_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The signed fingerprint of each set of shingle hashes, whose first are given (one more at the end); no set may be empty."""
    sizes = np.diff(first)
    ones, owner = np.zeros((len(sizes), BITS), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        sets, starts = np.unique(owner[k : k + (1 << 14)], return_index=True)
        ones[sets] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", size: int = 3, out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each whole text; all other columns stay.

    A-Z is lower-cased; words are parted by ASCII white space.  A null, empty or
    blank text has fingerprint 0; a text shorter than a shingle is one shingle.
    """

    rest = [c for c in docs.columns if c not in (text_col, out_col)]

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            values = np.fromiter(
                (shingle_fingerprint((x or "").encode().lower().split(), size) for x in (batch.column(0)[k].as_py() for k in range(batch.num_rows))),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values.view(np.int64))], names=[*rest, out_col])

    schema = docs.select(*rest).withColumn(out_col, F.lit(0).cast("long")).schema
    return docs.select(text_col, *rest).mapInArrow(freed(prints), schema)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments, of which one differs in at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masked(value: Column, bits: list[int]) -> Column:
    mask = sum(1 << bit for bit in bits)
    return value.bitwiseAND(F.lit(mask - ((mask >> 63) << 64)).cast("long"))


def _variants(fp: Column, distance: int) -> Column:
    """The keys of all segments with one bit deleted, as structs of segment number and key."""
    out = []
    for s, (low, width) in enumerate(_segments(distance)):
        for bit in range(low, low + width):
            rest = _masked(fp, [k for k in range(low, low + width) if k != bit])
            out.append(F.struct(F.lit(s).alias("segment"), F.xxhash64(F.lit(bit), rest).alias("key")))
    return F.array(*out)


def _pieces(fp: Column, segment: tuple[int, int], distance: int) -> Column:
    """The bits outside of a segment as ``distance + 1`` pieces, one of which is equal in linked fingerprints."""
    spare = [k for k in range(BITS) if not segment[0] <= k < sum(segment)]
    cuts = [len(spare) * k // (distance + 1) for k in range(distance + 2)]
    return F.array(*(F.xxhash64(F.lit(k), _masked(fp, spare[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def links(prints: DataFrame, distance: int = 2, fp_col: str = "fp", hot: int = 64) -> tuple[DataFrame, str]:
    """All pairs (a < b) of distinct fingerprints that differ in at most ``distance`` bits, and the folder they are made from.

    ``prints`` holds distinct non-null fingerprints (long) in ``fp_col``.  Index
    entries of more than ``hot`` fingerprints are divided further, exactly.  Keys
    are hashes; equal keys only make candidates, which the bit count verifies.
    """
    # Few small rows become many: they are spread before, or a task or two would make them all.  (Rows
    # that are grouped by the column itself would not be spread again, so they go by a hash of it.)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.select(fp_col).repartition(parts, F.xxhash64(fp_col))
    entries = prints.select(F.col(fp_col).alias("fp"), F.explode(_variants(F.col(fp_col), distance)).alias("v")).select("fp", "v.segment", "v.key")
    sizes = entries.groupBy("key").count().where("count > 1")
    # Spark sizes an explosion like its input, and stored tables as they are compressed: it would broadcast gigabytes.
    shared = entries.join(sizes.hint("merge"), "key")
    pieces = F.coalesce(*(F.when(F.col("segment") == k, _pieces(F.col("fp"), s, distance)) for k, s in enumerate(_segments(distance))))
    pieces = F.when(F.col("count") > hot, pieces).otherwise(F.array(F.lit(0).cast("long")))
    keyed, path = stored(shared.select("key", F.explode(pieces).alias("piece"), "fp"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right.hint("merge"), ["key", "piece"]).where((F.col("a") < F.col("b")) & differ).select("a", "b").distinct(), path


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the pairs (a, b) of longs.

    Large-star and small-star rounds until nothing changes; every round's edges
    are written to shared storage, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current, path = stored(edges.select("a", "b").distinct())
    mark = None
    while True:
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        near = both(current)
        low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = near.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        after, next_path = stored(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        dropped(spark, path)
        current, path = after, next_path
        if state == mark or state[0] == state[2] == 0:
            break
        mark = state
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (signed long) and ``component_id``.

    ``component_id`` is the smallest ``id_col`` reachable over links, the row's own
    included.  Null and empty texts have fingerprint 0 and link like any other;
    repeated rows all stay; a null id gets a component like any row (null only if
    no id of its component is known).  An empty table gives an empty result.  The
    fingerprints of all rows and the components lie in the shared storage, from where
    the result is read.
    """
    rest = [c for c in docs.columns if c not in (text_col, "fingerprint", "component_id")]
    marked, _ = stored(with_fingerprint(docs.select(text_col, *rest), text_col, size))
    prints = marked.groupBy("fingerprint").agg(F.min(id_col).alias("low_id")).withColumnRenamed("fingerprint", "node")
    found, path = links(prints, distance, "node")
    groups, groups_path = stored(components(found))
    dropped(docs.sparkSession, path)
    rooted = prints.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    labels, _ = stored(rooted.join(named, "root").select(F.col("node").alias("fingerprint"), "component_id"))
    dropped(docs.sparkSession, groups_path)
    return marked.join(labels, "fingerprint").select(*rest, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2, repeatable: bool = False) -> DataFrame:
    """The documents of which no near duplicate with a smaller id exists: one of each group stays.

    Of rows with the same smallest id (repeated rows) the first stays; a row without
    an id only stays if its group has no id.  ``docs`` is read twice: it is written to the
    shared storage first unless it is ``repeatable``, which means that every reading gives
    its rows in the same order (as plain reads of a stored table do).
    """
    if not repeatable:
        docs, _ = stored(docs)
    row = fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = near_duplicates(numbered.select(row, id_col, text_col), id_col, text_col, size, distance)
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, row)).alias("m"))
    return numbered.join(first.select(F.col(f"m.{row}").alias(row)), row, "left_semi").drop(row)
