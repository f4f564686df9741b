"""Extendible hashing: shards by hash prefix that split until each fits its byte limit.

A directory cell is a hash prefix of ``cell_bits`` bits.  One aggregation sums the bytes
of each cell; a bucket is the shortest prefix whose bytes fit, so only oversized buckets
split on another bit.  Cells that are still too large go on with the next bits.  Rows that
no bit parts (equal keys) fill numbered overflow pages of their bucket, counted per input
partition, so a key of any size is spread without being gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, hidden, shown, stored

#: Bits of the hash (the first 15 hexadecimal digits of an MD5 sum).
HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 sum of a key's text (null: empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hashed: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits as text of 0 and 1 (depth 0: empty)."""
    return F.substring(F.lpad(F.bin(hashed), HASH_BITS, "0"), F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def directory(sizes: DataFrame, limit: int, cell_bits: int) -> DataFrame:
    """(cell, prefix, bytes): the bucket of every cell of ``cell_bits`` bits.

    ``sizes`` has a row per cell: ``cell`` (text of bits) and ``bytes``.  A bucket is the
    shortest prefix with at most ``limit`` bytes, or the whole cell if none fits.
    """
    levels = sizes.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(cell_bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.substring("cell", F.lit(1), F.col("depth")))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"))
    fitting = levels.join(sums, ["depth", "prefix"]).where((F.col("total") <= limit) | (F.col("depth") == cell_bits))
    best = fitting.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "total")).alias("b"))
    return best.select("cell", F.col("b.prefix").alias("prefix"), F.col("b.total").alias("bytes"))


def assign_shards(docs: DataFrame, key_col: str, text_col: str, limit: int, step_bits: int = 4) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``shard`` and ``shard_bytes``.

    ``shard`` is the bucket's bits, a dot and an overflow page: 0 unless the rows of one
    key exceed a shard together.  Every shard has at most ``limit`` bytes of text, except
    one that is a single larger row.  A null key hashes like an empty one, a null text
    has no bytes, repeated rows share their bucket, and an empty table gives no rows.
    """
    added = ["n_bytes", "shard", "shard_bytes"]
    rest = [c for c in docs.columns if c not in (text_col, *added)]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = hidden(docs, rest, size.alias("n_bytes"), key_hash(F.col(key_col)).alias("hash"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, (total // limit).bit_length() + step_bits)
    while True:
        cells = rows.withColumn("cell", _prefix(F.col("hash"), bits))
        found, path = stored(directory(cells.groupBy("cell").agg(F.sum("n_bytes").alias("bytes")), limit, bits))
        if bits == HASH_BITS or found.where(F.col("bytes") > limit).isEmpty():
            break
        dropped(docs.sparkSession, path)
        bits = min(HASH_BITS, bits + step_bits)
    placed = cells.join(found, "cell")
    whole = placed.where(F.col("bytes") <= limit).withColumns({"shard": F.concat("prefix", F.lit(".0")), "shard_bytes": F.col("bytes")})
    over = _overflow(placed.where(F.col("bytes") > limit), limit)
    return whole.unionByName(over).select(*shown(rest), "n_bytes", "shard", "shard_bytes")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that no bit parts, with pages.

    Every input partition fills pages of its own: a page closes at half a limit, and a row of
    more than half a limit is a page by itself.
    """
    here = Window.partitionBy("prefix", "part")
    big = F.col("n_bytes") > limit // 2
    before = F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).over(here.orderBy("row")) - F.col("n_bytes")
    page = F.when(big, F.concat(F.lit("r"), F.col("row"))).otherwise(F.floor(before / max(1, limit - limit // 2)).cast("string"))
    paged = rows.withColumn("shard", F.concat("prefix", F.lit("."), F.concat_ws("-", F.col("part").cast("string"), page)))
    return paged.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard")))
