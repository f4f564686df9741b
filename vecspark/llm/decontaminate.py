"""Benchmark decontamination: windows of documents looked up in a set of benchmark n-grams.

Texts are normalised to lower-case words.  An item's windows are its runs of ``n``
consecutive words; an item of fewer words, but not none, is one window.  A word of
a document is hit if it lies inside any occurrence of any window.

The n-gram set of a benchmark is counted first.  Up to ``SET_LIMIT`` n-grams it goes
to the executors as a hash set inside the expressions, and a document is judged in
its own row: no text and no window is shuffled.  Of a larger benchmark, up to
``BROADCAST_LIMIT`` n-grams, the hashes are broadcast and meet the documents' windows
where these are; beyond, windows are shuffled.  All ways verify the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain_words

#: N-grams that an expression may hold (about 4 MB); above, documents are joined.
SET_LIMIT = 20_000
#: N-grams whose hashes are broadcast (8 bytes each, about 100 MB as Spark's table of them).
BROADCAST_LIMIT = 2_000_000
_HITS = "array<struct<at:int,n:int,gram:string>>"


def item_grams(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(gram, n, items): each distinct window of the benchmark with the sorted ids that hold it.

    Items without words have no window; null ids are left out of ``items``, but
    their windows count.
    """
    words = items.select(F.col(id_col).alias("item"), plain_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("n", F.least(F.lit(n), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    grams = words.select("item", "n", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k, F.col("n")), " "))).alias("gram"))
    return grams.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _windows(words: Column, n: int) -> Column:
    """(at, hash) of all windows of ``n`` words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct(k.alias("at"), F.xxhash64(F.slice(words, k + 1, n)).alias("h")))


def _sized(windows: Column, n: int) -> Column:
    return F.transform(windows, lambda x: F.struct(x["at"].alias("at"), F.lit(n).alias("n"), x["h"].alias("h")))


def _hash(gram: Column) -> Column:
    return F.xxhash64(F.split(gram, " "))


def _by_set(docs: DataFrame, grams: list, words: str, hits: str) -> DataFrame:
    """``docs`` with ``hits``; the n-grams are in the expressions, as SQL lists that Spark keeps as hash sets."""
    names = []
    for n in sorted({g.n for g in grams}):
        hashes = ",".join(f"{g.h}L" for g in grams if g.n == n)
        texts = ",".join(f"'{g.gram}'" for g in grams if g.n == n)  # words hold no quotes
        name = fresh(docs, f"windows_{n}")
        docs = docs.withColumn(name, _windows(F.col(words), n))
        docs = docs.withColumn(name, F.expr(f"filter(`{name}`, x -> x.h IN ({hashes}))"))
        docs = docs.withColumn(name, _spelled(name, words, F.lit(n)))
        docs = docs.withColumn(name, F.expr(f"filter(`{name}`, x -> x.gram IN ({texts}))"))
        names.append(name)
    return docs.withColumn(hits, F.concat(F.array().cast(_HITS), *names)).drop(*names)


def _spelled(name: str, words: str, n: Column | None = None) -> Column:
    """The places of ``name`` with the words that stand there."""

    def one(x: Column) -> Column:
        size = x["n"] if n is None else n
        return F.struct(x["at"].alias("at"), size.alias("n"), F.array_join(F.slice(words, x["at"] + 1, size), " ").alias("gram"))

    return F.transform(name, one)


def _by_join(docs: DataFrame, grams: DataFrame, sizes: list[int], words: str, hits: str, row: str, small: bool) -> DataFrame:
    """``docs`` with ``hits``; windows meet the n-grams in joins, for benchmarks of any size."""
    grams = grams.select("gram", _hash(F.col("gram")).alias("bench_h"))
    keys = grams.select("bench_h").distinct()
    parts = F.concat(*(_sized(_windows(F.col(words), n), n) for n in sizes))
    # Explode as outer: Spark would else work out all windows once more to find texts without any.
    if small:
        windows = docs.select(F.col(row).alias("row"), F.col(words).alias("w"), F.explode_outer(parts).alias("x"))
        near = windows.join(F.broadcast(keys), F.col("x.h") == F.col("bench_h"), "left_semi")
        gram = F.array_join(F.slice("w", F.col("x.at") + 1, F.col("x.n")), " ").alias("gram")
        spelled = near.select("row", F.struct(F.col("x.at").alias("at"), F.col("x.n").alias("n"), gram).alias("x"))
    else:
        windows = docs.select(F.col(row).alias("row"), F.explode_outer(parts).alias("x")).select("row", "x.*")
        near = windows.join(keys, F.col("h") == F.col("bench_h"), "left_semi")
        near = near.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("near"))
        spelled = docs.select(F.col(row).alias("row"), words).join(near, "row").select("row", F.explode(_spelled("near", words)).alias("x"))
    full = spelled.join(grams.select("gram").distinct(), F.col("x.gram") == F.col("gram"), "left_semi")
    full = full.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias(hits)).withColumnRenamed("row", row)
    return docs.join(full, row, "left").withColumn(hits, F.coalesce(hits, F.array().cast(_HITS)))


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    set_limit: int = SET_LIMIT,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``docs`` with ``words`` (normalised) and ``hits``: place, word count and words of each benchmark window.

    A null text has no words and no hits; an empty benchmark hits nothing; an empty table
    gives an empty one, and repeated rows are judged alike.  Columns of ``docs`` named
    ``words`` or ``hits`` are replaced.  The limits choose the way, not the result; beyond
    ``set_limit`` every reading of ``docs`` must give its rows in the same order.
    """
    docs = docs.drop("words", "hits").withColumn("words", plain_words(F.col(text_col)))
    # The row number keeps a filter on the hits from being moved below the words, where Spark
    # would extract a text's words anew for each of its windows.
    row = fresh(docs, "row")
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    grams = item_grams(items, item_id, item_text, n)
    sized = grams.groupBy("n").count().collect()  # at most n rows
    if not sized:
        found = docs.withColumn("hits", F.array().cast(_HITS))
    elif (total := sum(r["count"] for r in sized)) > set_limit:
        found = _by_join(docs, grams, sorted(r["n"] for r in sized), "words", "hits", row, total <= broadcast_limit)
    else:
        found = _by_set(docs, grams.select("gram", "n", _hash(F.col("gram")).alias("h")).collect(), "words", "hits")
    return found.withColumn("hits", F.when(F.col(row) >= 0, F.col("hits"))).drop(row)


def hit_places(hits: str = "hits") -> Column:
    """The distinct places of all words inside of hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))


def drop_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, unchanged."""
    return find_hits(docs, items, text_col, **options).where(F.size("hits") == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, without the words that are hit and what stands between these and the next word."""
    found = find_hits(docs, items, text_col, **options)
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    pieces = F.regexp_extract_all(text_col, F.lit(rf"{word}+[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*"), F.lit(0))
    stays = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("words") - 1), hit_places()))
    kept = F.concat(
        F.regexp_extract(text_col, r"(?s)^([^0-9A-Za-z\x{80}-\x{10FFFF}]*)", 1),
        F.array_join(F.transform(stays, lambda k: F.element_at("pieces", k + 1)), ""),
    )
    found = found.withColumn("pieces", F.when(F.size("hits") > 0, pieces))
    return found.withColumn(text_col, F.when(F.size("hits") > 0, kept).otherwise(F.col(text_col))).select(*docs.columns)


def with_items(found: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``found`` with ``items``: the sorted distinct ids of items whose windows occur.

    Only row numbers and the words of hits are shuffled.  A row without hits goes by a key of
    its own, so that clean rows are spread.
    """
    row = fresh(found, "row")
    rows = found.withColumn(row, F.monotonically_increasing_id())
    rows = rows.select(*keep, row, F.explode_outer(F.array_distinct(F.transform("hits", lambda x: x["gram"]))).alias("hit_gram"))
    rows = rows.withColumn("hit_gram", F.coalesce("hit_gram", F.concat(F.lit("\0"), F.col(row))))  # no window holds this character
    known = grams.select(F.col("gram").alias("hit_gram"), F.col("items").alias("hit_items"))
    joined = rows.join(known, "hit_gram", "left")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("items")
    return joined.groupBy(row).agg(*(F.first(c).alias(c) for c in keep), items).drop(row)
