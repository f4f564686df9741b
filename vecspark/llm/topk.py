"""Exact top-k by integer inner product over a bit-sliced index.

Vectors are quantised to integers.  A block of vectors becomes bitmaps: one per
attribute and bit, over the block's rows.  A query adds the slices that its components
select, as bitmaps, by carry-save adders: three slices of one significance become one of
the same and one of the next.  What is left are the slices of all rows' scores.  From the
most significant slice downward, rows are taken while they fit into the k best; rows that
tie at the boundary are taken by smallest id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed

#: Rows of a block of the index, and the most queries that meet a block in one task (fewer, but not
#: below ``LEAST_QUERY_ROWS``, where there would not be work for all cores).
BLOCK_ROWS, QUERY_ROWS, LEAST_QUERY_ROWS = 65_536, 4_096, 128


def quantised(vectors, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(scale * x) of these) of an Arrow list column.

    Null vectors and vectors with null or non-finite components take no part; shorter
    vectors, empty ones included, are filled up with zeros, which add nothing to a product.
    """
    import pyarrow as pa

    vectors = vectors.cast(pa.large_list(pa.float64()))
    whole = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    parts = vectors.take(pa.array(whole))
    size = np.diff(np.asarray(parts.offsets))
    values = parts.flatten()
    values = values.fill_null(float("nan")).to_numpy()
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    fine = np.isfinite(out).all(axis=1)
    return whole[fine], np.floor(scale * out[fine]).astype(np.int64)


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (attribute, bit, word of 64 rows) of ``values`` minus their smallest, and the smallest."""
    low = int(values.min()) if values.size else 0
    shifted = values - low
    bits = max(1, int(shifted.max()).bit_length()) if values.size else 1
    rows, width = values.shape
    words = -(-rows // 64)
    out = np.zeros((width, bits, words), np.uint64)
    for b in range(bits):
        flags = np.zeros((width, words * 64), np.uint8)
        flags[:, :rows] = (shifted.T >> b) & 1
        out[:, b] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    return out, low


def add_slices(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The bit slices of the sum of bitmaps, given by significance."""
    out, k = [], 0
    while k < len(levels):
        heap = levels[k]
        if len(heap) > 1 and k + 1 == len(levels):
            levels.append([])
        while len(heap) > 2:
            a, b, c = heap.pop(), heap.pop(), heap.pop()
            odd = a ^ b
            levels[k + 1].append((a & b) | (odd & c))
            heap.insert(0, odd ^ c)
        if len(heap) == 2:
            a, b = heap
            levels[k + 1].append(a & b)
            heap = [a ^ b]
        out.append(heap[0] if heap else None)
        k += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _positions(bitmap: np.ndarray, at_most: int | None = None) -> np.ndarray:
    found = []
    for word in np.flatnonzero(bitmap):
        bits = np.flatnonzero(np.unpackbits(bitmap[word : word + 1].view(np.uint8), bitorder="little"))
        found.append(bits + 64 * word)
        if at_most is not None and sum(map(len, found)) >= at_most:
            break
    return np.concatenate(found)[:at_most] if found else np.zeros(0, np.int64)


def best_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores among the allowed rows; the first positions of those that tie at the end."""
    sure, open_rows = np.zeros_like(allowed), allowed
    for bits in reversed(score):
        more = sure | (open_rows & bits)
        n = _count(more)
        if n > k:
            open_rows = open_rows & bits
        elif n < k:
            sure, open_rows = more, open_rows & ~bits
        else:
            return _positions(more)
    taken = _positions(sure)
    return np.concatenate([taken, _positions(open_rows, k - len(taken))])


def top_of_block(ids: np.ndarray, index: np.ndarray, low: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's ``k`` best rows of a block (ids ascending)."""
    width, bits, words = index.shape
    levels: list[list[np.ndarray]] = [[]]
    constant = 0
    every = np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
    top = (1 << bits) - 1
    for d in range(min(width, len(query))):
        weight = int(query[d])
        if not weight:
            continue
        constant += weight * low
        size = abs(weight)
        if weight < 0:  # w * u = |w| * (top - u) - |w| * top, and top - u has all bits of u inverted
            constant -= size * top
        for b in range(bits):
            bitmap = index[d, b] if weight > 0 else index[d, b] ^ every
            rest, shift = size, b
            while rest:
                if rest & 1:
                    while len(levels) <= shift:
                        levels.append([])
                    levels[shift].append(bitmap)
                rest >>= 1
                shift += 1
    score = [x if x is not None else np.zeros(words, np.uint64) for x in add_slices(levels)]
    flags = np.zeros(words * 64, np.uint8)
    flags[: len(ids)] = 1
    rows = best_rows(score, np.packbits(flags, bitorder="little").view(np.uint64), k)
    value = np.full(len(rows), constant, np.int64)
    for s, bitmap in enumerate(score):
        value += ((bitmap[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    return ids[rows], value


def _blocks(scale: float):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

        def close(ids, values):
            width = max(v.shape[1] for v in values)
            whole = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in values])
            ids = np.concatenate(ids)
            order = np.argsort(ids, kind="stable")
            index, low = slices(whole[order])
            values = (group, ids[order].tobytes(), index.tobytes(), width, index.shape[1], low)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names=["part", "ids", "slices", "width", "bits", "low"])

        ids, values, n = [], [], 0
        for batch in batches:
            kept, found = quantised(batch.column(1), scale)
            own = batch.column(0).to_numpy()[kept]
            for at in range(0, len(own), BLOCK_ROWS):
                for a, b in ((at, min(len(own), at + BLOCK_ROWS - n)), (min(len(own), at + BLOCK_ROWS - n), min(len(own), at + BLOCK_ROWS))):
                    if a < b:
                        ids.append(own[a:b])
                        values.append(found[a:b])
                        n += b - a
                    if n >= BLOCK_ROWS:
                        yield from close(ids, values)
                        ids, values, n = [], [], 0
        if n:
            yield from close(ids, values)

    return run


def _query_blocks(scale: float, rows: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept, found = quantised(batch.column(1), scale)
            ids, row = batch.column(0).to_numpy()[kept], batch.column(2).to_numpy()[kept]
            for at in range(0, len(ids), rows):
                part = slice(at, at + rows)
                values = (ids[part].tobytes(), row[part].tobytes(), found[part].tobytes(), found.shape[1])
                types = (pa.binary(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names=["query_ids", "query_rows", "queries", "query_width"])

    return run


def _search(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.to_pylist():
                ids = np.frombuffer(x["ids"], np.int64)
                index = np.frombuffer(x["slices"], np.uint64).reshape(x["width"], x["bits"], -(-len(ids) // 64))
                asked = np.frombuffer(x["query_ids"], np.int64)
                queries = np.frombuffer(x["queries"], np.int64).reshape(len(asked), x["query_width"])
                out = []
                for query_id, row, query in zip(asked, np.frombuffer(x["query_rows"], np.int64), queries):
                    found, score = top_of_block(ids, index, x["low"], query, k + 1)
                    own = (found == query_id) & (score == int(query @ query))
                    out.append((np.full(len(found), query_id), np.full(len(found), row), found, score, own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "query_row", "vec_id", "score", "own"])

    return run


_BLOCK_TYPES = "part int, ids binary, slices binary, width int, bits int, low long"
_QUERY_TYPES = "query_ids binary, query_rows binary, queries binary, query_width int"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` highest integer inner products.

    Both tables hold an integer id and a list of numbers; a component x counts as
    floor(scale * x).  One row of ``vectors`` is the query's own and is left out (one with its
    id and score with itself); repeated rows of it are candidates.  Ties go to the smaller id,
    and a query with fewer candidates gets all.  Rows with a null id and vectors that are
    null or hold null or non-finite components take no part; of vectors of unequal length
    the shorter one, even an empty one, counts as filled up with zeros.  Repeated query
    rows are each answered; without vectors or queries the result is empty.  Scores must
    fit 62 bits.
    """
    n = vectors.count()
    parts = max(1, -(-n // BLOCK_ROWS))
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    blocks = base.coalesce(parts).mapInArrow(_blocks(scale), _BLOCK_TYPES)
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("row"))
    # A block of the index is sent once for each block of queries: these are as large as the cores allow.
    n_asked, cores = queries.count(), vectors.sparkSession.sparkContext.defaultParallelism
    rows = min(QUERY_ROWS, max(LEAST_QUERY_ROWS, -(-n_asked * parts // (4 * cores))))
    asked = asked.coalesce(parts).mapInArrow(_query_blocks(scale, rows), _QUERY_TYPES)
    # Every block of queries goes to each part of the index: equal parts meet.
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = asked.join(blocks, "part").drop("part")
    tasks = max(1, parts * -(-n_asked // rows))
    found = pairs.repartition(tasks, F.xxhash64("query_rows", "ids")).mapInArrow(freed(_search(k)), "query_id long, query_row long, vec_id long, score long, own boolean")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # The first own row goes, and what stands behind it moves up.
    seen = near.withColumn("seen", F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = seen.where(~(F.col("own") & (F.col("seen") == 1))).withColumn("rank", F.col("place") - F.least("seen", F.lit(1)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
