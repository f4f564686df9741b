"""What the operators of this subpackage share: columns, shared storage, bytes of texts."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word of the ASCII-normalised text: digits, a-z and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and only those, in lower case."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """The words of ``text`` in order, lower-cased (null: none)."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0)), F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hidden(df: DataFrame, kept: list[str], *own: Column) -> DataFrame:
    """``own`` columns, with the ``kept`` ones under names that no operator uses."""
    return df.select(*own, *(F.col(f"`{c}`").alias(f"__kept{k}") for k, c in enumerate(kept)))


def shown(kept: list[str]) -> list[Column]:
    """The columns that ``hidden`` put away, by their names again."""
    return [F.col(f"__kept{k}").alias(c) for k, c in enumerate(kept)]


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and
    the master is local, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vecspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to shared storage and read again (this cuts its lineage), and its path."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``stored`` made."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lets the session send at most ``rows`` rows at once to Python workers.

    Spark counts rows, not bytes, and 10,000 documents are tens of megabytes, which the
    JVM, its Arrow buffers and the worker each hold; fewer where the session says so.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


# --- bytes of texts, inside tasks ---------------------------------------------------

#: Bytes of text that a task works on at once; a longer text is one piece by itself.
SLICE_BYTES = 1 << 18


def text_slices(column):
    """(first row, row count, bytes, offsets) of runs of whole texts of an Arrow string column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, last - first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words of concatenated texts, and each text's first word (one more at the end).

    ``is_word`` tells for each of the 256 bytes whether it belongs to a word; a
    word never reaches over the end of a text.
    """
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edges = offsets[offsets < len(data)]
    starts = inside & ~before[:-1]
    starts[edges] = inside[edges]
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = inside & ~after[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of ordered pairs of 64-bit hashes."""
    return mixed(mixed(a, salt) * np.uint64(5) + b)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes (rows) of each word; ``starts`` and ``ends`` as of ``word_spans``.

    Words are told apart by their bytes first, so that each distinct one is hashed once.
    """
    import pyarrow as pa
    import xxhash

    if not len(starts):
        return np.zeros((2, 0), np.uint64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_128_digest
    table = np.frombuffer(b"".join(map(digest, coded.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(table[coded.indices.to_numpy()].T)


def run_hashes(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` values, one for each start.

    Runs of 1, 2, 4 and more values are hashed from two halves; the last step lets two runs overlap.
    """
    size = 1
    while 2 * size <= length:
        hashes = joined(hashes[: max(0, len(hashes) - size)], hashes[size:], salt + size)
        size *= 2
    rest = length - size
    if rest:
        hashes = joined(hashes[: max(0, len(hashes) - rest)], hashes[rest:], salt + length)
    return hashes


def freed(run):
    """``run`` (batches to batches) that gives unused memory back to the system, as Python workers go on to other tasks.

    At a task's end, and at its start, as only then Spark has dropped the broadcast values of earlier jobs.
    """

    def release():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    def whole(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def text_list(column, first: int, n: int) -> list[str]:
    """``n`` texts of an Arrow column as str; null is empty."""
    return [x or "" for x in column.slice(first, n).to_pylist()]
