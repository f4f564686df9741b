"""Removal of word passages that repeat anywhere in the corpus, by suffix trees split by prefixes.

All suffixes (word positions) of all texts form a suffix tree whose nodes of ``window``
words or more are the repeats.  Prefixes of variable length split it into groups:

1. Every window of ``window`` words owns the smallest-hash ``prefix``-gram inside of
   it.  Equal windows own equal prefixes at equal places, so suffixes fall into
   groups by that prefix, and runs of neighbouring windows share one entry, which
   also knows the hashes of all words that the run covers.  Groups are counted first.  A
   prefix with one entry is a leaf, which is dropped here; one whose entries all cover
   the same words is a single path without a branch, all of whose windows repeat.
2. A branching group of up to ``group`` entries fits memory.  Only its entries travel,
   each with the words of its run, once for all suffixes that begin there.  One task builds
   the group's subtree from the top: an edge runs on as long as all suffixes below
   it have the same word, a branch parts them, and suffixes alone are leaves.  Nodes
   that are left at depth ``window`` are the repeats.
3. A group of more entries gets longer prefixes: first all words of a run.  Entries that
   agree in these repeat each other, and one of them stands for all.  What is left is
   told apart at ``window`` words, where a group is a node itself, so that it needs no
   tree and no memory, only its count, by partial sums.

Repeated windows that overlap or adjoin make the maximal repeats.  Words were told apart
by their bytes and hashed by XXH3 with 128 bits.  Trees compare words by 64 bits of these,
within one group; counted nodes are known by two independent 64-bit hashes of their word
path.  Words are not compared again: among 10**14 suffixes all chance collisions together
have a probability of about 1e-11.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, hidden, joined, run_hashes, shown, stored, text_slices, word_hashes, word_spans

#: What becomes of a run: it repeats as a whole, enters a subtree in memory, gets longer prefixes, or
#: repeats as a whole and gets longer prefixes for itself and all runs of the same words.
PATH, TREE, LONGER, LEADER = 0, 1, 2, 3
#: Words are parted by ASCII white space.
IS_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its first smallest one."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = values[:-step], values[step:]
        take = right < left
        values = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        reach += step
    return at


def window_owners(hashes: np.ndarray, first: np.ndarray, window: int, prefix: int):
    """(document, first window, window count, owner's distance, its hash, two hashes of all words) of each run of windows that one prefix owns.

    ``hashes`` are those of the words of several texts (two rows), ``first`` each text's first word.
    """
    counts = np.maximum(np.diff(first) - window + 1, 0)
    if not counts.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)
    grams = run_hashes(hashes[0], prefix)
    doc = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - ahead[doc]
    owner = leftmost_minima(grams, window - prefix + 1)[first[doc] + place]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(owner)))
    at = first[doc[begin]] + place[begin]
    # A run has no more windows than a window has words, so its first and its last window hold all of its words.
    cover = [joined(w[at], w[at + length - 1] + length.astype(np.uint64), 1) for w in (run_hashes(h, window, k << 20) for k, h in enumerate(hashes))]
    return doc[begin], place[begin], length, owner[begin] - at, grams[owner[begin]], np.array(cover)


def packed(place: np.ndarray, length: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Place, window count and owner's distance of runs in one number, as Spark's rows have 8 bytes for any."""
    return place << 32 | length << 16 | ahead


def unpacked(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 32, spot >> 16 & 0xFFFF, spot & 0xFFFF


def _entries(window: int, prefix: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row = batch.column(0).to_numpy()
            for at, n, data, offsets in text_slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets, IS_WORD)
                doc, place, length, ahead, key, cover = window_owners(word_hashes(data, starts, ends), first, window, prefix)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), cover[0].view(np.int64), cover[1].view(np.int64), row[at : at + n][doc], packed(place, length, ahead))],
                    names=["prefix", "cover", "cover2", "row", "spot"],
                )

    return freed(run)


def _runs_of(batch, *some: int):
    """(hashes of all words, row, first word, place, length, owner's distance, prefix) of the runs of some kinds, by slices of texts."""
    row, runs = batch.column(0).to_numpy(), batch.column(2)
    for at, n, data, offsets in text_slices(batch.column(1)):
        starts, ends, first = word_spans(data, offsets, IS_WORD)
        own = runs.slice(at, n)
        size = np.diff(np.asarray(own.offsets))
        spot, key, kinds = (own.flatten().field(k).to_numpy() for k in range(3))
        wanted = np.isin(kinds, some)
        doc = np.repeat(np.arange(n), size)[wanted]
        yield word_hashes(data, starts, ends), row[at : at + n][doc], first[doc], *unpacked(spot[wanted]), key[wanted]


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


def _branches(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for hashes, row, first, place, length, ahead, key in _runs_of(batch, TREE):
                size = length + window - 1
                words = np.ascontiguousarray(hashes[0][_spread(first + place, size)])
                offsets = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
                words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(packed(place, length, ahead)), words], names=["prefix", "row", "spot", "words"])

    return freed(run)


def deep_suffixes(words: np.ndarray, begin: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (numbers, rising) share their first ``depth`` words with another one of their group.

    ``begin`` is where each suffix begins in ``words``.  The tree grows from the top, all
    groups at once: suffixes of one node stand together, and only nodes where some word
    differs from the first suffix's are sorted by it.
    """
    suffix = np.argsort(group, kind="stable")
    begin, group = begin[suffix], group[suffix]
    new = np.ones(len(suffix), bool)
    new[1:] = group[1:] != group[:-1]
    level = 0
    while True:
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(new)))
        inner = np.repeat(size > 1, size)
        if not inner.all():
            suffix, begin, new = suffix[inner], begin[inner], new[inner]
            size = size[size > 1]
            starts = np.cumsum(size) - size
        branch = np.zeros(0, bool)
        while level < depth and len(suffix) and not branch.any():
            word = words[begin + level]
            branch = np.logical_or.reduceat(word != np.repeat(word[starts], size), starts)
            level += 1
        if not branch.any():
            return np.sort(suffix)
        at = np.flatnonzero(np.repeat(branch, size))
        order = np.lexsort((word[at], np.repeat(np.arange(len(size)), size)[at]))
        suffix[at], begin[at], word = suffix[at][order], begin[at][order], word[at][order]
        new[at[1:]] |= word[1:] != word[:-1]


def _trees(window: int):
    def repeats(table):
        import pyarrow as pa

        key, row, spot = (table.column(k).to_numpy() for k in range(3))
        place, length, ahead = unpacked(spot)
        column = pa.concat_arrays(table.column(3).cast(pa.large_binary()).chunks)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(row)]
        run = np.repeat(np.arange(len(row)), length)
        step = _spread(np.zeros(len(row), np.int64), length)
        # Equal windows have their owner at equal distances.
        group = (np.cumsum(np.append(True, key[1:] != key[:-1]))[run] * window) + ahead[run] - step
        hit = deep_suffixes(np.frombuffer(data, np.uint64), offsets[run] // 8 + step, group, window)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])
        begin = np.flatnonzero(new)
        first = hit[begin]
        size = np.diff(np.append(begin, len(hit)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row[run[first]], (place[run] + step)[first].astype(np.int32), size.astype(np.int32))], names=["row", "place", "length"])

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = int(np.searchsorted(held.column(0).to_numpy(), held.column(0)[-1].as_py()))
            if last:
                yield repeats(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield repeats(held)

    return freed(run)


def _suffixes(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for hashes, row, first, place, length, _, _ in _runs_of(batch, LONGER, LEADER):
                begin = _spread(first + place, length)
                nodes = [run_hashes(h, window, k << 20)[begin].view(np.int64) for k, h in enumerate(hashes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*nodes, np.repeat(row, length), _spread(place, length).astype(np.int32))],
                    names=["node", "node2", "row", "place"],
                )

    return freed(run)


def _cut(window: int, joiner: str | None, rest: list[str]):
    def kept(text: str | None, places: np.ndarray, lengths: np.ndarray) -> tuple[int, int, str]:
        data = (text or "").encode()
        if not len(places):
            if joiner is None:
                return len(data.split()), 0, text or ""
            words = data.split()
            return len(words), 0, joiner.encode().join(words).decode()
        starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), IS_WORD)
        depth = np.zeros(len(starts) + 1, np.int64)
        np.add.at(depth, places, 1)
        np.add.at(depth, places + lengths - 1 + window, -1)
        stays = np.cumsum(depth[:-1]) == 0
        if joiner is not None:
            words = data.split()
            return len(words), int((~stays).sum()), joiner.encode().join([words[k] for k in np.flatnonzero(stays)]).decode()
        edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
        spans = zip(starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1])
        return len(starts), int((~stays).sum()), b"\n".join(data[a:b] for a, b in spans).decode()

    def numbers(scalar, field: int) -> np.ndarray:
        return np.zeros(0, np.int64) if scalar.values is None else scalar.values.flatten()[field].to_numpy()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                runs, found = batch.column(1)[k], batch.column(2)[k]
                path = unpacked(numbers(runs, 0)[np.isin(numbers(runs, 2), (PATH, LEADER))])
                places, lengths = (np.concatenate([numbers(found, f).astype(np.int64), path[f]]) for f in (0, 1))
                out.append(kept(batch.column(0)[k].as_py(), places, lengths))
            n_words, n_removed, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                names=[*rest, "n_words", "n_removed", "kept_text"],
            )

    return freed(run)


def repeated_windows(docs: DataFrame, window: int = 35, prefix: int = 8, group: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The repeats of each row (``row``, ``text``, others) that has any, as two tables keyed by ``row``.

    ``runs`` are structs of spot (see ``packed``), prefix and kind: all windows of runs of kind
    ``PATH`` and ``LEADER`` are repeats.  ``places`` are structs of place and length of the repeated windows of others.
    """
    texts = docs.select("row", "text")
    entries = texts.mapInArrow(_entries(window, prefix), "prefix long, cover long, cover2 long, row long, spot long")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("cover", "cover2") for f in (F.min, F.max)]
    groups = entries.groupBy("prefix").agg(F.count("*").alias("n"), *ends)
    branch = F.expr("min_cover <> max_cover OR min_cover2 <> max_cover2")
    kind = F.when(~branch, PATH).when(F.col("n") <= group, TREE).otherwise(LONGER)
    groups = groups.where("n > 1").select("prefix", kind.alias("kind"))
    # Nothing is null here; this says what Spark infers for some readings only, which then could not share an exchange.
    inverse = F.bitwise_not("prefix")
    entries = entries.where(F.expr("row IS NOT NULL AND cover IS NOT NULL AND cover2 IS NOT NULL") & inverse.isNotNull() & F.bitwise_not(inverse).isNotNull())
    runs = _inverted(entries, "prefix").join(_inverted(groups, "prefix"), "prefix")
    same, first = ["prefix", "cover", "cover2"], F.struct("row", "spot")
    copies = runs.where(F.col("kind") == LONGER).groupBy(*same).agg(F.count("*").alias("n"), F.min(first).alias("leader")).where("n > 1").drop("n")
    runs = _inverted(runs, "prefix").join(_inverted(copies, "prefix"), same, "left")
    runs = runs.withColumn("kind", F.when(F.col("leader").isNull(), F.col("kind")).when(F.col("leader") == first, LEADER).otherwise(PATH))
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("spot", "prefix", "kind")).alias("runs"))
    # All columns of docs stay, so that this join and the last one share one exchange of the texts.
    below, rest = docs.join(runs, "row"), [c for c in docs.columns if c not in ("row", "text")]

    def having(*kinds: int) -> DataFrame:
        return below.where(F.exists("runs", lambda x: x["kind"].isin(*kinds))).select("row", "text", "runs", *rest)

    branches = having(TREE).mapInArrow(_branches(window), "prefix long, row long, spot long, words binary")
    grouped = branches.repartition("prefix").sortWithinPartitions("prefix")
    found = grouped.mapInArrow(_trees(window), "row long, place int, length int")
    suffixes = having(LONGER, LEADER).mapInArrow(_suffixes(window), "node long, node2 long, row long, place int")
    internal = suffixes.groupBy("node", "node2").count().where("count > 1").select("node", "node2")
    nodes = _inverted(suffixes, "node").join(_inverted(internal, "node"), ["node", "node2"], "left_semi")
    places = found.unionByName(nodes.select("row", "place", F.lit(1).alias("length")))
    return runs, places.groupBy("row").agg(F.collect_list(F.struct("place", "length")).alias("places"))


def _inverted(df: DataFrame, column: str) -> DataFrame:
    """``df`` with all bits of a key inverted: a join by it after an aggregation by the key itself has
    an exchange on either side, so that Spark can split the partition of a very frequent key."""
    return df.withColumn(column, F.bitwise_not(column))


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, prefix: int = 8, joiner: str | None = None, repeatable: bool = False, group: int = 1024) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` instead of the text column.

    Removed is every word covered by a window of ``window`` consecutive words whose
    word sequence also starts anywhere else (same text included); windows are judged
    on the input.  ``kept_text`` keeps the spacing inside the passages that stay and
    parts these by a line break; with ``joiner`` it is the kept words joined by that.
    A null text has no words and gives an empty text; texts shorter than a window are
    untouched; repeated rows repeat each other and lose all their windows; an empty
    table gives an empty one.  ``docs`` is read more than once: it is written to the
    shared storage first unless it is ``repeatable``, which means that every reading
    gives its rows in the same order (as plain reads of a stored table do).  Subtrees of
    up to ``group`` entries are built in memory (0.5 MB with the defaults); every size
    gives the same result.
    """
    if not 0 < prefix <= window < 1 << 15:
        raise ValueError("prefix must have between 1 and window words, a window less than 32,768")
    if not repeatable:
        docs, _ = stored(docs)
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_text")]
    numbered = hidden(docs, rest, F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    runs, places = repeated_windows(numbered, window, prefix, group)
    kept = [c for c in numbered.columns if c.startswith("__kept")]
    schema = numbered.select(*kept).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    found = numbered.join(runs, "row", "left").join(places, "row", "left")
    cut = found.select("text", "runs", "places", *kept).mapInArrow(_cut(window, joiner, kept), schema)
    return cut.select(*shown(rest), "n_words", "n_removed", "kept_text")
