"""Alignment of two tokenizers over the same texts, and how often the corpus links their ids.

Each batch of texts is encoded by both sides into frames of token starts, in bytes.
``pandas.merge_asof``, keyed by document, finds for every start the other side's token
that covers it; both directions together give all overlapping pairs, and starts that
both sides share cut the text into groups.

The links of a document are stored as distinct id pairs with their number, so the
second pass, which looks up how many documents hold a pair, reads no text again.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, freed, hidden, shown, stored
from .packing import byte_letters
from .pieces import PieceEncoder, PieceModel, sliced

#: Bytes of text aligned at once, pairs of ids whose counts are sent to all tasks, and parts of a pair's rows in joins beyond.
SLICE, SENT_PAIRS, SALTS = 1 << 19, 3_000_000, 16


class ByteEncoder:
    """Byte-level BPE ids of texts, and the bytes of each id, from a tokenizer file.

    Texts are encoded by the ranked merges of the file.  Those whose splitting takes
    more steps than that encoder allows go to the file's own library.
    """

    def __init__(self, file: str, pattern: str):
        import tiktoken

        told, self.file, self.whole = json.loads(file), file, None
        byte_of = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in word): k for word, k in told["model"]["vocab"].items()}
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, np.int64)
        self.length[list(ranks.values())] = [len(x) for x in ranks]
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if max(map(len, text.split("\n"))) < 1 << 16:
            return self.fast(text)
        from tokenizers import Tokenizer

        if not self.whole:
            self.whole = Tokenizer.from_str(self.file)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids


class Aligner:
    """Aligns slices of texts; one for all tasks of a Python worker."""

    def __init__(self, told: dict):
        self.a, self.b = ByteEncoder(told["file"], told["pattern"]), PieceEncoder(told["model"])
        self.b_length = np.array([len(x) for x in told["model"].shown])
        self.b_size = len(self.b_length)
        width = len(str(max(self.a.size, self.b_size) - 1))
        digits = np.zeros((max(self.a.size, self.b_size), width + 1), np.uint8)
        for k in range(width):
            number = np.arange(len(digits)) // 10**k
            size = np.char.str_len(np.arange(len(digits)).astype(str))
            at = np.flatnonzero(size > k)
            digits[at, size[at] - 1 - k] = number[at] % 10 + ord("0")
        self.digits = digits

    def frames(self, texts: list[str]):
        """Both sides' tokens of the texts: frames (doc, start, id), starts growing through all texts."""
        import pandas as pd

        shown = [f" {x}" if x else "" for x in texts]
        size = np.array([len(x.encode()) for x in shown])
        base = np.cumsum(size) - size
        ids, ends = self.b.encode(texts)
        sides = [[np.array(self.a.encode(x) if x else [], np.int64) for x in shown], [ids[a:b] for a, b in zip(ends, ends[1:])]]
        tables = list(zip((self.a.length, self.b_length), sides))
        # Encoders keep all bytes but for characters that stand for a space, which get shorter: equal sizes are equal bytes.
        same = np.array([all(length[x[k]].sum() == n for length, x in tables) for k, n in enumerate(size.tolist())], bool)
        out = []
        for length, found in tables:
            count = np.array([len(x) if ok else 0 for x, ok in zip(found, same)], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *(x for x, ok in zip(found, same) if ok)]).astype(np.int64)
            doc = np.repeat(np.arange(len(texts)), count)
            end = np.cumsum(length[flat])
            first = np.cumsum(count) - count
            before = np.concatenate([[0], end])[first]
            out.append(pd.DataFrame({"doc": doc, "start": end - length[flat] + (base - before)[doc], "id": flat}))
        return out

    def links(self, a, b):
        """(doc, a id, b id) of all overlapping pairs, and which tokens of either side begin a group."""
        import pandas as pd

        a, b = a.rename(columns={"id": "a"}), b.rename(columns={"id": "b"})
        left = pd.merge_asof(a, b.assign(other=b["start"]), on="start", by="doc")
        right = pd.merge_asof(b, a.assign(other=a["start"]), on="start", by="doc")
        begins = [(side["start"] == side["other"]).to_numpy() for side in (left, right)]
        more = right[~begins[1]]  # a shared start is a link of the other direction already
        return np.stack([np.concatenate([left[c].to_numpy(), more[c].to_numpy()]) for c in ("doc", "a", "b")]), *begins

    def digests(self, n: int, a, b, begins) -> list[str]:
        """For each text the hash of its groups as ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""
        group = [np.cumsum(x) - 1 for x in begins]
        count = [np.bincount(g, minlength=begins[0].sum()) for g in group]
        place = [np.arange(len(a)) + (np.cumsum(count[1]) - count[1])[group[0]], np.arange(len(b)) + np.cumsum(count[0])[group[1]]]
        letters = np.zeros((len(a) + len(b), self.digits.shape[1]), np.uint8)
        for side, at, begin, mark in zip((a, b), place, begins, "|;"):
            ends = np.append(begin[1:], True)
            rows = self.digits[side["id"].to_numpy()]
            size = (rows > 0).sum(axis=1)
            rows[np.arange(len(rows)), size] = np.where(ends, ord(mark), ord(","))
            letters[at] = rows
        total = np.bincount(a["doc"], minlength=n) + np.bincount(b["doc"], minlength=n)
        ends = np.cumsum(total)
        used = letters > 0
        bytes_at = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.concatenate([[0], ends])]
        data = letters[used].tobytes()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bytes_at, bytes_at[1:])]


def load_sides(byte_file: str, pattern: str, piece_model: PieceModel) -> dict:
    """Plain data of both sides, for ``align``: a byte-level BPE file with its splitting pattern, and a piece model."""
    with open(byte_file, encoding="utf-8") as file:
        text = file.read()
    vocabulary, merges = json.loads(text)["model"]["vocab"], json.loads(text)["model"]["merges"]
    first = min(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges)
    if any(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] != first + k for k, m in enumerate(merges)):
        raise ValueError("ids must follow the order of the merges")
    return {"file": text, "pattern": pattern, "model": piece_model}


def _worker_aligner(shared: dict) -> Aligner:
    """The aligner of broadcast data, kept in the broadcast value for all tasks of a Python worker."""
    if "aligner" not in shared:
        shared["aligner"] = Aligner(shared)
    return shared["aligner"]


def _lists(values, ends):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def token_groups(docs: DataFrame, sides: dict, text_col: str = "text", out_col: str = "groups") -> DataFrame:
    """``docs`` without the text, with its groups: arrays of (a, b), the ids of both sides between shared ends.

    Null and empty texts, and those with characters that a side writes as a space, have
    none.  A column named ``out_col`` gives way.
    """
    rest = [c for c in docs.columns if c not in (text_col, out_col)]
    shared = docs.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        import pyarrow as pa

        aligner = _worker_aligner(shared.value)
        for batch in batches:
            for first, texts in sliced(batch.column(0), SLICE):
                frames = aligner.frames(texts)
                _, *begins = aligner.links(*frames)
                inner = [_lists(pa.array(side["id"].to_numpy(), pa.int32()), np.append(np.flatnonzero(begin), len(side))) for side, begin in zip(frames, begins)]
                count = np.bincount(frames[0]["doc"][begins[0]], minlength=len(texts))
                groups = pa.StructArray.from_arrays(inner, names=["a", "b"])
                columns = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, _lists(groups, np.append(0, np.cumsum(count)))], names=[*rest, out_col])

    kept = [F.col(f"`{c}`") for c in rest]
    schema = docs.select(*kept).withColumn(out_col, F.array().cast("array<struct<a:array<int>,b:array<int>>>")).schema
    return docs.select(F.col(f"`{text_col}`"), *kept).mapInArrow(freed(run), schema)


_ADDED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __pairs array<bigint>, __times array<int>"


def _linked(docs: DataFrame, sides: dict, rest: list[str]) -> DataFrame:
    """Each document's numbers, and its distinct pairs of linked ids (a * size + b) with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(sides)
    added = T._parse_datatype_string(_ADDED)

    def run(batches):
        import pyarrow as pa

        aligner = _worker_aligner(shared.value)
        for batch in batches:
            for first, texts in sliced(batch.column(0), SLICE):
                a, b = aligner.frames(texts)
                (doc, ids, others), *begins = aligner.links(a, b)
                span = aligner.a.size * aligner.b_size
                keys, times = np.unique(doc * span + ids * aligner.b_size + others, return_counts=True)
                owner = keys // span
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                counts = [np.bincount(x, minlength=len(texts)) for x in (a["doc"], b["doc"], a["doc"][begins[0]], doc)]
                columns = [*(c.slice(first, len(texts)) for c in batch.columns[1:]), *(pa.array(x, pa.int64()) for x in counts)]
                columns += [pa.array(aligner.digests(len(texts), a, b, begins), pa.string())]
                columns += [_lists(pa.array(keys - owner * span, pa.int64()), ends), _lists(pa.array(times, pa.int32()), ends)]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *added.names])

    return docs.mapInArrow(freed(run), T.StructType([*docs.drop("__text").schema.fields, *added.fields]))


def pair_counts(linked: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and if that is the most of its first id."""
    counts = linked.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _looked_up(linked: DataFrame, counts: DataFrame, rest: list[str]) -> DataFrame:
    """``linked`` with its sums over links, from a table of counts that every task gets."""
    held = counts.orderBy("pair").toPandas()
    table = linked.sparkSession.sparkContext.broadcast((held["pair"].to_numpy(np.int64), held["count"].to_numpy(np.int64), held["best"].to_numpy(bool)))
    del held

    def run(batches):
        import pyarrow as pa

        pair, count, best = table.value
        for batch in batches:
            pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            n = times.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (n * best[at] if len(at) else n, n * count[at] if len(at) else n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(x, pa.int64()) for x in sums)], names=[*rest, "n_best", "count_sum"])

    schema = linked.drop("__pairs", "__times").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema
    return linked.mapInArrow(freed(run), schema)


def _joined(linked: DataFrame, counts: DataFrame, rest: list[str]) -> DataFrame:
    """The same by a join, for counts of any number; the rows of frequent pairs are salted."""
    rows = linked.withColumn("__row", F.monotonically_increasing_id())
    rows, _ = stored(rows)
    links = rows.select("__row", F.explode(F.arrays_zip("__pairs", "__times")).alias("x"))
    links = links.select("__row", F.col("x.__pairs").alias("pair"), F.col("x.__times").alias("n"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).alias("salt"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sums = links.join(salted, ["pair", "salt"]).groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = rows.drop("__pairs", "__times").join(sums, "__row", "left")
    return found.select(*rest, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))


def align(docs: DataFrame, sides: dict, text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``docs`` without the text, with its alignment's numbers.

    Added are ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping pairs of
    tokens), ``groups_sha256`` (of the groups' ids as text), ``n_best`` (links whose pair of
    ids is linked in as many documents as any pair of its first id, ties included) and
    ``count_sum`` (over links, the documents that hold their pair).  Null and empty texts,
    and those that a side does not keep byte by byte, have zeros and ''.  Repeated rows are
    documents like others.  An empty table gives an empty one; columns of ``docs`` with the
    added names give way.

    Up to ``sent_pairs`` distinct pairs (counted first) their counts go to every task;
    beyond, they are joined.  The documents' pairs stay in shared storage, as the result
    reads them.
    """
    names = [f.name for f in T._parse_datatype_string(_ADDED).fields[:5]] + ["n_best", "count_sum"]
    kept = [c for c in docs.columns if c not in (text_col, *names)]
    put_away = hidden(docs, kept, F.col(f"`{text_col}`").alias("__text"))
    linked, _ = stored(_linked(put_away, sides, put_away.columns[1:]))
    counts, path = stored(pair_counts(linked, len(sides["model"].shown)))
    rest = [*put_away.columns[1:], *names[:5]]
    if counts.count() <= sent_pairs:
        found = _looked_up(linked, counts, rest)
        dropped(docs.sparkSession, path)
    else:
        found = _joined(linked, counts, rest)
    return found.select(*shown(kept), *names)
