"""Packing of tokenised documents into sequences, first-fit decreasing by a tournament tree.

Every input partition draws its documents into random groups and packs each group
by itself, so neither texts nor tokens are shuffled, and a group's size bounds the
memory.  Documents longer than a sequence are cut; pieces go, longest first, to the
first bin with room, which a tournament tree over the bins' free room finds in
logarithmic time.  The gaps that this leaves are filled by cutting the pieces of
the emptiest bins, and what remains of the last bin goes to sequences of a power of
two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed

#: Documents of a random group, and how many groups' documents are drawn from at once.
GROUP, DRAWN = 2048, 4
#: Tokens after which a draw is closed early, words that a task remembers, and characters whose words are looked up at once.
DRAW_TOKENS, KNOWN_WORDS, TEXT_CHARS = 8_000_000, 250_000, 1 << 20


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (at most ``capacity``): longest first, each to the first bin with room."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, node = sizes[k], 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out[k] = node - leaves
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return out


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    All sequences have ``capacity`` tokens but for those, of a power of two each, that
    hold the last remainder.
    """
    full, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for piece, where in zip(rest, first_fit_decreasing([n for _, _, n in rest], capacity)):
        bins.setdefault(where, []).append(piece)
    loose = sorted(bins.values(), key=lambda b: sum(n for _, _, n in b))
    gap = [capacity - sum(n for _, _, n in b) for b in loose]
    give, take = 0, len(loose) - 1
    while give < take:
        if not gap[take]:
            take -= 1
        elif not loose[give]:
            give += 1
        else:
            doc, at, n = loose[give].pop()
            part = min(n, gap[take])
            loose[take].append((doc, at, part))
            gap[take] -= part
            gap[give] += part
            if part < n:
                loose[give].append((doc, at + part, n - part))
    if not loose:
        return full
    left, last = loose[give], capacity - gap[give]
    done = full + loose[give + 1 :]
    while last:
        size = 1 << (last.bit_length() - 1)
        last -= size
        done.append([])
        while size:
            doc, at, n = left.pop()
            part = min(n, size)
            done[-1].append((doc, at, part))
            size -= part
            if part < n:
                left.append((doc, at + part, n - part))
    return done


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(odd)}


class WordTokens:
    """Token ids of texts for a vocabulary that never joins over white space.

    Each distinct word is normalised and encoded once and remembered; results equal
    those of the whole text.  Texts with special tokens or rare control characters,
    whose splitting differs, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary, self.whole = vocabulary, None
        told = json.loads(vocabulary)
        splits = told["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.special = [*(t["content"] for t in told["added_tokens"]), *map(chr, range(0x1C, 0x20))]
        ends = told["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(told["model"]["vocab"].values()) + 1, bool)
        self.ends[[k for word, k in told["model"]["vocab"].items() if word.endswith(ends)]] = True
        told |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.letters = str.maketrans(byte_letters())
        self.bare = Tokenizer.from_str(json.dumps(told))
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_str(self.vocabulary)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        import unicodedata

        shown, counts = [], []
        for word in words:
            if word.isascii():
                if word.isalpha():
                    shown.append(word.lower())
                    counts.append(1)
                    continue
                parts = self.pieces(word.lower())
            else:
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
                parts = [p.encode().decode("latin-1").translate(self.letters) for p in self.pieces(word)]
            shown += parts
            counts.append(len(parts))
        chunks = [" ".join(shown[k : k + 512]) for k in range(0, len(shown), 512)]
        batches = (self.bare.encode_batch_fast(chunks[k : k + 8], add_special_tokens=False) for k in range(0, len(chunks), 8))
        ids = [np.array(e.ids, np.uint32) for batch in batches for e in batch]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        piece_ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        word_ends = piece_ends[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.bounds = np.concatenate([self.bounds, word_ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[np.ndarray | None] = [None] * len(texts)
        for k, text in enumerate(texts):
            if any(x in text for x in self.special):
                out[k] = self._whole(text)
        # Words stay in Arrow's buffers (those of white space alone are empty and have no ids): only distinct ones become str.
        split = pc.utf8_split_whitespace(pa.array(["" if done is not None else text for text, done in zip(texts, out)], pa.string()))
        coded = split.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in distinct if w not in known]
        kept = min(len(known) + len(new), KNOWN_WORDS)
        if new:
            self._learn(new)
        index = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[code]
        begin = self.bounds[index]
        length = self.bounds[index + 1] - begin
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], length)]
        ends = total[split.offsets.to_numpy()]
        if len(known) > KNOWN_WORDS:  # no room: these words are encoded again when they come again
            for word in new[len(new) - (len(known) - kept) :]:
                del known[word]
            self.bounds = self.bounds[: kept + 1]
            self.ids = self.ids[: self.bounds[-1]]
        return [ids[a:b] if done is None else done for done, a, b in zip(out, ends, ends[1:])]


def _encoder(shared: dict) -> WordTokens:
    """The encoder of a broadcast vocabulary, kept in the broadcast value for all tasks of a Python worker."""
    if "encoder" not in shared:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory
        shared["encoder"] = WordTokens(shared["text"])
    return shared["encoder"]


def _packed(vocabulary, capacity: int, end_id: int, rest: list[str], out_names: list[str], seed: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens = _encoder(vocabulary.value)
        part = TaskContext.get().partitionId()
        draw = np.random.default_rng([seed, part])
        sequence = part << 31

        def texts_of(column):
            text, size = [], 0
            for k in range(len(column)):
                text.append(column[k].as_py() or "")
                size += len(text[-1])
                if size > TEXT_CHARS:
                    yield text
                    text, size = [], 0
            if text:
                yield text

        def close(held, ids):
            nonlocal sequence
            table = pa.Table.from_batches(held)
            order = draw.permutation(len(ids))
            for at in range(0, len(order), GROUP):
                group = order[at : at + GROUP].tolist()
                rows = []
                for pieces in pack([len(ids[k]) for k in group], capacity):
                    offset = 0
                    for doc, start, n in pieces:
                        own = ids[group[doc]]
                        rows.append((group[doc], start, n, zlib.crc32(own[start : start + n].astype("<u4").tobytes()), len(own), sequence, offset))
                        offset += n
                    sequence += 1
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                kept = table.take(columns[0]).combine_chunks()
                arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
                yield pa.RecordBatch.from_arrays([*arrays, *columns[1:]], names=[*rest, *out_names])

        held, ids, size = [], [], 0
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[1:], names=rest)
            done = 0
            for text in texts_of(batch.column(0)):
                found = [np.append(x, np.uint32(end_id)) for x in tokens.encode(text)]
                held.append(own.slice(done, len(found)))
                done += len(found)
                ids += found
                size += sum(map(len, found))
                if len(ids) >= GROUP * DRAWN or size >= DRAW_TOKENS:
                    yield from close(held, ids)
                    held, ids, size = [], [], 0
        if ids:
            yield from close(held, ids)

    return freed(run)


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    seed: int = 0,
) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, and where the piece lies.

    Added are ``start`` (the document's ids before the piece), ``length``, ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (in the sequence).  Every id lies in exactly one piece;
    sequences have ``capacity`` ids or a power of two.  ``end_id`` ends each document; a
    null or empty text is that id alone.  Columns of ``docs`` with the added names give way.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = [c for c in docs.columns if c not in (text_col, *names)]
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast({"text": file.read()})
    schema = docs.select(*rest).withColumns({c: F.lit(0).cast("long") for c in names}).schema
    return docs.select(F.col(text_col).alias("__text"), *rest).mapInArrow(_packed(vocabulary, capacity, end_id, rest, names, seed), schema)
