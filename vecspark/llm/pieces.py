"""Exact encoding and decoding with merge-type (BPE) SentencePiece models.

A sequence of pieces is the model's encoding of a text if, and only if, every piece
encodes to itself and every two neighbours together encode to just these two.  So the
encoder walks from left to right: an Aho-Corasick automaton tells the longest piece at
every place; a piece is taken if merging it anew with the piece before gives the same
two; else the next shorter one that begins the same way is tried; where none is left,
the place is marked in a bitfield and the walk goes one piece back.  Every place fails
once at most, so the time is linear in the text, however long.

Merges never reach over a space after a letter, nor over characters that no longer
piece has, so texts are cut there and a task remembers the pieces of frequent parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, text_list

#: The character that stands for a space in pieces, and what an id outside of the vocabulary's texts decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Bytes of text encoded at once, parts that a task remembers, letters of a part that is worth it, and places for pairs.
SLICE, KNOWN_PARTS, LONG_PART, PAIR_SLOTS = 1 << 20, 200_000, 48, 1 << 20
#: Parts that are too few for array operations to pay.
FEW = 8


def merged(text: str, scores: dict[str, float], history: list | None = None) -> list[str]:
    """The pieces of a short text by merging: the best-scored pair first, of equals the leftmost.

    ``history`` gets the score of each merge, and the first and the last piece after it.
    """
    parts = list(text)
    while len(parts) > 1:
        best, at = None, 0
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if history is not None:
            history.append((best, parts[0], parts[-1]))
    return parts


@dataclass(frozen=True)
class PieceModel:
    """Plain data of a model, for broadcasting: pieces with id and score, ids of single bytes, texts of all ids."""

    ids: dict[str, int]
    scores: dict[str, float]
    usable: list[str]
    byte_ids: list[int]
    shown: list[bytes]
    is_byte: list[bool]


def load_model(path: str) -> PieceModel:
    """Reads a BPE model with byte fallback, a space put before texts and no other normalisation.

    Models of other kinds raise ValueError.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    text = [model.id_to_piece(k) for k in range(size)]
    plain = [k for k in range(size) if not (model.is_unknown(k) or model.is_control(k) or model.is_unused(k) or model.is_byte(k))]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    probe = " ﬁ  A\n"
    if not all(map(model.is_byte, byte_ids)) or model.decode(model.encode(probe)) != probe or model.decode(model.encode("a")) != "a" or model.encode("a") == model.encode(" a"):
        raise ValueError("the model must have byte fallback, put one space before texts and leave them as they are otherwise")
    ids = {text[k]: k for k in plain}
    scores = {text[k]: model.get_score(k) for k in plain}
    if any(SPACE in piece.lstrip(SPACE) for piece in ids):
        raise ValueError("pieces that hold a space after a letter are not supported")
    usable = [piece for piece in ids if merged(piece, scores) == [piece]]
    if any(model.encode(piece.replace(SPACE, " "))[-1] not in range(size) for piece in usable[:1]):
        raise ValueError("the model does not encode its own pieces")
    shown = []
    for k, piece in enumerate(text):
        if model.is_control(k):
            shown.append(b"")
        elif model.is_unknown(k):
            shown.append(UNKNOWN.encode())
        elif model.is_byte(k):
            shown.append(bytes([int(piece[3:5], 16)]))
        else:
            shown.append(piece.replace(SPACE, " ").encode())
    return PieceModel(ids, scores, usable, byte_ids, shown, [bool(model.is_byte(k)) for k in range(size)])


class PieceEncoder:
    """Encodes and decodes; one for all tasks of a Python worker.

    Tokens are numbered: pieces first, then characters that stand alone (no piece of
    their own, given by bytes); the last number is any character of no piece at all.
    All parts of a slice of texts take a step of their walks at once.
    """

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        lone = sorted({c for piece in model.ids for c in piece} - set(model.usable))
        self.tokens = [*model.usable, *lone]
        number = {token: k for k, token in enumerate(self.tokens)}
        self.other, self.lone = len(self.tokens), len(model.usable)
        self.automaton = ahocorasick.Automaton()
        self.single = np.full(0x110000, self.other, np.int32)
        for token, k in number.items():
            if len(token) > 1:
                self.automaton.add_word(token, k)
            else:
                self.single[ord(token)] = k
        self.automaton.make_automaton()
        self.length = np.array([*map(len, self.tokens), 1])
        begins = ((token[:n] for n in range(len(token) - 1, 0, -1)) for token in self.tokens)
        self.shorter = np.array([*(next((number[x] for x in some if x in number), -1) for some in begins), -1])
        self.id_of = np.array([*(model.ids[piece] for piece in model.usable), *[-1] * (len(lone) + 1)], np.int32)
        self.byte_ids = np.array(model.byte_ids, np.int32)
        used = {c for piece in model.ids for c in piece}
        inside = {c for piece in model.ids if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside and chr(c) != " ")
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]+" if alone else "")).findall
        self.between = next(chr(c) for c in [10, *range(0x110000)] if chr(c) not in used)
        self.histories: dict[str, list] = {}
        self.pair, self.fits = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)
        self.known: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.control = {k for k, text in enumerate(model.shown) if not text}

    def _history(self, token: str) -> list[tuple[float, str, str]]:
        """All merges of a token, and an end that comes last."""
        found = self.histories.get(token)
        if found is None:
            found = self.histories[token] = [(0.0, token[0], token[-1])]
            merged(token, self.model.scores, found)
            found.append((-np.inf, token, token))
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging both together never joins a piece of one to a piece of the other.

        Up to such a joint both merge as they do alone, so their merges are gone through
        in order of score; of equal ones the place to the left comes first.
        """
        scores, ours, theirs, i, j = self.model.scores, self._history(left), self._history(right), 0, 0
        while True:
            joint = scores.get(ours[i][2] + theirs[j][1])
            ends = i == len(ours) - 2, j == len(theirs) - 2
            if joint is not None and joint > ours[i + 1][0] and joint >= theirs[j + 1][0]:
                return False
            if all(ends):
                return True
            if ours[i + 1][0] >= theirs[j + 1][0]:
                i += 1
            else:
                j += 1

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging both tokens anew gives the same two; answers are remembered."""
        free = (left == self.other) | (right == self.other)
        pair = left * (self.other + 1) + right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        new = np.flatnonzero((self.pair[slot] != pair) & ~free)
        out = self.fits[slot] | free
        if len(new):
            distinct, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            tokens = self.tokens
            fits = np.array([self._stay_apart(tokens[a], tokens[b]) for a, b in zip(left[new[first]].tolist(), right[new[first]].tolist())])
            self.pair[slot[new[first]]], self.fits[slot[new[first]]] = distinct, fits
            out[new] = fits[back]
        return out

    def _walk_alone(self, at: int, token: int, end: int, longest: np.ndarray, before: np.ndarray, failed: np.ndarray) -> None:
        """The rest of one part's walk, as ``_walk`` takes it for many."""
        begin, apart = at, {}
        while begin and before[begin] >= 0:
            begin -= int(self.length[before[begin]])
        next_longest, chosen, gone = longest[begin:end].tolist(), before[begin : end + 1].tolist(), failed[begin : end + 1].tolist()
        length, shorter, at, end = self.length.tolist(), self.shorter.tolist(), at - begin, end - begin
        while at < end:
            to, last = at + length[token], chosen[at]
            good = not gone[to]
            if good and last >= 0 and token != self.other and last != self.other:
                good = apart.get((last, token))
                if good is None:
                    good = apart[last, token] = self._stay_apart(self.tokens[last], self.tokens[token])
            if good:
                chosen[to], at = token, to
                token = next_longest[at] if at < end else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                if last < 0:
                    raise ValueError("a text without encoding")
                gone[at], token = True, last
                at -= length[last]
        before[begin : begin + end + 1] = chosen

    def _walk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in one array, and each part's number of ids."""
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = self.between.join(parts) + self.between
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size + 1) - 1
        begin = end - size
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest = self.single[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int64)
        longest[hits[:, 0] + 1 - self.length[hits[:, 1]]] = hits[:, 1]  # ends grow, so the longest is the last
        before, failed = np.full(len(text), -1), np.zeros(len(text), bool)
        active = np.flatnonzero(size)
        at, token = begin.copy(), longest[begin]
        while len(active) > FEW:
            here, now = at[active], token[active]
            to, last = here + self.length[now], before[here]
            good = ~failed[to]
            check = np.flatnonzero(good & (last >= 0))
            good[check] = self._compatible(last[check], now[check])
            taken = active[good]
            before[to[good]], at[taken], token[taken] = now[good], to[good], longest[to[good]]
            other, less = active[~good], self.shorter[now[~good]]
            token[other] = less
            stuck = other[less < 0]
            if len(stuck):
                place = at[stuck]
                if (before[place] < 0).any():
                    raise ValueError("a text without encoding")
                failed[place], token[stuck] = True, before[place]
                at[stuck] = place - self.length[before[place]]
            active = active[at[active] < end[active]]
        for k in active.tolist():
            self._walk_alone(int(at[k]), int(token[k]), int(end[k]), longest, before, failed)
        chosen, place = np.full(len(text), -1), end.copy()
        back = np.flatnonzero(size)
        while len(back):
            found = before[place[back]]
            place[back] -= self.length[found]
            chosen[place[back]] = found
            back = back[place[back] > begin[back]]
        start = np.flatnonzero(chosen >= 0)
        found = chosen[start]
        data = np.frombuffer(text.encode(), np.uint8)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        width = np.where(found < self.lone, 1, byte[start + 1] - byte[start])
        to = np.cumsum(width)
        ids = np.repeat(self.id_of[found], width)
        for k in range(4):
            by_byte = np.flatnonzero((found >= self.lone) & (width > k))
            ids[to[by_byte] - width[by_byte] + k] = self.byte_ids[data[byte[start[by_byte]] + k]]
        ends = np.append(0, to)[np.searchsorted(start, end)]
        return ids, np.diff(ends, prepend=0)

    def _learn(self, parts: list[str]) -> None:
        ids, counts = self._walk(parts)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.bounds = np.concatenate([self.bounds, np.cumsum(counts) + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin (one more at the end)."""
        parts: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                parts += self.parts(SPACE + text.replace(" ", SPACE))
            ends.append(len(parts))
        known = self.known
        kept = len(known)
        new = list(set(parts).difference(known))
        new.sort(key=len)
        self._learn(new)
        index = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        begin = self.bounds[index]
        total = np.concatenate([[0], np.cumsum(self.bounds[index + 1] - begin)])
        flat = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], np.diff(total))]
        room = max(kept, min(KNOWN_PARTS, kept + sum(len(x) <= LONG_PART for x in new)))
        if len(known) > room:  # no room: these parts are encoded again when they come again
            for part in new[room - kept :]:
                del known[part]
            self.bounds = self.bounds[: room + 1]
            self.flat = self.flat[: self.bounds[-1]]
        return flat, total[ends]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8; bytes of ids that make no character become U+FFFD each."""
        shown, is_byte = self.model.shown, self.model.is_byte
        text = b"".join(map(shown.__getitem__, ids))
        try:
            if not self.control.isdisjoint(ids):
                raise UnicodeError
            text.decode()
        except UnicodeError:
            text = b"".join(self._runs(ids))
        # The space that encoding puts before a text goes again, unless bytes of ids stand before it.
        first = next((k for k in ids if shown[k] or is_byte[k]), None)
        return text[1:] if first is not None and not is_byte[first] and shown[first][:1] == b" " and shown[first] != UNKNOWN.encode() else text

    def _runs(self, ids: list[int]):
        for single, run in groupby(ids, key=self.model.is_byte.__getitem__):
            run = b"".join(map(self.model.shown.__getitem__, run))
            if not single:
                yield run
                continue
            at = 0
            while at < len(run):
                for n in range(1, 5):
                    try:
                        run[at : at + n].decode()
                    except UnicodeDecodeError:
                        continue
                    yield run[at : at + n]
                    break
                else:
                    n = 1
                    yield "�".encode()
                at += n


def worker_encoder(shared: dict) -> PieceEncoder:
    """The encoder of a broadcast model, kept in the broadcast value for all tasks of a Python worker."""
    if "encoder" not in shared:
        shared["encoder"] = PieceEncoder(shared["model"])
    return shared["encoder"]


def sliced(column, limit: int = SLICE):
    """(first row, texts) of runs of whole texts of an Arrow string column, about ``limit`` bytes each; null is empty."""
    first, text, size = 0, [], 0
    for k in range(len(column)):
        text += text_list(column, k, 1)
        size += len(text[-1])
        if size >= limit:
            yield first, text
            first, text, size = k + 1, [], 0
    if text:
        yield first, text


def _encoded(model, rest: list[str], names: list[str], decoded: bool):
    def run(batches):
        import pyarrow as pa

        encoder = worker_encoder(model.value)
        for batch in batches:
            for first, texts in sliced(batch.column(0)):
                ids, ends = encoder.encode(texts)
                columns = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
                if decoded:
                    columns.append(pa.array([encoder.decode(ids[a:b].tolist()).decode() for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    return freed(run)


def _shared_model(docs: DataFrame, model: PieceModel):
    return docs.sparkSession.sparkContext.broadcast({"model": model})


def encode_pieces(docs: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` without the text, with its ids as the model's library gives them (null and empty texts: none).

    With ``decoded_col`` also the text that the ids decode to, in the same pass.  Columns
    of ``docs`` with the added names give way; repeated rows are rows like others, and an
    empty table gives an empty one.  Texts are encoded whole, whatever their length.
    """
    names = [ids_col, *([decoded_col] if decoded_col else [])]
    rest = [c for c in docs.columns if c not in (text_col, *names)]
    kept = [F.col(f"`{c}`") for c in rest]
    added: dict[str, Column] = {ids_col: F.array().cast("array<int>")} | ({decoded_col: F.lit("")} if decoded_col else {})
    schema = docs.select(*kept).withColumns(added).schema
    return docs.select(F.col(f"`{text_col}`"), *kept).mapInArrow(_encoded(_shared_model(docs, model), rest, names, bool(decoded_col)), schema)


def decode_pieces(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null: null; null ids within a list take no part).

    Ids outside of the vocabulary raise an error.  A column named ``decoded_col`` gives way.
    """
    rest = [c for c in encoded.columns if c != decoded_col]
    at, shared = rest.index(ids_col), _shared_model(encoded, model)

    def run(batches):
        import pyarrow as pa

        encoder = worker_encoder(shared.value)
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                ids = batch.column(at)[k].as_py()
                texts.append(None if ids is None else encoder.decode([x for x in ids if x is not None]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*rest, decoded_col])

    kept = encoded.select(*(F.col(f"`{c}`") for c in rest))
    return kept.mapInArrow(freed(run), kept.withColumn(decoded_col, F.lit(None).cast("string")).schema)
