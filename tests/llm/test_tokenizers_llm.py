"""Alignment and SentencePiece operators against their libraries and brute force."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest

from vecspark.llm import alignment, pieces, queries

ODD = [None, "", " ", "   ", "a", " a", "\n\n", "\t x\x00y\r\n", "▁", "a▁b", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "é𝄞​梦 的", "١٢٣ ½", "word " * 700, "x" * 3000, " " * 2000, "ab" * 1500, "don't they'll I'VE", "a  b\n \n c", "﻿a b\x85c"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(queries.piece_model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


def test_pieces_equal_the_library(model, library):
    rng = random.Random(3)
    letters = [*map(chr, range(256)), *"▁▁   abcthe\n梦的是", *(chr(rng.randrange(0x20, 0xD7FF)) for _ in range(300)), *(chr(rng.randrange(0x10000, 0x10FFFF)) for _ in range(40))]
    own = [piece.replace(pieces.SPACE, " ") for piece in model.ids]
    texts = [x or "" for x in ODD]
    for k in range(4000):
        source, n = [(letters, 30), (" \n▁ax", 60), (own, 12), ("abcdehinorst", 60)][k % 4]
        texts.append("".join(rng.choice(source) for _ in range(rng.randrange(n))))
    encoder = pieces.PieceEncoder(model)
    ids, ends = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode(texts)
    for n in (1, 7):  # few parts walk one by one
        ids, _ = pieces.PieceEncoder(model).encode(texts[-n:])
        assert ids.tolist() == [k for t in texts[-n:] for k in library.encode(t)]
    for k in range(6000):
        some = [rng.randrange(259) if rng.random() < 0.6 else rng.randrange(len(model.shown)) for _ in range(rng.randrange(9))]
        assert encoder.decode(some).decode() == library.decode(some), some


def test_remembered_parts_are_bounded(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_PARTS", 5)
    encoder = pieces.PieceEncoder(model)
    texts = ["the cat sat on a mat with many other words", "another cat " + "y" * 100, "the cat sat"]
    for _ in range(2):
        for text in texts:
            assert encoder.encode([text])[0].tolist() == library.encode(text)
    assert len(encoder.known) <= 5 and len(encoder.bounds) == len(encoder.known) + 1


def test_merging_of_pairs_by_histories(model):
    encoder, rng = pieces.PieceEncoder(model), random.Random(4)
    for _ in range(3000):
        left, right = rng.choice(model.usable), rng.choice(model.usable)
        assert encoder._stay_apart(left, right) == (pieces.merged(left + right, model.scores) == [left, right])


def test_encode_and_decode_tables(spark, model, library):
    rows = [(k, text, 7, "x") for k, text in enumerate(ODD)] + [(None, "same", None, None), (None, "same", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, `__text` string")
    found = pieces.encode_pieces(docs, model, decoded_col="decoded")
    got = [(r["doc_id"], list(r["ids"]), r["decoded"], r["__text"]) for r in found.collect()]
    want = [(k, library.encode(text or ""), library.decode(library.encode(text or "")), x) for k, text, _, x in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    again = pieces.decode_pieces(found.drop("decoded"), model)
    assert sorted(repr(r["decoded"]) for r in again.collect()) == sorted(repr(w[2]) for w in want)
    null = spark.createDataFrame([([28705, None, 13],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode_pieces(null, model).collect()] == ["\n", None, ""]
    assert pieces.encode_pieces(docs.limit(0), model).count() == 0
    with pytest.raises(Exception):
        pieces.load_model(public_tokenizers.path("byte_bpe_50k.json"))


def brute_alignment(rows, library):
    """The contract of the query, document by document."""
    import tokenizers

    side_a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    byte_of = {c: b for b, c in alignment.byte_letters().items()}
    found, held = [], Counter()
    for key, text in rows:
        if not text:
            found.append((key, [], [], []))
            continue
        a = [(k, bytes(byte_of[c] for c in side_a.id_to_token(k))) for k in side_a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in library.encode(text):
            piece = library.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if library.is_byte(k) else piece.replace("▁", " ").encode()))
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            found.append((key, [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for k, x in side:
                own.append((k, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, low = [], 0
        for x in spans[0]:
            while spans[1][low][2] <= x[1]:
                low += 1
            links += [(x[0], y[0]) for y in spans[1][low : low + x[2] - x[1] + 1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for k, _, end in spans[side]:
                groups[bisect_left(cuts, end)][side].append(k)
        found.append((key, spans, links, groups))
        held.update(set(links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for key, spans, links, groups in found:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        n = [len(x) for x in spans] or [0, 0]
        out.append((key, *n, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha(text) if groups else "", groups))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 10])
def test_alignment_equals_brute_force(spark, library, sent):
    rng = random.Random(8)
    texts = [*(x if x is None else x[:400] for x in ODD), *("".join(rng.choice("abcdeé ▁\n 12,.'") for _ in range(rng.randrange(80))) for _ in range(60)), "the same text", "the same text"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n_a string").repartition(3)
    sides = queries.alignment_sides()
    want = brute_alignment(rows, library)
    got = {tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, sides, sent_pairs=sent).collect()}
    assert got == {w[:-1] for w in want}
    groups = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in alignment.token_groups(docs, sides).collect()}
    assert groups == {w[0]: w[-1] for w in want}
    assert alignment.align(docs.limit(0), sides, sent_pairs=sent).count() == 0


def test_queries_equal_brute_force_on_whole_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, sf).collect()}
    assert got == {w[:-1] for w in brute_alignment(docs, library)}
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {tuple(r[c] for c in names) for r in queries.op13_sentencepiece(spark, sf).collect()}
    ids = {k: library.encode(t or "") for k, t in docs}
    assert got == {(k, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for k, x in ids.items()}
