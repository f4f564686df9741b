"""Conversation repair against an exhaustive search, row by row."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from vecspark.llm import conversations as C
from vecspark.llm import queries


def least(symbols):
    """(cost, audit) of the cheapest repair with the least audit, by trying every edit everywhere."""

    @lru_cache(None)
    def best(k, state, put_in):
        options = [(0, "")] if k == len(symbols) and state in (0, 3) else []
        if put_in < 3:
            cost, audit = best(k, {0: 2, 1: 2, 2: 3, 3: 2}[state], put_in + 1)
            options.append((3 + cost, "I" + audit))
        if k < len(symbols):
            for letter, price, to in C.edits(state, symbols[k]):
                cost, audit = best(k + 1, to, 0)
                options.append((price + cost, letter + audit))
        return min(options, default=(10**9, ""))

    return best(0, 0, 0)


def test_tables_give_the_least_audit():
    rng = random.Random(1)
    for k in range(3000):
        symbols = tuple(rng.choice(range(9) if k % 2 else (0, 1, 2, 3)) for _ in range(rng.randrange(12)))
        own = np.array(symbols, np.uint8)
        audit, state = C.repaired(own)
        assert (C.audit_cost(own), audit + "I" * len(C.closing(state))) == least(symbols), symbols
        to, price, ends = C.chunk_maps(own)
        cut = rng.randrange(len(symbols) + 1)
        right = C.chunk_maps(own[cut:])
        left, middle = C.repaired(own[:cut], 0, right[0][0])
        assert left + C.repaired(own[cut:], middle)[0] == audit and price[0] + C.tables()[0][to[0]][0] == C.audit_cost(own) and ends[0] == state


def brute(rows):
    """The contract, conversation by conversation."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    out = set()
    white = " \t\n\x0b\x0c\r"
    for conv, members in groups.items():
        after = []
        for _, turn, role, text in members:
            show = lambda x: " " if x is None else str(x)
            role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, role, text in after:
            fault = 0 if not text.strip(white) else 1 if (role, text) in seen else 2 if text.strip(white)[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            symbols.append(0 if fault < 2 else 1 + ("sua".index(role[0]) if role[:1] and role[0] in "sua" else 3) + 4 * (fault == 2))
        cost, audit = least(tuple(symbols))
        state, k, lines = 0, 0, []
        for letter in audit:
            if letter == "I":
                state = {2: 3}.get(state, 2)
                lines.append(("user", "assistant")[state - 2] + ":")
                continue
            _, role, text = after[k]
            if letter in "KR":
                state = 1 if letter == "K" and role[0] == "s" else {2: 3}.get(state, 2)
                lines.append(f"{role if letter == 'K' else ('user', 'assistant')[state - 2]}:{text}")
            k += 1
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out.add((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def some_rows(seed=5, n=260):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = None if rng.random() < 0.03 else 7 if rng.random() < 0.35 else rng.randrange(8, 40)
        turn = None if rng.random() < 0.05 else rng.randrange(30) if rng.random() < 0.9 else rng.randrange(-5, 300)
        role = rng.choice(["user", "assistant", "system", "User", "tool", "", "u", None, "user", "assistant", "assistant"])
        text = rng.choice(["Yes.", "No!", "why?", "ok", "", " \n", None, "é.", "long " * 40 + ".", "a.\x0b ", ". .", "x"]) if rng.random() < 0.6 else f"t{rng.randrange(1000)}."
        rows.append((conv, turn, role, text))
    return rows + rows[:10] + [(99, 1, "user", "same.")] * 20 + [(98, t, "user", "same.") for t in range(15)]


@pytest.mark.parametrize("chunk", [(2, 1 << 20), (5, 30), (C.CHUNK_ROWS, C.CHUNK_TEXT)])
def test_repair_equals_brute_force(spark, chunk):
    rows = some_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS conv", "1 AS part", "2 AS times").repartition(3)
    got = {tuple(r[c] for c in NAMES) for r in C.repair(C.damaged(df), *chunk).collect()}
    assert got == brute(rows)
    assert C.repair(C.damaged(df.limit(0)), *chunk).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[c] for c in ["conv_id", *NAMES[1:]]) for r in queries.op12_conversation_repair(spark, sf).collect()}
    assert got == brute(rows)
