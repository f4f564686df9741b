"""Repair of the structure of conversations at the least cost, by the Four-Russians method.

A conversation is one symbol per row: who speaks, and whether the row must go or counts
more.  Its repair is a shortest path through four states (nothing yet, after a system
turn, after a user turn, after an assistant turn).  The costs to finish from each state
make a vector; without its smallest entry only a few vectors exist (any two states differ
by a few edits), so tables of what each block of symbols makes of each vector are worked
out once.  Blocks are looked up from the last to the first; then every block is expanded
again, backward from the vector behind it, and read forward, taking the edit whose letter
is the smallest of the cheapest ones: so ties go to the least whole audit.

Rows are sorted over range partitions.  A conversation that lies inside one chunk is
repaired by the task that reads it.  One of any size is cut into chunks of bounded size;
a chunk is a map of the few vectors and of the four states, and only these maps meet in
one task, chunk by chunk.  The hash of a repaired text has to go through its bytes in
order, so the chunks' repaired texts stream through one task for each conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, stored

#: Fixed values of the contract: costs of the edits, and of a row left in that ends too early.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.  A repair ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where the next user or assistant turn leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Symbols: 0 must go; 1 to 4 are rows of system, user, assistant and others; 5 to 8 the same, ending too early.
SYMBOLS, BLOCK = 9, 3
#: Rows and letters of a chunk.
CHUNK_ROWS, CHUNK_TEXT = 4096, 1 << 20
NAMES = {USER: "user", ASSISTANT: "assistant"}


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row."""
    out = [("D", DELETE, state)]
    if symbol:
        who, extra = (symbol - 1) % 4, CUT_SHORT * (symbol > 4)
        if who == 0 and state == START:
            out.append(("K", extra, SYSTEM))
        if who in (1, 2) and NEXT[state] == (USER, ASSISTANT)[who - 1]:
            out.append(("K", extra, NEXT[state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def inserted(costs: list[int]) -> list[int]:
    """Costs to finish, when turns may be put in first (three in a row reach every state)."""
    costs = list(costs)
    for _ in range(3):
        for state, to in NEXT.items():
            costs[state] = min(costs[state], INSERT + costs[to])
    return costs


def before_row(costs: list[int], symbol: int) -> list[int]:
    """Costs to finish before a row, from those behind it."""
    return inserted([min(cost + costs[to] for _, cost, to in edits(state, symbol)) for state in range(4)])


def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """The costs above the smallest, and the smallest."""
    least = min(costs)
    return tuple(c - least for c in costs), least


#: Costs to finish behind the last row.
FINISH = tuple(inserted([0 if s in ENDS else INSERT * 9 for s in range(4)]))


@lru_cache(1)
def tables():
    """(vectors, next vector, cost and next states) by (vector behind, block) for all blocks of 0 to ``BLOCK`` symbols.

    A block is its symbols as digits, the last one lowest.  Vectors are all that follow
    from ``FINISH``, which is number 0.
    """
    vectors, number, one, paid = [FINISH], {FINISH: 0}, [], []
    while len(one) < len(vectors):
        found = [normal(before_row(list(vectors[len(one)]), symbol)) for symbol in range(SYMBOLS)]
        for vector, _ in found:
            if number.setdefault(vector, len(vectors)) == len(vectors):
                vectors.append(vector)
        one.append([number[v] for v, _ in found])
        paid.append([c for _, c in found])
    one, paid = np.array(one), np.array(paid)
    to, price = [np.arange(len(vectors))[:, None]], [np.zeros((len(vectors), 1), np.int64)]
    for _ in range(BLOCK):  # one more symbol before the block
        price.append((price[-1][:, None, :] + paid[to[-1]].transpose(0, 2, 1)).reshape(len(vectors), -1))
        to.append(one[to[-1]].transpose(0, 2, 1).reshape(len(vectors), -1))
    return vectors, to, price


def blocks_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(size, number) of the blocks of a chunk; the first may be shorter."""
    rest = len(symbols) % BLOCK
    digits = symbols[rest:].reshape(-1, BLOCK).astype(np.int64) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    first = [(rest, int(symbols[:rest].astype(np.int64) @ SYMBOLS ** np.arange(rest - 1, -1, -1)))] if rest else []
    return first + [(BLOCK, k) for k in digits.tolist()]


@lru_cache(1 << 17)
def expanded(vector: int, size: int, block: int, state: int) -> tuple[str, int]:
    """The least audit of the cheapest ways from ``state`` through a block with a vector behind it, and where it ends."""
    symbols = [block // SYMBOLS**k % SYMBOLS for k in range(size)]  # the last one first
    costs = [list(tables()[0][vector])]
    for symbol in symbols:
        costs.append(before_row(costs[-1], symbol))
    audit = ""
    for k in range(size - 1, -1, -1):
        here, behind = costs[k + 1], costs[k]
        while True:
            ways = [(letter, to) for letter, cost, to in edits(state, symbols[k]) if cost + behind[to] == here[state]]
            if INSERT + here[NEXT[state]] == here[state]:
                ways.append(("I", NEXT[state]))
            letter, state = min(ways)
            audit += letter
            if letter != "I":
                break
    return audit, state


def repaired(symbols: np.ndarray, state: int = START, vector: int = 0) -> tuple[str, int]:
    """The least audit of the cheapest ways through a chunk from ``state``, and the state behind it.

    ``vector`` is the number of the costs to finish behind the chunk.
    """
    _, to, _ = tables()
    blocks, behind = blocks_of(symbols), []
    for size, block in reversed(blocks):
        behind.append(vector)
        vector = int(to[size][vector, block])
    audit = []
    for (size, block), vector in zip(blocks, reversed(behind)):
        part, state = expanded(vector, size, block, state)
        audit.append(part)
    return "".join(audit), state


def chunk_maps(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """What a chunk makes of any vector behind it: the vector before it, the cost taken off, and the states behind it by state before."""
    vectors, to, price = tables()
    blocks, at, taken, behind = blocks_of(symbols), np.arange(len(vectors)), np.zeros(len(vectors), np.int64), []
    for size, block in reversed(blocks):
        behind.append(at)
        taken = taken + price[size][at, block]
        at = to[size][at, block]
    states = [[s for s in range(4)] for _ in vectors]
    for (size, block), numbers in zip(blocks, reversed(behind)):
        states = [[expanded(v, size, block, s)[1] for s in row] for v, row in zip(numbers.tolist(), states)]
    return at.tolist(), taken.tolist(), [s for row in states for s in row]


def audit_cost(symbols: np.ndarray, vector: int = 0, state: int = START) -> int:
    """The least cost of a chunk from ``state`` to the end that ``vector`` stands for."""
    vectors, to, price = tables()
    taken = 0
    for size, block in reversed(blocks_of(symbols)):
        taken += int(price[size][vector, block])
        vector = int(to[size][vector, block])
    return taken + vectors[vector][state]


def closing(state: int) -> list[int]:
    """The states of the turns that are put in behind the last row."""
    out = []
    while state not in ENDS:
        state = NEXT[state]
        out.append(state)
    return out


def lines(audit: str, symbols: np.ndarray, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The turns that an audit leaves, as ``role:text``."""
    out, k = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:")
            continue
        if letter == "K":
            state = SYSTEM if symbols[k] in (1, 5) else NEXT[state]
            out.append(f"{roles[k]}:{texts[k]}")
        elif letter == "R":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[k]}")
        k += 1
    return out


# --- rows ------------------------------------------------------------------------------

BLANK_CHARS = "\\x20\\x09-\\x0D"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, there): the rows after the contract's damage by crc32 of ``conv:turn``.

    A dropped row stays with ``there`` false, so that no conversation is lost.  Null roles
    and texts, and null ids and turns within the key, are one space.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    key = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    out = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), key.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return out.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), times.alias("times"))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of (conv, turn, role, text, there) with their number and fault: 0 none, 1 blank, 2 duplicate, 3 ends too early.

    Equal rows are counted first.  Only roles and texts that come in more than one turn are
    looked up for the turn in which they come first.
    """
    place = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    rows = rows.withColumn("text", F.when(F.col("there"), F.col("text")).otherwise("")).withColumn("role", F.when(F.col("there"), F.col("role")).otherwise(""))
    rows = rows.groupBy("conv", "turn", "role", "text", "there").agg(F.sum("times").alias("times"))
    rows = rows.withColumn("key", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    again = rows.where("there").groupBy("conv", "key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = again.select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    found = rows.join(again, rows["conv"].eqNullSafe(again["c"]) & (rows["key"] == again["k"]), "left")
    last = F.regexp_extract("text", f"([^{BLANK_CHARS}])[{BLANK_CHARS}]*\\z", 1)
    later = F.col("first").isNotNull() & (F.col("first") < place)
    fault = F.when(last == "", 1).when(later, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return found.select("conv", "turn", "role", "text", "there", "times", fault.alias("fault"))


_PIECE = (
    "part int, k int, whole boolean, symbols binary, roles array<string>, texts array<string>, first_role string, last_role string, turns long, low long, high long, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, to array<int>, price array<long>, ends array<int>"
)
LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.symbols, self.roles, self.texts, self.size = conv, bytearray(), [], [], 0
        self.first = self.last = None
        self.turns, self.low, self.high = 0, None, None
        self.faults, self.illegal = [0, 0, 0, 0], 0

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.faults[fault] += 1
        gone = fault in (1, 2)
        self.symbols.append(0 if gone else 1 + ("sua".find(initial) % 4 if initial else 3) + 4 * (fault == 3))
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.size += 0 if gone else len(text)

    def row(self, part: int, k: int, whole: bool) -> tuple:
        symbols = np.frombuffer(bytes(self.symbols), np.uint8)
        numbers = (self.first, self.last, self.turns, self.low, self.high, *self.faults[1:], self.illegal)
        if not whole:
            return (self.conv, part, k, False, bytes(self.symbols), self.roles, self.texts, *numbers, None, None, None, *chunk_maps(symbols))
        audit, state = repaired(symbols)
        ends = closing(state)
        text = "\n".join(lines(audit, symbols, self.roles, self.texts, START) + [f"{NAMES[s]}:" for s in ends])
        return (self.conv, part, k, True, None, None, None, *numbers, audit_cost(symbols), audit + "I" * len(ends), hashlib.sha256(text.encode()).hexdigest(), None, None, None)


def _chunked(schema, rows_limit: int, text_limit: int):
    """Sorted rows to chunks; conversations that surely lie within the partition and one chunk are repaired here."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        out, size = [], 0
        chunk, opens, cut = None, True, False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                columns = [batch.column(c).slice(at, 512).to_pylist() for c in range(7)]
                for conv, turn, role, text, there, times, fault in zip(*columns):
                    if chunk is None or chunk.conv != conv:
                        if chunk is not None:
                            out.append(chunk.row(part, k, not opens and not cut))
                            k, opens, size = k + 1, False, size + chunk.size
                        chunk, cut = _Chunk(conv), False
                    for n in range(times if there else 0):
                        if len(chunk.symbols) >= rows_limit or chunk.size >= text_limit:
                            out.append(chunk.row(part, k, False))
                            k, cut, size = k + 1, True, size + chunk.size
                            chunk = _Chunk(conv)
                        chunk.add(turn, role, text, fault if n == 0 or fault == 1 else 2)
                    if size >= 4 * text_limit or len(out) >= 4096:
                        yield _batch(out, schema)
                        out, size = [], 0
        if chunk is not None:
            out.append(chunk.row(part, k, False))  # it may go on in the next partition
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), own)], schema=own)


def _streamed(rows: DataFrame, order: list[Column], added: str, each) -> DataFrame:
    """Rows of each conversation, in order, through ``each(conv)``, an object with ``add(row)`` and ``end()``, which give rows.

    A conversation's rows stream through one task, one after another.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([rows.schema["conv"], *_parse_datatype_string(added).fields])

    def run(batches):
        now, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if now is None or now.conv != row["conv"]:
                        out += now.end() if now else []
                        now = each(row["conv"])
                    out += now.add(row)
                if len(out) >= 256:
                    yield _batch(out, schema)
                    out = []
        out += now.end() if now else []
        if out:
            yield _batch(out, schema)

    return rows.sortWithinPartitions("conv", *order).mapInArrow(freed(run), schema)


class _Backward:
    """The vector behind each chunk, from the last chunk to the first."""

    def __init__(self, conv):
        self.conv, self.vector = conv, 0

    def add(self, row):
        behind, self.vector = self.vector, row["to"][self.vector]
        return [(self.conv, row["part"], row["k"], behind, row["price"][behind], tables()[0][self.vector][START], row["ends"][4 * behind : 4 * behind + 4])]

    def end(self):
        return []


class _Forward:
    """The state before each chunk, from the first chunk to the last."""

    def __init__(self, conv):
        self.conv, self.state = conv, None

    def add(self, row):
        first = self.state is None
        state = START if first else self.state
        self.state = row["ends"][state]
        return [(self.conv, row["part"], row["k"], row["behind"], state, row["price"] + (row["rest"] if first else 0))]

    def end(self):
        return []


class _Whole:
    """All numbers of a conversation from its chunks' in order."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.lines, self.state = conv, hashlib.sha256(), [], 0, START
        self.sums, self.last, self.turns, self.low, self.high = [0] * 5, None, 0, None, None

    def _line(self, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + text).encode())
        self.lines += 1

    def add(self, row):
        self.audit.append(row["audit"])
        if row["n_lines"]:
            self._line(row["lines"])
        self.state = row["state"]
        self.sums = [a + row[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "price"))]
        if row["first_role"] is not None:
            self.sums[3] += self.last is not None and self.last + row["first_role"] not in LEGAL
            self.last = row["last_role"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        return []

    def end(self):
        for state in closing(self.state):
            self._line(f"{NAMES[state]}:")
            self.audit.append("I")
        blank, duplicate, truncated, illegal, cost = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [(self.conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(self.audit), self.hash.hexdigest())]


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _pieced(pieces: DataFrame) -> DataFrame:
    """Results of conversations in several chunks, or at the ends of partitions."""
    narrow = pieces.select("conv", "part", "k", "to", "price", "ends").repartition("conv")
    behind = _streamed(narrow, [F.desc("part"), F.desc("k")], "part int, k int, behind int, price long, rest long, ends array<int>", _Backward)
    before = _streamed(behind, [F.col("part"), F.col("k")], "part int, k int, behind int, state int, price long", _Forward)
    known = pieces.drop("to", "ends", "cost", "audit", "price").join(before.drop("conv"), ["part", "k"])
    names = ["conv", "part", "k", "first_role", "last_role", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "price"]
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*known.select(*names).schema.fields, *_parse_datatype_string("audit string, lines string, n_lines int, state int").fields])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                symbols = np.frombuffer(row["symbols"], np.uint8)
                audit, state = repaired(symbols, row["state"], row["behind"])
                text = lines(audit, symbols, row["roles"], row["texts"], row["state"])
                yield _batch([(*(row[c] for c in names), audit, "\n".join(text), len(text), state)], schema)

    return _streamed(known.mapInArrow(freed(run), schema).repartition("conv"), [F.col("part"), F.col("k")], _RESULT, _Whole)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """One row for each conversation of ``rows`` (conv, turn, role, text, there, times): its faults and cheapest repair.

    ``times`` is how often a row stands, one after another; rows that are not ``there`` only
    name a conversation.  Rows go by turn (nulls first), those of one turn by role and text.
    The first of these faults counts: blank, duplicate (role and text seen earlier), truncated
    (its last letter is not one of ``.!?``).  Repairs keep or delete rows, change the role to
    user or assistant, or put empty turns in, so that an optional system turn and pairs of
    user and assistant are left; of equally cheap ones the least audit counts.  A null id is
    a conversation like others; without rows there are zeros, '' and the hash of ''; an empty
    table gives an empty one.

    The marked rows and the chunks stay in shared storage, as the result reads the latter.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    marked, _ = stored(_marked(rows))
    keys = ["conv", "turn", "role", "text", "there"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = StructType([marked.schema["conv"], *_parse_datatype_string(_PIECE).fields])
    chunks, _ = stored(sorted_rows.select(*keys, "times", "fault").mapInArrow(freed(_chunked(schema, chunk_rows, chunk_text)), schema))
    gaps = F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).alias("gaps")
    done = chunks.where("whole").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return done.unionByName(_pieced(chunks.where("NOT whole")))
