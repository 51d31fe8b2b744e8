"""Conversation structure repair: the cheapest edits that restore the order of roles.

A repaired conversation is empty, or an optional system turn and then user and assistant turns by turns.
Every row becomes one of nine symbols (four roles, whole or truncated, and "must go"). The cost of
finishing a conversation from each of the four states of its role order is a vector; without its least
entry only a handful of vectors exist, so the vectors before every block of ``BLOCK`` symbols are
tabulated once (Four Russians). A conversation is then priced from its end by one lookup a block. The
audit is traced from its start: each block is expanded backward from the vector behind it, and the
ASCII-least letter that stays on a cheapest path is taken, so ties are settled by whole conversations.

Two streams of sorted rows do the work. The first has no texts, only symbols, and gives a summary per
conversation; the second has the summary before the conversation's rows and applies its audit, holding
one Arrow batch of texts. Duplicates are found by aggregates and a join on a unique key before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\r\x0b\x0c"
#: Costs of edits, and what a truncated row costs on top unless it is deleted.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Symbols of a block.
BLOCK = 4

#: Role symbols; a truncated row's symbol is 4 higher, and MUST_GO is a blank or repeated row.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
MUST_GO, SYMBOLS = 8, 9
#: States: nothing written, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
#: The state after a role is kept in a state, where it fits.
FITS = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: The state after the one role that can be written in a state (user or assistant).
WRITTEN = (2, 2, 3, 2)
ROLE_OF_STATE = {2: "user", 3: "assistant"}

Vector = tuple[int, ...]


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of each way to treat a row, in ASCII order of letters."""
    ways = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED * (symbol // 4)
        if (kept := FITS[symbol % 4][state]) is not None:
            ways.append(("K", extra, kept))
        ways.append(("R", REROLE + extra, WRITTEN[state]))
    return ways


def with_inserts(costs: Iterable[int]) -> Vector:
    """Costs where any number of user and assistant turns may be inserted first."""
    v = list(costs)
    for _ in STATES:
        v = [min(v[q], INSERT + v[WRITTEN[q]]) for q in STATES]
    return tuple(v)


def before(symbol: int, after: Vector) -> Vector:
    """Costs in front of a symbol from the costs behind it."""
    return with_inserts(min(cost + after[q2] for _, cost, q2 in choices(symbol, q)) for q in STATES)


#: Behind the last row: a conversation may end empty or after an assistant turn.
END = with_inserts((0, 1 << 20, 1 << 20, 0))


@dataclass(frozen=True)
class BlockTables:
    """Normalised vectors, and the vector and cost in front of every symbol and block for each of them."""

    vectors: list[Vector]
    one: list[list[tuple[int, int]]]
    block: int
    nexts: np.ndarray
    costs: np.ndarray


def block_tables(block: int = BLOCK) -> BlockTables:
    """All normalised vectors that occur, by closure under symbols, and the tables over them."""
    vectors, number, one = [END], {END: 0}, []
    for v in vectors:  # grows while it is read
        row = []
        for symbol in range(SYMBOLS):
            found = before(symbol, v)
            least = min(found)
            normal = tuple(x - least for x in found)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            row.append((number[normal], least))
        one.append(row)
    step, cost = (np.array([[pair[i] for pair in row] for row in one]) for i in (0, 1))
    nexts, costs = step, cost
    for _ in range(block - 1):  # a further symbol in front: its number is the highest digit
        costs = np.concatenate([costs + cost[nexts, s] for s in range(SYMBOLS)], axis=1)
        nexts = np.concatenate([step[nexts, s] for s in range(SYMBOLS)], axis=1)
    return BlockTables(vectors, one, block, nexts, costs)


def expanded(tables: BlockTables, symbols: bytes, vector: int) -> list[tuple[int, int]]:
    """(vector, cost) in front of each of some symbols, from the vector behind them; last symbol first."""
    steps = []
    for symbol in reversed(symbols):
        vector, cost = tables.one[vector][symbol]
        steps.append((vector, cost))
    return steps


def traced(tables: BlockTables, symbols: bytes, behind: int, state: int) -> tuple[str, int]:
    """Least letters of a cheapest path through some symbols, and the state behind them."""
    steps = expanded(tables, symbols, behind)
    letters = []
    for i, symbol in enumerate(symbols):
        at, cost = steps[len(symbols) - 1 - i]
        here = tables.vectors[at]
        after = tables.vectors[steps[len(symbols) - 2 - i][0] if i + 1 < len(symbols) else behind]
        while True:
            ways = {letter: q for letter, c, q in choices(symbol, state) if c + after[q] == here[state] + cost}
            if INSERT + here[WRITTEN[state]] == here[state]:
                ways["I"] = WRITTEN[state]
            letter = min(ways)
            letters.append(letter)
            state = ways[letter]
            if letter != "I":
                break
    return "".join(letters), state


def cheapest_edits(tables: BlockTables, symbols: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair: one lookup a block from the end, then the trace."""
    size, whole = tables.block, len(symbols) - len(symbols) % tables.block
    tail = expanded(tables, symbols[whole:], 0)
    total = sum(cost for _, cost in tail)
    vector = tail[-1][0] if tail else 0
    digits = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, size).astype(np.int64)
    blocks = digits @ (SYMBOLS ** np.arange(size - 1, -1, -1))
    behind = np.empty(len(blocks), np.int32)
    for i in range(len(blocks) - 1, -1, -1):
        behind[i] = vector
        total += int(tables.costs[vector, blocks[i]])
        vector = int(tables.nexts[vector, blocks[i]])
    total += tables.vectors[vector][0]
    parts, state = [], 0
    for i, v in enumerate(behind):
        part, state = traced(tables, symbols[i * size : (i + 1) * size], int(v), state)
        parts.append(part)
    part, state = traced(tables, symbols[whole:], 0, state)
    parts.append(part)
    while END[state]:
        parts.append("I")
        state = WRITTEN[state]
    return total, "".join(parts)


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Reading:
    """What is counted while the rows of one conversation pass, in their order."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last_role = None

    def add(self, turn: int | None, code: int, first: bool, n: int) -> None:
        """``n`` equal rows; ``first`` if no row before them has their role and text."""
        role, fault = code % 4, code // 4
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        self.illegal += self.last_role is not None and (self.last_role, role) not in LEGAL
        self.illegal += n - 1  # no role may follow itself
        self.last_role = role
        if fault == 2:
            self.blank += n
            self.symbols += bytes([MUST_GO]) * n
        else:
            self.duplicate += n - first
            self.truncated += first and fault
            self.symbols += bytes([code]) * first + bytes([MUST_GO]) * (n - first)

    def summary(self, tables: BlockTables) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost, audit = cheapest_edits(tables, bytes(self.symbols))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _summaries(block: int, conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conv, turn, code, first, n), sorted: one summary per conversation; a null code is no row."""
    fields = [("conv", conv_type), *[(name, pa.int64()) for name in SUMMARY], ("audit", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, schema = block_tables(block), pa.schema(fields)
        conv, reading = None, None
        for batch in batches:
            done = []
            for key, turn, code, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reading is None or key != conv:
                    if reading is not None:
                        done.append((conv, *reading.summary(tables)))
                    conv, reading = key, Reading()
                if code is not None:
                    reading.add(turn, code, first, n)
            yield _batch(done, schema)
        if reading is not None:
            yield _batch([(conv, *reading.summary(tables))], schema)

    return run


class Editor:
    """Applies an audit to rows as they pass: gives (letter, role, text) of every turn that is written."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _written(self, letter: str, text: str) -> tuple[str, str, str]:
        self.state = WRITTEN[self.state]
        return letter, ROLE_OF_STATE[self.state], text

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._written("I", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = FITS["sua".index(role[0])][self.state]
            yield letter, role, text
        elif letter == "R":
            yield self._written(letter, text)


def _hashed(conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each summary with the digest of its conversation's repaired turns."""
    fields = [("conv", conv_type), *[(name, pa.int64()) for name in SUMMARY], ("audit", pa.string())]
    fields.append(("repaired_sha256", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        head, editor, digest, lead = None, None, None, b""

        def put(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal lead
            for _, role, text in turns:
                digest.update(lead + f"{role}:{text}".encode())
                lead = b"\n"

        def finished() -> tuple:
            put(editor.inserts())
            return (*head, digest.hexdigest())

        for batch in batches:
            done = []
            names = [f.name for f in schema][1:-2]
            sums = [batch.column(name).to_pylist() for name in names]
            plain = [batch.column(name).to_pylist() for name in ("conv", "is_row", "role", "text")]
            for i, (conv, is_row, role, text) in enumerate(zip(*plain, strict=True)):
                if is_row:
                    put(editor.row(role, text))
                else:
                    if editor is not None:
                        done.append(finished())
                    head, editor, digest, lead = (conv, *(s[i] for s in sums), text), Editor(text), hashlib.sha256(), b""
            yield _batch(done, schema)
        if editor is not None:
            yield _batch([finished()], schema)

    return run


def _turns(conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each turn of the repaired conversations."""
    fields = [("conv", conv_type), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        owner, editor, at = None, None, 0
        for batch in batches:
            out = []

            def put(turns: Iterator[tuple[str, str, str]], out: list = out) -> None:
                nonlocal at
                for letter, role, text in turns:
                    out.append((owner, at, letter, role, text))
                    at += 1

            plain = [batch.column(name).to_pylist() for name in ("conv", "is_row", "role", "text")]
            for conv, is_row, role, text in zip(*plain, strict=True):
                if is_row:
                    put(editor.row(role, text))
                else:
                    if editor is not None:
                        put(editor.inserts())
                    owner, editor, at = conv, Editor(text), 0
            yield _batch(out, schema)
        if editor is not None:
            yield _batch([(owner, at + i, *turn) for i, turn in enumerate(editor.inserts())], schema)

    return run


def _standard(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, h1, h2) with nulls as one space; the hashes stand for role and text."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    h1, h2 = F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")
    return rows.withColumns({"h1": h1, "h2": h2})


def row_code(role: Column, text: Column) -> Column:
    """Role symbol plus 4 for a truncated and 8 for a blank text."""
    initial = F.substring(role, 1, 1)
    symbol = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    content = F.rtrim(text, F.lit(SPACES))
    fault = F.when(content == "", 2).when(F.substring(content, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return symbol + 4 * fault


def _by_conversation(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


ROW_ORDER = (F.asc_nulls_first, "turn"), (F.asc, "h1"), (F.asc, "h2")


def _order() -> list[Column]:
    return [way(name) for way, name in ROW_ORDER]


def summaries(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Counts, cost and audit of every conversation: ``conv, gaps, ..., cost, audit``.

    Rows are taken by turn, nulls first; rows of one turn are taken in an order that depends on their
    role and text only. A null role or text counts as one space; rows without a conversation id are one
    conversation. Equal rows are aggregated before the sort. ``conversations`` may name further ids
    that have no rows: zeros and an empty audit. An empty table gives an empty result.
    """
    rows = _standard(turns, conv_col, turn_col, role_col, text_col)
    slim = rows.select("conv", "turn", "h1", "h2", row_code(F.col("role"), F.col("text")).alias("code"))
    distinct = slim.groupBy("conv", "turn", "h1", "h2").agg(F.first("code").alias("code"), F.count("*").alias("n"))
    # The turn at which a role and text is first seen; a null turn comes first.
    seen = F.min(F.struct(F.isnotnull("turn").alias("dated"), "turn")).alias("seen")
    firsts = distinct.groupBy("conv", "h1", "h2").agg(seen).select(
        F.col("conv").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("seen.turn").alias("_turn"),
        F.lit(True).alias("_first"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv", "turn")] + [F.col(c) == F.col(f"_{c}") for c in ("h1", "h2")]
    placed = distinct.join(firsts, same, "left").select(
        "conv", "turn", "h1", "h2", "code", F.coalesce("_first", F.lit(False)).alias("first"), "n"
    )
    if conversations is not None:
        ids = conversations.select(F.col(conv_col).alias("conv")).distinct()
        placed = placed.unionByName(ids, allowMissingColumns=True)
    streamed = _by_conversation(placed, *_order()).select("conv", "turn", "code", "first", "n")
    schema = T.StructType([placed.schema["conv"], *[T.StructField(n, T.LongType()) for n in SUMMARY]]).add("audit", "string")
    return streamed.mapInArrow(_summaries(block, _arrow_type(placed)), schema)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    kind = rows.schema["conv"].dataType.simpleString()
    if kind not in kinds:
        raise TypeError(f"conversation ids must be integers or strings, not {kind}")
    return kinds[kind]


def _audited(turns: DataFrame, found: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The summary of every conversation and then its rows, in the order the audit was made for."""
    rows = _standard(turns, *columns).withColumn("is_row", F.lit(True))
    heads = found.withColumn("is_row", F.lit(False)).withColumnRenamed("audit", "text")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return _by_conversation(both, F.asc("is_row"), *_order()).select("conv", "is_row", "role", "text", *SUMMARY)


def repair(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``summaries`` with ``repaired_sha256``, the digest of the repaired ``role:text`` lines.

    Other columns are not read, whatever their names. The digest reads a conversation from its start to
    its end, so one task streams each conversation, a batch of rows at a time.
    """
    columns = (conv_col, turn_col, role_col, text_col)
    found = summaries(turns, conversations, *columns, block)
    kind = found.schema["conv"]
    schema = T.StructType([*found.schema.fields]).add("repaired_sha256", "string")
    streamed = _audited(turns, found, columns).mapInArrow(_hashed(_arrow_type(found)), schema)
    return streamed.withColumnRenamed(kind.name, conv_col)


def repaired_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The turns of the repaired conversations: conversation, place, edit letter, role and text."""
    columns = (conv_col, turn_col, role_col, text_col)
    found = summaries(turns, None, *columns, block)
    schema = T.StructType([found.schema["conv"]]).add("at", T.LongType()).add("edit", "string")
    schema = schema.add("role", "string").add("text", "string")
    streamed = _audited(turns, found, columns).mapInArrow(_turns(_arrow_type(found)), schema)
    return streamed.withColumnRenamed("conv", conv_col)
