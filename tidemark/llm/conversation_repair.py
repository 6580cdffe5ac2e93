"""Conversation structure repair: damaged rows, their faults, and the cheapest edits that mend them.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Positions between rows and
the four states of that pattern (nothing yet, after s, after u, after a) make a graph; keeping,
renaming or deleting a row and inserting an empty one are its arcs. Forward and backward minimum
costs identify all arcs of cheapest paths: an arc is tight if the costs up to it, of it and from it
on add up to the least. A traversal takes the frontier of all states reached and follows, of the
tight arcs that leave it, those of the least letter, so among cheapest edits the least in ASCII
order comes out. Cost vectors are kept less their minimum; few differ, so each step is made once
and looked up from then on.

In Spark, texts stand aside as 128-bit digests: equal rows are merged with their number, faults
come from grouped minima, rows are put in order by ranges (so a long conversation lies in many
tasks), and each task writes blocks of at most ``BLOCK`` rows as a byte a row. Only these bytes of
a conversation meet in one row, as its edits must, being one value of the result. Letters go back
to the blocks and from there to the texts, which are shuffled once and hashed as they stream by:
a SHA-256 over a conversation is one sequence by its nature, so its texts pass one task, in
batches.

Edge cases: a null role or text is one space, and so are a null conv_id or turn in the digest that
picks the damage. A null conv_id is a conversation of its own; a null turn comes first. Rows of one
turn are ordered by role, then by digest of the text; equal rows stay equal. An initial other than
s, u and a fits nowhere and is renamed or deleted. Texts are read whole. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.storage import Workspace

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 4096
DELETE, INSERT, RENAME, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 40
#: States: nothing yet, after s, after u, after a. What a row that is made or renamed leads to.
GENERATED = (2, 2, 3, 2)
FINAL = (0, 3)
#: Of a kept row by its initial (s, u, a, other): the state it leads to from each state, -1 for none.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
FITTING = {(0, 1), (1, 2), (2, 1)}
#: A row is a byte: three times its initial, and 0 if nothing is wrong, 1 truncated, 2 to be deleted.
FINE, CUT_SHORT, GONE = 0, 1, 2


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (2 of repeated rows), one row in twenty dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"), fate.alias("fate"))
    return own.filter("fate > 0").drop("fate")


def digest() -> Column:
    return F.unhex(F.md5("text"))


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equality on all the columns, nulls equal to each other."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def faults(rows: DataFrame) -> DataFrame:
    """A row for each distinct row: conv_id, turn, role, digest, n (how often it stands), blank and
    duplicate (how many of these are), truncated, and its byte."""
    ended = F.rtrim("text", F.lit(SPACES))
    flagged = rows.select("conv_id", "turn", "role", digest().alias("digest"), "copies", (ended == "").alias("blank"), F.right(ended, F.lit(1)).isin(".", "!", "?").alias("closed"))
    merged = flagged.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("closed").alias("closed"))
    firsts = merged.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    met = merged.join(firsts, same(merged, firsts, "conv_id", "role", "digest")).select(merged["*"], F.col("first.turn").eqNullSafe(F.col("turn")).alias("is_first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    state = F.when(F.col("blank") | ~F.col("is_first"), GONE).when(F.col("closed"), FINE).otherwise(CUT_SHORT)
    return met.select(
        "conv_id", "turn", "role", "digest", "n", (3 * kind + state).alias("symbol"), F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("is_first").cast("long")).alias("duplicate"), (state == CUT_SHORT).cast("long").alias("truncated"),
    )


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation, in order: where they stand, their bytes, and their keys."""
    names = ["part", "block", "conv_id", "symbols", "turns", "roles", "digests", "ns"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    part, made, held = TaskContext.get().partitionId(), 0, []

    def close(runs: list[list[tuple]]) -> pa.RecordBatch:
        nonlocal made
        rows = []
        for run in runs:
            symbols = b"".join(bytes([s]) + bytes([s - s % 3 + GONE]) * (n - 1) for *_, n, s in run)
            rows.append((part, made, run[0][0], symbols, *([r[i] for r in run] for i in (1, 2, 3, 4))))
            made += 1
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[0] != held[0][0] or len(held) >= most):
                done.append(held)
                held = []
            held.append(row)
        yield close(done)
    if held:
        yield close([held])


Vector = tuple[int, int, int, int]


def lowered(costs: list[int]) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs), least


@lru_cache(None)
def row_arcs(symbol: int) -> tuple[tuple[str, int, int, int], ...]:
    """Arcs across a row: letter, state before, state after, cost."""
    kind, state = divmod(symbol, 3)
    arcs = [("D", s, s, DELETE) for s in range(4)]
    if state != GONE:
        extra = TRUNCATED * (state == CUT_SHORT)
        arcs += [("K", s, KEPT[kind][s], extra) for s in range(4) if KEPT[kind][s] >= 0]
        arcs += [("R", s, GENERATED[s], RENAME + extra) for s in range(4)]
    return tuple(arcs)


def inserting(costs: list[int], backward: bool) -> list[int]:
    """Costs with any number of insertions at the place."""
    for _ in range(3):
        for s, t in enumerate(GENERATED):
            if backward:
                costs[s] = min(costs[s], INSERT + costs[t])
            else:
                costs[t] = min(costs[t], INSERT + costs[s])
    return costs


@lru_cache(None)
def stepped(costs: Vector, symbol: int, backward: bool) -> tuple[Vector, int]:
    """Least costs on the other side of a row, and what they were lowered by."""
    after = [NEVER] * 4
    for _, s, t, cost in row_arcs(symbol):
        here, there = (t, s) if backward else (s, t)
        after[there] = min(after[there], costs[here] + cost)
    return lowered(inserting(after, backward))


@lru_cache(None)
def crossed(frontier: frozenset, symbol: int, forward: Vector, backward: Vector, beyond: Vector) -> tuple[str, frozenset]:
    """Letters up to and with that of a row, and the states behind it; ``symbol`` -1 is the end.

    ``forward`` and ``backward`` are the costs before the row, ``beyond`` the backward ones behind it.
    """
    letters, here = "", min(f + b for f, b in zip(forward, backward))
    across = min((forward[s] + cost + beyond[t] for _, s, t, cost in row_arcs(symbol)), default=0) if symbol >= 0 else 0
    while True:
        if symbol < 0 and any(s in FINAL and forward[s] + backward[s] == here and backward[s] == 0 for s in frontier):
            return letters, frontier
        tight = [("I", t) for s, t in enumerate(GENERATED) if s in frontier and forward[s] + INSERT + backward[t] == here]
        if symbol >= 0:
            tight += [(letter, t) for letter, s, t, cost in row_arcs(symbol) if s in frontier and forward[s] + cost + beyond[t] == across]
        letter = min(x for x, _ in tight)
        frontier = frozenset(t for x, t in tight if x == letter)
        letters += letter
        if letter != "I":
            return letters, frontier


def cheapest_edits(symbols: bytes) -> tuple[int, list[str]]:
    """Least cost, and the letters of the least of the cheapest edits: those up to each row, then
    those behind the last one."""
    forward, total = [lowered(inserting([0, NEVER, NEVER, NEVER], False))[0]], 0
    for symbol in symbols:
        costs, more = stepped(forward[-1], symbol, False)
        forward.append(costs)
        total += more
    ends, more = lowered(inserting([0 if s in FINAL else NEVER for s in range(4)], True))
    total += min(f + b for f, b in zip(forward[-1], ends))
    backward = [ends] * (len(symbols) + 1)
    for i in range(len(symbols) - 1, -1, -1):
        backward[i] = stepped(backward[i + 1], symbols[i], True)[0]
    frontier, letters = frozenset([0]), []
    for i, symbol in enumerate(symbols):
        some, frontier = crossed(frontier, symbol, forward[i], backward[i], backward[i + 1])
        letters.append(some)
    letters.append(crossed(frontier, -1, forward[-1], ends, ends)[0])
    return total, letters


REPAIRED = "conv_id long, illegal long, cost long, audit string, pieces array<struct<part:int,block:long,letters:array<string>>>"


def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation (its blocks in order): bad neighbours, cost, edits, and the edits by block."""
    piece = pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int64()), ("letters", pa.list_(pa.string()))]))
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist()):
            symbols = b"".join(p["symbols"] for p in parts)
            cost, letters = cheapest_edits(symbols)
            kinds = [s // 3 for s in symbols]
            illegal = sum(pair not in FITTING for pair in zip(kinds, kinds[1:]))
            letters[-2:] = ["".join(letters[-2:])]
            pieces, at = [], 0
            for p in parts:
                pieces.append({"part": p["part"], "block": p["block"], "letters": letters[at : at + len(p["symbols"])]})
                at += len(p["symbols"])
            rows.append((conv, illegal, cost, "".join(letters), pieces))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), piece]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "illegal", "cost", "audit", "pieces"])


def edits_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct row of a block with the letters of all its copies."""
    names = ["conv_id", "turn", "role", "digest", "edits"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        out = []
        for conv, turns, roles, digests, ns, letters in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "roles", "digests", "ns", "letters"))):
            at = 0
            for turn, role, key, n in zip(turns, roles, digests, ns):
                out.append((conv, turn, role, key, "".join(letters[at : at + n])))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


class Rewriter:
    """The rows of a repaired conversation, from its texts in order, each preceded by its edits."""

    def __init__(self):
        self.last, self.key, self.edits = "", None, ""

    def lines(self, row: tuple) -> Iterator[tuple[str, str]]:
        """(role, text) of the rows that come out when (turn, role, digest, edits, text) goes in."""
        *key, edits, text = row
        if edits is not None:
            self.key, self.edits = key, edits
            return
        if key != self.key:
            return  # a copy whose edits have been carried out
        self.key = None
        for letter in self.edits:
            if letter == "D":
                continue
            made = "assistant" if self.last == "u" else "user"
            role = key[1] if letter == "K" else made
            self.last = role[:1]
            yield role, "" if letter == "I" else text


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of rows in order of conversation and place."""
    conv, rewriter, sha, first = None, None, None, True
    for batch in batches:
        out = []
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rewriter is None or own != conv:
                if rewriter is not None:
                    out.append((conv, sha.hexdigest()))
                conv, rewriter, sha, first = own, Rewriter(), hashlib.sha256(), True
            for role, text in rewriter.lines(row):
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
    if rewriter is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])


def in_order(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, edits, text): texts dealt by conversation, each key's edits before them."""
    texts = rows.select("conv_id", "turn", "role", digest().alias("digest"), F.lit(None).cast("string").alias("edits"), "text")
    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(texts)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", F.col("edits").desc_nulls_last())


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, place, role, text) of rows in order of conversation and place."""
    conv, rewriter, place = None, None, 0
    for batch in batches:
        out = []
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rewriter is None or own != conv:
                conv, rewriter, place = own, Rewriter(), 0
            for role, text in rewriter.lines(row):
                out.append((conv, place, role, text))
                place += 1
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", "turn", "role", "text"])


class ConversationRepair:
    """Faults, edits and repaired rows of (conv_id, turn, role, text, copies), as ``damaged`` gives them."""

    def __init__(self, spark: SparkSession, rows: DataFrame, block: int = BLOCK):
        self.rows, space = rows, Workspace(spark, "repair")
        self.space = space
        self.faults = space.save(faults(rows), "faults")
        order = ["conv_id", "turn", "role", "digest"]
        ordered = self.faults.select(*order, "n", "symbol").repartitionByRange(*order).sortWithinPartitions(*order)
        shape = "part int, block long, conv_id long, symbols binary, turns array<long>, roles array<string>, digests array<binary>, ns array<long>"
        cut = space.save(ordered.mapInArrow(lambda batches: blocks(batches, block), shape), "blocks")
        whole = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", "symbols"))).alias("blocks"))
        self.repairs = space.save(whole.mapInArrow(repair, REPAIRED), "repairs")
        pieces = self.repairs.select(F.explode("pieces").alias("p")).select("p.part", "p.block", "p.letters")
        self.edits = cut.join(pieces, ["part", "block"]).mapInArrow(edits_of_rows, "conv_id long, turn long, role string, digest binary, edits string")

    def conversations(self) -> DataFrame:
        """(conv_id, turn, role, text): the repaired rows, numbered from 0."""
        return in_order(self.rows, self.edits).mapInArrow(repaired_rows, "conv_id long, turn long, role string, text string")

    def audits(self, ids: DataFrame) -> DataFrame:
        """A row for each distinct conv_id of ``ids``: gaps, faults, edits and the repaired rows' digest."""
        turns = self.faults.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        hashes = self.space.save(in_order(self.rows, self.edits).mapInArrow(hashed, "conv_id long, repaired_sha256 string"), "hashes")
        out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        for more in (counts, self.repairs.drop("pieces"), hashes):
            out = out.join(more, same(out, more, "conv_id"), "left").drop(more["conv_id"])
        zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        blank = F.lit(hashlib.sha256(b"").hexdigest())
        return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", blank)})


def repair_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Damages the rows, as ``damaged`` says, and returns what repairing them takes."""
    return ConversationRepair(spark, damaged(rows)).audits(rows)
