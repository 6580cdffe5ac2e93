"""Suffix-array dedup: every byte of a long string that occurs elsewhere goes.

A window of ``width`` bytes that occurs twice has the same anchor in both places (see
``anchors``), so windows are gathered by anchor: for each run of windows with one anchor a block
sends the bytes they span, once for each distinct content. A shard holds the contents of a class
of anchors and sorts their suffixes by induction (``induced_sort``), with common-prefix values;
neighbours that share ``width`` bytes are repeated windows. A content that a block holds twice, or
that two blocks hold, is repeated as a whole and stands in its shard once. The repeated windows go
back to the blocks, where documents are cut.

A window is anchored at its smallest 64-byte gram by hash, of those that start at a word, or lie
wholly inside a long word or a long stretch of white space; any window of ``width`` bytes has one.
The anchor is the gram with the bytes before or behind it that the window must hold as well.

Edge cases: a null or empty text, or one shorter than ``width`` bytes, loses nothing. Matches never
cross documents; matches within one count. Of a repeated text no copy stays: strings are judged on
the input. Rows with a null doc_id take part like others. Texts are read whole. An empty table
gives an empty result. Extra columns are ignored. Contexts under one anchor share a task, which
holds their bytes and the sort's arrays in memory; only the queues of the sort spill to a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.anchors import block_count, block_texts, shared_anchors
from tidemark.llm.arrays import Texts, distinct, mix
from tidemark.llm.induced_sort import join_strings, repeated_starts
from tidemark.llm.storage import Workspace

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
GRAM = 64


def stretches(flags: np.ndarray, least: int) -> np.ndarray:
    """Places from which ``least`` equal flags follow."""
    if not len(flags):
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(flags)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(flags))
    long = ends - starts >= least
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e - least + 1) for s, e in zip(starts[long], ends[long]))])


class Runs:
    """Runs of windows with one anchor: their documents, first and last starts, anchors and the
    hashes of the bytes they span."""

    def __init__(self, texts: Texts, width: int):
        data, offsets = texts.data, texts.offsets
        inside = (data != 32) & ((data < 9) | (data > 13))
        starts, _, _ = texts.words()
        grams = distinct(np.concatenate([starts, stretches(inside, GRAM)]))
        grams = grams[grams + GRAM <= len(data)]
        empty = np.zeros(0, np.int64)
        self.document = self.first = self.last = self.place = empty
        self.anchor = self.content = np.zeros(0, np.uint64)
        long = np.flatnonzero(np.diff(offsets) >= width)
        if not len(long) or not len(grams):
            return
        hashes = texts.range_hashes(grams, grams + GRAM)
        reach = width - GRAM
        # The grams in reach of a window change only where one enters or leaves, or a text starts.
        points = distinct(np.concatenate([grams, np.maximum(grams - reach, 0), offsets[:-1][long]]))
        owner = np.searchsorted(offsets, points, "right") - 1
        valid = points + width <= offsets[owner + 1]
        ends = np.append(points[1:], len(data)) - 1
        points, owner, ends = points[valid], owner[valid], ends[valid]
        ends = np.minimum(ends, offsets[owner + 1] - width)
        low, high = np.searchsorted(grams, points + 1), np.searchsorted(grams, points + reach, "right") - 1
        place = leftmost_minimum(hashes, low, high)
        new = np.ones(len(points), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (points[1:] != ends[:-1] + 1)
        begin = np.flatnonzero(new)
        document, first, place = owner[begin], points[begin], grams[place[begin]]
        last = ends[np.append(begin[1:], len(points)) - 1] if len(begin) else empty
        # A window holds ``reach // 2`` more bytes on one side of its gram at least: those with
        # fewer than that before it hold them behind it. The longer core is the anchor.
        half = reach // 2
        early, late = first < place - half, last >= place - half
        cut = np.maximum(place - half, 0)
        self.document = np.concatenate([document[early], document[late]])
        self.first = np.concatenate([first[early], np.maximum(first, cut)[late]])
        self.last = np.concatenate([np.minimum(last, cut - 1)[early], last[late]])
        self.place = np.concatenate([place[early], place[late]])
        start = np.concatenate([cut[early], place[late]])
        side = np.repeat(np.array([1, 2], np.uint64), [early.sum(), late.sum()])
        self.anchor = mix(texts.range_hashes(start, np.minimum(start + half + GRAM, len(data))) + side)
        self.content = mix(texts.range_hashes(self.first, self.last + width) + (self.place - self.first).astype(np.uint64))


def leftmost_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the smallest value in each range low..high; all ranges hold a place."""
    levels, longest = [np.arange(len(values))], int((high - low).max(initial=0)) + 1
    while 2 ** len(levels) <= longest:
        last, half = levels[-1], 2 ** (len(levels) - 1)
        a, b = last[:-half], last[half:]
        levels.append(np.where(values[b] < values[a], b, a))
    out = np.empty(len(low), np.int64)
    size = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in range(size.min(initial=0), size.max(initial=0) + 1):
        own = size == k
        a, b = levels[k][low[own]], levels[k][high[own] - 2**k + 1]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


def find_shared(shared: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(shared):
        return np.zeros(len(values), bool)
    return shared[np.minimum(np.searchsorted(shared, values), len(shared) - 1)] == values


def shard_repeats(contents: list[bytes], copied: np.ndarray, width: int, memory: int) -> list[list[int]]:
    """For each content the repeated window starts, as a flat list of first, end, first, end ..."""
    sizes = np.array([len(c) for c in contents]) - width + 1
    out: list[list[int]] = [[0, int(n)] for n in sizes]
    if copied.all():
        return out
    repeated = repeated_starts(contents, width, memory)
    _, starts = join_strings(contents)
    for i in np.flatnonzero(~copied):
        flags = np.zeros(sizes[i] + 2, np.int8)
        flags[1:-1] = repeated[starts[i] : starts[i] + sizes[i]]
        out[i] = np.flatnonzero(np.diff(flags)).tolist()
    return out


def remove_long_repeats(spark: SparkSession, docs: DataFrame, width: int = 400, memory: int = 256 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes kept, per document."""
    space = Workspace(spark, "suffix")
    # A block needs an id to be dealt by and sorted by; rows without one get theirs from the text.
    rows = docs.select(F.col("doc_id").cast("long").alias("real_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("real_id", F.xxhash64("text")))
    blocks = block_count(rows)
    shards = blocks
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)).cast("int")

    def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(texts, width)
        return runs.anchor, runs.document

    flags = shared_anchors(space, rows.select("doc_id", "text"), anchors, blocks, False)
    dealt = rows.withColumn("block", block)

    def contents(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        shared = distinct(own.column("a").to_numpy().view(np.uint64)) if own.num_rows else np.zeros(0, np.uint64)
        found: dict[tuple[int, int], list] = {}
        for run_texts in block_texts(texts):
            runs = Runs(run_texts, width)
            data = run_texts.data.tobytes()
            for i in np.flatnonzero(find_shared(shared, runs.anchor)).tolist():
                one = found.setdefault((int(runs.anchor[i]), int(runs.content[i])), [0, b""])
                if not one[0]:
                    one[1] = data[runs.first[i] : runs.last[i] + width]
                one[0] += 1
        keys = np.array(list(found), np.uint64).reshape(-1, 2)
        return pa.table({"shard": (keys[:, 0] % np.uint64(shards)).astype(np.int32), "a": keys[:, 0].view(np.int64), "c": keys[:, 1].view(np.int64), "block": np.full(len(keys), key[0].as_py(), np.int32), "n": pa.array([v[0] for v in found.values()], pa.int32()), "bytes": pa.array([v[1] for v in found.values()], pa.binary())})

    gathered = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(contents, "shard int, a long, c long, block int, n int, bytes binary")

    def sort_shard(rows_: pa.Table) -> pa.Table:
        where: dict[tuple[int, int], list[int]] = {}
        a, c, n = (rows_.column(x).to_numpy() for x in ("a", "c", "n"))
        for i, pair in enumerate(zip(a.tolist(), c.tolist())):
            where.setdefault(pair, []).append(i)
        first = [own[0] for own in where.values()]
        copied = np.array([n[own].sum() > 1 for own in where.values()])
        # An anchor with one content has nothing to compare it with.
        _, inverse, others = np.unique(a[first], return_inverse=True, return_counts=True)
        sorted_ones = np.flatnonzero(others[inverse] > 1)
        spans: list[list[int]] = [[]] * len(first)
        for i in np.flatnonzero((others[inverse] == 1) & copied):
            spans[i] = [0, len(rows_.column("bytes")[first[i]].as_py()) - width + 1]
        if len(sorted_ones):
            found = shard_repeats([rows_.column("bytes")[first[i]].as_py() for i in sorted_ones], copied[sorted_ones], width, memory)
            for i, own in zip(sorted_ones, found):
                spans[i] = own
        out = [(int(a[i]), int(c[i]), i, s) for own, s in zip(where.values(), spans) if s for i in own]
        at = pa.array([o[2] for o in out], pa.int64())
        return pa.table({"block": rows_.column("block").take(at), "a": pa.array([o[0] for o in out], pa.int64()), "c": pa.array([o[1] for o in out], pa.int64()), "spans": pa.array([o[3] for o in out], pa.list_(pa.int32()))})

    answers = gathered.groupBy("shard").applyInArrow(sort_shard, "block int, a long, c long, spans array<int>")
    answers = space.save(answers, "answers")

    def cut(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        known = {(a, c): spans for a, c, spans in zip(*(own.column(x).to_pylist() for x in ("a", "c", "spans")))}
        out = [row for run in block_texts(texts) for row in cut_run(run, width, known)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    known_rows = dealt.filter("real_id is not null").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT)
    unknown = dealt.filter("real_id is null").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT)
    return known_rows.unionByName(unknown.withColumn("doc_id", F.lit(None).cast("long")))


def cut_run(texts: Texts, width: int, known: dict[tuple[int, int], list[int]]) -> Iterator[tuple]:
    runs = Runs(texts, width)
    depth = np.zeros(len(texts.data) + 1, np.int32)
    firsts, ends = [], []
    for i, pair in enumerate(zip(runs.anchor.view(np.int64).tolist(), runs.content.view(np.int64).tolist())):
        if spans := known.get(pair):
            base = int(runs.first[i])
            firsts += [base + s for s in spans[::2]]
            ends += [base + e - 1 + width for e in spans[1::2]]
    np.add.at(depth, np.array(firsts, np.int64), 1)
    np.add.at(depth, np.array(ends, np.int64), -1)
    gone = np.cumsum(depth[:-1]) > 0
    for i, doc_id in enumerate(texts.ids.tolist()):
        own = slice(texts.offsets[i], texts.offsets[i + 1])
        flags = gone[own]
        spans = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
        yield doc_id, len(flags), int(flags.sum()), spans, hashlib.sha256(texts.data[own][~flags].tobytes()).hexdigest()
