"""SimHash near-duplicates: 64-bit fingerprints that differ in few bits, found by deletion variants.

A fingerprint is cut into ``parts`` segments, so few that of two fingerprints within the bound one
segment differs in one bit at most (two segments for three bits). Each segment is indexed once for
each of its bits with that bit left out; fingerprints that share a variant are candidates, and a
bit count verifies them. Candidates never become pairs of a list: a variant with two fingerprints
is one pair, and a longer list gives the edges of a forest that spans its links.

A list in which all fingerprints have the same bit at the place left out holds pairs of equal
segments only; one place of each segment stands for those, and the others drop out unless they hold
both bits. Lists longer than ``LONGEST_LIST`` are indexed once more, by variants of halves of the
segments that are left: what shares both variants agrees in all but 18 bits, which bounds a list by
2**18 fingerprints whatever the input. Inside a list a fingerprint looks for neighbours among the
members, or, where that is less work, tries each mask of bits that may differ.

Copies share a fingerprint and are one row from the start; a fingerprint carries the smallest
doc_id of its rows. Rows that share a doc_id are one document, so their fingerprints are joined.

Edge cases: texts without words (null ones too) have fingerprint zero and link like any other.
Fewer words than ``width`` are one shingle. A row with a null doc_id takes part and gets the
smallest doc_id that its fingerprint leads to, or null. Texts are read whole. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.arrays import give_back
from tidemark.llm.components import connected_components
from tidemark.llm.storage import Workspace

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles that are counted at a time.
CHUNK = 1 << 14
LONGEST_LIST = 4096
BITS = 64


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """The bits that are set in over half of the shingles' hashes, shingles counted as often as they stand."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        some = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())]
        hashes = np.array(some, "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the fingerprint as a signed long, a row for each row."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_buffer().to_pybytes() if text.is_valid else b"", width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, "doc_id long, fp long")


def spanning_links(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that join what is joined by links of at most ``most`` bits among distinct members."""
    members = np.sort(members)
    differ = int(np.bitwise_or.reduce(members ^ members[0]))
    free = np.array([1 << i for i in range(BITS) if differ >> i & 1], np.uint64)
    by_mask = sum(comb(len(free), k) for k in range(1, most + 1)) < len(members)
    if by_mask:
        masks = np.concatenate([np.bitwise_or.reduce(free[np.array(list(combinations(range(len(free)), k)), np.int64).reshape(-1, k)], axis=1) for k in range(1, most + 1)])
    open_, edges = np.ones(len(members), bool), []
    for seed in range(len(members)):
        if not open_[seed]:
            continue
        open_[seed] = False
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            if by_mask:
                asked = members[at] ^ masks
                place = np.minimum(np.searchsorted(members, asked), len(members) - 1)
                near = place[(members[place] == asked) & open_[place]]
            else:
                left = np.flatnonzero(open_)
                near = left[np.bitwise_count(members[left] ^ members[at]) <= most]
            open_[near] = False
            frontier.extend(near.tolist())
            edges.extend((int(members[at]), int(members[other])) for other in near)
    return edges


def forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The forest of each list, from rows that are sorted by the list's key (all columns but ``fp``).
    At most one list waits for its end."""

    def closed(columns: list[np.ndarray], stop: int, starts: np.ndarray) -> pa.RecordBatch:
        fps = columns[-1][:stop].view(np.uint64)
        edges = [e for part in np.split(fps, starts[1:]) if len(part) > 1 for e in spanning_links(part, most)]
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(held, columns)] if held else columns
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)) + 1
        if len(new):
            yield closed(columns, new[-1], np.append(0, new[:-1]))
            columns = [c[new[-1] :] for c in columns]
        held = columns
    if held:
        yield closed(held, len(held[0]), np.zeros(1, np.int64))
    give_back()


class SimHashJoin:
    def __init__(self, spark: SparkSession, most: int, longest: int):
        if not 1 <= most <= 5:
            raise ValueError("variants with one bit left out serve bounds from 1 to 5")
        # The fewest parts of which one must differ in a bit at most.
        self.parts = most // 2 + 1
        self.most, self.longest = most, longest
        self.space = Workspace(spark, "simhash")

    def variants(self, rows: DataFrame, segments: list[tuple[int, int]], keys: list[str]) -> DataFrame:
        """A row for each segment (first bit, bits) and bit of it: the place left out, what the rest
        of the segment holds, and whether the bit is set."""
        signed = lambda x: x - (1 << BITS) if x >> BITS - 1 else x
        shapes = [F.struct(F.lit(bit).alias("place"), F.lit(signed(((1 << size) - 1 << start) & ~(1 << bit))).alias("mask")) for start, size in segments for bit in range(start, start + size)]
        shaped = rows.select("fp", *keys, F.explode(F.array(*shapes)).alias("v"))
        return shaped.select("fp", *keys, F.col("v.place").alias("place"), F.col("fp").bitwiseAND(F.col("v.mask")).alias("key"), F.getbit("fp", F.col("v.place")).alias("bit"))

    def lists(self, rows: DataFrame, keys: list[str], segments: list[tuple[int, int]], name: str) -> DataFrame:
        """Keys of lists that can hold a link, with their lengths and ends. The first place of a
        segment stands for pairs of equal segments."""
        own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.min("bit").alias("least"), F.max("bit").alias("greatest"))
        useful = F.col("place").isin([start for start, _ in segments]) | (F.col("least") < F.col("greatest"))
        return self.space.save(own.filter(useful & (F.col("n") > 1)).select(*keys, "n", "low", "high"), name)

    def within(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """(u, v): the forests of lists that are short enough to be read whole by a task."""
        most = self.most
        dealt = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(lambda batches: forests(batches, most), "u long, v long")

    def links(self, prints: DataFrame) -> DataFrame:
        """(u, v) of fingerprints that join what links join."""
        size, keys = -(-BITS // self.parts), ["place", "key"]
        segments = [(start, min(size, BITS - start)) for start in range(0, BITS, size)]
        rows = self.variants(prints, segments, [])
        lists = self.lists(rows, keys, segments, "lists")
        near = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= self.most
        ends = lists.filter(near).select(F.col("low").alias("u"), F.col("high").alias("v"))
        longer = rows.join(lists.filter(F.col("n").between(3, self.longest)).select(*keys), keys)
        out = self.space.save(ends.unionByName(self.within(longer, keys)).distinct(), "links")
        hot = self.space.save(rows.join(lists.filter(F.col("n") > self.longest).select(*keys), keys).select("fp", *keys), "hot")
        for start, size in segments:
            # What shares a variant of one segment spreads its other bits over halves of the others.
            others = [(a, b) for a, b in segments if a != start] or segments
            halves = [half for a, b in others for half in ((a, b // 2), (a + b // 2, b - b // 2))]
            outer = hot.filter(F.col("place").between(start, start + size - 1)).withColumnsRenamed({"place": "outer_place", "key": "outer_key"})
            inner, inner_keys = self.variants(outer, halves, ["outer_place", "outer_key"]), ["outer_place", "outer_key", *keys]
            met = inner.join(self.lists(inner, inner_keys, halves, f"lists-{start}").select(*inner_keys), inner_keys)
            out = out.unionByName(self.space.save(self.within(met, inner_keys).distinct(), f"links-{start}"))
        return out

    def run(self, docs: DataFrame, width: int) -> DataFrame:
        space = self.space
        rows = space.save(fingerprints(docs, width), "fingerprints")
        prints = space.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
        # Rows of one doc_id are one document.
        same = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("high")).filter("u != high").select("doc_id", "u")
        same = rows.join(same, "doc_id").filter("fp != u").select("u", F.col("fp").alias("v")).distinct()
        labels = connected_components(space, self.links(prints.select("fp")).unionByName(same), "components")
        placed = prints.join(labels.select(F.col("id").alias("fp"), "label"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
        smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
        known = space.save(placed.join(smallest, "label").select("fp", "component_id"), "known")
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        return space.finish(rows.join(known, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, most: int = 3, longest: int = LONGEST_LIST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links lead to."""
    return SimHashJoin(spark, most, longest).run(docs, width)
