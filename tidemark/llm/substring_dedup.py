"""Substring dedup: relative Lempel-Ziv parsing against every indexed reference block.

Documents are dealt into reference blocks by a hash of their id. A block is indexed by its windows
of ``width`` words: window hash to the smallest document and position in the block. The entries of
all blocks meet by hash, so that each block learns which of its windows start in a smaller
document anywhere, and where first. Each document is then parsed greedily from left to right: a
factor starts at a window that the reference holds and grows for as long as the next word
continues the same reference position. Where it ends, the windows that straddle its boundary are
looked up by themselves and start factors of their own, which may overlap it: a passage pieced
together from several reference documents, or of which a later part has another first place, is
found too. A factor is at least ``width`` words long, and the factors' extents are what goes.
``factors`` returns them with their references.

A window is known by 64 bits. Two different windows of n in all that are compared share them with a
probability of n * n / 2**65, some 1 in 40 for 10**9 windows that have shared anchors.

Windows without a shared anchor (see ``anchors``) are never indexed. A block sends each window
once however many of its documents hold it, so a passage in a third of all documents is a row per
block, not per document.

Edge cases: a null or empty text, and one shorter than ``width`` words, loses nothing. Rows with
one doc_id are no duplicates of each other. Rows with a null doc_id come back whole and are no
reference. Of repeated texts the one with the smallest doc_id stays. Texts are read whole. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.anchors import block_count, block_texts, known_ids, shared_anchors, with_block
from tidemark.llm.arrays import Texts, distinct, inside_documents, window_hashes, window_minima
from tidemark.llm.storage import Workspace
from tidemark.llm.words import SPACE


class Windows:
    """Word windows of a run of documents, with the anchor of each."""

    def __init__(self, texts: Texts, width: int, gram: int):
        self.starts, self.ends, self.firsts = texts.words()
        words = texts.range_hashes(self.starts, self.ends)
        grams = window_hashes(words, gram)
        _, places = window_minima(grams, width - gram + 1)
        self.inside = inside_documents(self.firsts, len(places), width)
        self.anchor_places = places
        self.anchors = grams[places] if len(places) else grams[:0]
        self.hashes = window_hashes(words, width)
        self.documents = np.repeat(np.arange(len(texts.ids)), np.diff(self.firsts))

    def anchor_occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        places = distinct(self.anchor_places[self.inside])
        at = np.searchsorted(self.anchor_places, places) if len(places) else places
        # anchor places never decrease from window to window, so the first hit has the anchor
        return (self.anchors[at] if len(places) else self.anchors[:0]), self.documents[places]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of the windows whose anchor is in the sorted array ``shared``."""
        if not len(shared) or not len(self.anchors):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(shared, self.anchors), len(shared) - 1)
        return np.flatnonzero(self.inside & (shared[at] == self.anchors))


def block_index(docs: pa.Table, flags: pa.Table, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Sorted window hashes of a block, the smallest document and position of each, and the runs."""
    shared = distinct(flags.column("a").to_numpy().view(np.uint64)) if flags.num_rows else np.zeros(0, np.uint64)
    runs, hashes, ids, positions = [], [], [], []
    for texts in block_texts(docs):
        windows = Windows(texts, width, gram)
        at = windows.candidates(shared)
        hashes.append(windows.hashes[at])
        ids.append(texts.ids[windows.documents[at]])
        positions.append(at - windows.firsts[windows.documents[at]])
        runs.append((texts, windows, at))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    h, d, p = np.concatenate(hashes), np.concatenate(ids), np.concatenate(positions)
    order = np.lexsort((p, d, h))
    h, d, p = h[order], d[order], p[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h[first], d[first], p[first], runs


def parse_document(at: np.ndarray, source: np.ndarray, position: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of one document: starts, ends, reference documents and positions there.

    ``at`` are the window starts within the document that the reference holds, with the reference
    document and position of each. A window that continues the reference of the one before it
    extends its factor by a word; any other starts a factor.
    """
    goes_on = np.zeros(len(at), bool)
    if len(at) > 1:
        goes_on[1:] = (np.diff(at) == 1) & (source[1:] == source[:-1]) & (position[1:] == position[:-1] + 1)
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last] + width, source[first], position[first]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a factor."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth)[:n] > 0


@dataclass
class Parsed:
    """A run of documents with its windows and, for each document, its factors."""

    texts: Texts
    windows: Windows
    factors: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def parsed_blocks(space: Workspace, known: DataFrame, width: int, gram: int, report: Callable[[Parsed], Iterator[tuple]], columns: dict[str, tuple[str, pa.DataType]], blocks: int | None = None) -> DataFrame:
    """What ``report`` makes of each run of parsed documents, a table of ``columns``."""
    blocks = blocks or block_count(known)
    flags = shared_anchors(space, known, lambda texts: Windows(texts, width, gram).anchor_occurrences(), blocks, True)
    dealt = with_block(known, blocks)

    def entries(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        h, d, p, _ = block_index(texts, own, width, gram)
        return pa.table({"h": h.view(np.int64), "doc_id": d, "pos": p.astype(np.int32), "block": np.full(len(h), key[0].as_py(), np.int32)})

    indexed = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(entries, "h long, doc_id long, pos int, block int")
    first = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h"))
    met = indexed.withColumn("first", first).filter(F.col("first.doc_id") < F.col("doc_id"))
    answers = space.save(met.select("block", "h", F.col("first.doc_id").alias("ref"), F.col("first.pos").alias("ref_pos")), "answers")
    both = flags.select("block", F.col("a").alias("h"), F.lit(None).cast("long").alias("ref"), F.lit(None).cast("int").alias("ref_pos")).unionByName(answers)

    def parse(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        is_flag = own.column("ref").is_null()
        h, d, p, runs = block_index(texts, own.filter(is_flag).select(["h"]).rename_columns(["a"]), width, gram)
        found = own.filter(own.column("ref").is_valid())
        if found.num_rows:
            at = np.searchsorted(h, found.column("h").to_numpy().view(np.uint64))
            d[at], p[at] = found.column("ref").to_numpy(), found.column("ref_pos").to_numpy()
        out = [row for run in runs for row in report(parse_run(*run, h, d, p, width))]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [()] * len(columns), columns.values())], names=list(columns))

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(parse, ", ".join(f"{c} {kind}" for c, (kind, _) in columns.items()))


def parse_run(texts: Texts, windows: Windows, at: np.ndarray, h: np.ndarray, d: np.ndarray, p: np.ndarray, width: int) -> Parsed:
    entry = np.searchsorted(h, windows.hashes[at])
    owner = windows.documents[at]
    repeated = d[entry] < texts.ids[owner] if len(at) else np.zeros(0, bool)
    at, entry, owner = at[repeated], entry[repeated], owner[repeated]
    bounds = np.searchsorted(owner, np.arange(len(texts.ids) + 1))
    own = [slice(bounds[i], bounds[i + 1]) for i in range(len(texts.ids))]
    return Parsed(texts, windows, [parse_document(at[x] - windows.firsts[i], d[entry[x]], p[entry[x]], width) for i, x in enumerate(own)])


def cut(parsed: Parsed) -> Iterator[tuple]:
    """doc_id, words, words removed, factors and the digest of the words kept."""
    texts, windows, data = parsed.texts, parsed.windows, parsed.texts.data.tobytes()
    for i, doc_id in enumerate(texts.ids.tolist()):
        low, high = windows.firsts[i], windows.firsts[i + 1]
        starts, ends, _, _ = parsed.factors[i]
        cover = covered(starts, ends, int(high - low))
        kept = low + np.flatnonzero(~cover)
        text = b" ".join([data[s:e] for s, e in zip(windows.starts[kept].tolist(), windows.ends[kept].tolist())])
        yield doc_id, int(high - low), int(cover.sum()), len(starts), hashlib.sha256(text).hexdigest()


def listed(parsed: Parsed) -> Iterator[tuple]:
    """doc_id, first word, word behind the last, reference document and first word there."""
    for doc_id, own in zip(parsed.texts.ids.tolist(), parsed.factors):
        for row in zip(*(x.tolist() for x in own)):
            yield doc_id, *row


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 13, gram: int = 6, blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors and the digest of the words kept, per document."""
    long, string = ("long", pa.int64()), ("string", pa.string())
    columns = {"doc_id": long, "n_words": long, "n_removed": long, "n_factors": long, "kept_sha256": string}
    parsed = parsed_blocks(Workspace(spark, "substring"), known_ids(docs), width, gram, cut, columns, blocks)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), lambda w: w != "")
    zero = F.lit(0).cast("long")
    unknown = docs.filter("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.size(words).cast("long").alias("n_words"), zero.alias("n_removed"), zero.alias("n_factors"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256")
    )
    return parsed.unionByName(unknown)


def factors(spark: SparkSession, docs: DataFrame, width: int = 13, gram: int = 6, blocks: int | None = None) -> DataFrame:
    """The duplicate spans: doc_id, start and end in words, ref and ref_start."""
    columns = {c: ("long", pa.int64()) for c in ("doc_id", "start", "end", "ref", "ref_start")}
    return parsed_blocks(Workspace(spark, "substring"), known_ids(docs), width, gram, listed, columns, blocks)
