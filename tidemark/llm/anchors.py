"""Anchors: content-chosen positions that repeated passages share wherever they stand.

The anchor of a window is its smallest k-gram by hash, so equal windows have equal anchors. Text
whose anchors occur once in the corpus holds no repeated window and drops out here, which is most
of it. What remains is known for each block of documents: a block is a hash class of doc_id of a
few megabytes of text, the unit in which texts are indexed and parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import Texts, texts_of
from tidemark.llm.storage import Workspace

#: For each run of documents: the anchor hashes (one entry per occurrence) and the document places.
Anchors = Callable[[Texts], tuple[np.ndarray, np.ndarray]]
BLOCK_BYTES = 8 << 20


def known_ids(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.filter("doc_id is not null")


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def block_of(blocks: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)).cast("int")


def anchor_rows(docs: DataFrame, anchors: Anchors, blocks: int, across_documents: bool) -> DataFrame:
    """(a, block, low, high, n): a row for each anchor of a run of documents and their block, with
    its smallest and largest doc_id and its occurrences there."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, rows in texts_of(batch):
                found, places = anchors(texts)
                ids, block = texts.ids[places], rows.column("block").to_numpy()[places]
                order = np.lexsort((ids, block, found))
                found, ids, block = found[order], ids[order], block[order]
                first = np.ones(len(found), bool)
                first[1:] = (found[1:] != found[:-1]) | (block[1:] != block[:-1])
                starts = np.flatnonzero(first)
                if not len(starts):
                    continue
                ends = np.append(starts[1:], len(found))
                columns = {"a": found[starts].view(np.int64), "block": block[starts]}
                if across_documents:
                    columns |= {"low": ids[starts], "high": ids[ends - 1]}
                else:
                    columns |= {"n": (ends - starts).astype(np.int32)}
                yield pa.RecordBatch.from_pydict(columns)

    counted = "low long, high long" if across_documents else "n int"
    return with_block(docs, blocks).mapInArrow(occurrences, f"a long, block int, {counted}")


def shared_anchors(space: Workspace, docs: DataFrame, anchors: Anchors, blocks: int, across_documents: bool) -> DataFrame:
    """(block, a) for anchors that occur in two documents, or twice if not ``across_documents``.

    Where anchors are sparse (not ``across_documents``: byte anchors) their rows are kept and read
    twice; dense ones would fill the disk and are found twice instead.
    """
    rows = anchor_rows(docs, anchors, blocks, across_documents)
    if across_documents:
        shared = rows.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    else:
        rows = space.save(rows, "occurrences")
        shared = rows.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = space.save(shared.select("a"), "shared")
    flags = space.save(rows.select("block", "a").join(shared.hint("shuffle_hash"), "a", "left_semi").select("block", "a"), "flags")
    space.drop("occurrences", "shared")
    return flags


def with_block(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", block_of(blocks))


def block_texts(rows: pa.Table) -> Iterator[Texts]:
    """The documents of a block, in runs, in the order of their ids."""
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    ordered = rows.select(["doc_id", "text"]).take(pa.array(order))
    for batch in ordered.combine_chunks().to_batches():
        for texts, _ in texts_of(batch):
            yield texts
