"""Picking documents out by id without moving the texts of the others.

Ids are entered in a bit table of bounded size, which every task gets: ``BITS`` bits, in words of 64
of which only those with a bit set are rows. A document whose bit is not set is surely not among the
ids and stays where it is; the rest, the ids and a few by chance, are settled by an exact join. The
plan is the same at every size: as ids grow in number, more rows take the exact way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the table; its words are at most 2**20 rows of 16 bytes.
BITS = 1 << 26


def word_of(doc_id: str) -> Column:
    return F.shiftright(F.xxhash64(F.lit(11), doc_id).bitwiseAND(F.lit(BITS - 1)), 6)


def bit_of(doc_id: str) -> Column:
    return F.xxhash64(F.lit(11), doc_id).bitwiseAND(F.lit(63)).cast("int")


def bit_table(ids: DataFrame) -> DataFrame:
    """(word, bits) of the ids in ``doc_id``."""
    placed = ids.select(word_of("doc_id").alias("_word"), bit_of("doc_id").alias("_bit"))
    return placed.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, maybe): the rows of ``docs``, and whether they may be among the ids. Rows are structs here,
    so that their columns may have any name."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"))
    # At most BITS / 64 rows, whatever the input.
    met = rows.join(F.broadcast(bit_table(ids)), word_of("_id") == F.col("_word"), "left")
    return met.select("row", F.coalesce(F.getbit("_bits", bit_of("_id")) == 1, F.lit(False)).alias("maybe"))


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id, distinct)."""
    return marked(docs, ids).filter("maybe").select("row.*").join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The other rows, those with a null doc_id among them."""
    met = marked(docs, ids)
    settled = met.filter("maybe").select("row.*").join(ids.select("doc_id"), "doc_id", "left_anti")
    return met.filter("not maybe").select("row.*").unionByName(settled.select(*docs.columns))
