"""From raw documents to token ids: five stages, each an operator over all that its predecessor kept.

Every stage is written as Parquet in the session's shared folder and read again, so a lost executor
costs one stage at most. All but the last return the columns of ``documents``, extra ones included,
whatever their names. Whole texts are read, an empty table gives an empty table, and repeated rows
are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import byte_bpe, jaccard_join, mixing, secrets, sifting, toxicity
from tidemark.llm.storage import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; learns from the labels not held out.

    Null and empty texts, and null ids, are scored like others. Equal distances go to the smaller
    example. Without labels of both kinds every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(spark, docs, labels.select("doc_id", F.col("toxic").alias("label")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    A null or empty text is near nothing and stays; so do rows with a null id. Rows that repeat the
    id that stays, stay with it; all rows of an id that goes, go.
    """
    classes = jaccard_join.near_duplicate_classes(spark, docs)
    others = classes.filter("doc_id != component_id").select("doc_id").distinct()
    return sifting.without_ids(docs, others)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kinds; n_chars follows the text. A null text stays null, and so does its n_chars."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row for each copy that the mix takes.

    Texts without words are never taken. A null source is one of its own, last in order; rows with a
    null id draw their place by their text. Of equal rows at the edge of a budget as many are taken
    as it holds.
    """
    weights = mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix_documents(spark, docs, weights)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, four bytes each) with the digests of the round trip; a null or empty
    text has none. Null ids stay null."""
    return byte_bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_class),
    ("secret_scans", redact),
    ("source_mixing", mix),
    ("byte_bpe", tokenize),
]

#: Neither nearest neighbours nor byte-pair merges can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
