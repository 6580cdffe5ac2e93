"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget. As many complete epochs as fit come first; the rest of the budget
is filled by a weighted sample without replacement, in the order of exponential keys divided by a
document's quality weight. The order within a source is never sorted in one task: keys are cut
into buckets that keep their order, bucket totals are prefix-summed, and only rows inside a bucket
are sorted. A key's bucket is its place in the distribution that the source's own weights give
(weights within a quarter of a power of two count as one), so buckets are even.

Edge cases: a null or empty text has size 0 and is never taken. A null source is a source of its
own, last in order. Rows without a doc_id draw their keys by a hash of the text. Ties of keys go by
doc_id and size. Repeated rows, and rows that share a doc_id, are documents of their own; of equal
rows at the edge of a budget, as many are taken as the budget holds. An empty table, or one without
words, gives targets of 0. The same seed gives the same mix. Columns beyond doc_id, text and source
pass through ``mix_documents``, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.storage import Workspace
from tidemark.llm.words import word_count

SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


#: Sources that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def identity(seed: int) -> Column:
    """A hash of the id, or of the text where there is none."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("text", F.lit(seed + 1)))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def exponential_key(drawn: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn from a hash, so reruns agree."""
    u = (drawn.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Budgets by filling to a common level: a source is capped if the level at which it reaches
    its cap can be paid for. Works on one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*", (F.col("cap") / F.col("weight")).alias("level"),
        F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)).alias("cap_upto"),
        (F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, 0))).alias("weight_above"),
        F.sum("source_size").over(Window.partitionBy()).cast("double").alias("total"),
    )
    rows = rows.withColumn("capped", F.col("cap_upto") + F.col("level") * F.col("weight_above") <= F.col("total"))
    everything = Window.partitionBy()
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / open_weight))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0))
    return rows.select("source", "source_size", "n_docs", "target", epochs.cast("long").alias("epochs"))


def mix_sizes(
    spark: SparkSession,
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = SOURCE_WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 17,
    bucket_rows: int = 2_000,
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each row of ``docs``.

    ``quality`` gives one weight (``doc_id, weight``) for some documents; others weigh 1.
    """
    space = Workspace(spark, "mixing")
    return space.finish(placed_sizes(space, docs, quality, weights, most, seed, bucket_rows).select("doc_id", "size", "source_size", "target", "copies", "taken"))


def placed_sizes(space: Workspace, docs: DataFrame, quality: DataFrame | None, weights: tuple[float, ...], most: int, seed: int, bucket_rows: int) -> DataFrame:
    """``mix_sizes`` with the identity and the source key of each row."""
    sized = docs.select("doc_id", "source", identity(seed).alias("identity"), word_count("text").alias("size"))
    if quality is not None:
        sized = space.save(sized, "sizes").join(quality.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
        sized = sized.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    sized = sized.withColumn("key", exponential_key(F.col("identity"), F.col("weight")))
    sized = space.save(sized.withColumn("source_key", source_key()), "sized")
    space.drop("sizes")

    totals = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = space.save(source_targets(totals, weights, most), "targets")
    rate = F.pow(2.0, F.round(4 * F.log2("weight")) / 4)
    rates = sized.groupBy("source_key", rate.alias("rate")).agg(F.count("*").alias("n")).groupBy("source_key").agg(F.sum("n").alias("n_all"), F.sort_array(F.collect_list(F.struct("rate", "n"))).alias("rates"))
    rates = space.save(rates, "rates")
    reached = F.aggregate("rates", F.lit(0.0), lambda acc, r: acc + r["n"] * (1 - F.exp(-r["rate"] * F.col("key"))))
    bucket = F.floor(reached / F.col("n_all") * F.ceil(F.col("n_all") / bucket_rows)).cast("long")

    sized = sized.drop("source").join(F.broadcast(rates) if rates.count() <= MOST_BROADCAST else rates, "source_key").withColumn("bucket", bucket).drop("rates", "n_all")
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets.withColumn("source_key", source_key()), "source_key")
    offsets = space.save(offsets.select("source_key", "bucket", "offset", "source_size", "target", "epochs"), "offsets")

    inside = Window.partitionBy("source_key", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("upto", F.sum("size").over(inside))
    joined = summed.join(offsets, ["source_key", "bucket"])
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("offset") + F.col("upto") - F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(middle < rest, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "identity", "source_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: good documents come before others in the fractional epoch."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def mix_documents(
    spark: SparkSession, docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = SOURCE_WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, bucket_rows: int = 2_000
) -> DataFrame:
    """The documents of the mix, a row for each copy that it takes."""
    space = Workspace(spark, "mixed")
    keys = ["identity", "source_key", "size"]
    taken = placed_sizes(space, docs, quality, weights, most, seed, bucket_rows).groupBy(*keys)
    # Rows alike in all keys stand side by side in the order, so their copies differ at one place at most.
    taken = space.save(taken.agg(F.min("copies").alias("copies"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("more")).filter("copies + more > 0"), "taken")
    rows = docs.select(F.struct(*docs.columns).alias("row"), identity(seed).alias("identity"), source_key().alias("source_key"), word_count("text").alias("size"))
    # A row for each document: never broadcast, so that small inputs take the way of large ones.
    rows = rows.join(taken.hint("merge"), keys)
    alike = Window.partitionBy(*keys).orderBy(F.xxhash64("row.text", "row.doc_id"))
    edge = rows.filter("more > 0").withColumn("copies", F.col("copies") + (F.row_number().over(alike) <= F.col("more")).cast("long"))
    counted = rows.filter("more = 0").select("row", "copies").unionByName(edge.select("row", "copies")).filter("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
