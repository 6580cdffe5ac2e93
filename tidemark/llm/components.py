"""Connected components of a link table, by label minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import Workspace


def connected_components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(id, label): for each id in ``links`` (u, v) the smallest id it reaches.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    long chains shorten by half; every round is a table, and the driver sees one number of it.
    """
    both = space.save(links.select("u", "v").union(links.select("v", "u")).distinct(), f"{name}-edges")
    labels = space.save(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("label")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("id")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("lower"))
        target = labels.select(F.col("id").alias("lower"), F.col("label").alias("jump"))
        step += 1
        after = space.save(lower.join(target, "lower").select("id", F.least("lower", "jump").alias("label"), (F.least("lower", "jump") != F.col("label")).alias("moved")), f"{name}-{step}")
        moved = after.filter("moved").limit(1).count()
        space.drop(f"{name}-{step - 1}")
        labels = after.select("id", "label")
        if not moved:
            space.drop(f"{name}-edges")
            return labels
