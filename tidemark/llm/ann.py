"""Approximate nearest neighbours: a forest of random-projection trees.

The forest is fitted on a bounded sample (``sample_rows``, drawn by a hash of the id); each inner
node splits at the median of its sample along the line between two of its points. Every row is
then routed to one leaf of each tree. A query walks all trees through one shared priority queue,
nearest splitting planes first, until it has visited its budget of leaves. Leaf members and the
queries that visit the leaf meet in a grouped join; distances to the original vectors are exact,
in double precision, and each leaf sends at most ``k`` rows per query onwards.

How many leaves to visit is measured: within the sample, ``tuning_queries`` of its points are
searched for their true neighbours, and the budget is the smallest at which ``recall`` of them lie
in the leaves visited. Where the data have few dimensions of their own this is a small share of
the leaves; where they have many, as for independent random components, no forest can avoid a
large share, and the budget says so instead of losing neighbours.

Equal vectors are collapsed before the forest: at distance ties the smaller id wins, so the k + 1
smallest ids of a vector stand for all of its rows without loss, and a vector that a third of all
rows share is one row.

Edge cases: vectors that are null, zero, of another length than most of the sample, or hold null
or non-finite components take no part. A repeated (id, vector) row counts once. Where there are
fewer candidates than k, all come back. Below ``exact_rows`` vectors there is one leaf and the
search is exact. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import Workspace


@dataclass
class Forest:
    planes: list[np.ndarray]  # for each tree: inner nodes x dimensions
    offsets: list[np.ndarray]
    depth: int

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", vectors, self.planes[tree][node]) > self.offsets[tree][node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)

    def search(self, vector: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """The leaves to visit, over all trees by one priority queue.

        A node waits with the largest distance from the query to a plane on the wrong side of
        which it lies.
        """
        inner, found = 2**self.depth - 1, []
        margins = [p @ vector - o for p, o in zip(self.planes, self.offsets)]
        queue = [(0.0, tree, 0) for tree in range(len(self.planes))]
        while queue and len(found) < budget:
            bound, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree][node]
                near = 2 * node + 1 + (margin > 0)
                far = 4 * node + 3 - near
                heapq.heappush(queue, (max(bound, abs(margin)), tree, far))
                node = near
            found.append((tree, int(node - inner)))
        return found


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    rng, planes, offsets = np.random.default_rng(seed), [], []
    inner, width = 2**depth - 1, sample.shape[1]
    for _ in range(trees):
        plane, offset = np.zeros((inner, width)), np.zeros(inner)
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                direction = a - b
            else:
                direction = rng.standard_normal(width)
            norm = np.linalg.norm(direction)
            plane[node] = direction / norm if norm else np.eye(width)[node % width]
            along = sample[own] @ plane[node]
            offset[node] = np.median(along) if len(own) else 0.0
            members[2 * node + 1], members[2 * node + 2] = own[along <= offset[node]], own[along > offset[node]]
        planes.append(plane)
        offsets.append(offset)
    return Forest(planes, offsets, depth)


def tune_budget(forest: Forest, sample: np.ndarray, k: int, recall: float, queries: int, seed: int = 11) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours within the sample are reached."""
    trees, everything = len(forest.planes), len(forest.planes) * 2**forest.depth
    if forest.depth == 0:
        return 1
    leaf_of = np.stack([forest.leaves(sample, tree) for tree in range(trees)])
    visited_at: list[np.ndarray] = []
    for i in np.random.default_rng(seed).choice(len(sample), min(queries, len(sample)), replace=False):
        squares = np.square(sample - sample[i]).sum(1)
        squares[i] = np.inf
        near = np.argpartition(squares, min(k, len(squares) - 1))[:k]
        place = np.full((trees, 2**forest.depth), everything)
        for at, (tree, leaf) in enumerate(forest.search(sample[i], everything)):
            place[tree, leaf] = at
        visited_at.append(place[np.arange(trees)[:, None], leaf_of[:, near]].min(0))
    return int(np.quantile(np.concatenate(visited_at), recall, method="higher")) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def usable_vectors(rows: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    )


def collapse_equal(vectors: DataFrame, keep: int) -> DataFrame:
    """v and its ``keep`` smallest ids; ids are cut down within each batch before they are grouped."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            groups: dict[bytes, list] = {}
            for i, (own, v) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("v"))):
                key = np.asarray(v.values).tobytes()
                groups.setdefault(key, [i, set()])[1].add(own)
            first = pa.array([g[0] for g in groups.values()], pa.int64())
            ids = pa.array([sorted(g[1])[:keep] for g in groups.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("v").take(first), ids], ["v", "ids"])

    cut = vectors.mapInArrow(batches, "v array<double>, ids array<long>")
    merged = cut.groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select("v", F.slice(F.sort_array(F.array_distinct("ids")), 1, keep).alias("ids"))


def nearest_neighbours(
    spark: SparkSession,
    rows: DataFrame,
    every: int = 100,
    k: int = 10,
    trees: int = 6,
    leaf_rows: int = 1024,
    recall: float = 0.95,
    sample_rows: int = 100_000,
    tuning_queries: int = 100,
    exact_rows: int = 4096,
    query_block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id and score for the rows whose id is divisible by ``every``."""
    space = Workspace(spark, "ann")
    vectors = space.save(usable_vectors(rows), "vectors")
    unique = space.save(collapse_equal(vectors, k + 1).withColumn("own", F.col("ids")[0]), "unique")
    queries = vectors.filter(F.col("vec_id") % every == 0).distinct()
    result = "query_id long, rank int, vec_id long, score double"
    n = unique.count()
    if not n:
        return spark.createDataFrame([], result)

    width = unique.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()["width"]
    unique, queries = unique.filter(F.size("v") == width), queries.filter(F.size("v") == width)
    depth = 0 if n <= exact_rows else max(1, int(np.ceil(np.log2(n / leaf_rows))))
    share = min(1.0, sample_rows / n)
    sample = unique.filter(F.xxhash64("own", F.lit(3)).bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))
    points = _matrix(sample.orderBy("own").select("v").toArrow().column("v").combine_chunks(), width)
    fitted = fit_forest(points, trees if depth else 1, depth)
    budget = tune_budget(fitted, points, k, recall, tuning_queries)
    blocks = max(1, -(-queries.count() // query_block))
    forest = spark.sparkContext.broadcast(fitted)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _matrix(batch.column("v"), width)
            for tree in range(len(forest.value.planes)):
                leaf = forest.value.leaves(vs, tree)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vs), tree)), pa.array(leaf), batch.column("ids"), batch.column("v")], ["tree", "leaf", "ids", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _matrix(batch.column("v"), width)
            found = [(t, leaf, i) for i, v in enumerate(vs) for t, leaf in forest.value.search(v, budget)]
            tree, leaf, at = (pa.array([f[j] for f in found], pa.int64()) for j in range(3))
            yield pa.RecordBatch.from_arrays([tree, leaf, batch.column("vec_id").take(at), batch.column("v").take(at)], ["tree", "leaf", "query_id", "v"])

    members = unique.select("ids", "v").mapInArrow(route, "tree long, leaf long, ids array<long>, v array<double>")
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    visits = queries.mapInArrow(walk, "tree long, leaf long, query_id long, v array<double>")
    visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            q, m = (_matrix(t.column("v").combine_chunks(), width) for t in (asked, held))
            ids = held.column("ids").to_pylist()
            for query, v in zip(asked.column("query_id").to_pylist(), q):
                squares = np.square(m - v).sum(1)
                near = np.argpartition(squares, k)[: k + 1] if len(m) > k + 1 else np.arange(len(m))
                near = np.flatnonzero(squares <= squares[near].max())
                pairs = sorted((float(np.sqrt(squares[i])), x) for i in near for x in ids[i] if x != query)[:k]
                out += [(query, x, d) for d, x in pairs]
        return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("query_id", "vec_id", "score"), zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))})

    met = visits.groupBy("tree", "leaf", "block").cogroup(members.groupBy("tree", "leaf", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    # A pair found in several trees has one distance; the ten nearest of a query are few rows.
    found = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("near"))
    ranked = best.select("query_id", F.posexplode("near").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
