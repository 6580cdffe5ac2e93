"""N-gram Jaccard join: size-aware, heavy-light.

Sets are the distinct word shingles of a text. Sets up to a boundary are light: pairs of them are
found by enumerating, for both sizes, all subsets of just the size that their overlap must have; a
shared subset is a link. Larger sets are heavy: they scan inverted lists of prefix tokens, the
fewest tokens of which two linked sets share one, together with the light sets near the boundary.
The boundary is the one of least cost, from the number of sets of each size, the subsets that a
size needs, and the measured length of the lists that light sets would scan.

Of a linked pair the smaller set has its shared token within the prefix that a partner of its own
size needs (it is indexed there), the larger one within the longer prefix for its smallest partner
(it probes with that). Tokens that are frequent in some part of the corpus come last in the order
of a prefix. A template that many texts share is therefore indexed only where it makes up so much
of them that they link.

Equal sets are one set throughout, so copies are never paired. Within a list, sets are first
compared with one leader for each band of sizes. Links found so far merge sets into components,
and what is left to compare is the pairs of a list in different components; lists that lie in one
component are done. So a large group of near copies costs a comparison for each member, and no
link between components is lost.

A candidate pair is ids first. It meets the bitmaps of its two sets, two to four bits for each
shingle: bits in which they differ are shingles in which the sets differ, so most pairs end there
without loss. Between components the bitmaps, folded to a few words, are compared within the join
of the lists, so that sets just short of the bound do not become pairs. Only the rest have their sets made anew from the texts and counted.

Sets are known by their identity, not by an id: rows that repeat a doc_id with other texts are sets
of their own, joined because they are one document.

Edge cases: a null or empty text has an empty set and is linked with nothing; a text of fewer than
``width`` words is one shingle. Repeated rows link like copies, and all rows of a doc_id that have a
set are one component. Rows with a null doc_id come back with a null component. Texts are read whole. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.anchors import known_ids
from tidemark.llm.arrays import Texts, give_back, inside_documents, mix, texts_of, window_hashes
from tidemark.llm.components import connected_components
from tidemark.llm.sifting import only_ids
from tidemark.llm.storage import Workspace

LARGEST_LIGHT = 16
#: Words of 64 bits that stand for a set inside the join of long lists.
SKETCH = 8
#: Bound of the broadcast order of frequent tokens (8 bytes each); others keep their hash order.
MOST_FREQUENT = 500_000


def is_among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a run: sorted distinct hashes, joined, and where each document's set starts."""
    starts, ends, firsts = texts.words()
    words = texts.range_hashes(starts, ends, lower=True)
    hashes = window_hashes(words, width)
    inside = np.flatnonzero(inside_documents(firsts, len(hashes), width))
    documents = np.repeat(np.arange(len(texts.ids)), np.diff(firsts))
    values, owner = hashes[inside], documents[inside]
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [window_hashes(words[firsts[i] : firsts[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short]
        values, owner = np.append(values, mix(np.array(whole, np.uint64))), np.append(owner, short)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(texts.ids) + 1))


def identities(values: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """Of each set, 128 bits that equal sets share: two sums of its elements' hashes."""
    sums = [np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt)))) for salt in (0x51, 0xA3D70A3D)]
    return [a.tobytes() + b.tobytes() for a, b in zip(*(s[firsts[1:]] - s[firsts[:-1]] for s in sums))]


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest overlap at which 100 * overlap >= percent * union for sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def probe_length(n: int, percent: int) -> int:
    """Tokens by which a set finds sets of its size or smaller."""
    return n - least_partner(n, percent) + 1 if n else 0


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of at least twice as many bits as tokens."""
    size = max(64 * SKETCH, 2 << (max(1, len(tokens)) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def sketch(bits: bytes) -> np.ndarray:
    """A bitmap folded to ``SKETCH`` words of 64 bits."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.int64).reshape(-1, SKETCH), axis=0)


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two bitmaps differ in no more bits than the sets may differ in elements."""
    if len(a) < len(b):
        a, b = b, a
    left, right = int.from_bytes(a), int.from_bytes(b)
    size = 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        left = (left >> size) | (left & ((1 << size) - 1))
    return (left ^ right).bit_count() <= n + m - 2 * least_overlap(n, m, percent)


def light_keys(tokens: np.ndarray, largest: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """128-bit hashes of the subsets that a light set enumerates, with the side it takes in each
    pair of sizes (0: the smaller, 1: the larger, 2: both are equal)."""
    n = len(tokens)
    for m in range(least_partner(n, percent), min(largest, 100 * n // percent) + 1):
        size, low, high = least_overlap(n, m, percent), min(n, m), max(n, m)
        if size > low:
            continue
        chosen = np.array(list(combinations(range(n), size)), np.int64)
        halves = []
        for factor in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
            keys = np.zeros(len(chosen), np.uint64)
            for column in range(size):
                keys = mix(keys * np.uint64(factor) + tokens[chosen[:, column]])
            halves.append(mix(keys + np.uint64(low * 1024 + high)).view(np.int64).tolist())
        side = 2 if n == m else int(n == high)
        for key, more in zip(*halves):
            yield key, more, side


def choose_boundary(sizes: dict[int, int], list_rows: float, percent: int) -> int:
    """The largest light size, of least estimated cost in rows handled.

    A light set costs the subsets it enumerates. A heavy one costs, for each prefix token, the row
    and the rows of the list that it meets.
    """
    best, chosen, saved = 0.0, 0, 0.0
    for n in range(1, LARGEST_LIGHT + 1):
        subsets = sum(math.comb(n, least_overlap(n, m, percent)) for m in range(least_partner(n, percent), 100 * n // percent + 1) if least_overlap(n, m, percent) <= min(n, m))
        saved += sizes.get(n, 0) * (probe_length(n, percent) * (1 + list_rows) - subsets)
        if saved > best:
            best, chosen = saved, n
    return chosen


def frequent_tokens(docs: DataFrame, width: int, share: float = 0.005, least: int = 32) -> np.ndarray:
    """Tokens in at least ``share`` of the documents of some run of text, by total count, sorted."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _ in texts_of(batch):
                values, _ = shingle_sets(texts, width)
                tokens, counts = np.unique(values, return_counts=True)
                often = counts >= max(3, share * len(texts.ids))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"])
        give_back()

    totals = docs.mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = totals.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


class JaccardJoin:
    def __init__(self, spark: SparkSession, width: int, percent: int):
        self.spark, self.width, self.percent = spark, width, percent
        self.space = Workspace(spark, "jaccard")

    def compatible(self, a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def overlap(self, a: str, b: str) -> F.Column:
        """``least_overlap`` of two columns; a quotient that is whole is exact."""
        return F.ceil(self.percent * (F.col(a) + F.col(b)) / (100 + self.percent))

    def reaches(self, n: str, m: str, at: str) -> F.Column:
        """Whether a set of n elements needs its token at that place to meet one of m elements: the
        first shared token of a linked pair has as many others behind it as the overlap asks for."""
        return F.col(at) + self.overlap(n, m) <= F.col(n)

    def described(self, docs: DataFrame) -> DataFrame:
        """doc_id, n, a 128-bit identity of the set, its bitmap, its prefix and, if small, the set."""
        width, percent = self.width, self.percent
        frequent = self.spark.sparkContext.broadcast(frequent_tokens(docs, width))

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = frequent.value
            for batch in batches:
                for texts, _ in texts_of(batch):
                    values, firsts = shingle_sets(texts, width)
                    common = is_among(last, values)
                    n = np.diff(firsts)
                    prefixes, smalls, bits = [], [], []
                    for i, size in enumerate(n.tolist()):
                        own, often = values[firsts[i] : firsts[i + 1]], common[firsts[i] : firsts[i + 1]]
                        length = probe_length(size, percent)
                        rare = own[~often][:length]
                        prefixes.append(rare.tobytes() + own[often][: length - len(rare)].tobytes())
                        smalls.append(own.tobytes() if size <= LARGEST_LIGHT else None)
                        bits.append(bitmap(own))
                    arrays = [pa.array(texts.ids), pa.array(n.astype(np.int64)), *(pa.array(x, pa.binary()) for x in (identities(values, firsts), prefixes, smalls, bits)), pa.array([sketch(b) for b in bits], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "identity", "prefix", "small", "bits", "sketch"])
            give_back()

        self.frequent = frequent
        return self.space.save(docs.mapInArrow(describe, "doc_id long, n long, identity binary, prefix binary, small binary, bits binary, sketch array<long>"), "described")

    def light_links(self, sets: DataFrame, boundary: int) -> DataFrame:
        """(u, v) for light pairs: each set with the smallest id across each shared subset."""
        percent = self.percent

        def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(own, *key) for own, small in zip(batch.column("id").to_pylist(), batch.column("small").to_pylist()) for key in light_keys(np.frombuffer(small, np.uint64), boundary, percent)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["id", "key", "more", "side"])

        rows = self.space.save(sets.filter(F.col("n").between(1, boundary)).select("id", "small").mapInArrow(subsets, "id long, key long, more long, side int"), "subsets")
        across = rows.select("id", "key", "more", F.when(F.col("side") < 2, 1 - F.col("side")).otherwise(F.col("side")).alias("side"))
        firsts = self.space.save(rows.groupBy("key", "more", "side").agg(F.min("id").alias("first")), "subset-firsts")
        links = across.join(firsts, ["key", "more", "side"]).filter("id != first")
        return self.space.save(links.select(F.least("id", "first").alias("u"), F.greatest("id", "first").alias("v")).distinct(), "light-links")

    def lists(self, sets: DataFrame) -> DataFrame:
        """(token, id, n, at): inverted lists of prefix tokens, with the token's place in the prefix;
        those that hold two sets, one of them indexed there."""
        frequent = self.frequent

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arrays = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
                sizes = np.array([len(a) for a in arrays], np.int64)
                values = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.uint64)
                at = np.repeat(np.arange(len(arrays)), sizes)
                place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [pa.array(values.view(np.int64)), batch.column("id").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(place), pa.array(is_among(frequent.value, values))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "id", "n", "at", "often"])

        rows = sets.filter("n > 0").select("id", "n", "prefix").mapInArrow(tokens, "token long, id long, n long, at long, often boolean")
        own = Window.partitionBy("token")
        rare = rows.filter("not often").withColumns({"many": F.count("*").over(own), "held": F.max(self.reaches("n", "n", "at")).over(own)}).filter("many > 1 and held").drop("many", "held")
        return self.space.save(rare.unionByName(rows.filter("often")).drop("often"), "lists")

    def list_rows(self, lists: DataFrame) -> float:
        """Mean length of the list that a token of a set of light size stands in."""
        own = lists.groupBy("token").agg(F.count("*").cast("double").alias("all"), F.count(F.when(F.col("n") <= LARGEST_LIGHT, 1)).alias("light"))
        found = own.agg(F.sum(F.col("all") * F.col("light")).alias("met"), F.sum("light").alias("asked")).first()
        return found["met"] / found["asked"] if found["asked"] else 0.0

    def leader_pairs(self, lists: DataFrame, boundary: int) -> DataFrame:
        """Each set with an indexed one of its band of sizes and of the band below, that of the smallest id."""
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent)).cast("int")
        banded = lists.withColumn("band", band)
        leaders = self.space.save(banded.filter(self.reaches("n", "n", "at")).groupBy("token", "band").agg(F.min(F.struct("id", "n")).alias("leader")), "leaders")
        asked = banded.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
        met = asked.join(leaders, ["token", "band"]).select("id", "n", F.col("leader.id").alias("other"), F.col("leader.n").alias("m"))
        return self.pairs(met, boundary)

    def pairs(self, met: DataFrame, boundary: int) -> DataFrame:
        """Distinct pairs (u, v) of compatible sizes of which one at least is heavy."""
        fit = met.filter((F.col("id") != F.col("other")) & self.compatible("n", "m") & (F.greatest("n", "m") > boundary))
        return fit.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()

    def screened(self, pairs: DataFrame, bitmaps: DataFrame, name: str) -> DataFrame:
        """The pairs that their bitmaps do not part."""
        percent = self.percent

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = [may_link(*row, percent) for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m")))]
                yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

        pairs = self.space.save(pairs, f"{name}-pairs")
        left = bitmaps.select(F.col("id").alias("u"), F.col("n"), F.col("bits").alias("a"))
        right = bitmaps.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b"))
        met = pairs.join(left, "u").join(right, "v").select("u", "v", "n", "m", "a", "b")
        return self.space.save(met.mapInArrow(keep, "u long, v long"), f"{name}-near")

    def verified(self, docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets are near enough; sets are made anew for the documents in question."""
        width, percent = self.width, self.percent

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, _ in texts_of(batch):
                    values, firsts = shingle_sets(texts, width)
                    packed = [values[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(texts.ids), *(pa.array(x, pa.binary()) for x in (identities(values, firsts), packed))], ["doc_id", "identity", "set"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = []
                for left, right in zip(batch.column("left"), batch.column("right")):
                    a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                    overlap = int(is_among(b, a).sum())
                    near.append(100 * overlap >= percent * (len(a) + len(b) - overlap))
                yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

        ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
        ids = ids.join(self.named.select("id", F.col("doc_id").alias("of")), "id", "left").select(F.coalesce("of", "id").alias("doc_id")).distinct()
        picked = only_ids(docs, self.space.save(ids, f"{name}-ids"))
        made = self.space.save(picked.mapInArrow(sets, "doc_id long, identity binary, set binary"), f"{name}-sets")
        # A document with several sets has the one that a pair means among them.
        plain = made.join(self.several, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "set")
        made = plain.unionByName(made.join(self.named, ["doc_id", "identity"]).select("id", "set"))
        both = pairs.join(made.select(F.col("id").alias("u"), F.col("set").alias("left")), "u").join(made.select(F.col("id").alias("v"), F.col("set").alias("right")), "v")
        links = self.space.save(both.select("u", "v", "left", "right").mapInArrow(compare, "u long, v long").distinct(), f"{name}-links")
        self.space.drop(f"{name}-ids", f"{name}-sets")
        return links

    def classes(self, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(identity, first, id) of each distinct set, and the links (u, v) of documents with several.

        ``id`` is the smallest doc_id; of sets that share it, as a document with several texts makes
        them, one keeps it and the others get numbers of their own, beyond 2**62.
        """
        space, filled = self.space, own.filter("identity is not null")
        classes = space.save(filled.groupBy("identity").agg(F.min("doc_id").alias("first")), "classes")
        several = filled.groupBy("doc_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high")).filter("low != high")
        self.several = space.save(several.select("doc_id"), "several")
        met = classes.join(self.several, F.col("first") == F.col("doc_id"), "left_semi")
        lowest = met.groupBy("first").agg(F.min("identity").alias("keeps"))
        number = F.xxhash64("identity").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        named = met.join(lowest, "first").select(F.col("first").alias("doc_id"), "identity", F.when(F.col("identity") == F.col("keeps"), F.col("first")).otherwise(number).alias("id"))
        self.named = space.save(named, "named")
        whole = classes.join(self.named.select("identity", "id"), "identity", "left").select("identity", "first", F.coalesce("id", "first").alias("id"))
        rows = filled.join(self.several, "doc_id", "left_semi").join(whole, "identity").select("doc_id", "id").distinct()
        same = rows.join(rows.groupBy("doc_id").agg(F.min("id").alias("u")), "doc_id").filter("id != u").select("u", F.col("id").alias("v"))
        return whole, same.distinct()

    def run(self, docs: DataFrame) -> DataFrame:
        known = known_ids(docs)
        described = self.described(known)
        filled = described.filter("n > 0")
        own = self.space.save(described.select("doc_id", "n", F.when(F.col("n") > 0, F.col("identity")).alias("identity")), "own")
        classes, same = self.classes(own)
        chosen = filled.join(classes.select("id", "identity", F.col("first").alias("doc_id")), ["doc_id", "identity"]).dropDuplicates(["id"])
        sets = self.space.save(chosen.select("id", "n", "prefix", "small", "bits", "sketch"), "sets")
        # Prefixes are the bulk of these tables; each goes as soon as the next holds what is needed.
        self.space.drop("described")
        lists = self.lists(sets)
        bitmaps = self.space.save(sets.select("id", "n", "bits", "sketch"), "bitmaps")
        small = self.space.save(sets.filter(F.col("n") <= LARGEST_LIGHT).select("id", "n", "small"), "small")
        self.space.drop("sets")
        sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
        boundary = choose_boundary(sizes, self.list_rows(lists), self.percent)
        light = self.light_links(small, boundary)
        # A light set scans lists only if a heavy one can be near it in size.
        lists = lists.filter(F.col("n") >= max(1, least_partner(boundary + 1, self.percent)))
        near = self.screened(self.leader_pairs(lists, boundary), bitmaps, "first")
        links = self.space.save(light.unionByName(self.verified(known, near, "first")).unionByName(same), "links")
        labels = connected_components(self.space, links, "first-labels")
        labels = self.remaining(known, bitmaps, lists, links, labels, boundary)

        placed = own.join(classes, "identity", "left").join(labels.select("id", "label"), "id", "left")
        result = placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "id", "doc_id").alias("component_id"))
        unknown = docs.filter("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        return self.space.finish(result.unionByName(self.sizes_only(unknown)))

    def remaining(self, docs: DataFrame, bitmaps: DataFrame, lists: DataFrame, links: DataFrame, labels: DataFrame, boundary: int) -> DataFrame:
        """Compares what the leaders left open: pairs of a list in different components."""
        placed = lists.join(labels, "id", "left").select("token", "id", "n", "at", F.coalesce("label", "id").alias("label"))
        placed = self.space.save(placed, "placed")
        mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("token")
        open_ = placed.join(self.space.save(mixed, "mixed"), "token", "left_semi")
        folded = bitmaps.select("id", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
        open_ = self.space.save(open_.join(folded, "id"), "open")
        self.space.drop("placed", "mixed")
        held = open_.filter(self.reaches("n", "n", "at")).select(
            F.col("token").alias("of"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"), F.col("label").alias("other_label"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)]
        )
        differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH)])
        near = (F.col("m") <= F.col("n")) & self.compatible("n", "m") & self.reaches("n", "m", "at") & self.reaches("m", "n", "other_at") & (differ <= F.col("n") + F.col("m") - 2 * self.overlap("n", "m"))
        crossing = open_.join(held, (F.col("token") == F.col("of")) & (F.col("label") != F.col("other_label")) & near)
        tried = self.spark.read.parquet(self.space.path("first-pairs"))
        pairs = self.pairs(crossing.select("id", "n", "other", "m"), boundary).join(tried, ["u", "v"], "left_anti")
        near = self.screened(pairs, bitmaps, "second")
        if not near.limit(1).count():
            return labels
        more = self.verified(docs, near, "second")
        return connected_components(self.space, links.unionByName(more), "second-labels")

    def sizes_only(self, docs: DataFrame) -> DataFrame:
        width = self.width

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, _ in texts_of(batch):
                    n = np.diff(shingle_sets(texts, width)[1]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

        return docs.mapInArrow(count, "doc_id long, n_shingles long, component_id long")


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    return JaccardJoin(spark, width, percent).run(docs)
