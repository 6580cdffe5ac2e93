"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

A bounded sample of labelled rows (``sample_rows``, drawn by a hash of the id) gives the examples.
Their whole vocabulary enters the vectors: every word of an example without the punctuation around
it, known by a 64-bit hash. Inverse document frequencies are counted over all documents; terms whose
document frequency differs between the labels (chi-squared of at least ``least_chi2`` and shares at
least ``least_ratio`` apart) weigh ``TELLING`` times as much, since
without that weight the subject of a text drowns its tone. Equal texts of one label are one example,
under their smallest id. The search (``BlockMaxIndex``) is exact. Neighbours vote with weights that
fall with distance; the votes of the sample itself, each example without its own, calibrate the
score by isotonic regression. Rows are scored by their text alone, against all examples: equal texts
have equal scores, whatever their ids. A row's evidence is the ids of its nearest examples.

Edge cases: a null or empty text, or one that shares no term with any example, has no neighbours and
gets the calibrated score of such texts. Labels that are null are left out; of several labels for
one id the largest counts. Without usable labels of both kinds all scores are 0. Rows with a null
doc_id are scored like others. Repeated rows are scored separately, and ties of similarity go to the smaller example. Whole texts are read, however
long. An empty table gives an empty result. Columns but doc_id and text are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.arrays import give_back
from tidemark.llm.storage import Workspace, shuffle_cleanup

BLOCK = 512
FIRST_BLOCKS = 2
DENSE = 512
BATCH = 64
SLICE = 512
SEEDS = 64
TELLING = 3.0
STRIP = ".,;:!?\"'()[]"


def term_of(word: str) -> str:
    """A folded word without the punctuation around it."""
    return word.strip(STRIP)


class Vocabulary:
    """Places of the terms among their sorted codes; what each word of the text adds is looked up once.

    A code is Python's hash of the term: PySpark gives all workers one seed, and only workers hash."""

    most_words = 100_000

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self._known: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.codes)

    def forget(self) -> None:
        """Empties what a task remembered; the worker process goes on to other work."""
        self._known.clear()
        give_back()

    def look_up(self, words: dict[str, int]) -> np.ndarray:
        """Places of the words' terms, -1 for words that are no term."""
        known = self._known
        if missing := [w for w in words if w not in known]:
            if len(self._known) + len(missing) > self.most_words:
                self._known.clear()
                missing = list(words)
            codes = np.array([hash(term_of(w)) for w in missing], np.int64)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            self._known.update(zip(missing, np.where(self.codes[at] == codes, at, -1).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's terms, ascending, and how often each occurs."""
        words = Counter(text.lower().split())
        places, term = np.unique(self.look_up(words), return_inverse=True)
        n = np.bincount(term, np.fromiter(words.values(), np.int64, len(words)), len(places))
        return (places[1:], n[1:]) if len(places) and places[0] < 0 else (places, n)


class BlockMaxIndex:
    """Exact cosines with all examples over inverted lists cut into blocks; example ids are places.

    Examples stand in an order in which similar ones are neighbours, so that a block of them is of
    one language and kind. The longest lists are rows of a matrix, which a batch of queries is
    multiplied with; of the others each keeps its largest weight in each block. A block's largest
    product so far and these maxima bound every cosine in it: the blocks of largest bound are scored
    first, and then those whose bound reaches the k-th best cosine found. No other block can change
    the result.
    """

    def __init__(self, size: int, example: np.ndarray, at: np.ndarray, times: np.ndarray, idf: np.ndarray):
        order = np.argsort(at, kind="stable")
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        self.size, self.idf, self.sizes = size, idf, small(np.bincount(at, minlength=len(idf)))
        self.example, self.times = small(example)[order], small(times)[order]
        self.blocks = -(-size // BLOCK)
        self._ready: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def forget(self) -> None:
        """Drops the laid-out lists; they are made again where they are needed."""
        self._ready = {}

    def neighbourly(self, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The place of each example in an order by the nearest of a few examples spread over all."""
        by_example = np.argsort(self.example, kind="stable")
        terms = np.repeat(np.arange(len(self.sizes)), self.sizes)[by_example]
        own, bounds = weights[by_example], np.searchsorted(self.example[by_example], np.arange(self.size + 1))
        near, group = np.full(self.size, -1.0), np.zeros(self.size, np.int64)
        for i, seed in enumerate(np.linspace(0, self.size - 1, min(self.size, SEEDS)).astype(int).tolist()):
            held = slice(bounds[seed], bounds[seed + 1])
            places, repeated = spans(starts[terms[held]], self.sizes[terms[held]].astype(np.int64), own[held])
            cosines = np.bincount(self.example[places], weights[places] * repeated, self.size)
            closer = cosines > near
            near[closer], group[closer] = cosines[closer], i
        place = np.empty(self.size, np.int64)
        place[np.lexsort((-near, group))] = np.arange(self.size)
        return place

    def ready(self) -> dict[str, np.ndarray]:
        """The lists as they are searched, laid out once in each process."""
        if not self._ready:
            starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
            weights = np.repeat(self.idf, self.sizes)
            weights *= 1 + np.log(self.times.astype(float))
            weights /= np.maximum(np.sqrt(np.bincount(self.example, weights * weights, self.size)), 1e-300)[self.example]
            place = self.neighbourly(starts, weights)
            at = place[self.example].astype(np.int32)
            often = np.argsort(-self.sizes.astype(np.int64), kind="stable")[:DENSE]
            row, matrix = np.full(len(self.sizes), -1, np.int32), np.zeros((len(often), self.blocks * BLOCK))
            row[often] = np.arange(len(often))
            for i, term in enumerate(often):
                own = slice(starts[term], starts[term + 1])
                matrix[i, at[own]] = weights[own]
            term = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
            rare = row[term] < 0
            at, term, weights = at[rare], term[rare], weights[rare]
            order = np.lexsort((at, term))
            at, term, weights = at[order], term[order], weights[order]
            block = at // BLOCK
            new = np.ones(len(at), bool)
            new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
            entries = np.flatnonzero(new)
            original = np.empty(self.size, np.int64)
            original[place] = np.arange(self.size)
            self._ready = {
                "row": row, "matrix": matrix, "original": original, "place": place, "at": at, "weight": weights, "first": np.searchsorted(term[entries], np.arange(len(self.sizes) + 1)),
                "block": block[entries].astype(np.int64), "largest": np.maximum.reduceat(weights, entries) if len(entries) else weights, "posting": np.append(entries, len(at)),
            }
        return self._ready

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> Iterator[list[tuple[float, int]]]:
        """For each vector the k examples of largest positive cosine but the one at ``without``,
        largest first, ties to the smaller place."""
        ready = self.ready()
        row, matrix = ready["row"], ready["matrix"]
        for low in range(0, len(vectors), BATCH):
            part = vectors[low : low + BATCH]
            query = np.zeros((len(part), len(matrix)))
            for i, (terms, weights) in enumerate(part):
                dense = row[terms] >= 0
                query[i, row[terms[dense]]] = weights[dense]
            for i, scores in enumerate(query @ matrix):
                terms, weights = part[i]
                rare = row[terms] < 0
                yield self._best(ready, scores, terms[rare], weights[rare], k, without[low + i])

    def _best(self, ready: dict[str, np.ndarray], scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        first, posting = ready["first"], ready["posting"]
        entries, factors = spans(first[terms], first[terms + 1] - first[terms], weights)
        block = ready["block"][entries]
        bounds = scores.reshape(self.blocks, BLOCK).max(1) + np.bincount(block, factors * ready["largest"][entries], self.blocks)
        done, least = np.zeros(self.blocks, bool), 0.0
        for many in (min(FIRST_BLOCKS, self.blocks), self.blocks):
            chosen = (bounds >= np.partition(bounds, -many)[-many]) & (bounds >= least - 1e-12) & ~done
            done |= chosen
            held = chosen[block]
            own = entries[held]
            places, repeated = spans(posting[own], posting[own + 1] - posting[own], factors[held])
            scores += np.bincount(ready["at"][places], ready["weight"][places] * repeated, len(scores))
            if without >= 0:
                scores[ready["place"][without]] = 0
            # Scores of blocks not yet done lack their rare terms and only make this bound smaller.
            least = np.partition(scores, -k)[-k] if k < len(scores) else 0.0
        found = np.flatnonzero((scores > 0) & (scores >= least - 1e-12))
        return sorted(zip(scores[found].tolist(), ready["original"][found].tolist()), key=lambda s: (-round(s[0], 12), s[1]))[:k]


def spans(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges given by start and size, joined, and each range's value at its places."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + sizes, sizes) + np.arange(total), np.repeat(values, sizes)


class Scorer:
    def __init__(self, ids: list[int], labels: list[int], index: BlockMaxIndex, k: int):
        self.k, self.ids, self.labels, self.index = k, ids, labels, index
        self.prior = sum(labels) / max(1, len(labels))
        self.place = {own: i for i, own in enumerate(ids)}

    def votes(self, vocabulary: Vocabulary, texts: list[str], without: list[int | None] | None = None) -> list[tuple[float, list[int]]]:
        """Distance-weighted share of toxic neighbours for each text, drawn to the prior by one distant
        vote, and the neighbours; -1 for a text without neighbours. Equal texts are searched once.
        ``without`` names examples that do not vote, one for each text."""
        keys = [(text, self.place.get(own, -1)) for text, own in zip(texts, without or [None] * len(texts))]
        found: dict[tuple, tuple[float, list[int]]] = {}
        distinct = list(dict.fromkeys(keys))
        vectors = [weigh(vocabulary.counts(text), self.index.idf) for text, _ in distinct]
        for key, near in zip(distinct, self.index.nearest(vectors, self.k, [own for _, own in distinct])):
            votes = [(1 / (1.05 - min(1.0, s)), self.labels[i]) for s, i in near]
            total = sum(w for w, _ in votes) + 1
            found[key] = ((sum(w * y for w, y in votes) + self.prior) / total if near else -1.0, [self.ids[i] for _, i in near])
        return [found[key] for key in keys]


def batch_votes(scorer: Scorer, vocabulary: Vocabulary, batch: pa.RecordBatch, examples: bool = False) -> list[tuple[float, list[int]]]:
    """The votes of a batch, a slice at a time, so that few texts and vectors are held at once.
    ``examples`` do not vote for themselves."""
    out = []
    for low in range(0, batch.num_rows, SLICE):
        part = batch.slice(low, SLICE)
        out += scorer.votes(vocabulary, [t.as_py() or "" for t in part.column("text")], part.column("doc_id").to_pylist() if examples else None)
    return out


def weigh(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of (1 + ln tf) * idf over the vocabulary."""
    at, n = counts
    raw = (1 + np.log(n)) * idf[at]
    length = math.sqrt(float(raw @ raw))
    return at, raw / length if length else raw


def isotonic_steps(votes: list[tuple[float, int]], strength: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the votes; pools are smoothed towards the overall rate."""
    rate = sum(y for _, y in votes) / len(votes)
    pools: list[list[float]] = []  # sum of labels, count, lowest and highest vote
    by_vote: dict[float, list[float]] = {}
    for vote, label in votes:
        pool = by_vote.setdefault(round(vote, 6), [0.0, 0.0, vote, vote])
        pool[0] += label
        pool[1] += 1
    for vote in sorted(by_vote):
        pools.append(by_vote[vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    x, y = [], []
    for labels, n, low, high in pools:
        value = (labels + strength * rate) / (n + strength)
        x += [low, high]
        y += [max(value, y[-1] if y else 0.0)] * 2
    return np.array(x), np.array(y)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = 5_000, least_chi2: float = 20.0, least_df: int = 3, least_ratio: float = 4.0, k: int = 15
) -> tuple[Broadcast, Broadcast, tuple[np.ndarray, np.ndarray]] | None:
    """The broadcast vocabulary and scorer from a bounded sample of ``labels`` (doc_id, label), and the
    steps from votes to scores; None without both labels."""
    usable = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n_labels = usable.count()
    if not n_labels:
        return None
    cut = int(min(1.0, sample_rows / n_labels) * (1 << 30))
    sample = usable.filter(F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) < cut)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id")
    rows = rows.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("one"))
    space = Workspace(spark, "toxicity")
    rows = space.save(rows.select("doc_id", "one.text", "one.label"), "sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {"": [0, 0]}
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                for term in {"", *map(term_of, set((text.as_py() or "").lower().split()))}:
                    counts.setdefault(term, [0, 0])[int(label > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([hash(t) for t in counts], pa.int64()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], ["term", "clean", "toxic"])

    per_term = rows.select("text", "label").mapInArrow(spread, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    with shuffle_cleanup(spark):
        terms = per_term.toArrow()
    codes, a, b = (terms.column(c).to_numpy() for c in ("term", "a", "b"))
    everything = codes == hash("")
    n_a, n_b = float(a[everything].sum()), float(b[everything].sum())
    if not n_a or not n_b:
        return None
    order = np.argsort(codes[~everything])
    codes, a, b = (x[~everything][order] for x in (codes, a.astype(float), b.astype(float)))
    if not len(codes):
        return None
    chi2 = (n_a + n_b) * (a * (n_b - b) - b * (n_a - a)) ** 2 / (n_a * n_b * (a + b) * np.maximum(n_a + n_b - a - b, 0.5))
    odds = np.abs(np.log((b + 0.5) / (n_b + 1)) - np.log((a + 0.5) / (n_a + 1)))
    telling = np.flatnonzero((a + b >= least_df) & (chi2 >= least_chi2) & (odds >= math.log(least_ratio)))
    vocabulary = Vocabulary(codes)
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, words = np.zeros(len(shared.value) + 1, np.int64), 0, Counter()
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                own = set(text.as_py().lower().split()) if text.is_valid else ()
                # Two words of a text that are one term, as a word with and without a full stop, count once.
                words.update({term_of(w) for w in own})
            if len(words) > shared.value.most_words:
                np.add.at(counts, shared.value.look_up(words), np.fromiter(words.values(), np.int64, len(words)))
                words.clear()
        np.add.at(counts, shared.value.look_up(words), np.fromiter(words.values(), np.int64, len(words)))
        counts = counts[:-1]
        shared.value.forget()
        held = np.flatnonzero(counts)
        for low in range(0, len(held), 50_000):
            part = held[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([rows], pa.int64())], ["term", "n"])

    with shuffle_cleanup(spark):
        found = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    in_docs = np.zeros(len(vocabulary))
    in_docs[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + in_docs))
    idf[telling] *= TELLING

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [shared.value.counts(t.as_py() or "") for t in batch.column("text")]
            at, times = (pa.array([c[i] for c in counts], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), at, times], ["doc_id", "label", "at", "times"])
        shared.value.forget()

    with shuffle_cleanup(spark):
        made = rows.select("doc_id", "text", "label").mapInArrow(counted, "doc_id long, label int, at array<int>, times array<int>").toArrow()
    own = made.column("doc_id").to_numpy()
    order = np.argsort(own, kind="stable")
    places = np.argsort(order, kind="stable").astype(np.int32)
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in made.column("at").chunks])
    at, times = (np.concatenate([c.flatten().to_numpy() for c in made.column(name).chunks]) for name in ("at", "times"))
    labelled = (made.column("label").to_numpy()[order] > 0).astype(int).tolist()
    del made
    index = BlockMaxIndex(len(own), np.repeat(places, lengths), at, times, idf)
    ready = spark.sparkContext.broadcast(Scorer(own[order].tolist(), labelled, index, k))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [v for v, _ in batch_votes(ready.value, shared.value, batch, examples=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column("label")], ["vote", "label"])
        shared.value.forget()

    left_out = [(r["vote"], int(r["label"] > 0)) for r in rows.select("doc_id", "text", "label").mapInArrow(votes, "vote double, label int").collect()]
    space.drop("sample")
    return shared, ready, isotonic_steps(left_out)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, evidence: int = 3, **options) -> DataFrame:
    """doc_id, score, predicted and evidence; ``labels`` are doc_id and label, rows to learn from."""
    shared, ready, steps = fit(spark, docs, labels, **options) or (None, None, None)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready.value if ready else None
        for batch in rows:
            votes = batch_votes(scorer, shared.value, batch) if scorer else [(0.0, [])] * batch.num_rows
            scores = [float(np.interp(v, *steps)) if scorer else 0.0 for v, _ in votes]
            near = pa.array([ids[:evidence] for _, ids in votes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), near], ["doc_id", "score", "predicted", "evidence"])
        if scorer:
            shared.value.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, score double, predicted int, evidence array<long>")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    shared, ready, steps = fit(spark, docs, labels, **options) or (None, None, None)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready.value if ready else None
        for batch in rows:
            votes = batch_votes(scorer, shared.value, batch) if scorer else []
            kept = [float(np.interp(v, *steps)) < threshold for v, _ in votes] if scorer else [True] * batch.num_rows
            yield batch.filter(pa.array(kept, pa.bool_()))
        if scorer:
            scorer.index.forget()
            shared.value.forget()

    return docs.mapInArrow(batches, docs.schema)
