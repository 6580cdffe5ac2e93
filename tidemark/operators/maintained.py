"""Aggregates kept up to date with a partitioned table by reading only the partitions that changed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tidemark.operators.ordered import join_by


class Maintained:
    """Sums by key over a Parquet folder that is partitioned by one column.

    A run lists the source's files, without opening them, and compares each partition's fingerprint
    (names, lengths and times of its files) with that of the last run. Partitions that came, went or
    changed are aggregated anew; what they held before is known from their own partial sums. The
    signed differences by key are the run's delta. The state is the sum of all deltas, so nothing is
    overwritten: a run writes its partials and its delta to folders of its own, and counts once its
    list of fingerprints, written last, is there. A run that dies before that leaves files which the
    next one overwrites.

    ``sums`` name additive expressions of whole numbers or decimals (a sum of floats would depend on
    the order of edits). ``transform`` makes the rows that are summed of those that are read, and keeps
    ``_part``. A key whose rows are all gone leaves the state. Null keys are keys. ``source`` and
    ``root`` lie in folders that all executors share. One run works at a time.
    """

    def __init__(self, spark: SparkSession, root: str, source: str, part: str, keys: list[str], sums: dict[str, str], transform: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.source, self.part, self.keys, self.sums = spark, root.rstrip("/"), source, part, keys, sums
        self.transform = transform or (lambda df: df)

    def folder(self, kind: str, run: int) -> str:
        return f"{self.root}/{kind}/run={run:08d}"

    def runs(self) -> list[int]:
        """Runs whose list of fingerprints is complete."""
        found = []
        for path in self._list(f"{self.root}/fingerprints"):
            name = path.getName()
            if name.startswith("run=") and self._exists(f"{self.root}/fingerprints/{name}/_SUCCESS"):
                found.append(int(name[4:]))
        return sorted(found)

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, files = self._path(path)
        return files.exists(target)

    def _list(self, path: str) -> list:
        target, files = self._path(path)
        return [entry.getPath() for entry in files.listStatus(target)] if files.exists(target) else []

    def fingerprints(self) -> DataFrame:
        """(part, fingerprint, files) of the source as it is now; contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.source).select("path", "length", "modificationTime")
        named = files.select(self._part_of(F.col("path")).alias("part"), F.xxhash64("path", "length", "modificationTime").alias("file"))
        return named.groupBy("part").agg(F.sum(F.col("file").cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.count("*").alias("files"))

    def refresh(self) -> list[str] | None:
        """Takes in what changed and returns the names of those partitions; None if nothing did."""
        done = self.runs()
        run = done[-1] + 1 if done else 0
        now = self.fingerprints() if self._list(self.source) else self.spark.createDataFrame([], "part string, fingerprint string, files long")
        before = self.spark.read.parquet(self.folder("fingerprints", done[-1])) if done else self.spark.createDataFrame([], "part string, fingerprint string, files long, since int")
        met = now.alias("n").join(before.alias("b"), "part", "full").select("part", F.col("n.fingerprint").alias("new"), F.col("b.fingerprint").alias("old"), F.col("n.files").alias("files"), F.col("b.since").alias("since")).collect()
        changed = [r for r in met if r["new"] != r["old"]]
        if not changed:
            return None
        fresh = [r["part"] for r in changed if r["new"] is not None]
        stale: dict[int, list[str]] = {}
        for r in changed:
            if r["old"] is not None:
                stale.setdefault(r["since"], []).append(r["part"])
        pieces = []
        if fresh:
            # Only the folders of changed partitions are read.
            rows = self.spark.read.option("basePath", self.source).parquet(*[f"{self.source}/{self.part}={p}" for p in fresh])
            rows = self.transform(rows.withColumn("_part", self._part_of(F.col("_metadata.file_path"))))
            partial = rows.groupBy("_part", *self.keys).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(c) for c, e in self.sums.items()])
            self._check(partial)
            partial.write.mode("overwrite").parquet(self.folder("partials", run))
            pieces.append(self._partials(run, fresh))
        for since, parts in stale.items():
            pieces.append(self._partials(since, parts).select(*self.keys, *[(-F.col(c)).alias(c) for c in ("n", *self.sums)]))
        delta = reduce(DataFrame.unionByName, pieces).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("n", *self.sums)])
        any_change = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in ("n", *self.sums)])
        delta.filter(any_change).write.mode("overwrite").parquet(self.folder("deltas", run))
        kept = [(r["part"], r["new"], r["files"], run if r["new"] != r["old"] else r["since"]) for r in met if r["new"] is not None]
        self.spark.createDataFrame(kept, "part string, fingerprint string, files long, since int").write.mode("overwrite").parquet(self.folder("fingerprints", run))
        return sorted(r["part"] for r in changed)

    def _part_of(self, path: Column) -> Column:
        return F.regexp_extract(path, f"/{self.part}=([^/]*)/", 1)

    def _check(self, partial: DataFrame) -> None:
        for c in self.sums:
            kind = partial.schema[c].dataType
            if not isinstance(kind, (IntegralType, DecimalType)):
                raise ValueError(f"{c!r} sums {kind.simpleString()}; differences are exact for whole numbers and decimals only")

    def _partials(self, run: int, parts: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(self.folder("partials", run))
        return rows.filter(F.col("_part").isin(parts)).select(*self.keys, "n", *self.sums)

    def _deltas(self, runs: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[self.folder("deltas", r) for r in runs])

    def state(self, run: int | None = None) -> DataFrame:
        """(keys, n, sums) after a run, the last one if none is named."""
        runs = [r for r in self.runs() if run is None or r <= run]
        if not runs:
            raise ValueError("nothing has been taken in yet")
        return self._deltas(runs).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("n", *self.sums)]).filter("n > 0")

    def changelog(self, run: int) -> DataFrame:
        """(keys, change, and old_ and new_ of n and sums) of a run: keys that came, went or changed."""
        earlier, cells = [r for r in self.runs() if r < run], ("n", *self.sums)
        delta = self._deltas([run])
        touched = delta.select(*self.keys, *[F.col(c).alias(f"_d_{c}") for c in cells])
        if earlier:
            old = self._deltas(earlier).groupBy(*self.keys).agg(*[F.sum(c).alias(f"old_{c}") for c in cells]).filter("old_n > 0")
            met = join_by(touched, old, self.keys, "left")
        else:
            met = touched.withColumns({f"old_{c}": F.lit(None).cast(delta.schema[c].dataType) for c in cells})
        met = met.withColumns({f"new_{c}": F.coalesce(f"old_{c}", F.lit(0)) + F.coalesce(f"_d_{c}", F.lit(0)) for c in cells})
        gone = F.col("new_n") == 0
        change = F.when(F.col("old_n").isNull(), "insert").when(gone, "delete").otherwise("update")
        return met.select(*self.keys, change.alias("change"), *[f"old_{c}" for c in cells], *[F.when(~gone, F.col(f"new_{c}")).alias(f"new_{c}") for c in cells])
