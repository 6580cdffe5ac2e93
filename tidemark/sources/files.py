"""Readers and writers: CSV, rendered exports, and tables of Parquet that are merged into."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header. The schema is given, so the files are read once and columns are pruned."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, multiLine=False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _texts(df: DataFrame, missing: str = "") -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in df.columns]


def rendered(df: DataFrame, kind: str) -> DataFrame:
    """Lines (``part``, ``value``) of a table in Markdown or HTML, header first; rows stay distributed."""
    if kind == "md":
        cells = [F.regexp_replace(c, r"[|\n]", " ") for c in _texts(df)]
        head, line, foot = [f"| {' | '.join(df.columns)} |", f"|{' - |' * len(df.columns)}"], F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), []
    elif kind == "html":
        escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        head = ["<table>", f"<tr>{''.join(f'<th>{c}</th>' for c in df.columns)}</tr>"]
        line, foot = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape(c), F.lit("</td>")) for c in _texts(df)], F.lit("</tr>")), ["</table>"]
    else:
        raise ValueError(f"unknown format {kind!r}")
    fixed = lambda part, lines: df.sparkSession.createDataFrame([(part, i, v) for i, v in enumerate(lines)], "part int, at long, value string")
    return fixed(0, head).unionByName(df.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("at"), line.alias("value"))).unionByName(fixed(2, foot))


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv and json are written by all tasks; md and html are sorted into one order of lines."""
    if kind == "csv":
        write_csv(df, path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        rendered(df, kind).orderBy("part", "at").select("value").write.mode("overwrite").text(path)


def _existing(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _replace(df: DataFrame, path: str, partition: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str], partition: str, order: str | None = None, keep_old: bool = False) -> None:
    """Merges rows into a partitioned table by ``keys``; only partitions with new rows are rewritten.

    Without ``order``, a new row replaces the old one (``keep_old``: yields to it). With ``order``,
    the row with the larger value stays. A key keeps its partition.
    """
    spark = new.sparkSession
    rows = new.withColumn("_new", F.lit(1))
    old = _existing(spark, path, new.schema)
    if old is not None:
        touched = new.select(partition).distinct()
        rows = rows.unionByName(old.join(touched, partition, "left_semi").withColumn("_new", F.lit(0)))
    source = F.asc("_new") if keep_old else F.desc("_new")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*([F.desc(order)] if order else []), source))
    _replace(rows.withColumn("_place", place).filter("_place = 1").select(*new.columns), path, partition)


def replace_scope(new: DataFrame, path: str, partition: str) -> None:
    """The partitions of ``new`` hold just its rows afterwards: rows that it lacks are stale and go."""
    _replace(new, path, partition)


def append(new: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds rows to a Parquet table that has the same columns, in whatever order; other columns are an
    error, found before anything is written."""
    old = _existing(new.sparkSession, path, new.schema) if partition is None else None
    if old is not None:
        there = new.sparkSession.read.parquet(path)
        if dict(there.dtypes) != dict(new.dtypes):
            raise ValueError(f"the table has {sorted(there.dtypes)}, the rows {sorted(new.dtypes)}")
        new = new.select(*there.columns)
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
