"""Fill-in-middle: documents cut at two units and written with the middle last.

Units are the matches of a pattern, left to right; a code point that no match covers is a unit of
its own, so units tile the text. Each text is matched in runs of units, and ``posexplode`` makes a
row of each run. A window sums the lengths of the runs before each one, and the runs that hold a
cut (known by their ordinal) are exploded again, unit by unit. Cut requests meet the units by
ordinal, offsets are aggregated per document, and ``substring`` cuts the text. So a text of n units
costs n / ``run`` rows and two runs of units, never n rows, and texts themselves are shuffled once.

Where the cuts lie, and in which form a text is written, follows from the digest of its doc_id
alone, so reruns agree.

Edge cases: a null text is empty; an empty one, and one that holds a marker, stays plain. A null
doc_id counts as an empty string in the digest. Rows that repeat a doc_id are cut by their own
lengths, equal rows alike, and all come back. Texts are read whole. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.storage import Workspace

CODE_POINT = "(?s:.)"
#: A word with the spaces behind it; leading spaces are a unit of their own.
WORD_UNIT = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"


def digest_group(place: int) -> Column:
    """The eight hexadecimal digits at that place (from 1) of the document's digest, as a number."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(key, 8 * place - 7, 8), 16, 10).cast("long")


def planned(docs: DataFrame, unit: str, plain_percent: int, spm_percent: int) -> DataFrame:
    """doc_id, text, key (of id and text), n units, form, and the cuts low and high in units."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.length("text") if unit == CODE_POINT else F.regexp_count("text", F.lit(f"{unit}|{CODE_POINT}"))
    rows = rows.withColumns({"n": n.cast("long"), "key": F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))})
    first, second = digest_group(1) % (F.col("n") + 1), digest_group(2) % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKER) | (digest_group(3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(digest_group(4) % 100 < spm_percent, "spm").otherwise("psm")
    return rows.withColumns({"form": form, "low": F.least(first, second), "high": F.greatest(first, second)})


def cut_offsets(plan: DataFrame, unit: str, run: int) -> DataFrame:
    """(key, prefix_end, middle_end): code points before the two cuts of each key that is cut. Cuts
    before the first unit have no row here."""
    one = CODE_POINT if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"
    asked = plan.filter("form != 'plain'")
    runs = asked.select("key", "low", "high", F.posexplode(F.regexp_extract_all("text", F.lit(f"{one}{{1,{run}}}+"), 0)).alias("place", "piece"))
    holds = F.expr(f"place in ((low - 1) div {run}, (high - 1) div {run})")
    # Rows that repeat a document are one from here on; they meet before the shuffle where they can.
    merged = runs.select("key", "place", F.length("piece").alias("chars"), F.when(holds, F.col("piece")).alias("piece")).groupBy("key", "place").agg(F.max("chars").alias("chars"), F.max("piece").alias("piece"))
    before = Window.partitionBy("key").orderBy("place")
    held = merged.withColumn("before", F.sum("chars").over(before) - F.col("chars")).filter("piece is not null")
    requests = asked.select("key", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("cut")).distinct()
    # Requests meet the run of their unit, so units are exploded where they stand and not shuffled.
    met = held.join(requests.withColumn("place", F.expr(f"int((cut - 1) div {run})")).filter("cut > 0"), ["key", "place"])
    units = met.select("key", "place", "cut", "low", "high", "before", F.posexplode(F.regexp_extract_all("piece", F.lit(one), 0)).alias("at", "unit"))
    within = Window.partitionBy("key", "place", "cut").orderBy("at")
    ends = units.withColumn("end", F.col("before") + F.sum(F.length("unit")).over(within)).filter(F.col("place") * run + F.col("at") + 1 == F.col("cut"))
    return ends.groupBy("key").agg(F.max(F.when(F.col("cut") == F.col("low"), F.col("end"))).alias("prefix_end"), F.max(F.when(F.col("cut") == F.col("high"), F.col("end"))).alias("middle_end"))


def rewritten(spark: SparkSession, docs: DataFrame, unit: str = CODE_POINT, run: int = 64, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), text and output."""
    plan = planned(docs, unit, plain_percent, spm_percent)
    offsets = Workspace(spark, "fill-in-middle").save(cut_offsets(plan, unit, run), "offsets")
    # The key holds the id, so only the asked rows of one document can meet its offsets.
    met = plan.join(offsets.hint("shuffle_hash"), "key", "left")
    cut = F.col("form") != "plain"
    ends = met.withColumns({"prefix_end": F.coalesce("prefix_end", F.lit(0)), "middle_end": F.coalesce("middle_end", F.lit(0))})
    prefix, middle, suffix = (F.expr(x) for x in ("substring(text, 1, prefix_end)", "substring(text, prefix_end + 1, middle_end - prefix_end)", "substring(text, middle_end + 1)"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return ends.select(
        "doc_id", "n", "form",
        F.when(cut, F.col("prefix_end").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("middle_end") - F.col("prefix_end")).cast("long")).alias("middle_chars"),
        "text", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form. A cut text holds no marker, so markers part it."""
    parts = F.split(F.col(output), MARKER, -1)
    first, second, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output))


def fill_in_middle(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The digests of ``rewritten`` and of what is restored from it."""
    found = rewritten(spark, docs, **options)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
