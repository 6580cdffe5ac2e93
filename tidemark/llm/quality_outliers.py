"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Everything here is DataFrame expressions: text statistics are array functions inside the row, the
estimates are grouped aggregates, and the inverse of a covariance matrix is a Cholesky
substitution written out as columns.

Edge cases: a null or empty text has no words, fails the base rules and takes no part in the
estimates. Null ``lang`` or ``source`` values form groups of their own. Repeated rows are judged
separately and count separately. A group with fewer than ``min_group`` usable rows, or whose
statistics do not vary, gives no verdict, so its rows stay if they pass the base rules. An empty
table gives an empty result. Extra input columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.storage import Workspace
from tidemark.llm.words import SPACE


SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Groups that are broadcast at most (some 300 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Transformed statistics and the spread that stands in where a smaller one is found: where nearly
#: all of a group has no symbol or no repeated line, the estimate would otherwise shrink to a point
#: and one repeated line would be an outlier.
FEATURES = {"f_len": 0.3, "f_word": 0.1, "f_symbol": 0.08, "f_dup": 0.5, "f_repeat": 0.1}


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per document with the word, symbol, line and repetition counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    bare = F.translate("text", SPACE_CHARS, "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "")
    base = base.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    return base.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words("words").cast("long").alias("n_repeat_words"),
    )


def repeated_window_words(words: str, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the same row.

    Windows are sorted by hash inside the row, equal neighbours mark each other, and the marked
    starts are widened to word positions.
    """
    n = F.size(words) - F.lit(width - 1)
    starts = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = lambda i: [F.get(F.col(words), i + k) for k in range(width)]
    keyed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*parts(i)).alias("h"), i.alias("i"))))
    equal = F.zip_with(
        keyed, F.slice(keyed, 2, F.greatest(F.size(keyed) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    marked = F.array_distinct(F.flatten(F.filter(equal, lambda p: p.isNotNull())))
    covered = F.flatten(F.transform(marked, lambda i: F.array(*[i + k for k in range(width)])))
    return F.size(F.array_distinct(covered))


def feature_columns() -> dict[str, Column]:
    """Transformed statistics: logarithms and square roots tame the long tails."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f_len": F.log1p(F.col("n_words").cast("double")),
        "f_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f_symbol": F.sqrt(F.col("n_symbols") / n),
        "f_dup": F.log1p(F.col("n_dup_lines").cast("double")),
        "f_repeat": F.col("n_repeat_words") / n,
    }


def chi_square_share(x: float, degrees: int) -> float:
    """Share of a chi-squared variable below x, by the series of the incomplete gamma function."""
    half, term, total, n = x / 2, 1.0, 0.0, degrees / 2
    for i in range(1000):
        total += term
        term *= half / (n + i + 1)
        if term < 1e-17 * total:
            break
    return math.exp(n * math.log(half) - half - math.lgamma(n + 1)) * total if x > 0 else 0.0


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, degrees) < share else (low, middle)
    return high


def consistency(share: float, degrees: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied by."""
    return share / chi_square_share(chi_square_quantile(share, degrees), degrees + 2)


def with_whitening(estimate: DataFrame, features: dict[str, float]) -> DataFrame:
    """Adds w_i_j, the inverse Cholesky factor of each group's covariance, one column at a time, and
    log_det, the logarithm of its determinant. A variance below the least one is raised to it."""
    p, least, out = len(features), [spread**2 for spread in features.values()], estimate
    for i in range(p):
        for j in range(i + 1):
            own = F.greatest(F.col(f"c_{i}_{i}"), F.lit(least[i])) if i == j else F.col(f"c_{i}_{j}")
            rest = reduce(lambda acc, k: acc - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), own)
            value = F.sqrt(F.greatest(rest, F.lit(least[i] * 1e-3))) if i == j else rest / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    out = out.withColumn("log_det", reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(p)]))
    for j in range(p):
        for i in range(j, p):
            total = reduce(lambda acc, k: acc - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}"), range(j, i), F.lit(1.0 if i == j else 0.0))
            out = out.withColumn(f"w_{i}_{j}", total / F.col(f"l_{i}_{i}"))
    return out.drop(*[f"{c}_{i}_{j}" for c in "cl" for i in range(p) for j in range(i + 1)])


def distance_squared(features: dict[str, float]) -> Column:
    """Squared Mahalanobis distance from the columns mu_i and w_i_j."""
    names = list(features)
    z = [reduce(lambda a, b: a + b, [F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"mu_{j}")) for j in range(i + 1)]) for i in range(len(features))]
    return reduce(lambda a, b: a + b, [F.pow(x, 2) for x in z])


def _estimates(rows: DataFrame, keys: list[str], features: dict[str, float]) -> DataFrame:
    order = list(features)
    aggs = [F.avg(f).alias(f"mu_{i}") for i, f in enumerate(order)]
    for i, a in enumerate(order):
        for j in range(i + 1):
            aggs.append(F.covar_pop(a, order[j]).alias(f"c_{i}_{j}"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_group"), *aggs)


def met(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the columns of their group; the table of groups is broadcast if it is small enough."""
    return rows.join(F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups, names)


def mcd_outliers(
    space: Workspace,
    stats: DataFrame,
    keys: tuple[str, ...] = ("lang", "source"),
    features: dict[str, float] = FEATURES,
    starts: int = 4,
    steps: int = 3,
    kept_share: float = 0.75,
    min_group: int = 30,
    rejected_share: float = 0.0001,
    seed: int = 23,
) -> DataFrame:
    """Adds ``distance2`` and ``outlier`` to ``stats``, which carries the feature columns.

    Each group starts from its medians and quartiles, and from some forty of its rows, drawn by a
    hash, for each further start. All starts take ``steps`` concentration steps at once: the
    ``kept_share`` of rows nearest to an estimate (to a ten-thousandth of the group's rows, and rows
    as far as the last of them) give the next one. The estimate of least determinant is the group's.
    It is made consistent for normal rows, and once more taken from the rows within its 0.975
    quantile. Rows beyond the quantile that normal rows pass with ``rejected_share`` are outliers.
    """
    keyed = stats.withColumns({f"k_{k}": F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("null")) for k in keys})
    names, p = [f"k_{k}" for k in keys], len(features)
    d2 = distance_squared(features)
    usable = keyed.filter("n_words > 0").select(*names, "doc_id", *features)
    q = usable.groupBy(*names).agg(
        F.count("*").alias("n_group"),
        *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, f in enumerate(features)],
    )
    q = space.save(q, "quartiles")
    middle = q.select(
        *names, F.lit(0).alias("start"), "n_group",
        *[F.col(f"q_{i}")[1].alias(f"mu_{i}") for i in range(p)],
        *[(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    everywhere = usable.withColumn("start", F.explode(F.array(*map(F.lit, range(starts)))))
    drawn = F.xxhash64("doc_id", *features, "start", F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) * F.col("n_group") < 8 * (p + 1) * (1 << 30)
    some = _estimates(met(everywhere.filter("start > 0"), q.select(*names, "n_group"), names).filter(drawn).drop("n_group"), [*names, "start"], features)
    estimate = space.save(with_whitening(middle.unionByName(some.select(*middle.columns)), features), "estimate")
    for step in range(steps):
        measured = met(everywhere, estimate, [*names, "start"]).select(*names, "start", *features, d2.alias("d2"))
        bound = space.save(measured.groupBy(*names, "start").agg(F.percentile_approx("d2", kept_share, 10_000).alias("bound")), f"bound{step}")
        core = met(measured, bound, [*names, "start"]).filter("d2 <= bound")
        estimate = space.save(with_whitening(_estimates(core, [*names, "start"], features), features), f"estimate{step}")
    columns = [c for c in estimate.columns if c not in (*names, "log_det")]
    best = estimate.groupBy(*names).agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("one")).select(*names, "one.*")
    near = chi_square_quantile(0.975, p) * consistency(kept_share, p)
    core = met(usable, space.save(best, "best"), names).filter(d2 <= near).select(*names, *features)
    final = with_whitening(_estimates(core, names, features), features).drop("n_group").join(q.select(*names, F.col("n_group").alias("n_all")), names)
    final = space.save(final, "final")
    out = keyed.join(F.broadcast(final) if final.count() <= MOST_BROADCAST else final, names, "left").withColumn("distance2", d2 / consistency(0.975, p))
    verdict = (F.col("n_all") >= min_group) & (F.col("n_words") > 0) & (F.col("distance2") > chi_square_quantile(1 - rejected_share, p))
    return out.select(*stats.columns, "distance2", F.coalesce(verdict, F.lit(False)).alias("outlier"))


def quality_rules(spark: SparkSession, docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, **mcd) -> DataFrame:
    """Counts, the base rules and the verdict of the robust outlier test for each document."""
    space = Workspace(spark, "quality")
    stats = text_statistics(docs)
    stats = space.save(stats.withColumns(feature_columns()), "stats")
    judged = mcd_outliers(space, stats, **mcd)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance2", "outlier",
    )
    return space.finish(judged)
