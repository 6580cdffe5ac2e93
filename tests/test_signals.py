import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import fits, signals


def test_a_null_key_meets_no_signal_and_repeats_count_once(spark):
    spine = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    found = {r.k: (r.a, r.b, r.source_concurrence) for r in signals.concurrence(spine, ["k"], {"a": a, "b": b}).collect()}
    assert found == {1: (True, True, 2), 2: (False, True, 1), None: (False, False, 0)}


def test_grades_follow_the_era(spark):
    eras = [(2000, {}), (2010, {"medium": 1}), (None, {"medium": 1, "high": 2})]
    rows = spark.createDataFrame([(1999, 3), (2009, 0), (2009, 3), (2010, 1), (2010, 2)], "year int, n int")
    assert [r.c for r in rows.select(signals.confidence(F.col("year"), F.col("n"), eras).alias("c")).collect()] == ["low", "low", "medium", "medium", "high"]


def test_logistic_fit_has_no_slope_left_and_skips_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [2, 5] + [1, -3]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 0.8 * x[:, 0] - 0.2 * x[:, 1])))).astype(float)
    rows = [(float(c), float(a), float(b), 7.0) for (a, b), c in zip(x, y)] + [(1.0, None, 0.0, 7.0)]
    model = fits.logistic(spark.createDataFrame(rows, "y double, a double, b double, flat double"), "y", ["a", "b", "flat"], 0.5)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.array(model.coefficients)
    off = y - 1 / (1 + np.exp(-(beta[0] + z @ beta[1:3])))
    assert model.converged and abs(beta[3]) < 1e-9
    assert abs(off.sum()) < 1e-6 and np.abs(z.T @ off - 0.5 * beta[1:3]).max() < 1e-6


def test_logistic_fit_of_no_rows(spark):
    model = fits.logistic(spark.createDataFrame([], "y double, a double"), "y", ["a"], 1.0)
    assert model.coefficients == (0.0, 0.0)
