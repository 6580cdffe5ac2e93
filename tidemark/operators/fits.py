"""Models fitted from sums that Spark takes in one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Logistic:
    """Coefficients of standardised features; the intercept comes first."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    steps: int
    converged: bool

    def probability(self) -> Column:
        return chance(self.coefficients, standardised(self.features, self.means, self.deviations))


def standardised(features: tuple[str, ...], means: tuple[float, ...], deviations: tuple[float, ...]) -> list[Column]:
    return [F.lit(1.0), *[(F.col(f).cast("double") - m) / d for f, m, d in zip(features, means, deviations)]]


def chance(coefficients: tuple[float, ...], design: list[Column]) -> Column:
    return 1 / (1 + F.exp(-reduce(Column.__add__, [x * float(c) for c, x in zip(coefficients, design)])))


def logistic(df: DataFrame, label: str, features: list[str], ridge: float, most: int = 25, tolerance: float = 1e-8) -> Logistic:
    """Newton steps with a ridge on all but the intercept. ``label`` is 0 or 1.

    A step is one aggregation: the gradient and the upper half of the Hessian, a row of sums for the
    driver whatever the number of rows. Rows with a null take no part; a feature that does not vary
    keeps the coefficient 0. No rows give coefficients of 0.
    """
    names = tuple(features)
    known = df.select(F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in names]).dropna()
    found = known.agg(*[F.avg(f) for f in names], *[F.stddev_pop(f) for f in names]).first()
    means = tuple(v or 0.0 for v in found[: len(names)])
    deviations = tuple(v or 1.0 for v in found[len(names) :])
    design, size = standardised(names, means, deviations), len(names) + 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    penalty = np.diag([0.0] + [ridge] * len(names))
    beta, step, converged = np.zeros(size), 0, False
    while step < most and not converged:
        p = chance(tuple(beta), design)
        sums = known.select(*[x.alias(f"x{i}") for i, x in enumerate(design)], (F.col(label) - p).alias("off"), (p * (1 - p)).alias("weight")).agg(
            *[F.sum(F.col("off") * F.col(f"x{i}")) for i in range(size)], *[F.sum(F.col("weight") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
        )
        values = [v or 0.0 for v in sums.first()]
        hessian = np.zeros((size, size))
        for (i, j), v in zip(pairs, values[size:]):
            hessian[i, j] = hessian[j, i] = v
        change = np.linalg.lstsq(hessian + penalty, np.array(values[:size]) - penalty @ beta, rcond=None)[0]
        beta, step, converged = beta + change, step + 1, bool(np.abs(change).max() < tolerance)
    return Logistic(names, means, deviations, tuple(beta.tolist()), step, converged)
