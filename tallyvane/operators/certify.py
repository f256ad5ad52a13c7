"""Certificates of fits: what a fitted parameter claims, recomputed apart from the code that fitted it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc

Vector = Sequence[float]


def cross_entropy(logits: Sequence[Column], y: Column) -> Column:
    """-log softmax at the true class."""
    top = F.greatest(*logits)
    return top + F.log(sc.fold_sum([F.exp(z - top) for z in logits])) - F.get(F.array(*logits), y)


def neighbours(x: Vector, step: float, clip: Callable[[list[float]], list[float]] = list) -> list[list[float]]:
    """Points one step up and down each coordinate, inside the bounds."""
    out = []
    for i in range(len(x)):
        for sign in (1.0, -1.0):
            v = list(x)
            v[i] += sign * step
            out.append(clip(v))
    return out


def minimum(df: DataFrame, loss: Callable[[Vector], Column], start: Vector, best: Vector, around: Sequence[Vector], claimed: float, penalty: Callable[[Vector], float] = lambda _: 0.0) -> DataFrame:
    """Certificate of a minimum: (n_rows, start_loss, improved, stationary, recomputed), one row from one scan.

    ``loss`` gives the loss of a row at a parameter, written as an expression and not as the fit
    computes it; ``penalty`` is added to its mean. ``improved``: the loss is not above that at the
    start. ``stationary``: no point ``around`` is lower, which for a convex loss means the minimum
    up to the step. ``recomputed``: the claimed loss is the one found here.
    """
    points = [start, best, *around]
    means = df.agg(F.count("*").alias("n_rows"), *[(F.avg(loss(p)) + F.lit(float(penalty(p)))).alias(f"_l{i}") for i, p in enumerate(points)])
    at = lambda i: F.col(f"_l{i}")
    lowest = F.least(*[at(i) for i in range(2, len(points))], F.lit(float("inf")))
    return means.select(
        "n_rows", at(0).alias("start_loss"), (at(1) <= at(0) + 1e-9).alias("improved"), (lowest >= at(1) - 1e-7).alias("stationary"),
        (F.abs(at(1) - F.lit(float(claimed))) < 1e-6).alias("recomputed"))
