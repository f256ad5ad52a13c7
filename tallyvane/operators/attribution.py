"""Scorers on the metadata vector, group ablation and one-at-a-time attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators import metrics as mt
from tallyvane.schema import META_GROUPS


def fit_tabular(df: DataFrame, features: str, label: str, weight: str | None = None, reg: float = 0.01, max_iter: int = 100, unfinished: bool = False) -> tuple[list[list[float]], list[float]]:
    """SC14. Multinomial logistic regression on the vector; returns (K x d weights, K biases).

    It fails when the optimiser used up ``max_iter`` steps, unless ``unfinished`` asks for the last iterate.
    """
    ready = df.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"),
                      *([F.col(weight).alias("w")] if weight else []))
    lr = LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter, standardization=False,
                            **({"weightCol": "w"} if weight else {}))
    model = lr.fit(ready)
    if model.summary.totalIterations >= max_iter and not unfinished:
        raise RuntimeError(f"the scorer has not converged in {max_iter} steps")
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()


def linear_logits(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """SC14. The scorer as a native expression."""
    return F.array(*[
        sc.fold_sum([F.lit(float(b))] + [x[j] * float(w) for j, w in enumerate(row)]) for row, b in zip(weights, bias)
    ])


def ablate_groups(df: DataFrame, features: str, width: int, groups: dict[str, list[int]] = META_GROUPS) -> DataFrame:
    """SC11. Five rows per input: unchanged, and one per feature group zeroed (value and mask)."""
    zeroed = lambda members: F.array(*[F.lit(0.0) if i in members else F.col(features)[i] for i in range(width)])
    variants = [F.struct(F.lit("none").alias("masked"), F.col(features).alias("xv"))] + [
        F.struct(F.lit(g).alias("masked"), zeroed(set(m)).alias("xv")) for g, m in groups.items()
    ]
    return df.select("*", F.inline(F.array(*variants)))


def ablation_report(df: DataFrame, features: str, width: int, scorer, groups: dict[str, list[int]] = META_GROUPS, labels: int | None = None) -> DataFrame:
    """SC11. Macro-F1 per masked group and its drop from the unmasked score."""
    judged = ablate_groups(df, features, width, groups).select("masked", "y", sc.argmax(scorer(F.col("xv"))).alias("pred"))
    got = mt.summary(mt.confusion(judged, by=["masked"]), ["masked"], labels).select("masked", "macro_f1")
    base = got.filter("masked = 'none'").select("macro_f1").scalar()
    return got.withColumn("drop", base - F.col("macro_f1"))


def perturbation(df: DataFrame, key: str, features: str, names: Sequence[str], scorer, k: int) -> DataFrame:
    """SC12. Change of the predicted class's probability when one feature is set to 0.

    All variants of a row are scored in one projection; returns (key, pred, attribution map).
    """
    # logits are named columns before the softmax, which refers to each of them many times
    rows = df.select(key, F.col(features).alias("x")).withColumn("z", scorer(F.col("x"))).withColumn("p", sc.softmax(F.col("z"), k))
    rows = rows.withColumn("pred", sc.argmax(F.col("p")))
    long = rows.select(
        key, "pred", F.col("p")[F.col("pred")].alias("base"), "x",
        F.posexplode(F.array(*[F.lit(n) for n in names])).alias("j", "feature"),
    ).withColumn("xv", F.transform("x", lambda v, i: F.when(i == F.col("j"), 0.0).otherwise(v)))
    scored = long.withColumn("zv", scorer(F.col("xv"))).select(key, "pred", "feature", "base", sc.softmax(F.col("zv"), k).alias("pv"))
    delta = F.round(F.col("base") - F.col("pv")[F.col("pred")], 6)
    return scored.groupBy(key, "pred").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", delta.alias("v"))))).alias("attribution")
    )


def mean_absolute(attr: DataFrame, col: str = "attribution") -> DataFrame:
    """SC13. Mean absolute attribution per feature with its rank."""
    means = attr.select(F.explode(col).alias("feature", "v")).groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"))
    ordered = means.agg(F.sort_array(F.collect_list(F.struct((-F.col("mean_abs")).alias("neg"), "feature"))).alias("o"))  # one entry per feature
    return ordered.select(F.posexplode("o").alias("pos", "s")).select("s.feature", (-F.col("s.neg")).alias("mean_abs"), (F.col("pos") + 1).alias("rank"))
