"""View and model averaging in logit space, and the full calibrated prediction chain."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc


def mean_views(df: DataFrame, k: int) -> DataFrame:
    """SC3. Mean logits over views; a row's views are a bounded group, folded map-side."""
    return df.groupBy("row_id", "model").agg(F.first("y").alias("y"), F.array(*[F.avg(F.col("z")[i]) for i in range(k)]).alias("z"))


def blend_models(df: DataFrame, k: int, weights: Mapping[object, float] | None = None) -> DataFrame:
    """SC4. Logit-space ensemble: uniform mean, or the weighted sum when weights are given."""
    if weights is None:
        return df.groupBy("row_id").agg(F.first("y").alias("y"), F.array(*[F.avg(F.col("z")[i]) for i in range(k)]).alias("z"))
    w = F.lit(0.0)
    for m, v in weights.items():
        w = F.when(F.col("model") == m, v).otherwise(w)
    return df.groupBy("row_id").agg(F.first("y").alias("y"), F.array(*[F.sum(w * F.col("z")[i]) for i in range(k)]).alias("z"))


def calibrated_predict(
    df: DataFrame, k: int, *, per_class=None, scalar=None, weight=None, bias=None, train=None, target=None,
    scales=None, watch: int = 0, threshold=None, on: str = "raw",
) -> DataFrame:
    """SC10. The chain in its fixed order on mean logits: temperature, Dirichlet, prior shift on
    logits, softmax, class scales, safety override. Every step without parameters is skipped."""
    z = sc.temperature(F.col("z"), k, per_class, scalar) if per_class is not None or scalar is not None else F.col("z")
    rows = df.withColumn("zt", z)
    if weight is not None:
        rows = rows.withColumn("zt", sc.dirichlet(F.col("zt"), weight, bias, k))
    if train is not None and target is not None:
        rows = rows.withColumn("zt", sc.shift_logits(F.col("zt"), train, target, k))
    rows = rows.withColumn("raw_p", sc.softmax(F.col("zt"), k))
    rows = rows.withColumn("p", sc.scale_probs(F.col("raw_p"), scales, k) if scales is not None else F.col("raw_p"))
    watched = F.col("raw_p") if on == "raw" else F.col("p")
    return rows.withColumns({
        "override": sc.override_flag(watched, watch, threshold),
        "pred": sc.override_pred(sc.argmax(F.col("p")), watched, watch, threshold),
    })
