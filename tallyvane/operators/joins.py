"""Row filters, index joins and listing checks over manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.operators.ranking import cut_array, hash_cuts
from tallyvane.functions.encode import order_key


def attach_metadata(labels: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """JN1. Labels keep every row; the physical join is left to the adaptive planner."""
    return labels.join(meta, key, "left")


def known_label(df: DataFrame, unknown: str = "UNK") -> DataFrame:
    """FLT1. Drop rows flagged as unknown class; a null flag is not a flag."""
    return df.filter(~F.col(unknown).eqNullSafe(F.lit(1.0)))


def existing(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """FLT2/JN3. Rows whose file is in the listing."""
    return df.join(listing.select(key), key, "left_semi")


def low_confidence(df: DataFrame, threshold: float = 0.7, conf: str = "conf") -> DataFrame:
    """FLT5. Rows below a confidence; a row without one is not below it."""
    return df.filter(F.col(conf) < threshold)


def drop_invalid(df: DataFrame, *valid: Column) -> DataFrame:
    """FLT6. Rows that meet every condition; an unknown condition is not met."""
    for v in valid:
        df = df.filter(F.coalesce(v, F.lit(False)))
    return df


def listed_rows(df: DataFrame, listed: DataFrame, key: str, cls: str, classes: Sequence[object]) -> DataFrame:
    """FLT10. Rows of the chosen classes whose id is listed; an id listed twice brings a row once."""
    return df.filter(F.col(cls).isin(list(classes))).join(listed.select(key), key, "left_semi")


def check_sample(df: DataFrame, listing: DataFrame, key: str, n: int = 20, seed: int | str = 0, fail: bool = True) -> DataFrame:
    """FLT3. A seeded sample of ``n`` rows with ``exists``; optionally a missing file fails the query."""
    cut = cut_array(hash_cuts(df.select(key), [], [key], seed, lambda t: [F.lit(n).cast("long")]))
    sample = df.filter(order_key(seed, F.col(key)) <= cut[0]).select(key)
    seen = sample.join(listing.select(key).distinct().withColumn("_e", F.lit(True)), key, "left").select(key, F.coalesce("_e", F.lit(False)).alias("exists"))
    if not fail:
        return seen
    return seen.withColumn("exists", F.when(F.col("exists"), True).otherwise(
        F.raise_error(F.concat(F.lit("file missing for "), F.col(key).cast("string"))).cast("boolean")))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """FLT7. Fails while the plan is built, before any row is read."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing required columns: {gone}")
    return df


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN8/JN9. Two aggregates or tables matched by an explicit key, never by position."""
    return left.join(right, key)


def intake_errors(js: Column) -> Column:
    """FLT8. Error codes of one intake document: 400 for bad JSON, 422 per missing field."""
    doc = F.from_json(js, "ageYears double, sex string, anatomicalSite string, modelMode string, _bad string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    sex = F.lower(F.trim(doc["sex"]))
    bad = js.isNull() | doc.isNull() | doc["_bad"].isNotNull()
    return F.when(bad, F.array(F.lit("400 metadata must be valid JSON"))).otherwise(F.array_compact(F.array(
        F.when(doc["ageYears"].isNull(), "422 ageYears is required"),
        F.when(~F.coalesce(sex.isin("female", "male"), F.lit(False)), "422 sex is required"),
        F.when(F.trim(F.coalesce(doc["anatomicalSite"], F.lit(""))).isin("", "Unknown"), "422 anatomicalSite is required"),
    )))


def split_intake(df: DataFrame, js: str) -> DataFrame:
    """FLT8. Adds ``errors`` and ``accepted``; callers filter into the good and the reject table."""
    return df.withColumn("errors", intake_errors(F.col(js))).withColumn("accepted", F.size("errors") == 0)


def history_filter(entries: DataFrame, mode: str) -> DataFrame:
    """FLT9. 'patient' keeps the same patient, 'high' keeps high concern, 'all' keeps everything."""
    if mode == "patient":
        return entries.filter("samePatient")
    if mode == "high":
        return entries.filter(F.col("urgency") == "High concern")
    if mode == "all":
        return entries
    raise ValueError(f"unknown history filter: {mode}")


# --- Fixed values: review severity -------------------------------------------
STATUS_SEVERITY = {"Senior review": 3, "In review": 2, "Needs review": 1, "Reviewed": 0}
# -----------------------------------------------------------------------------


def severity(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_SEVERITY.items() for x in kv])
    return F.try_element_at(table, status)


def review_order(date: Column, status: Column, conf: Column, key: Column) -> list[Column]:
    """SRT6. Newest first, undated last; then severity, confidence, id."""
    return [date.desc_nulls_last(), severity(status).desc(), conf.desc(), key.asc()]


def review_array(entries: Column) -> Column:
    """SRT6 inside one case: its entries array sorted by the same rule."""
    def cmp(a: Column, b: Column) -> Column:
        def step(x: Column, y: Column) -> Column:
            return F.when(x > y, -1).when(x < y, 1)
        return F.coalesce(
            F.when(a["date"].isNull() & b["date"].isNotNull(), 1).when(a["date"].isNotNull() & b["date"].isNull(), -1),
            step(a["date"], b["date"]), step(severity(a["status"]), severity(b["status"])),
            step(a["confidence"], b["confidence"]), step(b["id"], a["id"]), F.lit(0),
        )
    return F.array_sort(entries, cmp)


def top_per_class(
    df: DataFrame, by: str, order: Sequence[Column], n: int, pool: int | None = None, pool_order: Sequence[Column] = ()
) -> DataFrame:
    """SRT5/SRT7. The n best rows of each class, optionally out of the first ``pool`` by another order.

    A rank filter on a window also runs below the exchange, so each task sends at most n rows of a
    class however hot the class is.
    """
    rows = df
    if pool is not None:
        first = Window.partitionBy(by).orderBy(*pool_order)
        rows = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= pool).drop("_r")
    best = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
