"""Quality gates, per-record jobs, distribution distance and their reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.text import fixed
from tallyvane.operators import dedup as dd
from tallyvane.operators.ranking import exact_median
from tallyvane.operators.vectors import add_vectors
from tallyvane.schema import QUALITY, RECORD_JOB
from tallyvane.storage import cut_lineage

SIMILARITY_LIMIT = 0.65


# ---- metric statistics --------------------------------------------------------

def metric_stats(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG4. mean, population std, min and max of each metric, long form, one scan."""
    aggs = [
        a for m in metrics for a in (
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")
        )
    ]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"),
            F.col(f"{m}_min").alias("min"), F.col(f"{m}_max").alias("max"),
        )
        for m in metrics
    ])))


def class_medians(df: DataFrame, by: str, numeric: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """AGG5. Exact per-class median of each column as ``med_<c>``; booleans count as 0/1."""
    cols = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in [*numeric, *flags]]
    long = df.select(by, F.inline(F.array(*cols)))
    med = exact_median(long, ["metric", by], "v")
    return med.groupBy(by).agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"med_{c}") for c in [*numeric, *flags]])


def grade(candidates: DataFrame, real: DataFrame, metrics: Sequence[str], wide: str | None = None, digits: int = 1) -> DataFrame:
    """QG2. PASS/FAIL against the real mean ± 2 std (upper side 3 std for ``wide``), with reasons."""
    stats = real.agg(F.struct(*[
        F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(m) for m in metrics
    ])).scalar()
    reasons = []
    rows = candidates.withColumn("_s", stats)
    for m in metrics:
        lo = F.col("_s")[m]["mean"] - 2 * F.col("_s")[m]["std"]
        hi = F.col("_s")[m]["mean"] + (3 if m == wide else 2) * F.col("_s")[m]["std"]
        text = F.concat(F.lit(f"{m}="), fixed(F.col(m), digits), F.lit(" outside ["), fixed(lo, digits), F.lit(", "), fixed(hi, digits), F.lit("]"))
        reasons.append(F.when((F.col(m) < lo) | (F.col(m) > hi), text))
    rows = rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return rows.select(
        *candidates.columns, F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL").alias("grade"),
        F.array_join("reasons", "; ").alias("fail_reasons"),
    )


def gate_by_class(candidates: DataFrame, real: DataFrame, by: str, metrics: Sequence[str], wide: str | None = None) -> DataFrame:
    """QG3. Each class against its own real statistics: total, passed and pass rate."""
    stats = real.groupBy(by).agg(F.struct(*[
        F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(m) for m in metrics
    ]).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct(by, "s")))).scalar()
    rows = candidates.withColumn("_s", F.try_element_at(stats, F.col(by)))
    ok = F.lit(True)
    for m in metrics:
        s = F.col("_s")[m]
        ok = ok & (F.col(m) >= s["mean"] - 2 * s["std"]) & (F.col(m) <= s["mean"] + (3 if m == wide else 2) * s["std"])
    return rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"),
    ).withColumn("pass_rate_pct", F.round(100.0 * F.col("passed") / F.col("total"), 2))


def verdict(fid: Column, pass_rate: Column) -> Column:
    """AGG33. From the distribution distance and the pass rate in 0..1."""
    return (
        F.when((fid < 50) & (pass_rate > 0.85), "PASS")
        .when((fid < 100) & (pass_rate > 0.70), "MARGINAL")
        .otherwise("REVIEW")
    )


def metric_distance(real: DataFrame, synth: DataFrame, metrics: Sequence[str], by: str | None = None) -> DataFrame:
    """AGG30. Diagonal Frechet distance of two row sets over metrics in units of the real deviation: (by, fid).

    Means and variances per metric, side and class come from one aggregate, folded map-side.
    """
    keys = [by] if by else []
    rows = real.select(*keys, *metrics, F.lit("a").alias("_side")).unionByName(synth.select(*keys, *metrics, F.lit("b").alias("_side")))
    of = lambda t, m: F.when(F.col("_side") == t, F.col(m))
    both = rows.groupBy(*keys).agg(*[x for t in "ab" for m in metrics for x in (F.avg(of(t, m)).alias(f"{t}m_{m}"), F.var_samp(of(t, m)).alias(f"{t}v_{m}"))])
    term = lambda m: (F.pow(F.col(f"am_{m}") - F.col(f"bm_{m}"), F.lit(2.0)) + F.col(f"av_{m}") + F.col(f"bv_{m}") - 2 * F.sqrt(F.col(f"av_{m}") * F.col(f"bv_{m}"))) / F.nullif(F.col(f"av_{m}"), F.lit(0.0))
    total = term(metrics[0])
    for m in metrics[1:]:
        total = total + term(m)
    return both.select(*keys, total.alias("fid"))


def surplus_copies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG33. One row: how many rows repeat an earlier one in all ``columns``."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_copies"))


def near_duplicate_pairs(df: DataFrame, key: str, text: str, limit: int = 8) -> DataFrame:
    """AGG33. One row: pairs of rows whose fingerprints differ in fewer than ``limit`` bits, copies counted and not paired."""
    prints = cut_lineage(dd.copies(dd.simhash(df, key, text), key))
    return dd.near_pair_totals(prints, limit).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).cast("long").alias("near_duplicates"))


def quality_summary(graded: DataFrame, real: DataFrame, fid: Column | float | None, near_duplicates: Column | int = 0, name: str = "near_duplicates") -> DataFrame:
    """AGG33. One row: counts, pass rate, distance, verdict. Distance and duplicates may be scalars of tables; ``name`` says which duplicates."""
    return graded.agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("grade") == "PASS").alias("pass_count"),
        F.count_if(F.col("grade") == "FAIL").alias("fail_count"),
    ).select(
        "*", real.agg(F.count("*")).scalar().alias("real_count"),
        F.round(100.0 * F.col("pass_count") / F.nullif(F.col("candidate_count"), F.lit(0)), 2).alias("pass_rate_pct"),
        F.lit(fid).cast("double").alias("fid"), F.lit(near_duplicates).cast("long").alias(name),
        verdict(F.lit(fid).cast("double"), F.col("pass_count") / F.greatest("candidate_count", F.lit(1))).alias("verdict"),
    )


def class_manifest(real: DataFrame, synth: DataFrame, by: str, gate: DataFrame, distances: DataFrame) -> DataFrame:
    """AGG29. Per class: real, synthetic and total counts, ratio, distance and pass rate. ``distances``: (by, fid)."""
    both = real.select(by, F.lit(1).alias("r")).unionByName(synth.select(by, F.lit(0).alias("r")))
    counts = both.groupBy(by).agg(F.sum("r").cast("long").alias("real_images"), F.count_if(F.col("r") == 0).alias("synthetic_images"))
    return counts.join(gate.select(by, "pass_rate_pct"), by, "left").join(distances.select(by, "fid"), by, "left").select(
        by, "real_images", "synthetic_images", (F.col("real_images") + F.col("synthetic_images")).alias("total_images"),
        F.when(F.col("real_images") > 0, F.round(F.col("synthetic_images") / F.col("real_images"), 2)).otherwise(0.0).alias("synth_ratio"),
        F.round("fid", 2).alias("fid"), "pass_rate_pct",
    )


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """AGG31. Equal-width histogram between the observed minimum and maximum, empty bins included."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = df.withColumn("_s", span)
    width = (F.col("_s")["hi"] - F.col("_s")["lo"]) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_s")["lo"]) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = placed.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def similarity_audit(df: DataFrame, score: str, limit: float = SIMILARITY_LIMIT) -> DataFrame:
    """AGG31. Mean, minimum, maximum and the number below the limit."""
    return df.agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.count_if(F.col(score) < limit).alias("below_limit"),
    )


def stage_failures(manifest: DataFrame) -> DataFrame:
    """AGG6. Records, time and share by outcome stage ('ok' for success)."""
    return manifest.groupBy(F.when(F.col("ok"), "ok").otherwise(F.coalesce("failed_stage", F.lit("unknown"))).alias("stage")).agg(
        F.count("*").alias("n")
    ).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per stage


def throughput(manifest: DataFrame) -> DataFrame:
    """AGG6. ok/fail counts and records per second of task time."""
    return manifest.agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        (1000.0 * F.count("*") / F.nullif(F.sum("elapsed_ms"), F.lit(0.0))).alias("records_per_task_second"),
    )


# ---- distribution distance ----------------------------------------------------

def gram_sums(df: DataFrame, features: str, by: str) -> DataFrame:
    """(by, sums) per group: n, Σx and the upper triangle of Σx·xᵀ as bytes; one vector per task and group, added in a tree."""
    kind = dict(df.dtypes)[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby(by):
                x = np.stack(part[features].to_numpy()).astype(float)
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])]])
                sums[g] = flat if g not in sums else sums[g] + flat
        yield pd.DataFrame({by: list(sums), "sums": [v.tobytes() for v in sums.values()]})

    return add_vectors(df.select(by, features).mapInPandas(run, f"{by} {kind}, sums binary"), [by])


def _moments(rows: list, group, by: str) -> tuple[int, np.ndarray, np.ndarray]:
    flat = np.frombuffer(next(r["sums"] for r in rows if r[by] == group), dtype=np.float64)
    d = int((-3 + np.sqrt(9 + 8 * (len(flat) - 1))) / 2)  # 1 + d + d (d + 1) / 2 numbers
    n = flat[0]
    mean = flat[1:1 + d] / n
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = flat[1 + d:]
    gram = gram + np.triu(gram, 1).T
    cov = (gram - n * np.outer(mean, mean)) / max(n - 1, 1)
    return int(n), mean, cov


def _psd_root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T


def frechet_distance(df: DataFrame, features: str, by: str, a, b) -> float:
    """AGG30. |μa−μb|² + tr(Σa + Σb − 2(Σa^½ Σb Σa^½)^½) with sample covariances.

    Moments are distributed sums over all rows; only the d x d root is taken on the driver.
    """
    rows = gram_sums(df.filter(F.col(by).isin(a, b)), features, by).collect()  # 1 + d + d² numbers per set
    _, ma, ca = _moments(rows, a, by)
    _, mb, cb = _moments(rows, b, by)
    root = _psd_root(ca)
    cross = _psd_root(root @ cb @ root)
    return float((ma - mb) @ (ma - mb) + np.trace(ca) + np.trace(cb) - 2 * np.trace(cross))


def frechet_diagonal(df: DataFrame, features: str, by: str, a, b, d: int) -> DataFrame:
    """AGG30. The diagonal form: Σ (Δmean)² + va + vb − 2·√(va·vb), all in one aggregate."""
    def side(v, fn):
        return [fn(F.when(F.col(by) == v, F.col(features)[i].cast("double"))) for i in range(d)]
    means = df.groupBy(by).agg(
        F.array(*[F.avg(F.col(features)[i].cast("double")) for i in range(d)]).alias("m"),
        F.array(*[F.var_samp(F.col(features)[i].cast("double")) for i in range(d)]).alias("v"),
    )
    pick = lambda g, c: F.max(F.when(F.col(by) == g, F.col(c)))
    both = means.agg(pick(a, "m").alias("ma"), pick(b, "m").alias("mb"), pick(a, "v").alias("va"), pick(b, "v").alias("vb"))
    term = lambda t: F.pow(t["ma"] - t["mb"], F.lit(2.0)) + t["va"] + t["vb"] - 2 * F.sqrt(t["va"] * t["vb"])
    return both.select(F.aggregate(F.arrays_zip("ma", "mb", "va", "vb"), F.lit(0.0), lambda s, t: s + term(t)).alias("fid_diagonal"))


# ---- image statistics ---------------------------------------------------------

def _gray(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14  # 14-bit fixed-point luma


def image_stats(height: int, width: int, channels: int, data: bytes) -> tuple[float, ...]:
    """Laplacian variance, mean gray, mean HSV saturation and RGB means of one decoded image."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    bgr = np.repeat(px, 3, axis=2) if channels == 1 else px[..., :3]
    gray = _gray(bgr)
    pad = np.pad(gray, 1, mode="reflect") if min(height, width) > 1 else np.pad(gray, 1, mode="edge")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * gray
    top, low = bgr.max(axis=2).astype(np.int64), bgr.min(axis=2).astype(np.int64)
    scale = np.where(top > 0, np.rint((255 << 12) / np.maximum(top, 1)), 0).astype(np.int64)
    sat = ((top - low) * scale + 2048) >> 12
    return (
        float(lap.var()), float(gray.mean()), float(sat.mean()),
        float(bgr[..., 2].mean()), float(bgr[..., 1].mean()), float(bgr[..., 0].mean()),
    )


def folder_stats(images: DataFrame) -> DataFrame:
    """QG1. One quality record per decodable image row (file, image struct as the image source
    gives it). An undecodable image yields no row."""
    fields = [f.name for f in QUALITY.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out.append((row.file, *image_stats(row.height, row.width, row.nChannels, row.data)))
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=fields)

    return images.select("file", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, QUALITY)


# ---- stage-tracked record jobs ------------------------------------------------

Stage = tuple[str, Callable[[bytes], bytes]]


def run_stages(df: DataFrame, stages: Sequence[Stage], key: str = "id", content: str = "content") -> DataFrame:
    """QG4. Run the stages over each record's bytes; never raise.

    A failing record keeps the stage's name and its error and has no output. Exactly one result
    row per input row; sha1 of the output is added natively.
    """
    names = [f.name for f in RECORD_JOB.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, body in zip(pdf[key], pdf[content]):
                began, at, failed, error = time.perf_counter(), None, None, None
                try:
                    for at, fn in stages:
                        body = fn(body)
                except Exception as e:
                    failed, error, body = at, f"{type(e).__name__}: {e}", None
                out.append((rid, failed is None, failed, error, 1000 * (time.perf_counter() - began), body))
            yield pd.DataFrame(out, columns=names)

    source = df.select(F.col(key).cast("string").alias(key), content)
    done = source.mapInPandas(run, RECORD_JOB)
    return done.withColumn("output_sha1", F.sha1("output"))


def pending(inputs: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """QG5. Inputs that the manifest does not already hold as done."""
    return inputs.join(manifest.filter("ok").select(key), key, "left_anti")


# ---- heat maps ----------------------------------------------------------------

def summarize_heat(df: DataFrame, key: str, cells: str, width: int, size: int = 384) -> DataFrame:
    """ARR1. Peak, named region and active area of each row's grid (flat array, row-major).

    Values are shifted to 0 and scaled to 1. Active cells reach max(.55, 85th percentile);
    the percentile interpolates linearly. A grid is one bounded row, so it stays in its row.
    """
    from tallyvane.functions.clinical import region, zone_family
    from tallyvane.functions.scores import let
    raw = F.transform(F.col(cells), lambda v: F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v.cast("double")))
    rows = df.filter(F.size(cells) > 0).select(key, raw.alias("a"), (F.size(cells) / width).cast("int").alias("height"))
    shifted = let(F.array_min("a"), lambda least: F.transform("a", lambda v: v - least))
    rows = rows.select(key, "height", shifted.alias("a"))
    scaled = let(F.array_max("a"), lambda most: F.when(most > 0, F.transform("a", lambda v: v / most)).otherwise(F.col("a")))
    rows = rows.select(key, "height", scaled.alias("a"))
    at = (F.size("a") - 1) * 0.85
    ordered = F.array_sort("a")
    lo, hi = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    rows = rows.select(
        key, "height", "a", (F.array_position("a", F.array_max("a")) - 1).cast("int").alias("pos"),
        F.greatest(F.lit(0.55), lo + (hi - lo) * (at - F.floor(at))).alias("cut"),
    )
    rows = rows.select(
        key, ((F.col("pos") % width) / max(width - 1, 1)).alias("x"),
        (F.floor(F.col("pos") / width) / F.greatest(F.col("height") - 1, F.lit(1))).alias("y"),
        F.round(100.0 * F.size(let(F.col("cut"), lambda cut: F.filter("a", lambda v: v >= cut))) / F.size("a"), 1).alias("area_pct"),
    )
    named = rows.withColumn("region", region(F.col("x"), F.col("y")))
    return named.select(
        key, "region", zone_family(F.col("region")).alias("zone_family"), "area_pct",
        F.bround(F.col("x") * (size - 1)).cast("int").alias("peak_x"), F.bround(F.col("y") * (size - 1)).cast("int").alias("peak_y"),
    )
