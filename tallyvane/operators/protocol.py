"""Runs of the study from end to end: split and write, calibrate and evaluate, audit.

Each run writes tables whose size follows its input and reads back what it reports on; the driver
program sees one row per (fold, split), a few parameters, and never rows or groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.text import json_fingerprint
from tallyvane.operators import fit, metrics as mt, split as sp
from tallyvane.operators.dedup import content_dedup, union_all
from tallyvane.functions import scores as sc
from tallyvane.sources.sinks import write_json, write_params, write_table
from tallyvane.storage import cut_lineage

#: Shares of test, calibrate and select; train takes what is left.
SHARES = (0.15, 0.05, 0.10)


class LeakError(RuntimeError):
    """Rows or groups of one split are found in another."""


# ---- split ----------------------------------------------------------------------

def wanted_shares(mode: str, k: int) -> dict[str, float]:
    """Share of rows that each split should have."""
    test, calibrate, select = SHARES
    if mode == "kfold":
        test, rest = 1.0 / k, 1.0 - 1.0 / k
        calibrate, select = rest * calibrate / 0.85, (rest - rest * calibrate / 0.85) * select / 0.80
    return {"test": test, "val_calibrate": calibrate, "val_select": select, "train": 1.0 - test - calibrate - select}


def run_split(
    rows: DataFrame, out: str, group: str, by: str, mode: str = "single", seed: int | str = 42, k: int = 5,
    copies: tuple[str, str, str] | None = None, tolerance: float = 0.05, drift_pp: float = 2.0,
) -> DataFrame:
    """Remove copies, split, write, verify, and write the manifest: one row per fold and split.

    ``out/rows`` holds the rows under ``fold=`` and ``split=`` folders (one fold, 0, in mode
    "single"), ``out/balance`` the class shares, ``out/manifest`` sizes and run id. ``copies``
    names (hash, priority, sequence) columns of ``content_dedup``.

    The written rows are what is verified. A group in two splits of a fold raises ``LeakError``, a
    share of rows further off than ``tolerance`` or a missing split ``ValueError``; then there is
    no manifest, and rows without a manifest are no finished split. An empty input is refused, a
    null group or class fails the split, and an existing ``out`` is never overwritten.
    """
    if mode not in ("single", "kfold"):
        raise ValueError("mode is 'single' or 'kfold'")
    clash = {"fold", "split"} & set(rows.columns)
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    if rows.isEmpty():
        raise ValueError("no rows to split")
    spark = rows.sparkSession
    if copies:
        rows = content_dedup(rows, *copies)
    cut = sp.group_split(rows, group, seed, *SHARES).withColumn("fold", F.lit(0)) if mode == "single" else sp.group_kfold(rows, group, by, k, seed, *SHARES[1:])
    write_table(cut, f"{out}/rows", ["fold", "split"])
    done = spark.read.schema(cut.schema).parquet(f"{out}/rows")

    counts = cut_lineage(done.groupBy("fold", "split", by).agg(F.count("*").alias("n")))
    held = cut_lineage(done.select("fold", "split", group).distinct())
    leak = held.groupBy("fold", group).agg(F.count("*").alias("n")).filter("n > 1").orderBy("fold", group).limit(3).collect()
    if leak:
        raise LeakError("groups in more than one split: " + ", ".join(f"{r[group]} (fold {r['fold']})" for r in leak))

    config = {"mode": mode, "seed": seed, "k": k if mode == "kfold" else 1, "group": group, "by": by, "copies": copies}
    in_fold, in_split = Window.partitionBy("fold"), Window.partitionBy("fold", "split")  # folds x splits (x classes) rows
    sizes = counts.groupBy("fold", "split").agg(F.sum("n").alias("n_rows")).join(held.groupBy("fold", "split").agg(F.count("*").alias("n_groups")), ["fold", "split"])
    manifest = cut_lineage(sizes.select(
        json_fingerprint({c: F.lit(str(v)) for c, v in config.items()}).alias("run_id"), F.lit(mode).alias("mode"), F.lit(str(seed)).alias("seed"),
        "fold", "split", "n_rows", "n_groups", (F.col("n_rows") / F.sum("n_rows").over(in_fold)).alias("achieved")))
    want, found = wanted_shares(mode, k), {}
    for r in manifest.select("fold", "split", "achieved").collect():  # at most four rows a fold
        found.setdefault(r["fold"], {})[r["split"]] = r["achieved"]
    for fold, shares in found.items():
        for name, share in want.items():
            if abs(shares.get(name, 0.0) - share) > tolerance or name not in shares:
                raise ValueError(f"split {name} of fold {fold} has a share of {shares.get(name, 0.0):.4f}, wanted {share:.4f}")

    in_class = Window.partitionBy("fold", by)
    share, target = F.col("n") / F.sum("n").over(in_split), F.sum("n").over(in_class) / F.sum("n").over(in_fold)
    balance = counts.select("fold", "split", by, "n", share.alias("share"), target.alias("target"))
    write_table(balance.withColumn("drifts", F.abs(F.col("share") - F.col("target")) > drift_pp / 100.0), f"{out}/balance")
    write_json(manifest, f"{out}/manifest")
    return spark.read.schema(manifest.schema).json(f"{out}/manifest")


# ---- calibrate and evaluate --------------------------------------------------------

def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that both tables hold; each side is folded first, so a hot value meets itself once."""
    return a.select(column).filter(F.col(column).isNotNull()).distinct().join(b.select(column).distinct(), column, "left_semi")


def require_disjoint(fit_rows: DataFrame | None, test_rows: DataFrame, columns: Sequence[str], allow_leak: bool = False) -> None:
    """Refuse a fit on the rows, or on groups of the rows, that it is judged by."""
    if allow_leak:
        return
    if fit_rows is None:
        raise LeakError("no calibration rows: fitting on the test rows needs allow_leak=True")
    for column in columns:
        shared = overlap(fit_rows, test_rows, column).orderBy(column).limit(3).collect()
        if shared:
            raise LeakError(f"{column} in both calibration and test rows, e.g. " + ", ".join(str(r[0]) for r in shared))


@dataclass
class Evaluation:
    """Fitted parameters (``sinks.PARAMS_SCHEMA``) and metrics in long form."""

    params: dict
    metrics: DataFrame


def calibrate_and_evaluate(
    fit_rows: DataFrame | None, test_rows: DataFrame, k: int, train_prior: Sequence[float], keys: Sequence[str] = ("row_id",),
    out: str | None = None, allow_leak: bool = False, prior_steps: int = 500, unfinished: bool = False,
) -> Evaluation:
    """Fit temperatures, Dirichlet map and target prior on ``fit_rows``; judge all of them on ``test_rows``.

    Both tables have y, z (K logits) and the ``keys`` (row ids, group ids) that they may not share:
    a shared value, or no ``fit_rows``, raises ``LeakError`` unless ``allow_leak``. ``train_prior``
    is the class distribution the model was trained on and has no default: taking it from the
    calibration rows would hide the very shift that the target prior is to show. The primary scores
    are those of the temperatures per class. A target prior that has not converged in ``prior_steps``
    fails, unless ``unfinished`` asks for the last iterate. With ``out`` the parameters and metrics are written.
    """
    if len(train_prior) != k or abs(sum(train_prior) - 1.0) > 1e-6 or min(train_prior) < 0:
        raise ValueError(f"train_prior must be {k} shares that add up to 1")
    require_disjoint(fit_rows, test_rows, keys, allow_leak)
    source = (test_rows if fit_rows is None else fit_rows).select("y", "z").persist()
    try:
        scalar, _ = fit.fit_temperature(source, k)
        per_class, _ = fit.fit_class_temperatures(source, k)
        weight, bias, _ = fit.fit_dirichlet(source, k)
    finally:
        source.unpersist()
    raw = test_rows.select(sc.softmax(F.col("z"), k).alias("p")).persist()
    try:
        target, _ = fit.sld_prior(raw, list(train_prior), k, prior_steps, unfinished=unfinished)
    finally:
        raw.unpersist()
    params = {
        "temperature": float(scalar), "class_temperature": [float(t) for t in per_class], "weight": [[float(x) for x in r] for r in weight],
        "bias": [float(b) for b in bias], "scales": None, "train_prior": [float(p) for p in train_prior], "target_prior": target, "threshold": None,
    }
    report = fit.calibration_report(test_rows.select("y", "z"), k, scalar, per_class, weight, bias)
    p = test_rows.select("y", sc.softmax(sc.temperature(F.col("z"), k, per_class=per_class), k).alias("p"))
    scored = p.select("y", "p", sc.argmax(F.col("p")).alias("pred"))
    conf = cut_lineage(mt.confusion(scored))
    long = union_all([
        long_form(mt.summary(conf), "headline", [], ["accuracy", "macro_f1", "weighted_f1"]),
        long_form(mt.class_report(conf), "per_class", ["cls"], ["precision", "recall", "f1", "support"]),
        long_form(report, "calibration", ["method"], ["nll", "ece", "mce", "brier", "accuracy"]),
    ])
    if out:
        write_params(test_rows.sparkSession, params, f"{out}/calibration")
        write_table(long, f"{out}/metrics")
        long = test_rows.sparkSession.read.schema(long.schema).parquet(f"{out}/metrics")
    return Evaluation(params, long)


# ---- audit ------------------------------------------------------------------------

def long_form(df: DataFrame, name: str, scope: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(name, scope, key, value): one row per row of ``df`` and value; ``scope`` is "column=value/..." or "all"."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in scope]
    pairs = F.array(*[F.struct(F.lit(v).alias("key"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(name).alias("name"), (F.concat_ws("/", *parts) if parts else F.lit("all")).alias("scope"), F.inline(pairs))


def audit_bundle(
    df: DataFrame, group: str, k: int, watch_class: int = 0, points: Sequence[float] = (0.5, 0.7, 0.9, 1.0),
    variants: Mapping[str, DataFrame] | None = None, attribution: DataFrame | None = None, out: str | None = None,
) -> DataFrame:
    """All audits of one table of predictions as (name, scope, key, value).

    ``df``: row_id, ``group``, y, p, pred, conf, and fitzpatrick, sex and age, each of which may be
    absent. ``variants`` holds (y, pred) of the same rows scored with some metadata left out,
    judged against ``df``; ``attribution`` holds (cls, feature, value). Cohorts too small to judge
    have a count and null metrics. With ``out`` the table and one JSON document
    {name: {scope: {key: value}}} are written; its size follows cohorts and classes, not rows.
    """
    columns = [c for c in ("fitzpatrick", "sex", "age") if c in df.columns]
    sections = [
        long_form(mt.fairness(df, watch_class, columns=columns), "fairness", ["dim", "cohort"], ["n", "macro_f1", "watched_recall"]),
        long_form(mt.rollup_report(df, group, k), "per_group", ["level"], ["n", "macro_f1"]),
        long_form(mt.accuracy_at_coverage(df, points), "selective", ["point"], ["n", "accuracy"]),
        long_form(mt.miss_rates(df, watch_class), "missed", ["threshold"], ["n", "miss_rate"]),
    ]
    if variants:
        tagged = [d.select(F.lit(v).alias("variant"), "y", "pred") for v, d in {"all": df, **variants}.items()]
        sections.append(long_form(fit.variant_report(union_all(tagged), "all"), "missing_metadata", ["variant"], ["accuracy", "macro_f1", "delta"]))
    if attribution is not None:
        mean = attribution.groupBy("cls", "feature").agg(F.avg("value").alias("mean"))
        sections.append(long_form(mean, "attribution", ["cls", "feature"], ["mean"]))
    bundle = union_all(sections)
    if out:
        write_table(bundle, f"{out}/metrics")
        bundle = df.sparkSession.read.schema(bundle.schema).parquet(f"{out}/metrics")
        as_json(bundle).write.text(f"{out}/audit")
    return bundle


def as_json(bundle: DataFrame) -> DataFrame:
    """One row, one column ``value``: the bundle as nested JSON, keys in order, null values kept."""
    folded = bundle
    for by, pair in ((["name", "scope"], ["key", "value"]), (["name"], ["scope", "inner"]), ([], ["name", "inner"])):
        pairs = F.collect_list(F.struct(F.col(pair[0]).alias("k"), F.col(pair[1]).alias("v")))
        in_order = F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        folded = folded.groupBy(*by).agg(F.map_from_entries(in_order).alias("inner"))
    return folded.select(F.to_json("inner", {"ignoreNullFields": "false"}).alias("value"))
