"""Evaluation and audit metrics, all derived from three small aggregates.

Confusion counts (K x K), confidence bins and ordered score counts are each one partial+final
aggregation over the predictions; what follows only touches the aggregated rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators.ranking import prefix_sums

MIN_COHORT = 30
#: Score prefixes: binary places per level, levels, and rows that one task may rank.
SCORE_BITS, SCORE_LEVELS, FEW_ROWS = 12, 4, 50_000


def ratio(num: Column, den: Column) -> Column:
    """num/den with a zero denominator giving 0, the zero-division rule of every report."""
    return F.when(den > 0, num / den).otherwise(0.0)


# ---- confusion family ---------------------------------------------------------

def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Non-zero confusion counts (by..., y, pred, n). ``n`` names the column that says how many rows a row stands for."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg((F.sum(n) if n else F.count("*")).alias("n"))


def confusion_matrix(df: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """AGG7. All K x K cells, zeros included."""
    spine = df.sparkSession.range(k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("y"), (F.col("id") % k).cast("int").alias("pred")
    )
    # a union instead of an outer join: no null check on the keys is pushed down to the scores
    cells = spine.withColumn("n", F.lit(0).cast("long")).unionByName(confusion(df, y, pred))
    return cells.groupBy("y", "pred").agg(F.sum("n").alias("n"))


def confusion_pivot(df: DataFrame, k: int) -> DataFrame:
    """AGG7. One row per true class, one column per predicted class."""
    return df.groupBy("y").agg(*[F.count_if(F.col("pred") == c).alias(f"pred_{c}") for c in range(k)])


def class_counts(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, support and predicted count of every class met in truth or prediction."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = conf.select(
        *by,
        F.inline(F.array(
            F.struct(F.col("y").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
            F.struct(F.col("pred").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
        )),
    )
    return sides.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def class_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG9. Precision, recall, F1 and support by class; zero division counts as 0."""
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return class_counts(conf, by).select(
        *by, "cls", "tp", "support", "predicted",
        ratio(tp, p).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, p + s).alias("f1"),
    )


def summary(conf: DataFrame, by: Sequence[str] = (), labels: int | None = None) -> DataFrame:
    """AGG9. accuracy, macro and weighted F1.

    ``labels=None`` averages over the classes present in truth or prediction;
    an int averages over that many fixed classes.
    """
    report = class_report(conf, by)
    macro = F.avg("f1") if labels is None else F.sum("f1") / labels
    total = F.sum("support")
    return report.groupBy(*by).agg(
        total.alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        macro.alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
    )


def sensitivity_specificity(conf: DataFrame) -> DataFrame:
    """AGG8."""
    counts = class_counts(conf)
    n = F.sum("support").over(Window.partitionBy())  # K rows
    tn = F.col("n") - F.col("support") - F.col("predicted") + F.col("tp")
    return counts.withColumn("n", n).select(
        "cls", ratio(F.col("tp"), F.col("support")).alias("sensitivity"),
        ratio(tn, F.col("n") - F.col("support")).alias("specificity"),
    )


def weighted_f1(conf: DataFrame, weights: Sequence[float]) -> DataFrame:
    """AGG10. Sum of w·F1 over sum of w."""
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("cls"))
    return class_report(conf).agg((F.sum(w * F.col("f1")) / F.lit(float(sum(weights)))).alias("weighted_f1"))


def binary_rates(df: DataFrame, cls: int) -> DataFrame:
    """AGG27. Recall and specificity of one class, denominators guarded by max(·, 1)."""
    pos, hit = F.col("y") == cls, F.col("pred") == cls
    guard = lambda c: F.greatest(F.count_if(c), F.lit(1))
    return df.agg(
        (F.count_if(pos & hit) / guard(pos)).alias("recall"),
        (F.count_if(~pos & ~hit) / guard(~pos)).alias("specificity"),
    )


def confusion_pairs(conf: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """AGG28. Count and row rate of chosen true -> predicted pairs, zeros included."""
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("y"), F.lit(p).alias("pred"),
            count((F.col("y") == t) & (F.col("pred") == p)).alias("n"),
            count(F.col("y") == t).alias("total"),
        )
        for t, p in pairs
    ])
    return conf.agg(rows.alias("r")).select(F.inline("r")).withColumn("rate", ratio(F.col("n"), F.col("total")))


# ---- proper scores ------------------------------------------------------------

def brier(df: DataFrame, k: int, p: str = "p", y: str = "y") -> Column:
    """AGG12 as an aggregate expression."""
    return F.avg(sc.fold_sum([
        F.pow(F.col(p)[i] - F.when(F.col(y) == i, 1.0).otherwise(0.0), F.lit(2.0)) for i in range(k)
    ]))


def soft_macro_f1(df: DataFrame, k: int, eps: float = 1e-7) -> DataFrame:
    """AGG26. 1 − mean soft F1, from per-class sums of p·y, p·(1−y) and (1−p)·y."""
    y = lambda i: F.when(F.col("y") == i, 1.0).otherwise(0.0)
    p = lambda i: F.col("p")[i]
    sums = df.agg(*[
        e for i in range(k) for e in (
            F.sum(p(i) * y(i)).alias(f"tp{i}"),
            F.sum(p(i) * (1 - y(i))).alias(f"fp{i}"),
            F.sum((1 - p(i)) * y(i)).alias(f"fn{i}"),
        )
    ])
    f1 = [2 * F.col(f"tp{i}") / (2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}") + eps) for i in range(k)]
    return sums.select((1 - sc.fold_sum(f1) / k).alias("soft_macro_f1_loss"))


# ---- calibration bins ---------------------------------------------------------

def calibration_bins(
    df: DataFrame, value: Column, hit: Column, by: Sequence[str] = (), bins: int = 15, closed: str = "left"
) -> DataFrame:
    """AGG17. Non-empty bins: count, accuracy, confidence and centre."""
    keyed = df.select(*by, sc.bin_index(value, bins, closed).alias("bin"), value.alias("_v"), hit.cast("double").alias("_h"))
    return keyed.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("_h").alias("accuracy"), F.avg("_v").alias("confidence")
    ).withColumn("centre", (F.col("bin") + 0.5) / bins)


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG14/AGG16. Expected and maximum calibration error from the bins."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def one_vs_rest(df: DataFrame, k: int, keep: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Long form (cls, score, positive): K rows per prediction, folded map-side by what follows.

    A literal array of structs needs no emptiness check, which would re-evaluate the scores.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("cls"), F.col(p)[i].alias("score"), (F.col(y) == i).alias("positive")) for i in range(k)
    ])
    return df.select(*keep, F.inline(cells))


def auc_one_vs_rest(df: DataFrame, k: int) -> DataFrame:
    """AGG11/WIN5. Tie-averaged Mann-Whitney AUC of each class.

    Scores are counted per distinct value before ordering, so ties cost nothing and the running
    totals are range-partitioned.
    """
    counted = one_vs_rest(df, k).groupBy("cls", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    run = prefix_sums(counted, ["cls"], [F.col("score")], ["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)
    return run.groupBy("cls").agg(
        F.sum(wins).alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    ).select(
        "cls", "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
    )


def average_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """WIN5. Rank of each distinct value within its group, ties sharing the average rank."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    run = prefix_sums(counted, [group], [F.col(value)], ["n"])
    return run.select(group, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


# ---- cohorts and groups -------------------------------------------------------

def min_cohort(df: DataFrame, metrics: Sequence[str], least: int = MIN_COHORT, n: str = "n") -> DataFrame:
    """FLT4. Metrics of cohorts under ``least`` rows become null; the cohort keeps its count."""
    return df.withColumns({m: F.when(F.col(n) >= least, F.col(m)) for m in metrics})


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """AGG3. Distinct groups and rows."""
    return df.agg(F.count_distinct(group).alias("n_groups"), F.count("*").alias("n_rows"))


def batch_summary(df: DataFrame, malignant: Sequence[int], pred: str = "pred") -> DataFrame:
    """AGG32. Predictions per class of a batch, whether the class is malignant, and the malignant total."""
    counts = df.groupBy(pred).agg(F.count("*").alias("n"))  # one row per class
    bad = F.col(pred).isin(list(malignant))
    return counts.select(pred, "n", bad.alias("malignant"), F.sum(F.when(bad, F.col("n")).otherwise(0)).over(Window.partitionBy()).alias("malignant_total"))


def cohort_rows(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One (dim, cohort) row per membership; null cohorts are in no stratum."""
    members = F.array_compact(F.array(*[
        F.when(c.isNotNull(), F.struct(F.lit(d).alias("dim"), c.alias("cohort"))) for d, c in dims.items()
    ]))
    return df.select("y", "pred", F.inline(members))


def skin_band(fitz: Column) -> Column:
    return F.when(fitz.isin(1, 2), "I-II").when(fitz.isin(3, 4), "III-IV").when(fitz.isin(5, 6), "V-VI")


def sex_band(sex: Column) -> Column:
    low = F.lower(sex)
    return F.when(low.isin("male", "female"), low)


def age_band(age: Column) -> Column:
    return (
        F.when(~(age > 0), F.lit(None).cast("string"))
        .when(age < 40, "<40").when(age < 60, "40-60").when(age < 75, "60-75").when(age >= 75, ">=75")
    )


def fairness(df: DataFrame, watch_class: int = 0, labels: int | None = None, columns: Sequence[str] = ("fitzpatrick", "sex", "age")) -> DataFrame:
    """AGG19. Macro-F1 and watched-class recall by cohort in a single pass.

    Cohorts under 30 rows keep their count but no metric; a missing column gives one
    'unavailable' row.
    """
    bands = {"fitzpatrick": ("skin_tone", skin_band), "sex": ("sex", sex_band), "age": ("age_band", age_band)}
    have = {bands[c][0]: bands[c][1](F.col(c)) for c in columns if c in df.columns}
    conf = cohort_rows(df, have).groupBy("dim", "cohort", "y", "pred").agg(F.count("*").alias("n"))
    by = ["dim", "cohort"]
    watched = conf.groupBy(*by).agg(
        (F.coalesce(F.sum(F.when((F.col("y") == watch_class) & (F.col("pred") == watch_class), F.col("n"))), F.lit(0))
         / F.greatest(F.coalesce(F.sum(F.when(F.col("y") == watch_class, F.col("n"))), F.lit(0)), F.lit(1))).alias("recall")
    )
    shown = lambda c: F.when(F.col("n") >= MIN_COHORT, c)
    out = summary(conf, by, labels).join(watched, by).select(
        *by, "n", shown(F.col("macro_f1")).alias("macro_f1"),
        F.when(F.col("dim") == "skin_tone", shown(F.col("recall"))).alias("watched_recall"),
        F.when(F.col("n") >= MIN_COHORT, "ok").otherwise("n<30, skipped").alias("note"),
    )
    for c in columns:
        if c not in df.columns:
            gone = df.sparkSession.range(1).select(
                F.lit(bands[c][0]).alias("dim"), F.lit(None).cast("string").alias("cohort"), F.lit(0).cast("long").alias("n"),
                F.lit(None).cast("double").alias("macro_f1"), F.lit(None).cast("double").alias("watched_recall"),
                F.lit("unavailable").alias("note"),
            )
            out = out.unionByName(gone)
    return out


def group_rollup(df: DataFrame, group: str, k: int, row_id: str = "row_id") -> DataFrame:
    """AGG20. One row per group: majority vote, mean-probability vote and the first row's truth.

    Votes are counted as K columns, so a group of any size folds map-side. Ties go to the
    smallest class.
    """
    agg = df.groupBy(group).agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.count_if(F.col("pred") == c) for c in range(k)]).alias("votes"),
        F.array(*[F.avg(F.col("p")[c]) for c in range(k)]).alias("mean_p"),
        F.min_by("y", row_id).alias("y"),
    )
    return agg.select(group, "n_rows", "y", sc.argmax(F.col("votes")).alias("majority"), sc.argmax(F.col("mean_p")).alias("mean_prob"))


def rollup_report(df: DataFrame, group: str, k: int, row_id: str = "row_id", labels: int | None = None) -> DataFrame:
    """AGG20. Macro-F1 per image, per group by majority and per group by mean probability."""
    rolled = group_rollup(df, group, k, row_id)
    votes = rolled.select("y", F.inline(F.array(
        F.struct(F.lit("group_majority").alias("level"), F.col("majority").alias("pred")),
        F.struct(F.lit("group_mean_prob").alias("level"), F.col("mean_prob").alias("pred")),
    )))
    images = df.select("y", F.lit("image").alias("level"), "pred")
    both = votes.select("y", "level", "pred").unionByName(images)
    return summary(confusion(both, by=["level"]), ["level"], labels).select("level", "n", "macro_f1")


# ---- selective prediction -----------------------------------------------------

def risk_coverage(df: DataFrame, conf: str = "conf", row_id: str = "row_id") -> DataFrame:
    """WIN1. Full curve: rank by confidence (ties by row id), coverage and running accuracy."""
    rows = df.select(row_id, conf, F.lit(1).cast("long").alias("one"), (F.col("y") == F.col("pred")).cast("long").alias("hit"))
    run = prefix_sums(rows, [], [F.col(conf).desc(), F.col(row_id)], ["one", "hit"])
    total = run.agg(F.max("cum_one")).scalar()
    return run.select(
        row_id, F.col("cum_one").alias("rank"), (F.col("cum_one") / total).alias("coverage"),
        (F.col("cum_hit") / F.col("cum_one")).alias("accuracy"),
    )


def accuracy_at_coverage(df: DataFrame, points: Sequence[float] = (0.5, 0.7, 0.9, 1.0), conf: str = "conf", row_id: str = "row_id") -> DataFrame:
    """WIN1. Accuracy over the most confident max(1, int(N·c)) rows; ties go to the smaller row id.

    No order of all rows is made. Rows are counted by score prefix; whole prefixes above a point are
    taken by their counts, and the one prefix that holds it is refined until few rows are left, which
    alone are ranked. If equal scores leave more, those are ranked over ranges. Nulls come last.
    """
    # one integer per row, in the order of the score; its leading bits are the prefixes
    edge = float(2 ** (62 - SCORE_BITS * SCORE_LEVELS))
    key = F.floor(F.least(F.greatest(F.col(conf), F.lit(-edge)), F.lit(edge)) * float(2 ** (SCORE_BITS * SCORE_LEVELS))).cast("long")
    rows = df.select(F.col(row_id).alias("_id"), F.col(conf).alias("_s"), key.alias("_k"), (F.col("y") == F.col("pred")).cast("long").alias("_hit"))
    prefix = lambda level: F.shiftright("_k", SCORE_BITS * (SCORE_LEVELS - level))

    class Point:
        level, at, left, hits, size, wanted = 0, 0, 0, 0, FEW_ROWS + 1, 0
    found = {float(p): Point() for p in points}
    for level in range(1, SCORE_LEVELS + 1):
        live = [p for p in found.values() if p.size > FEW_ROWS]
        if not live:
            break
        part = rows if level == 1 else rows.filter(prefix(level - 1).isin(sorted({p.at for p in live})))
        # at most 2**SCORE_BITS rows per point reach the driver
        counts = part.groupBy((prefix(level - 1) if level > 1 else F.lit(0).cast("long")).alias("p"), prefix(level).alias("q")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("h")).orderBy(F.desc("q")).collect()
        if level == 1:
            total = sum(r["n"] for r in counts)
            if not total:
                return df.sparkSession.createDataFrame([], "point double, n bigint, accuracy double")
            for share, p in found.items():
                p.wanted = p.left = max(1, int(math.floor(share * total)))
        for p in live:
            for r in counts:
                if r["p"] != p.at:
                    continue
                if p.left <= r["n"]:
                    p.level, p.at, p.size = level, r["q"], r["n"]
                    break
                p.left, p.hits = p.left - r["n"], p.hits + r["h"]
    cut = F.array_compact(F.array(*[
        F.when(prefix(p.level) == p.at, F.struct(F.lit(share).alias("point"), F.lit(p.left).cast("long").alias("left"), F.lit(p.size > FEW_ROWS).alias("big"))) for share, p in found.items()]))
    inside = rows.select("_id", "_s", "_hit", F.inline(cut))
    best = [F.col("_s").desc(), F.col("_id")]
    few = inside.filter(~F.col("big")).withColumn("_rank", F.row_number().over(Window.partitionBy("point").orderBy(*best)))
    taken = few.filter(F.col("_rank") <= F.col("left")).select("point", "_hit")
    if any(p.size > FEW_ROWS for p in found.values()):
        ranked = prefix_sums(inside.filter("big").withColumn("one", F.lit(1).cast("long")), ["point"], best, ["one"])
        taken = taken.unionByName(ranked.filter(F.col("cum_one") <= F.col("left")).select("point", "_hit"))
    above = lambda of: F.element_at(F.create_map(*[F.lit(x) for share, p in found.items() for x in (share, of(p))]), F.col("point"))
    return taken.groupBy("point").agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("h")).select(
        "point", above(lambda p: p.wanted).cast("long").alias("n"), ((F.col("h") + above(lambda p: p.hits)) / above(lambda p: p.wanted)).alias("accuracy"))


def miss_rates(df: DataFrame, cls: int, thresholds: Sequence[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    """WIN2. Share of the class's rows whose class probability stays under each threshold."""
    rows = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"), F.count_if(F.col("y") == cls).alias("n"),
            ((F.count_if(F.col("y") == cls) - F.count_if((F.col("y") == cls) & (F.col("p")[cls] >= t)))
             / F.nullif(F.count_if(F.col("y") == cls), F.lit(0))).alias("miss_rate"),
        )
        for t in thresholds
    ])
    return df.agg(rows.alias("r")).select(F.inline("r"))


# ---- priors, weights, margins -------------------------------------------------

def distribution(df: DataFrame, cls: str, classes: Sequence[object] | None = None) -> DataFrame:
    """AGG1. Count and percentage by class; with ``classes`` in that order, zeros included."""
    counts = df.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    if classes is not None:
        spine = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("pos", "cls"))
        counts = spine.join(counts, "cls", "left").select("pos", "cls", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def empirical_prior(df: DataFrame, cls: str, classes: Sequence[object]) -> DataFrame:
    """AGG21. Class shares with every count raised to at least 1."""
    counts = distribution(df, cls, classes).select("cls", F.greatest("n", F.lit(1)).alias("n"))
    return counts.select("cls", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))


def mean_probs(df: DataFrame, k: int, p: str = "p") -> DataFrame:
    """AGG22. Effective prior: mean probability per class, clipped at 1e-12 and renormalised."""
    means = df.agg(F.array(*[F.avg(F.col(p)[i]) for i in range(k)]).alias("m"))
    clipped = means.select(F.array(*[F.greatest(F.col("m")[i], F.lit(sc.FLOOR)) for i in range(k)]).alias("m"))
    return clipped.select(F.posexplode(sc.normalise(F.col("m"), k)).alias("cls", "prior"))


def compare_priors(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """AGG23. Side by side with the gap and the L-infinity error."""
    joined = a.select("cls", F.col("prior").alias(name_a)).join(b.select("cls", F.col("prior").alias(name_b)), "cls")
    gap = F.abs(F.col(name_a) - F.col(name_b))
    return joined.select("cls", name_a, name_b, gap.alias("gap"), F.max(gap).over(Window.partitionBy()).alias("linf"))


def class_weights(counts: DataFrame, beta: float = 0.999, costs: dict | None = None) -> DataFrame:
    """AGG24. Every weighting in use, from one row per class (cls, n)."""
    everyone = Window.partitionBy()
    n = F.greatest("n", F.lit(1)).cast("double")
    k = F.count("*").over(everyone)
    total = F.sum("n").over(everyone)
    inv = 1.0 / n
    effective = (1.0 - beta) / F.greatest(1.0 - F.pow(F.lit(beta), n), F.lit(sc.FLOOR))
    cost = F.lit(1.0)
    for name, c in (costs or {}).items():
        cost = F.when(F.col("cls") == name, float(c)).otherwise(cost)
    return counts.select(
        "cls", "n",
        (total / (k * n)).alias("balanced"), inv.alias("inverse"), (1.0 / F.sqrt(n)).alias("inverse_sqrt"),
        (effective / F.sum(effective).over(everyone) * k).alias("effective"),
        (cost * inv / F.avg(cost * inv).over(everyone)).alias("cost_normalised"),
    )


def ldam_margins(counts: DataFrame, max_m: float = 0.5) -> DataFrame:
    """AGG25. n^(-1/4) scaled so the largest margin is ``max_m``."""
    raw = 1.0 / F.sqrt(F.sqrt(F.col("n") + 1e-9))
    return counts.select("cls", "n", (raw * (max_m / F.max(raw).over(Window.partitionBy()))).alias("margin"))


# ---- uncertain rows -----------------------------------------------------------

def uncertain(df: DataFrame, threshold: float = 0.7, conf: str = "conf") -> DataFrame:
    """AGG18."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(conf) < threshold).alias("n_uncertain"),
        (100.0 * F.avg(F.when(F.col(conf) < threshold, 1.0).otherwise(0.0))).alias("pct_uncertain"),
    )
