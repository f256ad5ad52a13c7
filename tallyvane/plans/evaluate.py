"""Evaluation and audit queries (AGG7-AGG28, WIN1-WIN5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators import fit, metrics as mt
from tallyvane.plans.fixtures import BIG, COHORT, FLAGS, K, KB, PRED, cohort_columns, groups, pred_big, predictions, scored
from tallyvane.plans.registry import query, r, rounded, rq

W = "WITH " + PRED
WB = "WITH " + BIG
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def big(spark, sf):
    return scored(pred_big(spark, sf), KB)


def class_sql(source: str, by: str = "") -> str:
    """CTEs cc and cf: per-class counts and F1 of a (by, y, pred) source."""
    b = f"{by}, " if by else ""
    g = "GROUP BY " + (f"{by}, cls" if by else "cls")
    return f"""
cs AS (SELECT {b}y AS cls, count(*) FILTER (WHERE y = pred) AS tp, count(*) AS support, 0 AS predicted FROM {source} {g}
       UNION ALL SELECT {b}pred AS cls, 0, 0, count(*) FROM {source} {g}),
cc AS (SELECT {b}cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted FROM cs {g}),
cf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS "precision", CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0.0 END AS f1 FROM cc)
"""


# ---- flagship -------------------------------------------------------------------

@query("calibration_by_cohort", W + """,
co AS (SELECT *, CAST(row_id % 3 AS INTEGER) AS cohort FROM pr),
bn AS (SELECT cohort, least(floor(conf * 15), 14) AS bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(conf) AS c FROM co GROUP BY 1, 2),
ec AS (SELECT cohort, sum(n * abs(acc - c)) / sum(n) AS ece FROM bn GROUP BY 1),""" + class_sql("co", "cohort") + f""",
fm AS (SELECT cohort, CAST(sum(support) AS BIGINT) AS n, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM cf GROUP BY 1)
SELECT cohort, n, {rq("accuracy")} AS accuracy, {rq("macro_f1")} AS macro_f1, {rq("ece")} AS ece FROM fm JOIN ec USING (cohort) WHERE n >= 30""")
def calibration_by_cohort(spark, sf):
    rows = predictions(spark, sf).withColumn("cohort", (F.col("row_id") % 3).cast("int"))
    rows = rows.select("cohort", "y", "pred", "conf")
    bins = mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred"), ["cohort"])
    ece = mt.calibration_error(bins, ["cohort"]).select("cohort", "ece")
    f1 = mt.summary(mt.confusion(rows, by=["cohort"]), ["cohort"]).filter(F.col("n") >= mt.MIN_COHORT)
    return rounded(f1.join(ece, "cohort").select("cohort", "n", "accuracy", "macro_f1", "ece"), "accuracy", "macro_f1", "ece")


# ---- class counts, weights, priors ------------------------------------------------

_COUNTS = """pc AS (SELECT * FROM (VALUES (0,'1-URGENT'),(1,'2-HIGH'),(2,'3-MEDIUM'),(3,'4-NOT SPECIFIED'),(4,'5-LOW'),(5,'6-NEVER')) t(pos, cls)),
n1 AS (SELECT pos, pc.cls, count(o_orderkey) AS n FROM pc LEFT JOIN orders ON o_orderpriority = pc.cls GROUP BY 1, 2)"""


@query("agg1_class_counts", f"WITH {_COUNTS} SELECT CAST(pos AS INTEGER) AS pos, cls, n, {rq('100.0 * n / sum(n) OVER ()')} AS pct FROM n1")
def agg1(spark, sf):
    return rounded(mt.distribution(groups(spark, sf), "o_orderpriority", PRIORITIES + ["6-NEVER"]), "pct")


@query("agg3_distinct_groups", "SELECT count(DISTINCT o_custkey) AS n_groups, count(*) AS n_rows FROM orders")
def agg3(spark, sf):
    return mt.group_counts(groups(spark, sf), "o_custkey")


@query("agg21_empirical_prior", f"WITH {_COUNTS}, g AS (SELECT cls, greatest(n, 1) AS n FROM n1) SELECT cls, n, {rq('n / sum(n) OVER ()')} AS prior FROM g")
def agg21(spark, sf):
    return rounded(mt.empirical_prior(groups(spark, sf), "o_orderpriority", PRIORITIES + ["6-NEVER"]), "prior")


@query("agg22_effective_prior", W + f", m AS (SELECT CAST(k AS INTEGER) AS cls, greatest(avg(p), 1e-12) AS a FROM pl GROUP BY 1) SELECT cls, {rq('a / sum(a) OVER ()')} AS prior FROM m")
def agg22(spark, sf):
    return rounded(mt.mean_probs(predictions(spark, sf), K), "prior")


@query("agg23_prior_comparison", W + f""", m AS (SELECT k AS cls, greatest(avg(p), 1e-12) AS a FROM pl GROUP BY 1),
em AS (SELECT cls, a / sum(a) OVER () AS estimated FROM m), lb AS (SELECT label AS cls, greatest(count(*), 1) AS n FROM embeddings GROUP BY 1),
la AS (SELECT cls, n / sum(n) OVER () AS actual FROM lb)
SELECT CAST(cls AS INTEGER) AS cls, {rq('estimated')} AS estimated, {rq('actual')} AS actual, {rq('abs(estimated - actual)')} AS gap,
  {rq('max(abs(estimated - actual)) OVER ()')} AS linf FROM em JOIN la USING (cls)""")
def agg23(spark, sf):
    rows = predictions(spark, sf)
    actual = mt.empirical_prior(rows, "y", list(range(K)))
    out = mt.compare_priors(mt.mean_probs(rows, K), actual, "estimated", "actual")
    return rounded(out, "estimated", "actual", "gap", "linf")


@query("agg24_class_weights", f"""WITH {_COUNTS}, g AS (SELECT cls, greatest(n, 1)::DOUBLE AS n, CASE cls WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 ELSE 1.0 END::DOUBLE AS cost FROM n1 WHERE pos < 5),
e AS (SELECT *, (1 - 0.999::DOUBLE) / greatest(1 - pow(0.999::DOUBLE, n), 1e-12) AS eff FROM g)
SELECT cls, CAST(n AS BIGINT) AS n, {rq("sum(n) OVER () / (count(*) OVER () * n)", 8)} AS balanced, {rq("1 / n", 8)} AS inverse, {rq("1 / sqrt(n)", 8)} AS inverse_sqrt,
  {rq("eff / sum(eff) OVER () * count(*) OVER ()", 8)} AS effective, {rq("cost / n / avg(cost / n) OVER ()", 8)} AS cost_normalised FROM e""")
def agg24(spark, sf):
    counts = mt.distribution(groups(spark, sf), "o_orderpriority", PRIORITIES)
    out = mt.class_weights(counts, costs={"1-URGENT": 3.0, "2-HIGH": 2.0})
    return rounded(out, "balanced", "inverse", "inverse_sqrt", "effective", "cost_normalised", digits=8)


@query("agg25_ldam_margins", f"WITH {_COUNTS}, g AS (SELECT cls, n, 1 / sqrt(sqrt(n + 1e-9::DOUBLE)) AS m FROM n1 WHERE pos < 5) SELECT cls, n, {rq('m * (0.5 / max(m) OVER ())')} AS margin FROM g")
def agg25(spark, sf):
    return rounded(mt.ldam_margins(mt.distribution(groups(spark, sf), "o_orderpriority", PRIORITIES)), "margin")


# ---- confusion family -------------------------------------------------------------

@query("agg7_confusion_matrix", W + """, g AS (SELECT CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS pred FROM range(10) a, range(10) b)
SELECT g.y, g.pred, count(pr.row_id) AS n FROM g LEFT JOIN pr ON pr.y = g.y AND pr.pred = g.pred GROUP BY 1, 2""")
def agg7(spark, sf):
    return mt.confusion_matrix(predictions(spark, sf), K)


@query("agg7_confusion_pivot_big", WB + """SELECT y, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
  count(*) FILTER (WHERE pred = 2) AS pred_2 FROM bpr GROUP BY 1""")
def agg7_big(spark, sf):
    return mt.confusion_pivot(big(spark, sf), KB)


@query("agg8_sensitivity_specificity", W + "," + class_sql("pr") + f""", t AS (SELECT sum(support) AS n FROM cc)
SELECT CAST(cls AS INTEGER) AS cls, {rq("recall")} AS sensitivity, {rq("CASE WHEN n - support > 0 THEN (n - support - predicted + tp)::DOUBLE / (n - support) ELSE 0 END")} AS specificity FROM cf, t""")
def agg8(spark, sf):
    return rounded(mt.sensitivity_specificity(mt.confusion(predictions(spark, sf))), "sensitivity", "specificity")


@query("agg9_class_report", W + "," + class_sql("pr") + f"""SELECT CAST(cls AS INTEGER) AS cls, tp, support, predicted, {rq('"precision"')} AS "precision", {rq("recall")} AS recall, {rq("f1")} AS f1 FROM cf""")
def agg9(spark, sf):
    return rounded(mt.class_report(mt.confusion(predictions(spark, sf))), "precision", "recall", "f1")


@query("agg9_summary_label_modes", WB + "," + class_sql("bpr") + f""", t AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(f1) AS present, sum(f1) / 4 AS fixed4, sum(f1 * support) / sum(support) AS w FROM cf)
SELECT CAST(n AS BIGINT) AS n, {rq("tp / n")} AS accuracy, {rq("present")} AS macro_present, {rq("fixed4")} AS macro_fixed4, {rq("w")} AS weighted_f1 FROM t""")
def agg9_modes(spark, sf):
    conf = mt.confusion(big(spark, sf))
    got = mt.summary(conf).select("n", "accuracy", F.col("macro_f1").alias("macro_present"), "weighted_f1")
    fixed = mt.summary(conf, labels=4).select("macro_f1").scalar()
    return rounded(got.withColumn("macro_fixed4", fixed), "accuracy", "macro_present", "macro_fixed4", "weighted_f1")


_WEIGHTS = [2.5, 0.5, 1.0, 1.5, 1.0, 0.8, 0.8, 3.0, 1.0, 1.0]


@query("agg10_weighted_f1", W + "," + class_sql("pr") + f""" SELECT {rq(f"sum((({_WEIGHTS})[cls + 1])::DOUBLE * f1) / {sum(_WEIGHTS)}::DOUBLE")} AS weighted_f1 FROM cf""")
def agg10(spark, sf):
    return rounded(mt.weighted_f1(mt.confusion(predictions(spark, sf)), _WEIGHTS), "weighted_f1")


@query("agg27_binary_rates", WB + f"""SELECT {rq("count(*) FILTER (WHERE y = 1 AND pred = 1) / greatest(count(*) FILTER (WHERE y = 1), 1)")} AS recall,
 {rq("count(*) FILTER (WHERE y <> 1 AND pred <> 1) / greatest(count(*) FILTER (WHERE y <> 1), 1)")} AS specificity FROM bpr""")
def agg27(spark, sf):
    return rounded(mt.binary_rates(big(spark, sf), 1), "recall", "specificity")


@query("agg28_confusion_pairs", W + f""", q AS (SELECT * FROM (VALUES (0,1),(7,2),(3,4),(3,7),(7,3)) t(y, pred))
SELECT q.y, q.pred, count(pr.row_id) FILTER (WHERE pr.pred = q.pred) AS n, count(pr.row_id) AS total,
 {rq("CASE WHEN count(pr.row_id) > 0 THEN count(pr.row_id) FILTER (WHERE pr.pred = q.pred) / count(pr.row_id) ELSE 0 END")} AS rate
FROM q LEFT JOIN pr ON pr.y = q.y GROUP BY 1, 2""")
def agg28(spark, sf):
    return rounded(mt.confusion_pairs(mt.confusion(predictions(spark, sf)), [(0, 1), (7, 2), (3, 4), (3, 7), (7, 3)]), "rate")


# ---- ranking metrics --------------------------------------------------------------

_AUC = """ps AS (SELECT cls, y = cls AS pos, s FROM src),
rk AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2.0::DOUBLE AS rk FROM ps),
au AS (SELECT cls, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(rk) FILTER (WHERE pos) AS sr FROM rk GROUP BY 1)"""


@query("agg11_auc", W + ", src AS (SELECT CAST(k AS INTEGER) AS cls, y, p AS s FROM pl)," + _AUC +
       f" SELECT cls, n_pos, n_neg, {rq('(sr - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)')} AS auc FROM au")
def agg11(spark, sf):
    return rounded(mt.auc_one_vs_rest(predictions(spark, sf), K), "auc")


@query("agg11_auc_big", WB + ", src AS (SELECT 0 AS cls, y, round(p0, 9) AS s FROM bp UNION ALL SELECT 1, y, round(p1, 9) FROM bp UNION ALL SELECT 2, y, round(p2, 9) FROM bp)," + _AUC +
       f" SELECT cls, n_pos, n_neg, {rq('(sr - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)')} AS auc FROM au")
def agg11_big(spark, sf):
    # scores compared at 9 decimals, so that ties do not hang on the last bit of exp
    rows = big(spark, sf).withColumn("p", F.array(*[F.round(F.col("p")[i], 9) for i in range(KB)]))
    return rounded(mt.auc_one_vs_rest(rows, KB), "auc")


@query("win5_average_rank", """SELECT l_returnflag, l_quantity, count(*) AS n, any_value(rk) AS avg_rank FROM (
 SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk
 FROM lineitem) GROUP BY 1, 2""")
def win5(spark, sf):
    from tallyvane.plans.fixtures import table
    return mt.average_ranks(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


# ---- proper scores and calibration -------------------------------------------------

@query("agg12_brier", W + f", b AS (SELECT row_id, sum(pow(p - CASE WHEN k = y THEN 1 ELSE 0 END, 2)) AS s FROM pl GROUP BY 1) SELECT {rq('avg(s)')} AS brier FROM b")
def agg12(spark, sf):
    return rounded(predictions(spark, sf).agg(mt.brier(None, K).alias("brier")), "brier")


@query("agg13_nll", W + f"SELECT {rq('avg(-ln(greatest(py, 1e-12)))')} AS nll_clipped, {rq('(SELECT avg(lse - z) FROM pl WHERE k = y)')} AS nll_logits FROM pr")
def agg13(spark, sf):
    rows = predictions(spark, sf)
    return rounded(rows.agg(
        F.avg(sc.nll_from_probs(F.col("p"), F.col("y"))).alias("nll_clipped"), F.avg(sc.nll(F.col("z"), F.col("y"), K)).alias("nll_logits"),
    ), "nll_clipped", "nll_logits")


def _ece_sql(binning: str, src: str, v: str, hit: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""bn AS (SELECT {b}{binning} AS bin, count(*) AS n, avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg({v}) AS cf FROM {src} GROUP BY ALL),
er AS (SELECT {b}sum(n * abs(acc - cf)) / sum(n) AS ece, max(abs(acc - cf)) AS mce FROM bn {f'GROUP BY {by}' if by else ''})"""


_LEFT, _RIGHT = "least(floor({v} * 15), 14)", "greatest(least(ceil({v} * 15) - 1, 14), 0)"


@query("agg14_ece", W + "," + _ece_sql(_LEFT.format(v="conf"), "pr", "conf", "y = pred") + f" SELECT {rq('ece')} AS ece FROM er")
def agg14(spark, sf):
    rows = predictions(spark, sf)
    return rounded(mt.calibration_error(mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred"))).select("ece"), "ece")


@query("agg14_ece_right_closed", W + "," + _ece_sql(_RIGHT.format(v="conf"), "pr", "conf", "y = pred") + f" SELECT {rq('ece')} AS ece FROM er")
def agg14_right(spark, sf):
    rows = predictions(spark, sf)
    bins = mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred"), closed="right")
    return rounded(mt.calibration_error(bins).select("ece"), "ece")


@query("agg14_ece_big", WB + "," + _ece_sql(_LEFT.format(v="conf"), "bpr", "conf", "y = pred") + f" SELECT {rq('ece')} AS ece, {rq('mce')} AS mce FROM er")
def agg14_big(spark, sf):
    rows = big(spark, sf)
    return rounded(mt.calibration_error(mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred"))), "ece", "mce")


@query("agg15_class_ece", W + "," + _ece_sql(_LEFT.format(v="p"), "(SELECT CAST(k AS INTEGER) AS cls, p, y FROM pl)", "p", "y = cls", "cls") + f" SELECT cls, {rq('ece')} AS ece FROM er")
def agg15(spark, sf):
    long = mt.one_vs_rest(predictions(spark, sf), K)
    return rounded(mt.calibration_error(mt.calibration_bins(long, F.col("score"), F.col("positive"), ["cls"]), ["cls"]).select("cls", "ece"), "ece")


@query("agg16_mce", W + "," + _ece_sql(_LEFT.format(v="conf"), "pr", "conf", "y = pred") + f" SELECT {rq('mce')} AS mce FROM er")
def agg16(spark, sf):
    rows = predictions(spark, sf)
    return rounded(mt.calibration_error(mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred"))).select("mce"), "mce")


@query("agg17_reliability_table", W + f"""SELECT CAST({_LEFT.format(v='conf')} AS INTEGER) AS bin, count(*) AS n, {rq("avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END)")} AS accuracy,
 {rq("avg(conf)")} AS confidence, {rq(f"({_LEFT.format(v='conf')} + 0.5) / 15")} AS centre FROM pr GROUP BY {_LEFT.format(v='conf')}""")
def agg17(spark, sf):
    rows = predictions(spark, sf)
    return rounded(mt.calibration_bins(rows, F.col("conf"), F.col("y") == F.col("pred")), "accuracy", "confidence", "centre")


@query("agg17_class_curve", W + f"""SELECT CAST(k AS INTEGER) AS cls, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n,
 {rq("avg(CASE WHEN y = k THEN 1.0::DOUBLE ELSE 0 END)")} AS accuracy, {rq("avg(p)")} AS confidence FROM pl GROUP BY 1, 2""")
def agg17_class(spark, sf):
    long = mt.one_vs_rest(predictions(spark, sf), K)
    return rounded(mt.calibration_bins(long, F.col("score"), F.col("positive"), ["cls"], bins=10).drop("centre"), "accuracy", "confidence")


@query("agg18_uncertain", W + f"SELECT count(*) AS n, count(*) FILTER (WHERE conf < 0.7) AS n_uncertain, {rq('100.0 * avg(CASE WHEN conf < 0.7 THEN 1.0::DOUBLE ELSE 0 END)')} AS pct_uncertain FROM pr")
def agg18(spark, sf):
    return rounded(mt.uncertain(predictions(spark, sf)), "pct_uncertain")


# ---- cohorts and groups -------------------------------------------------------------

@query("agg19_fairness", W + "," + COHORT + """, mb AS (
 SELECT 'skin_tone' AS dim, CASE WHEN fitzpatrick <= 2 THEN 'I-II' WHEN fitzpatrick <= 4 THEN 'III-IV' WHEN fitzpatrick <= 6 THEN 'V-VI' END AS cohort, y, pred FROM co
 UNION ALL SELECT 'sex', sex, y, pred FROM co
 UNION ALL SELECT 'age_band', CASE WHEN age > 0 THEN CASE WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-60' WHEN age < 75 THEN '60-75' ELSE '>=75' END END, y, pred FROM co),
mm AS (SELECT * FROM mb WHERE cohort IS NOT NULL),""" + class_sql("mm", "dim, cohort") + f""",
s AS (SELECT dim, cohort, CAST(sum(support) AS BIGINT) AS n, avg(f1) AS f1, max(CASE WHEN cls = 0 THEN recall END) AS r FROM cf GROUP BY 1, 2)
SELECT dim, cohort, n, CASE WHEN n >= 30 THEN {rq("f1")} END AS macro_f1, CASE WHEN n >= 30 AND dim = 'skin_tone' THEN {rq("coalesce(r, 0)")} END AS watched_recall,
 CASE WHEN n >= 30 THEN 'ok' ELSE 'n<30, skipped' END AS note FROM s""")
def agg19(spark, sf):
    return rounded(mt.fairness(cohort_columns(predictions(spark, sf))), "macro_f1", "watched_recall")


@query("agg19_unavailable_column", "SELECT 'skin_tone' AS dim, CAST(NULL AS VARCHAR) AS cohort, 0::BIGINT AS n, 'unavailable' AS note "
       "UNION ALL SELECT 'sex', CASE WHEN vec_id % 2 = 0 THEN 'male' ELSE 'female' END, count(*), 'ok' FROM embeddings WHERE vec_id % 13 <> 0 GROUP BY 2")
def agg19_missing(spark, sf):
    rows = cohort_columns(predictions(spark, sf)).drop("fitzpatrick", "age")
    return mt.fairness(rows, columns=("fitzpatrick", "sex")).select("dim", "cohort", "n", "note")


@query("flt4_min_cohort", W + """, co AS (SELECT CAST(row_id % 23 AS BIGINT) AS cohort, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM pr GROUP BY 1)
SELECT cohort, n, CASE WHEN n >= 22 THEN round(acc, 6) END AS accuracy FROM co""")
def flt4(spark, sf):
    rows = predictions(spark, sf).groupBy((F.col("row_id") % 23).alias("cohort")).agg(
        F.count("*").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"))
    return rounded(mt.min_cohort(rows.withColumnRenamed("acc", "accuracy"), ["accuracy"], 22), "accuracy")


_ROLL = """lm AS (SELECT row_id // 3 AS lesion, * FROM pr), vt AS (SELECT lesion, pred, count(*) AS c FROM lm GROUP BY 1, 2),
mv AS (SELECT lesion, min(pred) AS majority FROM (SELECT *, max(c) OVER (PARTITION BY lesion) AS m FROM vt) WHERE c = m GROUP BY 1),
ap AS (SELECT row_id // 3 AS lesion, k, avg(p) AS a FROM pl GROUP BY 1, 2),
mp AS (SELECT lesion, min(k) AS mean_prob FROM (SELECT *, max(a) OVER (PARTITION BY lesion) AS m FROM ap) WHERE a = m GROUP BY 1),
tr AS (SELECT lesion, arg_min(y, row_id) AS y, count(*) AS n_rows FROM lm GROUP BY 1)"""


@query("agg20_group_rollup", W + "," + _ROLL + " SELECT lesion, n_rows, y, majority, CAST(mean_prob AS INTEGER) AS mean_prob FROM tr JOIN mv USING (lesion) JOIN mp USING (lesion)")
def agg20(spark, sf):
    rows = predictions(spark, sf).withColumn("lesion", F.floor(F.col("row_id") / 3))
    return mt.group_rollup(rows, "lesion", K)


@query("agg20_rollup_report", W + "," + _ROLL + """, lv AS (SELECT 'image' AS level, y, pred FROM pr UNION ALL SELECT 'group_majority', y, majority FROM tr JOIN mv USING (lesion)
 UNION ALL SELECT 'group_mean_prob', y, mean_prob FROM tr JOIN mp USING (lesion)),""" + class_sql("lv", "level") +
       f" SELECT level, CAST(sum(support) AS BIGINT) AS n, {rq('avg(f1)')} AS macro_f1 FROM cf GROUP BY 1")
def agg20_report(spark, sf):
    rows = predictions(spark, sf).withColumn("lesion", F.floor(F.col("row_id") / 3))
    return rounded(mt.rollup_report(rows, "lesion", K), "macro_f1")


@query("agg20_rollup_big", WB + """, v AS (SELECT grp, pred, count(*) AS c FROM bpr GROUP BY 1, 2),
mv AS (SELECT grp, min(pred) AS majority FROM (SELECT *, max(c) OVER (PARTITION BY grp) AS m FROM v) WHERE c = m GROUP BY 1)
SELECT majority, count(*) AS n_groups FROM mv GROUP BY 1""")
def agg20_big(spark, sf):
    return mt.group_rollup(big(spark, sf), "grp", KB).groupBy("majority").agg(F.count("*").alias("n_groups"))


# ---- losses over logged predictions ---------------------------------------------------

@query("agg26_losses", W + """, lp AS (SELECT row_id, y, k, z, z - lse AS l FROM pl),
ce AS (SELECT row_id, -max(l) FILTER (WHERE k = y) AS ce, -(max(l) FILTER (WHERE k = y) * 0.9 + sum(l) * 0.01) AS sm FROM lp GROUP BY 1),
sf AS (SELECT k, sum(CASE WHEN k = y THEN p ELSE 0 END) AS tp, sum(CASE WHEN k <> y THEN p ELSE 0 END) AS fp, sum(CASE WHEN k = y THEN 1 - p ELSE 0 END) AS fn FROM pl GROUP BY 1),
ld AS (SELECT row_id, y, k, 30 * (z - CASE WHEN k = y THEN 0.05 * (k + 1) ELSE 0 END) AS s FROM lp),
lm AS (SELECT *, max(s) OVER (PARTITION BY row_id) AS m FROM ld),
ll AS (SELECT row_id, any_value(m) + ln(sum(exp(s - m))) - max(s) FILTER (WHERE k = y) AS nl FROM lm GROUP BY 1)
""" + f"""SELECT {rq("(SELECT avg(pow(1 - exp(-ce), 2) * ce) FROM ce)")} AS focal, {rq("(SELECT avg(pow(1 - exp(-sm), 2) * sm) FROM ce)")} AS focal_smooth,
 {rq("(SELECT 1 - avg(2 * tp / (2 * tp + fp + fn + 1e-7)) FROM sf)")} AS soft_macro_f1_loss, {rq("(SELECT avg(nl) FROM ll)", 4)} AS ldam""")
def agg26(spark, sf):
    rows = predictions(spark, sf)
    lp = sc.log_softmax(F.col("z"), K)
    margins = [0.05 * (i + 1) for i in range(K)]
    losses = rows.withColumn("lp", lp).agg(
        F.avg(sc.focal(F.col("lp"), F.col("y"), K)).alias("focal"),
        F.avg(sc.focal(F.col("lp"), F.col("y"), K, smoothing=0.1)).alias("focal_smooth"),
        F.avg(sc.nll(sc.ldam_logits(F.col("z"), F.col("y"), margins, K), F.col("y"), K)).alias("ldam"),
    )
    soft = mt.soft_macro_f1(rows, K).scalar()
    out = losses.withColumn("soft_macro_f1_loss", soft)
    return rounded(rounded(out, "focal", "focal_smooth", "soft_macro_f1_loss"), "ldam", digits=4)


# ---- selective prediction ---------------------------------------------------------------

@query("win1_risk_coverage", W + f""" SELECT row_id, row_number() OVER w AS rank, {rq("row_number() OVER w / count(*) OVER ()")} AS coverage,
 {rq("sum(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) OVER w / row_number() OVER w")} AS accuracy FROM pr WINDOW w AS (ORDER BY conf DESC, row_id ROWS UNBOUNDED PRECEDING)""")
def win1(spark, sf):
    return rounded(mt.risk_coverage(predictions(spark, sf)), "coverage", "accuracy")


@query("win1_accuracy_at_coverage_big", WB + f""", o AS (SELECT row_number() OVER w AS rank, sum(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) OVER w AS c FROM bpr
 WINDOW w AS (ORDER BY round(conf, 9) DESC, row_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT point, greatest(1, CAST(floor(point * (SELECT count(*) FROM bpr)) AS BIGINT)) AS n FROM (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS point))
SELECT point, n, {rq("c / n")} AS accuracy FROM q JOIN o ON o.rank = q.n""")
def win1_big(spark, sf):
    rows = big(spark, sf).withColumn("conf", F.round("conf", 9))
    return rounded(mt.accuracy_at_coverage(rows), "accuracy")


@query("win2_miss_rates", W + f""", t AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS threshold), m AS (SELECT * FROM pl WHERE k = 0 AND y = 0)
SELECT threshold, count(*) AS n, {rq("(count(*) - count(*) FILTER (WHERE p >= threshold)) / count(*)")} AS miss_rate FROM m, t GROUP BY 1""")
def win2(spark, sf):
    return rounded(mt.miss_rates(predictions(spark, sf), 0, (0.1, 0.2, 0.3)), "miss_rate")


@query("win3_majority_pick", """SELECT o_custkey, min(o_orderpriority) AS pick FROM (SELECT *, max(c) OVER (PARTITION BY o_custkey) AS m
 FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2)) WHERE c = m GROUP BY 1""")
def win3(spark, sf):
    from tallyvane.operators.split import group_class
    return group_class(groups(spark, sf), "o_custkey", "o_orderpriority").withColumnRenamed("_cls", "pick")


_CURVE = """ts AS (SELECT CAST(range AS INTEGER) AS i, round(0.95::DOUBLE - range * 0.005::DOUBLE, 10) AS t FROM range(188)),
raw AS (SELECT pr.row_id, pr.y, pr.pred, pl.p AS own FROM pr JOIN pl ON pl.row_id = pr.row_id AND pl.k = 0),
mv AS (SELECT t, y, CASE WHEN own >= t THEN 0 ELSE pred END AS pred FROM raw, ts),"""


@query("win4_threshold_curve", W + "," + _CURVE + class_sql("mv", "t") + f" SELECT t, {rq('max(CASE WHEN cls = 0 THEN recall END)')} AS recall, {rq('avg(f1)')} AS macro_f1 FROM cf GROUP BY 1")
def win4_curve(spark, sf):
    return rounded(fit.threshold_curve(predictions(spark, sf), 0).select("t", "recall", "macro_f1"), "recall", "macro_f1")


@query("win4_safety_threshold", W + "," + _CURVE + class_sql("mv", "t") + """,
cu AS (SELECT t, max(CASE WHEN cls = 0 THEN recall END) AS recall, avg(f1) AS f1 FROM cf GROUP BY 1),
n0 AS (SELECT y AS cls, count(*) FILTER (WHERE y = pred) AS tp, count(*) AS su, 0 AS pd FROM pr GROUP BY 1 UNION ALL SELECT pred, 0, 0, count(*) FROM pr GROUP BY 1),
n1 AS (SELECT cls, 2.0 * sum(tp) / (sum(su) + sum(pd)) AS f1, CASE WHEN sum(su) > 0 THEN sum(tp) / sum(su) ELSE 0 END AS recall FROM n0 GROUP BY 1),
nw AS (SELECT avg(f1) AS f1, max(recall) FILTER (WHERE cls = 0) AS recall FROM n1),
pk AS (SELECT max(t) FILTER (WHERE cu.recall >= 0.8 AND cu.f1 >= nw.f1 - 0.015) AS strict, max(t) FILTER (WHERE cu.recall >= 0.8) AS loose, any_value(nw.f1) AS f1, any_value(nw.recall) AS recall FROM cu, nw)
""" + f"""SELECT {rq("recall")} AS recall_before, {rq("f1")} AS macro_f1_before, CASE WHEN recall < 0.8 THEN coalesce(strict, loose) END AS threshold,
 CASE WHEN recall >= 0.8 THEN 'already_met' WHEN strict IS NOT NULL THEN 'within_floor' WHEN loose IS NOT NULL THEN 'floor_relaxed' ELSE 'unreachable' END AS outcome FROM pk""")
def win4(spark, sf):
    return rounded(fit.safety_threshold(predictions(spark, sf), 0), "recall_before", "macro_f1_before")


@query("agg32_batch_summary", W + """, c AS (SELECT CAST(pred AS INTEGER) AS pred, count(*) AS n FROM pr GROUP BY 1)
SELECT pred, n, pred IN (0, 2, 3, 7) AS malignant, CAST(sum(CASE WHEN pred IN (0, 2, 3, 7) THEN n ELSE 0 END) OVER () AS BIGINT) AS malignant_total FROM c""")
def agg32(spark, sf):
    return mt.batch_summary(predictions(spark, sf), [0, 2, 3, 7])


@query("agg34_variant_report", WB + """, vr AS (SELECT 'default' AS variant, y, pred FROM bpr UNION ALL
 SELECT 'scaled', y, CASE WHEN p0 * 0.8 >= p1 * 1.3 AND p0 * 0.8 >= p2 THEN 0 WHEN p1 * 1.3 >= p2 THEN 1 ELSE 2 END FROM bp),""" + class_sql("vr", "variant") + f""",
s AS (SELECT variant, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1 FROM cf GROUP BY 1)
SELECT variant, {rq("accuracy")} AS accuracy, {rq("f1")} AS macro_f1, {rq("f1 - max(CASE WHEN variant = 'default' THEN f1 END) OVER ()")} AS delta FROM s""")
def agg34(spark, sf):
    rows = big(spark, sf)
    scaled = sc.argmax(sc.scale_probs(F.col("p"), [0.8, 1.3, 1.0], KB, renormalise=False))
    both = rows.select("y", F.inline(F.array(
        F.struct(F.lit("default").alias("variant"), F.col("pred")), F.struct(F.lit("scaled").alias("variant"), scaled.alias("pred")))))
    return rounded(fit.variant_report(both, "default"), "accuracy", "macro_f1", "delta")
