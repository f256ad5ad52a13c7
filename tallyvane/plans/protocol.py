"""Runs from end to end as queries: each writes its tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.operators import protocol as pt, split as sp
from tallyvane.plans.evaluate import _LEFT, _ROLL, _ece_sql, class_sql
from tallyvane.plans.fixtures import COHORT, K, PRED, cohort_columns, groups, pred, predictions
from tallyvane.plans.registry import query, r, rounded, rq
from tallyvane.plans.split import _FOLD, _GROUP, SEED
from tallyvane.storage import scratch_path

W = "WITH " + PRED
_SIZES = f" SELECT fold, split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, {rq('count(*) / sum(count(*)) OVER (PARTITION BY fold)')} AS achieved FROM"


def _run(spark, sf, mode):
    out = scratch_path(spark, f"split-{mode}")
    manifest = pt.run_split(groups(spark, sf), out, "o_custkey", "o_orderpriority", mode, SEED)
    return out, rounded(manifest.select("fold", "split", "n_rows", "n_groups", "achieved"), "achieved")


@query("run_split_single", "WITH " + _GROUP + _SIZES + " (SELECT 0::INTEGER AS fold, split, o_custkey FROM orders JOIN gs USING (o_custkey)) GROUP BY fold, split")
def run_split_single(spark, sf):
    return _run(spark, sf, "single")[1]


@query("run_split_kfold", "WITH " + _FOLD + _SIZES + " orders JOIN fs USING (o_custkey) GROUP BY fold, split")
def run_split_kfold(spark, sf):
    return _run(spark, sf, "kfold")[1]


@query("run_split_rows", "WITH " + _GROUP + " SELECT o_orderkey, o_orderpriority, split FROM orders JOIN gs USING (o_custkey)")
def run_split_rows(spark, sf):
    """The rows as they lie in the written folders."""
    out, _ = _run(spark, sf, "single")
    return spark.read.parquet(f"{out}/rows").select("o_orderkey", "o_orderpriority", "split")


_SPLIT = "sp AS (SELECT vec_id AS row_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id)) <= round(count(*) OVER (PARTITION BY label) * 0.5::DOUBLE) THEN 'fit' ELSE 'test' END AS split FROM embeddings), tp AS (SELECT pr.* FROM pr JOIN sp USING (row_id) WHERE split = 'test')"


@query("run_calibrate_evaluate", W + "," + _SPLIT + "," + _ece_sql(_LEFT.format(v="conf"), "tp", "conf", "y = pred") + f""",
b AS (SELECT avg(x) AS brier FROM (SELECT sum(pow(p - CASE WHEN k = y THEN 1 ELSE 0 END, 2)) AS x FROM pl JOIN sp USING (row_id) WHERE split = 'test' GROUP BY row_id)),
m AS (SELECT avg(-ln(greatest(py, 1e-12))) AS nll, avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM tp)
SELECT 'method=raw' AS scope, key, round(value, 5) + 0.0 AS value, TRUE AS refused FROM (SELECT unnest(['nll', 'ece', 'mce', 'brier', 'accuracy']) AS key, unnest([nll, ece, mce, brier, accuracy]) AS value FROM m, er, b)
UNION ALL SELECT 'method=' || m, k, NULL, TRUE FROM (SELECT unnest(['global', 'per_class', 'dirichlet']) AS m), (SELECT unnest(['nll', 'ece', 'mce', 'brier', 'accuracy']) AS k)""")
def run_evaluate(spark, sf):
    """Raw metrics have an SQL twin; ``refused``: the same run with the test rows as calibration rows is turned down.

    The target prior of these rows lies on the edge and is crept up to, so the tenth iterate is taken.
    """
    rows = sp.stratified_split(pred(spark, sf).select("row_id", "y", "z"), "y", "row_id", [0.5], ["fit", "test"], 7)
    cal, test = rows.filter("split = 'fit'"), rows.filter("split = 'test'")
    prior = [1.0 / K] * K
    try:
        pt.require_disjoint(test, test, ["row_id"])
        refused = False
    except pt.LeakError:
        refused = True
    got = pt.calibrate_and_evaluate(cal, test, K, prior, out=scratch_path(spark, "evaluation"), prior_steps=10, unfinished=True).metrics
    value = F.when(F.col("scope") == "method=raw", r(F.col("value"), 5))
    return got.filter("name = 'calibration'").select("scope", "key", value.alias("value"), F.lit(refused).alias("refused"))


@query("run_audit_bundle", W + "," + COHORT + "," + _ROLL + """, mb AS (
 SELECT 'skin_tone' AS dim, CASE WHEN fitzpatrick <= 2 THEN 'I-II' WHEN fitzpatrick <= 4 THEN 'III-IV' WHEN fitzpatrick <= 6 THEN 'V-VI' END AS cohort, y, pred FROM co
 UNION ALL SELECT 'sex', sex, y, pred FROM co
 UNION ALL SELECT 'age_band', CASE WHEN age > 0 THEN CASE WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-60' WHEN age < 75 THEN '60-75' ELSE '>=75' END END, y, pred FROM co),
lv AS (SELECT 'fairness' AS name, 'dim=' || dim || '/cohort=' || cohort AS scope, y, pred FROM mb WHERE cohort IS NOT NULL
 UNION ALL SELECT 'per_group', 'level=image', y, pred FROM pr UNION ALL SELECT 'per_group', 'level=group_majority', y, majority FROM tr JOIN mv USING (lesion)
 UNION ALL SELECT 'per_group', 'level=group_mean_prob', y, mean_prob FROM tr JOIN mp USING (lesion)),""" + class_sql("lv", "name, scope") + """,
s AS (SELECT name, scope, sum(support)::DOUBLE AS n, avg(f1) AS f1, max(CASE WHEN cls = 0 THEN recall END) AS r FROM cf GROUP BY 1, 2),
o AS (SELECT row_number() OVER w AS rank, sum(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) OVER w AS c FROM pr WINDOW w AS (ORDER BY round(conf, 9) DESC, row_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT point, greatest(1, CAST(floor(point * (SELECT count(*) FROM pr)) AS BIGINT)) AS n FROM (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS point)),
a AS (SELECT point, n, c / n AS accuracy FROM q JOIN o ON o.rank = q.n),
ms AS (SELECT t, count(*) AS n, (count(*) - count(*) FILTER (WHERE p >= t)) / count(*) AS m FROM pl, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS t) WHERE k = 0 AND y = 0 GROUP BY 1),
u AS (SELECT name, scope, 'n' AS key, n AS value FROM s UNION ALL SELECT name, scope, 'macro_f1', CASE WHEN name = 'per_group' OR n >= 30 THEN f1 END FROM s
 UNION ALL SELECT name, scope, 'watched_recall', CASE WHEN n >= 30 AND scope LIKE 'dim=skin_tone%' THEN coalesce(r, 0) END FROM s WHERE name = 'fairness'
 UNION ALL SELECT 'selective', 'point=' || point, 'n', n FROM a UNION ALL SELECT 'selective', 'point=' || point, 'accuracy', accuracy FROM a
 UNION ALL SELECT 'missed', 'threshold=' || t, 'n', n FROM ms UNION ALL SELECT 'missed', 'threshold=' || t, 'miss_rate', m FROM ms)
SELECT name, scope, key, """ + rq("value") + " AS value FROM u")
def run_audit(spark, sf):
    rows = cohort_columns(predictions(spark, sf)).withColumns({"grp": F.floor(F.col("row_id") / 3), "conf": F.round("conf", 9)})
    return rounded(pt.audit_bundle(rows, "grp", K, out=scratch_path(spark, "audit")), "value")
