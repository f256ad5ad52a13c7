"""Study protocol queries: identity groups, paired comparisons, held-out datasets, equalised odds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators import metrics as mt, study as st
from tallyvane.plans.fixtures import BIG, DIM, K, KB, PRED, COHORT, cohort_columns, pred_big, predictions, table
from tallyvane.plans.registry import query, rounded, rq

SEED = 42

# ---- identity groups ------------------------------------------------------------

IDS = ["patient", "lesion", "visit"]


def images(spark, sf):
    """Orders as images: patients, lesions and visits that some rows hold and others lack."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("image"), F.col("o_orderpriority").alias("cls"), F.when(k % 7 == 0, F.col("o_custkey")).alias("patient"),
        F.when(k % 4 != 0, F.floor(k / 3)).alias("lesion"), F.when(k % 10 == 1, F.floor(k / 50)).alias("visit"))


IMAGES = """im AS (SELECT o_orderkey AS image, o_orderpriority AS cls, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS patient,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 3 END AS lesion, CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey // 50 END AS visit FROM orders),
nd AS (SELECT image, unnest(list_filter(['patient:' || patient, 'lesion:' || lesion, 'visit:' || visit], lambda x: x IS NOT NULL)) AS node FROM im),
lk AS (SELECT DISTINCT a.node AS a, b.node AS b FROM nd a JOIN nd b USING (image)),
rc AS (SELECT a AS x, b AS y FROM lk UNION SELECT rc.x, lk.b FROM rc JOIN lk ON lk.a = rc.y),
ro AS (SELECT x AS node, min(y) AS root FROM rc GROUP BY x),
ig AS (SELECT image, any_value(root) AS grp FROM nd JOIN ro USING (node) GROUP BY image)"""


@query("study_identity_groups", "WITH RECURSIVE " + IMAGES + """ SELECT im.image, grp AS "group" FROM im LEFT JOIN ig USING (image)""")
def identity_groups(spark, sf):
    return st.identity_groups(images(spark, sf), IDS).select("image", "group")


_SPLIT = IMAGES + """,
gr AS (SELECT grp, row_number() OVER (ORDER BY md5('42:' || grp)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM ig)),
t1 AS (SELECT *, CAST(ceil(n * (0.15::DOUBLE / 1.0)) AS BIGINT) AS a FROM gr), t2 AS (SELECT *, a + CAST(ceil((n - a) * (0.05::DOUBLE / (1.0::DOUBLE - 0.15))) AS BIGINT) AS b FROM t1),
t3 AS (SELECT *, b + CAST(ceil((n - b) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2))) AS BIGINT) AS c FROM t2),
gs AS (SELECT grp, CASE WHEN rn <= a THEN 'test' WHEN rn <= b THEN 'val_calibrate' WHEN rn <= c THEN 'val_select' ELSE 'train' END AS split FROM t3),
fr AS (SELECT image, row_number() OVER (PARTITION BY cls ORDER BY md5('42:' || image)) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM im WHERE image NOT IN (SELECT image FROM ig)),
fs AS (SELECT image, CASE WHEN rn <= round(n * 0.15::DOUBLE) THEN 'test' WHEN rn <= round(n * 0.2::DOUBLE) THEN 'val_calibrate' WHEN rn <= round(n * 0.3::DOUBLE) THEN 'val_select' ELSE 'train' END AS split FROM fr),
sp AS (SELECT image, split FROM ig JOIN gs USING (grp) UNION ALL SELECT image, split FROM fs)"""


@query("study_identity_split", "WITH RECURSIVE " + _SPLIT + " SELECT image, split FROM sp")
def identity_split(spark, sf):
    return st.identity_split(images(spark, sf), IDS, "image", "cls", SEED).select("image", "split")


@query("study_straddling_ids", "WITH RECURSIVE " + _SPLIT + """, pi AS (SELECT split_part(node, ':', 1) AS "column", node, count(DISTINCT split) AS c FROM nd JOIN sp USING (image) GROUP BY 1, 2)
SELECT "column", count(*) AS n_ids, count(*) FILTER (WHERE c > 1) AS n_straddling FROM pi GROUP BY 1""")
def straddling(spark, sf):
    return st.straddling_ids(st.identity_split(images(spark, sf), IDS, "image", "cls", SEED), IDS)


# ---- two models on the same rows ---------------------------------------------------

def paired(spark, sf):
    """Line-item predictions of a baseline and of a variant that adds to one logit."""
    rows = pred_big(spark, sf)
    return rows.select("row_id", "y", sc.argmax(F.col("z")).alias("pred_a"), sc.argmax(F.array(F.col("z")[0], F.col("z")[1] + 0.05, F.col("z")[2])).alias("pred_b"))


PAIRED = BIG + """, pa AS (SELECT row_id, y, CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INTEGER) AS pred_a,
  CAST(CASE WHEN z0 >= z1 + 0.05 AND z0 >= z2 THEN 0 WHEN z1 + 0.05 >= z2 THEN 1 ELSE 2 END AS INTEGER) AS pred_b FROM bz)"""
REPLICATES = 100


def _replicates_sql() -> str:
    """Weights of all rows in all replicates, from the hashes that the operator draws by."""
    draws = ", ".join(f"({r}, {f}, {s})" for r, (f, s) in enumerate(st.replicate_keys(SEED, REPLICATES)))
    copies = " + ".join(f"(v >= {c})::INT" for c in st.poisson_cuts())
    return PAIRED + f""", dr AS (SELECT * FROM (VALUES {draws}) t(replicate, f, s)),
hs AS (SELECT y, pred_a, pred_b, ('0x' || substr(md5('{SEED}:' || row_id), 1, 12))::BIGINT % {st.PRIME} AS h FROM pa),
wt AS (SELECT replicate, y, pred_a, pred_b, sum({copies})::BIGINT AS n FROM (SELECT replicate, y, pred_a, pred_b, (h * f + s) % {st.PRIME} AS v FROM hs, dr) GROUP BY ALL),
al AS (SELECT * FROM wt WHERE n > 0 UNION ALL SELECT -1, y, pred_a, pred_b, count(*) FROM hs GROUP BY ALL),
md AS (SELECT replicate, 'a' AS model, y, pred_a AS pred, n FROM al UNION ALL SELECT replicate, 'b', y, pred_b, n FROM al),
sd AS (SELECT replicate, model, cls, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (SELECT replicate, model, y AS cls, CASE WHEN y = pred THEN n ELSE 0 END AS tp, n AS s, 0 AS p FROM md
  UNION ALL SELECT replicate, model, pred, 0, 0, n FROM md) GROUP BY 1, 2, 3),
rp AS (SELECT replicate, model, CAST(sum(s) AS BIGINT) AS n, sum(tp) / sum(s) AS accuracy, sum(2 * tp / (p + s)) / {KB} AS macro_f1 FROM sd GROUP BY 1, 2)"""


@query("study_bootstrap_replicates", "WITH " + _replicates_sql() + f" SELECT CAST(replicate AS INTEGER) AS replicate, model, n, {rq('accuracy')} AS accuracy, {rq('macro_f1')} AS macro_f1 FROM rp")
def bootstrap_replicates(spark, sf):
    return rounded(st.paired_bootstrap(paired(spark, sf), "row_id", KB, replicates=REPLICATES, seed=SEED), "accuracy", "macro_f1")


@query("study_paired_bootstrap", "WITH " + _replicates_sql() + f""", df AS (SELECT replicate, unnest(['accuracy', 'macro_f1']) AS metric,
  unnest([round(max(accuracy) FILTER (WHERE model = 'b') - max(accuracy) FILTER (WHERE model = 'a'), 12), round(max(macro_f1) FILTER (WHERE model = 'b') - max(macro_f1) FILTER (WHERE model = 'a'), 12)]) AS d FROM rp GROUP BY replicate)
SELECT metric, count(*) FILTER (WHERE replicate >= 0) AS replicates, {rq('max(d) FILTER (WHERE replicate < 0)')} AS difference, {rq('quantile_cont(d, 0.025) FILTER (WHERE replicate >= 0)')} AS low,
  {rq('quantile_cont(d, 0.975) FILTER (WHERE replicate >= 0)')} AS high, {rq('avg((d <= 0)::INT::DOUBLE) FILTER (WHERE replicate >= 0)')} AS share_not_better FROM df GROUP BY metric""")
def bootstrap(spark, sf):
    made = st.bootstrap_interval(st.paired_bootstrap(paired(spark, sf), "row_id", KB, replicates=REPLICATES, seed=SEED))
    return rounded(made, "difference", "low", "high", "share_not_better")


_MCN = """, ct AS (SELECT y, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither
  FROM (SELECT y, y = pred_a AS a, y = pred_b AS b FROM pa) GROUP BY GROUPING SETS ((y), ())),
mc AS (SELECT *, only_a + only_b AS m, least(only_a, only_b) AS lo FROM ct),
tl AS (SELECT y, "both", only_a, only_b, neither, m, CASE WHEN m > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / m ELSE 0 END AS statistic,
  CASE WHEN m = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, lo + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))))) END AS p_exact FROM mc)"""


@query("study_mcnemar_by_class", "WITH " + PAIRED + _MCN + f""" SELECT y, "both", only_a, only_b, neither, {rq('statistic', 4)} AS statistic, {rq('p_exact')} AS p_exact FROM tl WHERE y IS NOT NULL""")
def mcnemar_by_class(spark, sf):
    return rounded(rounded(st.mcnemar(paired(spark, sf), ["y"]), "p_exact"), "statistic", digits=4)


@query("study_mcnemar", "WITH " + PAIRED + _MCN + f""" SELECT "both", only_a, only_b, neither, {rq('statistic', 4)} AS statistic, {rq('p_exact')} AS p_exact FROM tl WHERE y IS NULL""")
def mcnemar(spark, sf):
    return rounded(rounded(st.mcnemar(paired(spark, sf)), "p_exact"), "statistic", digits=4)


@query("study_mcnemar_by_label", "WITH " + PRED + """, pa AS (SELECT y, pred AS pred_a, CAST(CASE WHEN row_id % 9 = 0 THEN (pred + 1) % 10 WHEN row_id % 11 = 0 THEN y ELSE pred END AS INTEGER) AS pred_b FROM pr)""" + _MCN +
       f""" SELECT y, "both", only_a, only_b, neither, {rq('statistic', 4)} AS statistic, {rq('p_exact')} AS p_exact FROM tl WHERE y IS NOT NULL""")
def mcnemar_by_label(spark, sf):
    moved = F.when(F.col("row_id") % 9 == 0, (F.col("pred") + 1) % 10).when(F.col("row_id") % 11 == 0, F.col("y")).otherwise(F.col("pred")).cast("int")
    rows = predictions(spark, sf).select("y", F.col("pred").alias("pred_a"), moved.alias("pred_b"))
    return rounded(rounded(st.mcnemar(rows, ["y"]), "p_exact"), "statistic", digits=4)


# ---- held-out datasets ----------------------------------------------------------------

DATASETS = [0, 1, 2, 3]


@query("study_held_out_sizes", """WITH c AS (SELECT source AS held_out, lang AS cls, count(*) AS own FROM documents GROUP BY 1, 2), s AS (SELECT * FROM (SELECT DISTINCT held_out FROM c), (SELECT DISTINCT cls FROM c)),
f AS (SELECT s.held_out, s.cls, coalesce(own, 0) AS own FROM s LEFT JOIN c USING (held_out, cls))
SELECT held_out, cls, CAST(sum(own) OVER (PARTITION BY cls) - own AS BIGINT) AS n_train, own AS n_test FROM f""")
def held_out_sizes(spark, sf):
    return st.held_out_sizes(table(spark, sf, "documents"), "source", "lang")


@query("study_held_out_roles", """SELECT doc_id, CASE WHEN source = 'src0' THEN 'test' WHEN ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT / pow(2, 52) < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents""")
def held_out_roles(spark, sf):
    return st.held_out_roles(table(spark, sf, "documents"), "source", "src0", "doc_id", SEED).select("doc_id", "split")


@query("study_transfer_matrix", f"""WITH e AS (SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS ds, label AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
o AS (SELECT unnest([0, 1, 2, 3]) AS left_out), mu AS (SELECT left_out, y AS k, d, avg(v) AS m FROM o JOIN e ON e.ds <> o.left_out GROUP BY 1, 2, 3),
ds AS (SELECT left_out, vec_id, any_value(e.ds) AS tested_on, any_value(y) AS y, k, sum((v - m) * (v - m)) AS far FROM e JOIN mu USING (d) GROUP BY left_out, vec_id, k),
pr AS (SELECT left_out, tested_on, y, arg_min(k, far) AS pred FROM ds GROUP BY left_out, tested_on, y, vec_id),
sd AS (SELECT left_out, tested_on, cls, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (SELECT left_out, tested_on, y AS cls, (y = pred)::INT AS tp, 1 AS s, 0 AS p FROM pr UNION ALL SELECT left_out, tested_on, pred, 0, 0, 1 FROM pr) GROUP BY 1, 2, 3)
SELECT CAST(left_out AS INTEGER) AS left_out, tested_on, CAST(sum(s) AS BIGINT) AS n, {rq('sum(tp) / sum(s)')} AS accuracy, {rq('sum(2 * tp / (p + s)) / 10')} AS macro_f1 FROM sd GROUP BY 1, 2""")
def transfer_matrix(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("ds", (F.col("vec_id") % 4).cast("int"))
    return rounded(st.transfer_matrix(rows, "ds", "label", "embedding", DIM, DATASETS, K), "accuracy", "macro_f1")


# ---- equalised odds --------------------------------------------------------------------

POSITIVE = [0, 1, 2]
_LATTICE = "WITH " + PRED + "," + COHORT + """,
bd AS (SELECT y, pred, CASE WHEN fitzpatrick IN (1, 2) THEN 'I-II' WHEN fitzpatrick IN (3, 4) THEN 'III-IV' WHEN fitzpatrick IN (5, 6) THEN 'V-VI' END AS skin_tone, sex,
  CASE WHEN age > 0 AND age < 40 THEN '<40' WHEN age >= 40 AND age < 60 THEN '40-60' WHEN age >= 60 AND age < 75 THEN '60-75' WHEN age >= 75 THEN '>=75' END AS age_band FROM co),
ms AS (SELECT * FROM (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) t(a, b, c)),
lt AS (SELECT concat_ws(' x ', CASE WHEN a = 1 THEN 'skin_tone' END, CASE WHEN b = 1 THEN 'sex' END, CASE WHEN c = 1 THEN 'age_band' END) AS crossing,
  concat_ws(' | ', CASE WHEN a = 1 THEN skin_tone END, CASE WHEN b = 1 THEN sex END, CASE WHEN c = 1 THEN age_band END) AS cohort, y, pred
  FROM bd, ms WHERE (a = 0 OR skin_tone IS NOT NULL) AND (b = 0 OR sex IS NOT NULL) AND (c = 0 OR age_band IS NOT NULL)),
ra AS (SELECT crossing, cohort, count(*) AS n, count(*) FILTER (WHERE y IN (0, 1, 2) AND pred IN (0, 1, 2)) / nullif(count(*) FILTER (WHERE y IN (0, 1, 2)), 0) AS tpr,
  count(*) FILTER (WHERE y NOT IN (0, 1, 2) AND pred IN (0, 1, 2)) / nullif(count(*) FILTER (WHERE y NOT IN (0, 1, 2)), 0) AS fpr FROM lt GROUP BY 1, 2 HAVING count(*) >= 30),
sd AS (SELECT crossing, cohort, cls, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (SELECT crossing, cohort, y AS cls, (y = pred)::INT AS tp, 1 AS s, 0 AS p FROM lt UNION ALL SELECT crossing, cohort, pred, 0, 0, 1 FROM lt) GROUP BY 1, 2, 3),
od AS (SELECT ra.*, f1 FROM ra JOIN (SELECT crossing, cohort, sum(2 * tp / (p + s)) / 10 AS f1 FROM sd GROUP BY 1, 2) USING (crossing, cohort))"""


def odds(spark, sf):
    rows = cohort_columns(predictions(spark, sf))
    bands = {"skin_tone": mt.skin_band(F.col("fitzpatrick")), "sex": mt.sex_band(F.col("sex")), "age_band": mt.age_band(F.col("age"))}
    return st.cohort_odds(st.cohort_lattice(rows, bands), POSITIVE, K)


@query("study_cohort_odds", _LATTICE + f" SELECT crossing, cohort, n, {rq('tpr')} AS tpr, {rq('fpr')} AS fpr, {rq('f1')} AS macro_f1 FROM od")
def cohort_odds(spark, sf):
    return rounded(odds(spark, sf), "tpr", "fpr", "macro_f1")


@query("study_equalised_odds", _LATTICE + f""", g AS (SELECT crossing, count(*) AS n_cohorts, max(tpr) - min(tpr) AS t, max(fpr) - min(fpr) AS f FROM od WHERE crossing <> '' GROUP BY 1)
SELECT crossing, n_cohorts, {rq('t')} AS tpr_gap, {rq('f')} AS fpr_gap, {rq('greatest(t, f)')} AS odds_gap FROM g""")
def equalised_odds(spark, sf):
    return rounded(st.equalised_odds(odds(spark, sf)), "tpr_gap", "fpr_gap", "odds_gap")


@query("study_cohort_deficits", _LATTICE + f""", w AS (SELECT f1 AS everyone FROM od WHERE crossing = '')
SELECT crossing, cohort, n, {rq('f1')} AS macro_f1, {rq('everyone - f1')} AS deficit, everyone - f1 > 0.10 AS flagged FROM od, w WHERE crossing <> ''""")
def cohort_deficits(spark, sf):
    return rounded(st.cohort_deficits(odds(spark, sf)), "macro_f1", "deficit")
