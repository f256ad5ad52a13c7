"""Score-algebra queries (SC*, SRT1-SRT5, MAP1, JN9, JN10 inputs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.functions.encode import meta_mask, meta_vector
from tallyvane.operators import attribution as at, ensemble as es, joins as jn, metrics as mt
from tallyvane.plans.evaluate import class_sql
from tallyvane.plans.fixtures import K, META, PRED, VIEWS, meta, pred, pred_views, predictions, scored, table
from tallyvane.plans.registry import query, r, rounded, rq
from tallyvane.schema import META_FEATURES, META_GROUPS
from tallyvane.sources.sinks import one_row

W = "WITH " + PRED
NAMES = [f"C{i}" for i in range(K)]
T_CLASS = [0.5, 0.8, 1.0, 1.2, 1.5, 0.7, 0.9, 1.1, 1.3, 2.0]
SCALES = [1.0, 0.5, 1.5, 2.0, 1.0, 1.0, 0.8, 1.2, 1.0, 0.9]
BIAS = [0.05 * i for i in range(K)]
WEIGHT = [[1.0 + 0.02 * i if i == j else 0.01 * ((i * 3 + j) % 5 - 2) for j in range(K)] for i in range(K)]
TRAIN = [0.05, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]
TARGET = [0.2, 0.1, 0.1, 0.05, 0.05, 0.1, 0.1, 0.1, 0.1, 0.1]


def lst(values) -> str:
    return "([" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "])"


def long(df, col: str, *keep: str):
    """(keep..., k, value) rows of an array column, rounded."""
    cells = F.array(*[F.struct(F.lit(i).alias("k"), r(F.col(col)[i]).alias("value")) for i in range(K)])
    return df.select(*keep, F.inline(cells))


# normalised priors and their ratio
PRIOR = f"""pri AS (SELECT unnest(range(10)) AS k, unnest({lst(TRAIN)}) AS tr, unnest({lst(TARGET)}) AS ta),
rat AS (SELECT k, (greatest(ta, 1e-12) / sum(greatest(ta, 1e-12)) OVER ()) / (greatest(tr, 1e-12) / sum(greatest(tr, 1e-12)) OVER ()) AS ratio FROM pri)"""


def soft_sql(src: str, out: str) -> str:
    """Softmax of a long (row_id, y, k, z) source into ``out`` (row_id, y, k, p)."""
    return f"""{out}_m AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS m FROM {src}),
{out} AS (SELECT row_id, y, k, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id) AS p FROM {out}_m)"""


@query("sc1_softmax", W + f"SELECT row_id, CAST(k AS INTEGER) AS k, {rq('p')} AS p, {rq('z - lse')} AS log_p FROM pl")
def sc1(spark, sf):
    rows = pred(spark, sf).withColumns({"p": sc.softmax(F.col("z"), K), "lp": sc.log_softmax(F.col("z"), K)})
    cells = F.array(*[F.struct(F.lit(i).alias("k"), r(F.col("p")[i]).alias("p"), r(F.col("lp")[i]).alias("log_p")) for i in range(K)])
    return rows.select("row_id", F.inline(cells))


@query("sc2_argmax", W + f"SELECT row_id, pred, {rq('conf')} AS conf FROM pr")
def sc2(spark, sf):
    return rounded(predictions(spark, sf).select("row_id", "pred", "conf"), "conf")


@query("sc3_view_mean", W + "," + VIEWS + f" SELECT row_id, CAST(model AS INTEGER) AS model, CAST(k AS INTEGER) AS k, {rq('avg(z)')} AS value FROM vl GROUP BY row_id, model, k")
def sc3(spark, sf):
    return long(es.mean_views(pred_views(spark, sf), K), "z", "row_id", "model")


MODEL_W = {0: 0.5, 1: 0.3, 2: 0.2}


@query("sc4_ensemble", W + "," + VIEWS + f""", mv AS (SELECT row_id, y, model, k, avg(z) AS z FROM vl GROUP BY 1, 2, 3, 4)
SELECT row_id, CAST(k AS INTEGER) AS k, {rq('avg(z)')} AS uniform, {rq("sum(z * ([0.5, 0.3, 0.2])[model + 1]::DOUBLE)")} AS weighted FROM mv GROUP BY row_id, k""")
def sc4(spark, sf):
    rows = es.mean_views(pred_views(spark, sf), K)
    u = long(es.blend_models(rows, K), "z", "row_id").withColumnRenamed("value", "uniform")
    w = long(es.blend_models(rows, K, MODEL_W), "z", "row_id").withColumnRenamed("value", "weighted")
    return u.join(w, ["row_id", "k"])


@query("sc5_temperature", W + f""" SELECT row_id, CAST(k AS INTEGER) AS k, {rq('z / 0.75')} AS scalar, {rq(f'z / {lst(T_CLASS)}[k + 1]')} AS per_class, {rq('z')} AS identity FROM zl""")
def sc5(spark, sf):
    z = F.col("z")
    rows = pred(spark, sf).withColumns({
        "s": sc.temperature(z, K, scalar=0.75), "c": sc.temperature(z, K, per_class=T_CLASS, scalar=0.75), "i": sc.temperature(z, K),
    })
    cells = F.array(*[F.struct(
        F.lit(i).alias("k"), r(F.col("s")[i]).alias("scalar"), r(F.col("c")[i]).alias("per_class"), r(F.col("i")[i]).alias("identity"),
    ) for i in range(K)])
    return rows.select("row_id", F.inline(cells))


_DIR = f"""wt AS (SELECT unnest(range(100)) AS ij, unnest({lst([v for row in WEIGHT for v in row])}) AS w),
dz AS (SELECT row_id, y, ij // 10 AS k, sum(w * (z - lse)) + any_value({lst(BIAS)}[ij // 10 + 1]) AS z FROM pl JOIN wt ON wt.ij % 10 = pl.k GROUP BY 1, 2, 3)"""


@query("sc6_dirichlet", W + "," + _DIR + f" SELECT row_id, CAST(k AS INTEGER) AS k, {rq('z')} AS value FROM dz")
def sc6(spark, sf):
    return long(pred(spark, sf).withColumn("d", sc.dirichlet(F.col("z"), WEIGHT, BIAS, K)), "d", "row_id")


@query("sc7_prior_shift", W + "," + PRIOR + f""", j AS (SELECT pl.*, ratio, p * ratio AS a FROM pl JOIN rat USING (k))
SELECT row_id, CAST(k AS INTEGER) AS k, {rq('z + ln(ratio)')} AS logit, {rq('a / sum(a) OVER (PARTITION BY row_id)')} AS prob FROM j""")
def sc7(spark, sf):
    rows = predictions(spark, sf).withColumns({
        "l": sc.shift_logits(F.col("z"), TRAIN, TARGET, K), "q": sc.shift_probs(F.col("p"), TRAIN, TARGET, K),
    })
    cells = F.array(*[F.struct(F.lit(i).alias("k"), r(F.col("l")[i]).alias("logit"), r(F.col("q")[i]).alias("prob")) for i in range(K)])
    return rows.select("row_id", F.inline(cells))


@query("sc8_class_scales", W + f", j AS (SELECT *, p * {lst(SCALES)}[k + 1] AS a FROM pl) SELECT row_id, CAST(k AS INTEGER) AS k, {rq('a / sum(a) OVER (PARTITION BY row_id)')} AS value FROM j")
def sc8(spark, sf):
    return long(predictions(spark, sf).withColumn("q", sc.scale_probs(F.col("p"), SCALES, K)), "q", "row_id")


@query("sc9_safety_override", W + f""", j AS (SELECT *, p * {lst(SCALES)}[k + 1] AS a FROM pl), f AS (SELECT *, a / sum(a) OVER (PARTITION BY row_id) AS q FROM j),
g AS (SELECT row_id, max(p) FILTER (WHERE k = 1) AS raw, max(q) FILTER (WHERE k = 1) AS fin, min(k) FILTER (WHERE q = qm) AS pred FROM (SELECT *, max(q) OVER (PARTITION BY row_id) AS qm FROM f) GROUP BY 1)
SELECT row_id, CAST(CASE WHEN raw >= 0.15 THEN 1 ELSE pred END AS INTEGER) AS pred_raw, CAST(CASE WHEN fin >= 0.15 THEN 1 ELSE pred END AS INTEGER) AS pred_final, raw >= 0.15 AS triggered FROM g""")
def sc9(spark, sf):
    rows = predictions(spark, sf).withColumn("q", sc.scale_probs(F.col("p"), SCALES, K)).withColumn("best", sc.argmax(F.col("q")))
    return rows.select(
        "row_id", sc.override_pred(F.col("best"), F.col("p"), 1, 0.15).alias("pred_raw"),
        sc.override_pred(F.col("best"), F.col("q"), 1, 0.15).alias("pred_final"), sc.override_flag(F.col("p"), 1, 0.15).alias("triggered"),
    )


@query("sc10_calibrated_predict", W + "," + VIEWS + f""", mv AS (SELECT row_id, y, model, k, avg(z) AS z FROM vl GROUP BY 1, 2, 3, 4),
en AS (SELECT row_id, y, k, sum(z * ([0.5, 0.3, 0.2])[model + 1]::DOUBLE) / {lst(T_CLASS)}[k + 1] AS z FROM mv GROUP BY 1, 2, 3),
""" + f"""em AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS m FROM en), el AS (SELECT row_id, y, k, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY row_id)) AS lp FROM em),
wt AS (SELECT unnest(range(100)) AS ij, unnest({lst([v for row in WEIGHT for v in row])}) AS w),
dd AS (SELECT row_id, y, ij // 10 AS k, sum(w * lp) + any_value({lst(BIAS)}[ij // 10 + 1]) AS z FROM el JOIN wt ON wt.ij % 10 = el.k GROUP BY 1, 2, 3),
""" + PRIOR + ", ps AS (SELECT row_id, y, k, z + ln(ratio) AS z FROM dd JOIN rat USING (k))," + soft_sql("ps", "sp") + f""",
sa AS (SELECT *, p * {lst(SCALES)}[k + 1] AS a FROM sp), sn AS (SELECT *, a / sum(a) OVER (PARTITION BY row_id) AS q FROM sa),
sm AS (SELECT *, max(q) OVER (PARTITION BY row_id) AS qm FROM sn)
SELECT row_id, {rq('max(q)')} AS conf, max(p) FILTER (WHERE k = 1) >= 0.15 AS override,
 CAST(CASE WHEN max(p) FILTER (WHERE k = 1) >= 0.15 THEN 1 ELSE min(k) FILTER (WHERE q = qm) END AS INTEGER) AS pred FROM sm GROUP BY row_id""")
def sc10(spark, sf):
    rows = es.blend_models(es.mean_views(pred_views(spark, sf), K), K, MODEL_W)
    out = es.calibrated_predict(rows, K, per_class=T_CLASS, weight=WEIGHT, bias=BIAS, train=TRAIN, target=TARGET, scales=SCALES, watch=1, threshold=0.15)
    return out.select("row_id", r(F.array_max("p")).alias("conf"), "override", "pred")


# ---- parameters as a table ---------------------------------------------------------

def params_table(spark, sf):
    """One-row parameter table with some assets absent, derived from the label counts."""
    e = table(spark, sf, "embeddings")
    counts = e.groupBy("label").agg(F.count("*").alias("n"))
    prior = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda s: s["n"].cast("double")).alias("train_prior"))
    return prior.select(
        F.lit(0.75).alias("temperature"), F.lit(None).cast("array<double>").alias("class_temperature"), "train_prior",
        F.lit(None).cast("array<double>").alias("scales"), F.lit(0.2).alias("threshold"),
    )


@query("src11_parameter_assets", W + f""", cn AS (SELECT label AS k, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1), rt AS (SELECT k, 0.1 / (n / sum(n) OVER ()) AS ratio FROM cn),
zt AS (SELECT row_id, y, k, z / 0.75 AS z FROM zl),""" + soft_sql("zt", "tp") + f""", ad AS (SELECT row_id, k, p * ratio AS a FROM tp JOIN rt USING (k)), an AS (SELECT *, a / sum(a) OVER (PARTITION BY row_id) AS q FROM ad)
SELECT row_id, {rq('max(q)')} AS conf, max(q) FILTER (WHERE k = 0) >= 0.2 AS triggered FROM an GROUP BY 1""")
def src11(spark, sf):
    rows = pred(spark, sf).withColumn("prm", one_row(params_table(spark, sf)))
    prm = F.col("prm")
    rows = rows.withColumn("zt", sc.temperature(F.col("z"), K, per_class=prm["class_temperature"], scalar=prm["temperature"]))
    rows = rows.withColumn("p", sc.softmax(F.col("zt"), K))
    rows = rows.withColumn("q", sc.shift_probs(F.col("p"), prm["train_prior"], [0.1] * K, K))
    rows = rows.withColumn("q", sc.scale_probs(F.col("q"), F.coalesce(prm["scales"], F.array(*[F.lit(1.0)] * K)), K))
    return rows.select("row_id", r(F.array_max("q")).alias("conf"), sc.override_flag(F.col("q"), 0, prm["threshold"]).alias("triggered"))


@query("jn9_row_aligned", W + f", m AS (SELECT vec_id, label % 3 AS grp FROM embeddings) SELECT row_id, pred, CAST(grp AS INTEGER) AS grp FROM pr JOIN m ON m.vec_id = pr.row_id")
def jn9(spark, sf):
    side = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 3).alias("grp"))
    return jn.align(predictions(spark, sf).select("row_id", "pred"), side, "row_id")


# ---- rankings inside a row -----------------------------------------------------------

@query("srt1_top3", W + f", o AS (SELECT row_id, k, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, k) AS pos FROM pl) "
       f"SELECT row_id, CAST(pos AS INTEGER) AS pos, 'C' || k AS class, {rq('p')} AS probability FROM o WHERE pos <= 3")
def srt1(spark, sf):
    rows = predictions(spark, sf).select("row_id", F.posexplode_outer(sc.top_k(F.col("p"), 3, NAMES)).alias("pos", "s"))
    return rows.select("row_id", (F.col("pos") + 1).alias("pos"), "s.class", r("s.probability").alias("probability"))


_THR = {"C0": 0.57, "C1": 0.48, "C2": 0.42, "C3": 0.31}


@query("srt2_scores_with_margin", W + f""", t AS (SELECT *, CASE k WHEN 0 THEN 0.57 WHEN 1 THEN 0.48 WHEN 2 THEN 0.42 WHEN 3 THEN 0.31 ELSE 0.5 END::DOUBLE AS thr FROM pl)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY p DESC, k) AS INTEGER) AS pos, 'C' || k AS "classCode", {rq('p')} AS probability, thr AS threshold, {rq('p - thr')} AS "thresholdMargin" FROM t""")
def srt2(spark, sf):
    rows = predictions(spark, sf).select("row_id", F.posexplode_outer(sc.scores_with_margin(F.col("p"), NAMES, _THR, 0.5)).alias("pos", "s"))
    return rows.select("row_id", (F.col("pos") + 1).alias("pos"), "s.classCode", r("s.probability").alias("probability"), "s.threshold", r("s.thresholdMargin").alias("thresholdMargin"))


@query("srt3_top_attributions", W + f""", a AS (SELECT row_id, 'C' || k AS id, p - 0.1 AS value FROM pl),
o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, id) AS pos FROM a)
SELECT row_id, CAST(pos AS INTEGER) AS pos, id, {rq('value')} AS value, CASE WHEN value >= 0 THEN 'supports' ELSE 'weakens' END AS direction FROM o WHERE pos <= 6""")
def srt3(spark, sf):
    attr = F.map_from_arrays(F.array(*[F.lit(n) for n in NAMES]), F.array(*[F.col("p")[i] - 0.1 for i in range(K)]))
    rows = predictions(spark, sf).withColumn("attr", attr).select("row_id", F.posexplode_outer(sc.top_attributions(F.col("attr"))).alias("pos", "s"))
    return rows.select("row_id", (F.col("pos") + 1).alias("pos"), "s.id", r("s.value").alias("value"), "s.direction")


@query("srt4_closest_alternatives", W + f""", o AS (SELECT pl.row_id, k, p, row_number() OVER (PARTITION BY pl.row_id ORDER BY p DESC, k) AS pos FROM pl JOIN pr ON pr.row_id = pl.row_id AND pr.pred <> pl.k)
SELECT row_id, CAST(pos AS INTEGER) AS pos, 'C' || k AS class, {rq('p')} AS probability FROM o WHERE pos <= 2""")
def srt4(spark, sf):
    rows = predictions(spark, sf).select("row_id", F.posexplode_outer(sc.closest_alternatives(F.col("p"), F.col("pred"), NAMES)).alias("pos", "s"))
    return rows.select("row_id", (F.col("pos") + 1).alias("pos"), "s.class", r("s.probability").alias("probability"))


@query("srt5_class_candidates", W + f""", f AS (SELECT row_id, y, round(py, 9) AS py, row_id % 4 = 0 AS downsampled FROM pr),
pool AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY downsampled, row_id) AS a FROM f),
best AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY py DESC, row_id) AS rank FROM pool WHERE a <= 50)
SELECT y, row_id, downsampled, {rq('py')} AS true_prob, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5""")
def srt5(spark, sf):
    rows = predictions(spark, sf).select(
        "row_id", "y", F.round(F.col("p")[F.col("y")], 9).alias("py"), (F.col("row_id") % 4 == 0).alias("downsampled"))
    out = jn.top_per_class(rows, "y", [F.col("py").desc(), F.col("row_id")], 5, pool=50, pool_order=[F.col("downsampled"), F.col("row_id")])
    return out.select("y", "row_id", "downsampled", r("py").alias("true_prob"), "rank")


@query("srt7_first_per_class", "SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 5")
def srt7(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return jn.top_per_class(rows, "l_returnflag", order, 5).select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("map1_probability_map", W + f"SELECT row_id, {rq('max(p) FILTER (WHERE k = 3)')} AS p_c3, 0.0::DOUBLE AS p_missing, 'C' || any_value(pred) AS first_key FROM pl JOIN pr USING (row_id) GROUP BY row_id")
def map1(spark, sf):
    rows = predictions(spark, sf).select("row_id", sc.prob_map(F.col("p"), NAMES).alias("m"))
    return rows.select("row_id", r(sc.prob_of(F.col("m"), "C3")).alias("p_c3"), sc.prob_of(F.col("m"), "ZZ").alias("p_missing"), F.map_keys("m")[0].alias("first_key"))


# ---- ablation and attribution ------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
N_SEG = len(SEGMENTS)


def _fixed_weights() -> tuple[list[list[float]], list[float]]:
    return [[0.5 * (((c + 1) * (j + 2)) % 7 - 3) for j in range(len(META_FEATURES))] for c in range(N_SEG)], [0.1 * c for c in range(N_SEG)]


def meta_rows(spark, sf):
    """Encoded metadata with the market segment as class."""
    m = meta(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    y = (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1).cast("int")
    cols = [F.col(c) for c in ("age", "sex", "site", "fitzpatrick")]
    return m.select(F.col("c_custkey").alias("row_id"), y.alias("y"), meta_vector(*cols).alias("x"), meta_mask(*cols).alias("mask"))


def feature_sql() -> str:
    """CTE ml: long (row_id, y, j, v) form of the 19-feature vector."""
    sites = ["anterior torso", "head/neck", "lateral torso", "lower extremity", "oral/genital", "palms/soles", "posterior torso", "upper extremity"]
    parts = ["CASE WHEN age IS NOT NULL THEN age / 100 ELSE 0 END", "CASE WHEN sex = 'female' THEN 1 ELSE 0 END", "CASE WHEN sex = 'male' THEN 1 ELSE 0 END", "0"]
    parts += [f"CASE WHEN site = '{s}' THEN 1 ELSE 0 END" for s in sites] + ["CASE WHEN site = 'unknown' THEN 1 ELSE 0 END"]
    parts += [f"CASE WHEN fitzpatrick = {i} THEN 1 ELSE 0 END" for i in range(1, 7)]
    vec = ", ".join(f"({p})::DOUBLE" for p in parts)
    weights, bias = _fixed_weights()
    flat = ", ".join(f"{v!r}::DOUBLE" for row in weights for v in row)
    return f"""mv AS (SELECT mn.c_custkey AS row_id, list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 AS y, [{vec}] AS x
  FROM mn JOIN customer c ON c.c_custkey = mn.c_custkey),
ml AS (SELECT row_id, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM mv),
lw AS (SELECT unnest(range({N_SEG * 19})) // 19 AS k, unnest(range({N_SEG * 19})) % 19 AS j, unnest([{flat}]) AS w)"""


@query("sc11_group_ablation", "WITH " + META + "," + feature_sql() + f""", grp AS (SELECT * FROM (VALUES ('none',-1,-1),('age',0,0),('sex',1,3),('site',4,12),('fitz',13,18)) t(masked, lo, hi)),
sc AS (SELECT row_id, y, masked, k, 0.1 * k + sum(CASE WHEN ml.j BETWEEN lo AND hi THEN 0 ELSE v * w END) AS z FROM ml JOIN lw ON lw.j = ml.j, grp GROUP BY 1, 2, 3, 4),
sm AS (SELECT *, max(round(z, 9)) OVER (PARTITION BY row_id, masked) AS m FROM sc),
pd AS (SELECT row_id, y, masked, min(k) FILTER (WHERE round(z, 9) = m) AS pred FROM sm GROUP BY 1, 2, 3),""" + class_sql("pd", "masked") + f""",
f AS (SELECT masked, avg(f1) AS f1 FROM cf GROUP BY 1) SELECT masked, {rq('f1')} AS macro_f1, {rq("max(CASE WHEN masked = 'none' THEN f1 END) OVER () - f1")} AS "drop" FROM f""")
def sc11(spark, sf):
    weights, bias = _fixed_weights()
    # logits compared at 9 decimals: several classes tie exactly on these weights
    scorer = lambda x: F.transform(at.linear_logits(x, weights, bias), lambda v: F.round(v, 9))
    return rounded(at.ablation_report(meta_rows(spark, sf), "x", len(META_FEATURES), scorer), "macro_f1", "drop")


@query("sc12_perturbation_attribution", "WITH " + META + "," + feature_sql() + f""", dl AS (SELECT -1 AS drop_j UNION ALL SELECT unnest(range(19))),
sc AS (SELECT row_id, drop_j, k, 0.1 * k + sum(CASE WHEN ml.j = drop_j THEN 0 ELSE v * w END) AS z FROM ml JOIN lw ON lw.j = ml.j, dl GROUP BY 1, 2, 3),
sm AS (SELECT *, max(z) OVER (PARTITION BY row_id, drop_j) AS m FROM sc), sp AS (SELECT *, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id, drop_j) AS p FROM sm),
ba AS (SELECT row_id, min(k) FILTER (WHERE p = pm) AS pred, max(p) AS base FROM (SELECT *, max(p) OVER (PARTITION BY row_id) AS pm FROM sp WHERE drop_j = -1) GROUP BY 1)
SELECT sp.drop_j AS feature, count(*) AS n, {rq('sum(round(base - p, 6))', 4)} AS total FROM sp JOIN ba ON ba.row_id = sp.row_id AND ba.pred = sp.k WHERE drop_j >= 0 GROUP BY 1""")
def sc12(spark, sf):
    weights, bias = _fixed_weights()
    attr = at.perturbation(meta_rows(spark, sf), "row_id", "x", META_FEATURES, lambda x: at.linear_logits(x, weights, bias), N_SEG)
    idx = F.array_position(F.array(*[F.lit(f) for f in META_FEATURES]), F.col("feature")) - 1
    return attr.select(F.explode("attribution").alias("feature", "v")).groupBy(idx.alias("feature")).agg(F.count("*").alias("n"), r(F.sum("v"), 4).alias("total"))


@query("sc13_mean_absolute_attribution", "WITH " + META + "," + feature_sql() + f""", a AS (SELECT ml.j, avg(abs(v * w)) AS m FROM ml JOIN lw ON lw.j = ml.j AND lw.k = 0 GROUP BY 1)
SELECT j AS feature, {rq('m')} AS mean_abs FROM a""")
def sc13(spark, sf):
    weights, _ = _fixed_weights()
    attr = F.map_from_arrays(F.array(*[F.lit(f) for f in META_FEATURES]), F.array(*[F.col("x")[j] * weights[0][j] for j in range(len(META_FEATURES))]))
    ranked = at.mean_absolute(meta_rows(spark, sf).select(attr.alias("attribution")))
    idx = F.array_position(F.array(*[F.lit(f) for f in META_FEATURES]), F.col("feature")) - 1
    return ranked.select(idx.alias("feature"), r("mean_abs").alias("mean_abs"))


@query("sc14_tabular_scorer")
def sc14(spark, sf):
    rows = meta_rows(spark, sf)
    counts = mt.distribution(rows, "y", list(range(N_SEG)))
    table_w = mt.class_weights(counts).agg(F.map_from_entries(F.collect_list(F.struct("cls", "balanced")))).scalar()
    weighted = rows.withColumn("w", F.try_element_at(table_w, F.col("y")))
    weights, bias = at.fit_tabular(weighted, "x", "y", "w")
    judged = rows.select("y", sc.argmax(at.linear_logits(F.col("x"), weights, bias)).alias("pred"))
    return rounded(mt.summary(mt.confusion(judged)), "accuracy", "macro_f1", "weighted_f1", digits=4)
