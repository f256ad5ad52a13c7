"""Fitting queries (FIT*, JN10)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators import certify as ct, ensemble as es, fit, metrics as mt, split as sp
from tallyvane.plans.evaluate import class_sql
from tallyvane.plans import fixtures as fx
from tallyvane.plans.fixtures import BIG, K, KB, PRED, VIEWS, pred, pred_views, predictions
from tallyvane.storage import spread
from tallyvane.plans.registry import query, r, rounded, rq

W = "WITH " + PRED
WB = "WITH " + BIG


def pred_big(spark, sf):
    return spread(fx.pred_big(spark, sf))


def big(spark, sf):
    return fx.scored(pred_big(spark, sf), KB)


_TG = """tg AS (SELECT round(0.5::DOUBLE + range * 0.05::DOUBLE, 10) AS t FROM range(91)),
tl AS (SELECT t, ln(exp(z0/t - zm/t) + exp(z1/t - zm/t) + exp(z2/t - zm/t)) + zm/t - CASE y WHEN 0 THEN z0/t WHEN 1 THEN z1/t ELSE z2/t END AS l FROM bm, tg)"""


@query("fit1_temperature_grid", WB + "," + _TG + f" SELECT t, {rq('avg(l)')} AS nll FROM tl GROUP BY 1")
def fit1_grid(spark, sf):
    return rounded(fit.temperature_grid(pred_big(spark, sf), KB), "nll")


@query("fit1_best_temperature", WB + "," + _TG + f", g AS (SELECT t, avg(l) AS nll FROM tl GROUP BY 1) SELECT round(arg_min(t, (nll, CASE WHEN t = 1 THEN 0 ELSE 1 END, t)), 2) AS t, {rq('min(nll)')} AS nll FROM g")
def fit1(spark, sf):
    return rounded(fit.best_temperature(fit.temperature_grid(pred_big(spark, sf), KB)), "nll")


@query("jn10_candidates_by_rows", W + f""", tg AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS t), j AS (SELECT t, row_id, k, y, z / t AS z FROM zl, tg), m AS (SELECT *, max(z) OVER (PARTITION BY t, row_id) AS m FROM j),
l AS (SELECT t, row_id, any_value(m) + ln(sum(exp(z - m))) - max(z) FILTER (WHERE k = y) AS nl FROM m GROUP BY 1, 2) SELECT t, {rq('avg(nl)')} AS nll FROM l GROUP BY 1""")
def jn10(spark, sf):
    return rounded(fit.temperature_grid(pred(spark, sf), K, [0.5, 2.0]), "nll")


@contextmanager
def held(df):
    """Persist a fit's input for its loop only."""
    rows = df.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


@contextmanager
def folded(df, cols):
    """Rows equal in ``cols`` held once with their number, in as many tasks as the rows left ask for."""
    with held(fit.fold_equal(df, cols)) as rows:
        yield rows.coalesce(max(1, -(-rows.count() // 20_000)))


_RAW = ", rl AS (SELECT zm + ln(es) - CASE y WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS l FROM bs)"
_CERTIFIED = f" SELECT count(*) AS n_rows, {rq('avg(l)')} AS start_loss, TRUE AS improved, TRUE AS stationary, TRUE AS recomputed FROM rl"


def logits(of):
    """Loss of a row at a parameter, from the logits that ``of`` makes with it."""
    return lambda p: ct.cross_entropy(of(p), F.col("y"))


@query("fit2_temperature_continuous", WB + _RAW + _CERTIFIED)
def fit2(spark, sf):
    source = pred_big(spark, sf).select("y", "z")
    with held(source) as rows:
        t, nll = fit.fit_temperature(rows, KB)
    inside = lambda v: [min(max(x, 1e-3), 20.0) for x in v]
    loss = logits(lambda u: [F.col("z")[i] * float(u[0]) for i in range(KB)])
    return rounded(ct.minimum(source, loss, [1.0], [1.0 / t], ct.neighbours([1.0 / t], 0.01, inside), nll), "start_loss")


@query("fit3_class_temperatures", WB + _RAW + _CERTIFIED)
def fit3(spark, sf):
    source = pred_big(spark, sf).select("y", "z")
    with held(source) as rows:
        ts, nll = fit.fit_class_temperatures(rows, KB)
    inside = lambda v: [min(max(x, 1e-3), 20.0) for x in v]
    loss = logits(lambda u: [F.col("z")[i] * float(u[i]) for i in range(KB)])
    best = [1.0 / t for t in ts]
    return rounded(ct.minimum(source, loss, [1.0] * KB, best, ct.neighbours(best, 0.01, inside), nll), "start_loss")


@query("fit4_dirichlet", WB + _RAW + _CERTIFIED)
def fit4(spark, sf):
    source = pred_big(spark, sf).select("y", "z")
    with held(source) as rows:
        w, b, loss = fit.fit_dirichlet(rows, KB)
    d = KB + 1
    best = [v for row, bias in zip(w, b) for v in (*row, bias)]
    start = [float(i == j) for i in range(KB) for j in range(d)]
    logs = source.select("y", sc.log_softmax(F.col("z"), KB).alias("f"))
    linear = logits(lambda x: [sc.fold_sum([F.col("f")[j] * float(x[i * d + j]) for j in range(KB)]) + float(x[i * d + KB]) for i in range(KB)])
    penalty = lambda x: sum(0.01 * x[i * d + j] ** 2 for i in range(KB) for j in range(d) if i != j)
    return rounded(ct.minimum(logs, linear, start, best, ct.neighbours(best, 0.01), loss, penalty), "start_loss")


def stacked(spark, sf):
    return fit.stack_models(es.mean_views(pred_views(spark, sf), K), [0, 1, 2], K)


@query("fit5_ensemble_weights", W + "," + VIEWS + f""", mv AS (SELECT row_id, y, k, avg(z) AS z FROM vl GROUP BY 1, 2, 3), mm AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS m FROM mv),
rl AS (SELECT row_id, max(m) + ln(sum(exp(z - m))) - max(z) FILTER (WHERE k = y) AS l FROM mm GROUP BY 1)""" + _CERTIFIED)
def fit5(spark, sf):
    source = stacked(spark, sf)
    with held(source) as rows:
        w, nll = fit.fit_ensemble_weights(rows, 3, K)
    mixed = logits(lambda v: [sc.fold_sum([F.col("zs")[m][i] * float(v[m]) for m in range(3)]) for i in range(K)])
    # steps that stay on the simplex: a little weight from one model to another
    around = [[x + 0.01 * (i == a) - 0.01 * (i == b) for i, x in enumerate(w)] for a in range(3) for b in range(3) if a != b and w[b] >= 0.01]
    return rounded(ct.minimum(source, mixed, [1 / 3] * 3, w, around, nll), "start_loss")


WEIGHT_TRIALS = [[1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1], [2, -1, 1]]


@query("fit5_ensemble_weights_f1", W + "," + VIEWS + """, mv AS (SELECT row_id, y, model, k, avg(z) AS z FROM vl GROUP BY 1, 2, 3, 4),
wt AS (SELECT * FROM (VALUES (0,[1/3, 1/3, 1/3]),(1,[1.0,0.0,0.0]),(2,[0.0,1.0,0.0]),(3,[0.0,0.0,1.0]),(4,[0.5,0.25,0.25])) t(cand, w)),
bz AS (SELECT cand, row_id, y, k, round(sum(z * w[model + 1]::DOUBLE), 9) AS z FROM mv, wt GROUP BY 1, 2, 3, 4), bw AS (SELECT *, max(z) OVER (PARTITION BY cand, row_id) AS m FROM bz),
bb AS (SELECT cand, row_id, y, min(k) FILTER (WHERE z = m) AS pred FROM bw GROUP BY 1, 2, 3),""" + class_sql("bb", "cand") + f" SELECT CAST(cand AS INTEGER) AS cand, {rq('avg(f1)')} AS macro_f1 FROM cf GROUP BY 1")
def fit5_f1(spark, sf):
    return rounded(fit.fit_ensemble_weights_f1(stacked(spark, sf), 3, K, WEIGHT_TRIALS), "macro_f1")


_PRIOR0 = [0.05, 0.15] + [0.1] * 8


def _sld_sql(steps: int) -> str:
    """A fixed number of EM steps from the uniform prior, chained CTEs."""
    out = [f"q0 AS (SELECT unnest(range(10)) AS k, 0.1::DOUBLE AS q), tp AS (SELECT unnest(range(10)) AS k, unnest([{', '.join(f'{v}::DOUBLE' for v in _PRIOR0)}]) AS t)"]
    for i in range(steps):
        out.append(f"""a{i} AS (SELECT row_id, pl.k, p * (q / t) AS a FROM pl JOIN q{i} ON q{i}.k = pl.k JOIN tp ON tp.k = pl.k),
n{i} AS (SELECT k, a / greatest(sum(a) OVER (PARTITION BY row_id), 1e-12) AS a FROM a{i}), m{i} AS (SELECT k, greatest(avg(a), 1e-12) AS q FROM n{i} GROUP BY 1), q{i+1} AS (SELECT k, q / sum(q) OVER () AS q FROM m{i})""")
    return ",\n".join(out)


@query("fit6_sld_prior_four_steps", W + "," + _sld_sql(4) + f" SELECT CAST(k AS INTEGER) AS cls, {rq('q')} AS prior FROM q4")
def fit6(spark, sf):
    source = predictions(spark, sf).select("p")
    with folded(source, ["p"]) as rows:
        prior, _ = fit.sld_prior(rows, _PRIOR0, K, max_iter=4, tol=0.0, unfinished=True)
    table = F.array(*[F.struct(F.lit(i).alias("cls"), F.lit(v).alias("prior")) for i, v in enumerate(prior)])
    return rounded(source.agg(F.count("*")).select(F.inline(table)), "prior")


@query("fit6_sld_prior_variants", WB + f""", ll AS (SELECT ln(p0 * (1.0::DOUBLE / 3) / 0.3 + p1 * (1.0::DOUBLE / 3) / 0.4 + p2 * (1.0::DOUBLE / 3) / 0.3) AS l FROM bp)
SELECT count(*) AS n_rows, {rq('avg(l)')} AS start_likelihood, TRUE AS improved, TRUE AS fixed_point, TRUE AS agree FROM ll""")
def fit6_variants(spark, sf):
    source = big(spark, sf).select("p")
    with folded(source, ["p"]) as rows:
        prior, steps = fit.sld_prior(rows, [0.3, 0.4, 0.3], KB)
        alt, alt_steps = fit.sld_prior(rows, [0.3, 0.4, 0.3], KB, init="train", finalize=False)
    train = [0.3, 0.4, 0.3]
    mass = lambda q: sc.fold_sum([F.col("p")[i] * (float(q[i]) / train[i]) for i in range(KB)])
    # a fixed point of the step: the mean posterior is the prior itself
    means = source.agg(
        F.count("*").alias("n_rows"), F.avg(F.log(mass([1 / 3] * 3))).alias("start_likelihood"), F.avg(F.log(mass(prior))).alias("likelihood"),
        *[F.avg(F.col("p")[i] * (prior[i] / train[i]) / mass(prior)).alias(f"q{i}") for i in range(KB)])
    moved = F.greatest(*[F.abs(F.col(f"q{i}") - prior[i]) for i in range(KB)])
    return rounded(means.select("n_rows", "start_likelihood", (F.col("likelihood") >= F.col("start_likelihood") - 1e-9).alias("improved"), (moved < 1e-5).alias("fixed_point"),
                                F.lit(max(abs(a - b) for a, b in zip(prior, alt)) < 1e-2).alias("agree")), "start_likelihood")


_GRID7 = """sg AS (SELECT CAST(range AS INTEGER) AS point, round(0.3::DOUBLE + range * 0.05::DOUBLE, 10) AS s FROM range(75)),
tr AS (SELECT point, y, CASE WHEN p1 * s > greatest(p0, p2) OR (p1 * s = greatest(p0, p2) AND p0 < p2) THEN 1 WHEN p0 >= p2 THEN 0 ELSE 2 END AS pred FROM bp, sg)"""


@query("fit7_scale_curve", WB + "," + _GRID7 + "," + class_sql("tr", "point") + f" SELECT point, {rq('avg(f1)')} AS macro_f1 FROM cf GROUP BY 1")
def fit7_curve(spark, sf):
    curve = fit.scale_curve(big(spark, sf), 1, [1.0] * KB, KB).filter("point >= 0")
    return rounded(mt.summary(curve, ["point"]).select("point", "macro_f1"), "macro_f1")


_BASE_F1 = class_sql("bpr")


@query("fit7_greedy_scales", WB + "," + _BASE_F1 + f", b AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, avg(f1) AS f FROM cf) SELECT n_rows, {rq('f')} AS start_f1, TRUE AS improved, TRUE AS recomputed, TRUE AS local_optimum FROM b")
def fit7(spark, sf):
    source = big(spark, sf).select("y", "p")
    with folded(source, ["y", "p"]) as rows:
        scales, f1 = fit.greedy_scales(rows, KB)[None]
    points = fit.grid(fit.GRID_LO, fit.GRID_HI, fit.GRID_STEP)
    moves = [[x if i == c else s for i, s in enumerate(scales)] for c in range(KB) for x in points[::5]]
    got = fit.evaluate_candidates(source, [[1.0] * KB, scales, *moves], KB)
    at = lambda i: F.max(F.when(F.col("cand") == i, F.col("objective")))
    return rounded(got.agg(at(0).alias("start_f1"), at(1).alias("own"), F.max("objective").alias("top")).select(
        F.lit(source.count()).cast("bigint").alias("n_rows"), "start_f1", (F.col("own") >= F.col("start_f1")).alias("improved"), (F.abs(F.col("own") - f1) < 1e-9).alias("recomputed"),
        (F.col("top") <= F.col("own") + 1e-12).alias("local_optimum")), "start_f1")


_FOLDS8 = f""", k8 AS (SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM bp),
fb AS (SELECT CAST(((rn - 1) * 5) // n AS INTEGER) AS fold, bpr.y, bpr.pred FROM k8 JOIN bpr USING (row_id))"""


@query("fit8_kfold_scales", WB + _FOLDS8 + "," + class_sql("fb", "fold") + f" SELECT fold, CAST(sum(support) AS BIGINT) AS n_rows, {rq('avg(f1)')} AS baseline, TRUE AS in_grid, TRUE AS gains_overall FROM cf GROUP BY 1")
def fit8(spark, sf):
    source = sp.stratified_folds(big(spark, sf).select("row_id", "y", "p"), "y", "row_id", 5, 42).select("fold", "y", "p")
    with folded(source, ["fold", "y", "p"]) as rows:
        scales, report = fit.kfold_scales(rows, KB, 5)
    base, tuned = ({x["fold"]: x["macro_f1"] for x in report if x["variant"] == v} for v in ("baseline", "tuned"))
    table = F.create_map(*[x for f, v in base.items() for x in (F.lit(f), F.lit(v))])
    inside = all(fit.GRID_LO <= s <= fit.GRID_HI for s in scales)
    return rounded(source.groupBy("fold").agg(F.count("*").alias("n_rows")).select(
        "fold", "n_rows", F.try_element_at(table, F.col("fold")).alias("baseline"), F.lit(inside).alias("in_grid"), F.lit(sum(tuned.values()) >= sum(base.values())).alias("gains_overall")), "baseline")


_CAND = [[1.0, 1.0, 1.0], [2.0, 1.0, 0.5], [0.5, 1.5, 1.2], [1.1, 0.9, 1.0]]


@query("fit9_candidate_objectives", WB + """, cd AS (SELECT * FROM (VALUES (0,1.0,1.0,1.0),(1,2.0,1.0,0.5),(2,0.5,1.5,1.2),(3,1.1,0.9,1.0)) t(cand, s0, s1, s2)),
ap AS (SELECT cand, y, p0 * s0::DOUBLE AS a, p1 * s1::DOUBLE AS b, p2 * s2::DOUBLE AS c FROM bp, cd), jd AS (SELECT cand, y, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred FROM ap),""" + class_sql("jd", "cand") +
       f" SELECT CAST(cand AS INTEGER) AS cand, {rq('avg(f1)')} AS macro_f1, {rq('sum(f1 * ([2.5, 0.5, 3.0])[cls + 1]::DOUBLE) / 6.0')} AS weighted_f1 FROM cf GROUP BY 1")
def fit9_eval(spark, sf):
    rows = big(spark, sf).select("y", "p")
    a = fit.evaluate_candidates(rows, _CAND, KB).withColumnRenamed("objective", "macro_f1")
    b = fit.evaluate_candidates(rows, _CAND, KB, weights=[2.5, 0.5, 3.0]).withColumnRenamed("objective", "weighted_f1")
    return rounded(a.join(b, "cand"), "macro_f1", "weighted_f1")


@query("fit9_evolved_scales", WB + "," + _BASE_F1 + f", b AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, avg(f1) AS f FROM cf) SELECT n_rows, {rq('f')} AS start_f1, TRUE AS improved, TRUE AS recomputed, TRUE AS in_bounds FROM b")
def fit9(spark, sf):
    source = big(spark, sf).select("y", "p")
    with folded(source, ["y", "p"]) as rows:
        scales, best = fit.evolve_scales(rows, [(0.3, 4.0)] * KB)
    got = fit.evaluate_candidates(source, [[1.0] * KB, scales], KB)
    at = lambda i: F.max(F.when(F.col("cand") == i, F.col("objective")))
    return rounded(got.agg(at(0).alias("start_f1"), at(1).alias("own")).select(
        F.lit(source.count()).cast("bigint").alias("n_rows"), "start_f1", (F.col("own") >= F.col("start_f1")).alias("improved"), (F.abs(F.col("own") - best) < 1e-9).alias("recomputed"),
        F.lit(all(0.3 <= s <= 4.0 for s in scales)).alias("in_bounds")), "start_f1")


_CHECK10 = """, k10 AS (SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM bp),
cb AS (SELECT bpr.y, bpr.pred FROM k10 JOIN bpr USING (row_id) WHERE rn > round(n * 0.8::DOUBLE))"""


@query("fit10_guarded_scales", WB + _CHECK10 + "," + class_sql("cb") + f", b AS (SELECT CAST(sum(support) AS BIGINT) AS n_check, avg(f1) AS f FROM cf) SELECT n_check, {rq('f')} AS check_f1, TRUE AS delta_recomputed, TRUE AS policy_follows FROM b")
def fit10(spark, sf):
    source = sp.stratified_split(big(spark, sf).select("row_id", "y", "p"), "y", "row_id", [0.8], ["tune", "check"], 42)
    with folded(source, ["split", "y", "p"]) as rows:
        got = fit.guarded_scales(rows.filter("split = 'tune'"), rows.filter("split = 'check'"), KB)
    d, policy, check = got["delta"], got["policy"], source.filter("split = 'check'")
    follows = {"revert": d < 0, "coarse_grid": d > 0.15, "keep_cautiously": 0 <= d < 0.03, "keep": 0.03 <= d <= 0.15}[policy]
    scored = fit.evaluate_candidates(check, [[1.0] * KB, got["scales"]], KB)
    at = lambda i: F.max(F.when(F.col("cand") == i, F.col("objective")))
    # only scales that were kept are those whose gain was measured
    gain = F.abs(at(1) - at(0) - d) < 1e-9 if policy.startswith("keep") else at(1) >= at(0) - 1e-12
    return rounded(scored.agg(at(0).alias("check_f1"), gain.alias("delta_recomputed")).select(
        F.lit(check.count()).cast("bigint").alias("n_check"), "check_f1", "delta_recomputed", F.lit(follows).alias("policy_follows")), "check_f1")


@query("fit11_best_method", WB + "," + class_sql("bpr") + f""", o AS (SELECT 'default' AS method, avg(f1) AS score FROM cf UNION ALL SELECT 'zero', 0.0 UNION ALL SELECT 'also_default', avg(f1) FROM cf)
SELECT method, {rq('score')} AS score FROM o ORDER BY o.score DESC, method LIMIT 1""")
def fit11(spark, sf):
    got = mt.summary(mt.confusion(big(spark, sf)))
    methods = (("default", F.col("macro_f1")), ("zero", F.lit(0.0)), ("also_default", F.col("macro_f1")))
    scored = got.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in methods])))
    return rounded(fit.best_method(scored, "method", "score"), "score")


@query("fit12_calibration_report", WB + _RAW + f", ac AS (SELECT avg((y = pred)::INT::DOUBLE) AS a FROM bpr), n AS (SELECT avg(l) AS l FROM rl), m AS (SELECT unnest(['raw', 'global', 'per_class', 'dirichlet']) AS method) "
       f"SELECT method, CASE WHEN method = 'raw' THEN {rq('l', 5)} END AS raw_nll, CASE WHEN method = 'raw' THEN {rq('a', 5)} END AS raw_accuracy, TRUE AS not_above_raw FROM m, n, ac")
def fit12(spark, sf):
    source = pred_big(spark, sf).select("y", "z")
    with held(source) as rows:
        t, _ = fit.fit_temperature(rows, KB)
        ts, _ = fit.fit_class_temperatures(rows, KB)
        w, b, _ = fit.fit_dirichlet(rows, KB)
    report = fit.calibration_report(source, KB, t, ts, w, b)
    raw = F.max(F.when(F.col("method") == "raw", F.col("nll"))).over(Window.partitionBy())  # one row per method
    return rounded(report.select(
        "method", F.when(F.col("method") == "raw", F.col("nll")).alias("raw_nll"), F.when(F.col("method") == "raw", F.col("accuracy")).alias("raw_accuracy"),
        (F.col("nll") <= raw + 1e-3).alias("not_above_raw")), "raw_nll", "raw_accuracy", digits=5)


@query("fit12_report_fixed_parameters", WB + """, v AS (SELECT 'raw' AS method, y, z0, z1, z2 FROM bz UNION ALL SELECT 'global', y, z0/0.8, z1/0.8, z2/0.8 FROM bz UNION ALL SELECT 'per_class', y, z0/0.9, z1/1.1, z2/2.0 FROM bz
 UNION ALL SELECT 'dirichlet', y, (z0 - l) * 0.5 + 0.1, (z1 - l) * 0.5, (z2 - l) * 0.5 - 0.1 FROM (SELECT *, zm + ln(exp(z0-zm)+exp(z1-zm)+exp(z2-zm)) AS l FROM bm)),
x AS (SELECT method, y, exp(z0 - greatest(z0,z1,z2)) AS a, exp(z1 - greatest(z0,z1,z2)) AS b, exp(z2 - greatest(z0,z1,z2)) AS c FROM v), q AS (SELECT method, y, a/(a+b+c) AS a, b/(a+b+c) AS b, c/(a+b+c) AS c FROM x),
w AS (SELECT *, greatest(a,b,c) AS conf, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS py FROM q),
bn AS (SELECT method, least(floor(conf * 15), 14) AS bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(conf) AS cf FROM w GROUP BY 1, 2), er AS (SELECT method, sum(n * abs(acc - cf)) / sum(n) AS ece FROM bn GROUP BY 1),
o AS (SELECT method, avg(-ln(greatest(py, 1e-12))) AS nll, avg(pow(a - CASE WHEN y=0 THEN 1 ELSE 0 END, 2) + pow(b - CASE WHEN y=1 THEN 1 ELSE 0 END, 2) + pow(c - CASE WHEN y=2 THEN 1 ELSE 0 END, 2)) AS brier FROM w GROUP BY 1)
""" + f"SELECT method, {rq('nll')} AS nll, {rq('brier')} AS brier, {rq('ece')} AS ece FROM o JOIN er USING (method)")
def fit12_fixed(spark, sf):
    w = [[0.5 if i == j else 0.0 for j in range(KB)] for i in range(KB)]
    out = fit.calibration_report(pred_big(spark, sf), KB, 0.8, [0.9, 1.1, 2.0], w, [0.1, 0.0, -0.1])
    return rounded(out.select("method", "nll", "brier", "ece"), "nll", "brier", "ece")
