"""Fits: never worse than the start, and equal to a brute-force optimum where one is cheap."""

import math
import random

import numpy as np
import pytest

from tallyvane.operators import fit, metrics as mt


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        y = rng.randrange(3)
        z = [rng.gauss(0, 1) * (1 + k) + (2.5 if k == y else 0) for k in range(3)]
        rows.append((i, y, [2.0 * v for v in z]))
    return rows, spark.createDataFrame(rows, "row_id int, y int, z array<double>").repartition(4).persist()


def loss(rows, f):
    total = 0.0
    for _, y, z in rows:
        s = f(np.array(z))
        s = s - s.max()
        total += math.log(np.exp(s).sum()) - s[y]
    return total / len(rows)


def test_grid_matches_direct_evaluation(data):
    rows, df = data
    got = {r.t: r.nll for r in fit.temperature_grid(df, 3).collect()}
    assert len(got) == 91
    for t in (0.5, 1.0, 2.35, 5.0):
        assert got[t] == pytest.approx(loss(rows, lambda z: z / t))
    best = fit.best_temperature(fit.temperature_grid(df, 3)).first()
    assert best.t == min(got, key=got.get)


def test_no_improvement_keeps_one(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0])], "y int, z array<double>")
    assert fit.best_temperature(fit.temperature_grid(df, 2)).first().t == 1.0


def test_continuous_temperature_is_the_minimum(data):
    rows, df = data
    t, nll = fit.fit_temperature(df, 3)
    assert nll == pytest.approx(loss(rows, lambda z: z / t), abs=1e-6)
    assert all(nll <= loss(rows, lambda z: z / s) + 1e-9 for s in np.arange(0.5, 5, 0.01))


def test_class_temperatures_beat_the_global_one(data):
    rows, df = data
    t, nll = fit.fit_temperature(df, 3)
    ts, class_nll = fit.fit_class_temperatures(df, 3)
    assert class_nll <= nll + 1e-9 and min(ts) >= 0.1
    assert class_nll == pytest.approx(loss(rows, lambda z: z / np.array(ts)), abs=1e-6)


def test_dirichlet_is_stationary_and_beats_identity(data):
    rows, df = data
    w, b, value = fit.fit_dirichlet(df, 3)
    def objective(w, b):
        w = np.array(w)
        lp = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
        off = w * (1 - np.eye(3))
        return loss(rows, lambda z: w @ lp(z) + b) + 0.01 * (off**2).sum() + 0.01 * (np.array(b) ** 2).sum()
    assert value == pytest.approx(objective(w, b), abs=1e-6)
    assert value < objective(np.eye(3), np.zeros(3))
    rng = np.random.default_rng(0)
    for _ in range(20):
        assert objective(np.array(w) + rng.normal(0, 0.01, (3, 3)), np.array(b) + rng.normal(0, 0.01, 3)) >= value - 1e-9


def test_ensemble_weights_lie_on_the_simplex_and_win(spark, data):
    rows, _ = data
    rng = random.Random(4)
    long = [(i, m, y, [v + rng.gauss(0, 1 + 2 * m) for v in z]) for i, y, z in rows for m in range(3)]
    df = spark.createDataFrame(long, "row_id int, model int, y int, z array<double>")
    st = fit.stack_models(df, [0, 1, 2], 3).persist()
    w, nll = fit.fit_ensemble_weights(st, 3, 3)
    zs = {}
    for i, m, y, z in long:
        zs.setdefault(i, (y, {}))[1][m] = np.array(z)
    def blend(ws):
        return loss([(i, y, sum(a * z[m] for m, a in enumerate(ws))) for i, (y, z) in zs.items()], lambda z: z)
    assert sum(w) == pytest.approx(1.0) and min(w) >= 0
    assert nll == pytest.approx(blend(w), abs=1e-6)
    trials = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1 / 3,) * 3] + [tuple(x) for x in np.random.default_rng(1).dirichlet([1, 1, 1], 40)]
    assert all(nll <= blend(t) + 1e-6 for t in trials)


def test_sld_recovers_the_prior_and_is_a_fixed_point(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(3000):
        y = 0 if rng.random() < 0.8 else 1
        x = rng.gauss(2.0 if y == 0 else -2.0, 1.0)
        a = 1 / (1 + math.exp(-4 * x))  # posterior under an even prior
        rows.append(([a, 1 - a],))
    df = spark.createDataFrame(rows, "p array<double>").persist()
    prior, steps = fit.sld_prior(df, [0.5, 0.5], 2)
    assert abs(prior[0] - 0.8) < 0.03 and steps < 60 and sum(prior) == pytest.approx(1.0)
    again = fit.sld_step(df, np.array(prior) / 0.5)
    assert np.abs(again - prior).max() < 1e-5
    loose, _ = fit.sld_prior(df, [0.5, 0.5], 2, finalize=False)
    assert np.abs(np.array(loose) - prior).max() < 1e-4


@pytest.fixture(scope="module")
def skewed_probs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        y = rng.choice([0, 0, 0, 1, 2])
        z = [rng.random() * (1.6 if k == 0 else 1.0) + (0.4 if k == y else 0) for k in range(3)]
        rows.append((i, y, [v / sum(z) for v in z], i % 3))
    return rows, spark.createDataFrame(rows, "row_id int, y int, p array<double>, fold int").persist()


def f1(rows, scales):
    from tests.test_metrics import macro
    return macro([(y, int(np.argmax(np.array(p) * scales))) for _, y, p, _ in rows])


def greedy(rows, points, passes):
    s = np.ones(3)
    for _ in range(passes):
        moved = False
        for c in range(3):
            best, at = f1(rows, s), s[c]
            for t in points:
                trial = s.copy()
                trial[c] = t
                if f1(rows, trial) > best + 1e-12:
                    best, at, moved = f1(rows, trial), t, True
            s[c] = at
        if not moved:
            break
    return s


def test_greedy_search_equals_the_loop(skewed_probs):
    rows, df = skewed_probs
    scales, score = fit.greedy_scales(df, 3, step=0.1)[None]
    want = greedy(rows, fit.grid(0.3, 4.0, 0.1), 3)
    assert scales == pytest.approx(list(want)) and score == pytest.approx(f1(rows, want))


def test_kfold_fits_all_complements_together(skewed_probs):
    rows, df = skewed_probs
    mean, report = fit.kfold_scales(df, 3, 3, step=0.1)
    want = [greedy([r for r in rows if r[3] != k], fit.grid(0.3, 4.0, 0.1), 2) for k in range(3)]
    assert mean == pytest.approx(list(np.mean(want, axis=0)))
    assert len(report) == 6


def test_evolution_never_loses_to_ones_and_repeats(skewed_probs):
    rows, df = skewed_probs
    a = fit.evolve_scales(df, [(0.3, 4.0)] * 3, population=8, generations=2)
    b = fit.evolve_scales(df, [(0.3, 4.0)] * 3, population=8, generations=2)
    assert a == b and a[1] >= f1(rows, np.ones(3)) - 1e-12
    assert a[1] == pytest.approx(f1(rows, np.array(a[0])))


def test_guard_reverts_when_the_check_part_loses(spark, skewed_probs):
    rows, df = skewed_probs
    tune, check = df.filter("fold < 2"), df.filter("fold = 2")
    got = fit.guarded_scales(tune, check, 3, passes=1)
    base = f1([r for r in rows if r[3] == 2], np.ones(3))
    if got["policy"] == "revert":
        assert got["scales"] == [1.0] * 3 and got["delta"] < 0
    else:
        assert f1([r for r in rows if r[3] == 2], np.array(got["scales"])) >= base
    # tuned on inverted truth, the check part must reject it
    flipped = spark.createDataFrame([(i, (y + 1) % 3, p, k) for i, y, p, k in rows], df.schema)
    assert fit.guarded_scales(flipped, check, 3, passes=1)["policy"] == "revert"


def test_best_method_prefers_first_name_on_a_tie(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "m string, s double")
    assert fit.best_method(df, "m", "s").first().m == "a"


def test_fitting_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        fit.fit_temperature(spark.createDataFrame([], "y int, z array<double>"), 2)


def test_variant_report_counts_each_variant(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1)], "variant string, y int, pred int")
    got = {r.variant: r.delta for r in fit.variant_report(df, "a").collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(1 - 1 / 3)
    assert mt.summary(mt.confusion(df, by=["variant"]), ["variant"]).count() == 2


def test_prior_search_says_when_it_has_not_converged(spark):
    df = spark.createDataFrame([([0.6, 0.4],), ([0.3, 0.7],), ([0.55, 0.45],)], "p array<double>")
    with pytest.raises(RuntimeError, match="not converged in 2 steps"):
        fit.sld_prior(df, [0.5, 0.5], 2, max_iter=2)
    assert fit.sld_prior(df, [0.5, 0.5], 2, max_iter=2, unfinished=True)[1] == 2
    a, b = fit.sld_prior(df, [0.5, 0.5], 2), fit.sld_prior(df, [0.5, 0.5], 2, init="train")
    assert a[0] == pytest.approx(b[0], abs=1e-4)


def test_folded_rows_give_the_results_of_all_rows(spark):
    rng = np.random.default_rng(5)
    kinds = rng.dirichlet([1.0, 1.0, 1.0], 25)
    rows = [(int(rng.integers(3)), [float(x) for x in kinds[i]], int(rng.integers(3))) for i in rng.integers(0, 25, 600)]
    df = spark.createDataFrame(rows, "y int, p array<double>, fold int")
    folded = fit.fold_equal(df, ["y", "p", "fold"])
    assert folded.count() < 250 and folded.agg({"n": "sum"}).first()[0] == 600
    a, b = fit.sld_prior(df, [0.3, 0.4, 0.3], 3, max_iter=20, tol=0.0, unfinished=True)[0], fit.sld_prior(folded, [0.3, 0.4, 0.3], 3, max_iter=20, tol=0.0, unfinished=True)[0]
    assert np.allclose(a, b, atol=1e-12)
    near = lambda got, want: all(x == pytest.approx(y, abs=1e-12) for x, y in zip(got, want, strict=True))
    (s, f1), (t, f2) = (fit.greedy_scales(x, 3, step=0.5, passes=1)[None] for x in (df, folded))
    assert s == t and f1 == pytest.approx(f2, abs=1e-12)
    cand = [[1.0, 1.0, 1.0], [2.0, 1.0, 0.5]]
    for w in (None, [2.5, 0.5, 3.0]):
        assert near(*([r.objective for r in fit.evaluate_candidates(x, cand, 3, w).orderBy("cand").collect()] for x in (df, folded)))
    one, two = (fit.kfold_scales(x, 3, 3, step=0.5, passes=1) for x in (df, folded))
    order = lambda r: (r["fold"], r["variant"])
    assert one[0] == two[0] and near(*([r["macro_f1"] for r in sorted(x[1], key=order)] for x in (one, two)))
    assert near(*([r.macro_f1 for r in fit.scaled_f1(x, {"a": cand[0], "b": cand[1]}, 3).orderBy("variant").collect()] for x in (df, folded)))
