"""Metric goldens worked out by hand, and curves against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import attribution as at, fit, metrics as mt


def preds(spark, pairs):
    return spark.createDataFrame(pairs, "y int, pred int")


def test_macro_f1_in_both_label_modes(spark):
    conf = mt.confusion(preds(spark, [(0, 0), (0, 1), (1, 1), (1, 1)]))
    assert mt.summary(conf).first().macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)
    assert mt.summary(conf, labels=4).first().macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 4)


def test_zero_division_is_zero(spark):
    got = {r.cls: (r.precision, r.recall, r.f1) for r in mt.class_report(mt.confusion(preds(spark, [(0, 1)]))).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (0.0, 0.0, 0.0)}


def test_confusion_matrix_fills_zeros(spark):
    got = mt.confusion_matrix(preds(spark, [(0, 1)]), 3).collect()
    assert len(got) == 9 and sum(r.n for r in got) == 1


def test_ece_in_both_closed_modes(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4, 0), (1.0, 1)], "c double, h int")
    def ece(mode):
        return mt.calibration_error(mt.calibration_bins(df, F.col("c"), F.col("h") == 1, bins=2, closed=mode)).first()
    left, right = ece("left"), ece("right")
    assert left.ece == pytest.approx(1 / 3 * 0.4 + 2 / 3 * 0.25) and left.mce == pytest.approx(0.4)
    assert right.ece == pytest.approx(2 / 3 * 0.05 + 0.0) and right.mce == pytest.approx(0.05)


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.2, 0.8])], "y int, p array<double>")
    assert {r.cls: r.auc for r in mt.auc_one_vs_rest(df, 2).collect()} == {0: 0.875, 1: 0.875}


def test_auc_of_an_absent_class_is_null(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1])], "y int, p array<double>")
    assert {r.cls: r.auc for r in mt.auc_one_vs_rest(df, 2).collect()} == {0: None, 1: None}


def test_curve_breaks_ties_by_row_id(spark):
    df = spark.createDataFrame([(3, 0.9, 0, 0), (1, 0.9, 0, 1), (2, 0.5, 1, 1), (4, 0.1, 1, 0)], "row_id int, conf double, y int, pred int")
    got = [(r.row_id, r.accuracy) for r in mt.risk_coverage(df).orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 0.5), (2, pytest.approx(2 / 3)), (4, 0.5)]
    at_points = {r.point: (r.n, r.accuracy) for r in mt.accuracy_at_coverage(df, (0.1, 0.5)).collect()}
    assert at_points == {0.1: (1, 0.0), 0.5: (2, 0.5)}


def test_miss_rate_without_the_class_is_null(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8])], "y int, p array<double>")
    assert mt.miss_rates(df, 0, (0.5,)).first().miss_rate is None


def test_small_cohorts_are_suppressed(spark):
    rows = [(0, 0, 1, "male", 30.0)] * 30 + [(0, 1, 5, "female", None)] * 5
    df = spark.createDataFrame(rows, "y int, pred int, fitzpatrick int, sex string, age double")
    got = {(r.dim, r.cohort): r for r in mt.fairness(df).collect()}
    assert got["skin_tone", "I-II"].macro_f1 == 1.0 and got["skin_tone", "I-II"].watched_recall == 1.0
    assert got["skin_tone", "V-VI"].macro_f1 is None and got["skin_tone", "V-VI"].n == 5
    assert ("age_band", None) not in got
    gone = mt.fairness(df.drop("fitzpatrick")).filter("note = 'unavailable'").collect()
    assert [r.dim for r in gone] == ["skin_tone"]


def test_vote_tie_takes_smallest_class_and_first_truth(spark):
    df = spark.createDataFrame([(2, 1, 1, 2, [0.1, 0.2, 0.7]), (1, 1, 0, 0, [0.6, 0.2, 0.2])], "row_id int, g int, y int, pred int, p array<double>")
    r = mt.group_rollup(df, "g", 3).first()
    assert (r.majority, r.mean_prob, r.y) == (0, 2, 0)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        y = rng.choice([0, 0, 0, 1, 1, 2])
        z = [rng.random() + (0.35 if k == y else 0) for k in range(3)]
        p = [v / sum(z) for v in z]
        rows.append((i, y, p.index(max(p)), p))
    return rows, spark.createDataFrame(rows, "row_id int, y int, pred int, p array<double>").repartition(3).persist()


def macro(pairs):
    out = []
    for c in sorted({a for a, _ in pairs} | {b for _, b in pairs}):
        tp = sum(1 for a, b in pairs if a == b == c)
        out.append(2 * tp / (sum(1 for a, _ in pairs if a == c) + sum(1 for _, b in pairs if b == c)))
    return sum(out) / len(out)


def test_threshold_curve_equals_rescoring(scored):
    rows, df = scored
    for r in fit.threshold_curve(df, 2).collect():
        pairs = [(y, 2 if p[2] >= r.t else d) for _, y, d, p in rows]
        assert r.macro_f1 == pytest.approx(macro(pairs))


def test_safety_threshold_is_the_highest_that_works(scored):
    rows, df = scored
    got = fit.safety_threshold(df, 2, target=0.9, floor_drop=0.0)
    r = got.first()
    def at_t(t):
        pairs = [(y, 2 if p[2] >= t else d) for _, y, d, p in rows]
        return sum(1 for a, b in pairs if a == b == 2) / sum(1 for a, _ in pairs if a == 2), macro(pairs)
    ts = [round(0.95 - i * 0.005, 10) for i in range(188)]
    strict = [t for t in ts if at_t(t)[0] >= 0.9 and at_t(t)[1] >= r.macro_f1_before]
    loose = [t for t in ts if at_t(t)[0] >= 0.9]
    assert r.threshold == (max(strict) if strict else max(loose))
    assert fit.safety_threshold(df, 2, target=0.0).first().outcome == "already_met"


def test_scale_curve_equals_rescoring(scored):
    rows, df = scored
    scales = [1.0, 1.3, 0.7]
    points = fit.grid(0.3, 4.0, 0.05)
    for c in range(3):
        got = {r.point: r.macro_f1 for r in mt.summary(fit.scale_curve(df, c, scales, 3), ["point"]).collect()}
        for i, s in [(-1, scales[c])] + list(enumerate(points)):
            trial = [s if k == c else scales[k] for k in range(3)]
            pairs = []
            for _, y, _, p in rows:
                q = [a * b for a, b in zip(p, trial)]
                pairs.append((y, q.index(max(q))))
            assert got[i] == pytest.approx(macro(pairs)), (c, s)


def test_masking_every_group_shows_the_drop(spark):
    df = spark.createDataFrame([(0, [0.5] + [0.0] * 18), (1, [0.0, 1.0] + [0.0] * 17)], "y int, x array<double>")
    scorer = lambda x: F.array(x[0], x[1])
    got = {r.masked: r.drop for r in at.ablation_report(df, "x", 19, scorer).collect()}
    assert got["none"] == 0.0 and got["sex"] > 0.0 and got["site"] == 0.0
