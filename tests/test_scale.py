"""Forms that keep any one task small: against plain Python, with limits lowered so that they matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import dedup as dd, fit, metrics as mt, quality as qg
from tallyvane.operators.vectors import add_vectors
from tallyvane.storage import child_names, scratch_path
from tallyvane.streaming import intake as st


@pytest.mark.parametrize("few", [50_000, 20])
def test_accuracy_at_coverage_with_ties(spark, monkeypatch, few):
    """Scores that repeat leave more rows than one task may rank."""
    monkeypatch.setattr(mt, "FEW_ROWS", few)
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, 0.5, 0.25, rng.random(), None, 1e-9 * i]), rng.randrange(2), rng.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, conf double, y int, pred int").repartition(4)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    points = (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)
    got = {r.point: (r.n, r.accuracy) for r in mt.accuracy_at_coverage(df, points).collect()}
    for p in points:
        n = max(1, int(600 * p))
        assert got[p][0] == n and got[p][1] == pytest.approx(np.mean([y == q for _, _, y, q in order[:n]]))
    assert mt.accuracy_at_coverage(df.limit(0)).count() == 0


@pytest.mark.parametrize("used,start,n", [([], 5, 4), ([5, 6, 7, 8], 5, 3), ([1, 9, 10**12], 0, 12), (list(range(500)) + [510, 512, 512], 0, 20), ([3], 4, 2)])
def test_first_free_ids(spark, used, start, n):
    df = spark.createDataFrame([(u,) for u in used], "id long")
    want, k, held = [], start, set(used)
    while len(want) < n:
        if k not in held:
            want.append(k)
        k += 1
    assert [r.id for r in dd.unused_ids(spark, df, "id", start, n).collect()] == want


def test_vectors_are_added_in_a_tree(spark):
    parts = spark.range(0, 200, 1, 23).select(F.pmod("id", F.lit(3)).alias("g"), "id")
    rows = parts.mapInPandas(lambda it: ({"g": p["g"], "sums": [np.array([float(i), 1.0]).tobytes() for i in p["id"]]} and __import__("pandas").DataFrame(
        {"g": p["g"], "sums": [np.array([float(i), 1.0]).tobytes() for i in p["id"]]}) for p in it), "g long, sums binary")
    got = {r.g: np.frombuffer(r.sums).tolist() for r in add_vectors(rows, ["g"], fan_in=3).collect()}
    assert got == {g: [float(sum(i for i in range(200) if i % 3 == g)), float(sum(i % 3 == g for i in range(200)))] for g in range(3)}


def test_moments_of_wide_vectors(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 40)), rng.normal(size=(50, 40)) * 1.5
    df = spark.createDataFrame([("a", v.tolist()) for v in x] + [("b", v.tolist()) for v in y], "side string, f array<double>").repartition(5)
    rows = qg.gram_sums(df, "f", "side").collect()
    n, mean, cov = qg._moments(rows, "b", "side")
    assert n == 50 and np.allclose(mean, y.mean(axis=0)) and np.allclose(cov, np.cov(y.T))
    assert all(len(r["sums"]) == 8 * (1 + 40 + 40 * 41 // 2) for r in rows)


def test_untouched_buckets_stay(spark):
    src, table, state = (scratch_path(spark, n) for n in ("in", "tbl", "state"))
    schema = "k int, t int"
    run = lambda: st.upsert_latest(spark.readStream.schema(schema).parquet(src), "k", ["t"], table, state, buckets=8).awaitTermination()
    spark.createDataFrame([(k, 0) for k in range(40)], schema).coalesce(1).write.parquet(src)
    run()
    for t in (1, 2, 3):
        spark.createDataFrame([(5, t)], schema).coalesce(1).write.mode("append").parquet(src)
        run()
    entries = {r.bucket: r.batch for r in st._manifest(spark, table, 3).collect()}
    assert sorted(entries.values()) == [0] * 7 + [3]
    assert {r.k: r.t for r in st.read_latest(spark, table).collect()} == {k: 3 if k == 5 else 0 for k in range(40)}
    assert sorted(n for n in child_names(spark, table) if n.startswith("rows-")) == ["rows-0", "rows-2", "rows-3"]


def test_unconverged_fits_fail(spark, monkeypatch):
    rng = np.random.default_rng(1)
    zs = rng.normal(size=(200, 2, 3)) * 3
    y = np.where(rng.random(200) < 0.8, zs[:, 1].argmax(axis=1), rng.integers(0, 3, 200))
    stacked = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, zs)], "y int, zs array<array<double>>")
    with pytest.raises(RuntimeError, match="not converged"):
        fit.fit_ensemble_weights(stacked, 2, 3, max_iter=0)
    assert fit.fit_ensemble_weights(stacked, 2, 3, max_iter=0, unfinished=True)[0] == [0.5, 0.5]
    probs = spark.createDataFrame([(int(v), p) for v, p in zip(rng.integers(0, 2, 50), rng.dirichlet([1, 1], 50).tolist())], "y int, p array<double>")
    monkeypatch.setattr(fit, "MOST_GENERATIONS", 1)
    with pytest.raises(RuntimeError, match="not converged"):
        fit.evolve_scales(probs, [(0.3, 4.0)] * 2, population=4, tol=0.0)
    assert len(fit.evolve_scales(probs, [(0.3, 4.0)] * 2, population=4, generations=1, tol=0.0)[0]) == 2
