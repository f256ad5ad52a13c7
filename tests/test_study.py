"""Study protocol operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import graph, study as st


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (7, 7), (None, 3)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)],
    [],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.id: r.root for r in graph.components(df).collect()} == plain_components(edges)


def test_join_hot_keeps_every_row(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1), (None, 2), ("gone", 3)]
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(50)], "k string, v string")
    got = graph.join_hot(spark.createDataFrame(rows, "k string, i long"), right, "k").collect()
    want = {"hot": "H", **{f"k{i}": f"v{i}" for i in range(50)}}
    assert sorted((str(r.k), r.i, str(r.v)) for r in got) == sorted((str(k), i, str(want.get(k))) for k, i in rows)


def test_identity_groups_link_through_any_id(spark):
    rows = [(1, "p1", "l1", 0), (2, "p1", "l2", 0), (3, None, "l2", 0), (4, None, "l3", 1), (5, "p2", None, 1), (6, None, None, 1), (7, None, None, 0), (8, "l1", None, 0)]
    df = spark.createDataFrame(rows, "id long, patient string, lesion string, cls int")
    got = {r.id: r.group for r in st.identity_groups(df, ["patient", "lesion"]).collect()}
    assert got[1] == got[2] == got[3] == "lesion:l1" and got[4] == "lesion:l3" and got[5] == "patient:p2"
    assert got[6] is None and got[7] is None and got[8] == "patient:l1"
    split = st.identity_split(df, ["patient", "lesion"], "id", "cls", 1)
    assert split.count() == 8 and all(r.n_straddling == 0 for r in st.straddling_ids(split, ["patient", "lesion"]).collect())
    assert st.identity_groups(df.limit(0), ["patient", "lesion"]).count() == 0


def test_coalesced_ids_would_leak(spark):
    """Two lesions of a patient: by the first id a row has they could part, by identity they cannot."""
    rows = [(i, None if i % 3 else f"p{i // 6}", f"l{i // 2}", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, patient string, lesion string, cls int")
    naive = df.withColumn("split", F.pmod(F.xxhash64(F.coalesce("patient", "lesion")), F.lit(2)).cast("string"))
    assert sum(r.n_straddling for r in st.straddling_ids(naive, ["patient", "lesion"]).collect()) > 0
    sound = st.identity_split(df, ["patient", "lesion"], "id", "cls", 3)
    assert sum(r.n_straddling for r in st.straddling_ids(sound, ["patient", "lesion"]).collect()) == 0


def models(spark, n, better=0.1, parts=3):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        y = rng.randrange(3)
        a = y if rng.random() < 0.6 else rng.randrange(3)
        rows.append((f"r{i}", y, a, y if rng.random() < better else a))
    return spark.createDataFrame(rows, "id string, y int, pred_a int, pred_b int").repartition(parts)


def test_bootstrap_repeats_and_covers(spark):
    df = models(spark, 900)
    once, again = (st.paired_bootstrap(d, "id", 3, replicates=300, seed=5).collect() for d in (df, df.repartition(7)))
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))
    sizes = [r.n for r in once if r.replicate >= 0 and r.model == "a"]
    assert len(sizes) == 300 and abs(np.mean(sizes) - 900) < 10 and 20 < np.std(sizes) < 40  # Poisson: sqrt(900) = 30
    by = {r.metric: r for r in st.bootstrap_interval(st.paired_bootstrap(df, "id", 3, replicates=300, seed=5)).collect()}
    acc = by["accuracy"]
    exact = df.agg(F.avg((F.col("y") == F.col("pred_b")).cast("double")) - F.avg((F.col("y") == F.col("pred_a")).cast("double"))).first()[0]
    assert acc.difference == pytest.approx(exact) and acc.low < exact < acc.high and acc.replicates == 300 and acc.share_not_better == 0
    assert other_seed_differs(df, once)


def other_seed_differs(df, once):
    return sorted(map(tuple, st.paired_bootstrap(df, "id", 3, replicates=300, seed=6).collect())) != sorted(map(tuple, once))


def test_equal_models_have_no_difference(spark):
    df = models(spark, 200, better=0.0)
    for r in st.bootstrap_interval(st.paired_bootstrap(df, "id", 3, replicates=50)).collect():
        assert r.difference == r.low == r.high == 0.0 and r.share_not_better == 1.0


@pytest.mark.parametrize("n,k", [(0, 0), (1, 0), (1, 1), (2, 1), (10, 3), (15, 15), (16, 2), (40, 11), (1000, 470), (100_000, 49_500)])
def test_binomial_tail(spark, n, k):
    got = spark.range(1).select(st.binomial_two_sided(F.lit(n).cast("bigint"), F.lit(k).cast("bigint")).alias("p")).first().p
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
    want = min(1.0, 2 * (sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n if n < 2000 else math.fsum(map(term, range(min(k, n - k) + 1))))) if n else 1.0
    assert got == pytest.approx(want, rel=1e-8)


def test_mcnemar_counts_and_no_discordance(spark):
    rows = [("x", 1, 1, 0)] * 9 + [("x", 1, 0, 1)] * 2 + [("x", 1, 1, 1)] * 5 + [("z", 1, 1, 1), ("z", 1, None, 0), ("z", None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, y int, pred_a int, pred_b int")
    got = {r.g: r for r in st.mcnemar(df, ["g"]).collect()}
    x, z = got["x"], got["z"]
    assert (x.both, x.only_a, x.only_b, x.neither) == (5, 9, 2, 0) and x.statistic == pytest.approx(36 / 11) and x.p_exact == pytest.approx(0.06542968)
    assert (z.both, z.only_a, z.only_b, z.neither) == (1, 0, 0, 2) and z.p_exact == 1.0 and z.statistic == 0.0


def test_held_out_sizes_and_roles(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 2 if i % 3 else 0) for i in range(60)], "id long, ds string, cls int")
    for r in st.held_out_sizes(df, "ds", "cls").collect():
        own = df.filter((F.col("ds") == r.held_out) & (F.col("cls") == r.cls)).count()
        assert (r.n_test, r.n_train) == (own, df.filter(F.col("cls") == r.cls).count() - own)
    roles = st.held_out_roles(df, "ds", "b", "id", 1)
    assert roles.filter("split = 'test' and ds <> 'b'").count() == 0 and roles.filter("split <> 'test' and ds = 'b'").count() == 0
    assert 0 < roles.filter("split = 'val'").count() < 20


def test_transfer_matrix_equals_models_fitted_apart(spark):
    rng = np.random.default_rng(2)
    rows = [("pqr"[i % 3], int(y := i % 4 if i % 3 else i % 3), (rng.normal(size=5) + y).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "ds string, y int, x array<double>")
    got = {(r.left_out, r.tested_on): r for r in st.transfer_matrix(df, "ds", "y", "x", 5, ["p", "q", "r"], 4).collect()}
    assert len(got) == 9
    for out in "pqr":
        means = {c: np.mean([x for d, y, x in rows if d != out and y == c], axis=0) for c in range(4) if any(d != out and y == c for d, y, _ in rows)}
        for on in "pqr":
            mine = [(y, min(means, key=lambda c: ((np.array(x) - means[c]) ** 2).sum())) for d, y, x in rows if d == on]
            assert got[out, on].n == len(mine) and got[out, on].accuracy == pytest.approx(np.mean([a == b for a, b in mine]))


def test_equalised_odds(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["m", "f", None]), rng.choice(["x", "y"]), rng.randrange(3), rng.randrange(3)) for _ in range(900)]
    df = spark.createDataFrame(rows, "sex string, band string, y int, pred int")
    odds = st.cohort_odds(st.cohort_lattice(df, {"sex": F.col("sex"), "band": F.col("band")}), [0, 1], 3).collect()
    by = {(r.crossing, r.cohort): r for r in odds}
    assert by["", ""].n == 900 and {r.crossing for r in odds} == {"", "sex", "band", "sex x band"}
    for s in "mf":
        for b in "xy":
            mine = [(y, p) for a, c, y, p in rows if a == s and c == b]
            r = by["sex x band", f"{s} | {b}"]
            pos = [p for y, p in mine if y < 2]
            assert r.n == len(mine) and r.tpr == pytest.approx(sum(p < 2 for p in pos) / len(pos))
    frame = spark.createDataFrame(odds)
    gaps = {r.crossing: r for r in st.equalised_odds(frame).collect()}
    assert gaps["sex"].tpr_gap == pytest.approx(abs(by["sex", "m"].tpr - by["sex", "f"].tpr)) and gaps["sex x band"].n_cohorts == 4
    worst = st.cohort_deficits(frame, 0.01).orderBy(F.desc("deficit")).first()
    assert worst.flagged and worst.deficit == pytest.approx(by["", ""].macro_f1 - min(r.macro_f1 for r in odds))
