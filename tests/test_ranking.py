"""Distributed ranks, cuts, medians and nearest values against brute force, with a hot group."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import ranking as rk


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", float(rng.randrange(40))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double").repartition(5)


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_cuts_match_sorting(skewed, digits):
    rows, df = skewed
    cuts = rk.hash_cuts(df, ["g"], ["id"], 9, lambda n: [F.lit(0), F.lit(2), F.floor(n / 2), n + 5], digits=digits).collect()
    got = {(r.g, r.slot): r.cut for r in cuts}
    for g in {r[1] for r in rows}:
        hs = sorted(md5(9, i) for i, k, _ in rows if k == g)
        assert got[g, 0] == rk.NOTHING and got[g, 3] == rk.EVERYTHING
        assert got[g, 1] == hs[1] and got[g, 2] == hs[len(hs) // 2 - 1]


def test_take_is_exact_and_partition_invariant(skewed):
    rows, df = skewed
    take = lambda d: sorted(r.id for r in rk.take_per_class(d, "g", "id", 1, lambda n: F.floor(n * 0.3)).filter("kept").collect())
    got = take(df)
    assert got == take(df.repartition(1)) == take(df.repartition(13, "v"))
    want = []
    for g in {r[1] for r in rows}:
        ids = sorted((i for i, k, _ in rows if k == g), key=lambda i: md5(1, i))
        want += ids[: int(len(ids) * 0.3)]
    assert got == sorted(want)


def test_prefix_sums_match_pandas(skewed):
    rows, df = skewed
    out = rk.prefix_sums(df.withColumn("one", F.lit(1)), ["g"], [F.col("v").desc(), F.col("id")], ["one", "v"]).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    pdf["c"], pdf["s"] = pdf.groupby("g").cumcount() + 1, pdf.groupby("g")["v"].cumsum()
    m = out.merge(pdf, on="id")
    assert (m.cum_one == m.c).all() and (m.cum_v == m.s).all()


def test_median_matches_pandas(skewed):
    rows, df = skewed
    got = {r.g: r.median for r in rk.exact_median(df, ["g"], "v").collect()}
    assert got == pd.DataFrame(rows, columns=["id", "g", "v"]).groupby("g")["v"].median().to_dict()


def test_median_of_nulls_only_is_absent(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    assert [(r.g, r.median) for r in rk.exact_median(df, ["g"], "v").collect()] == [("b", 2.0)]


def test_nearest_value_matches_brute_force(spark):
    rng = random.Random(5)
    left = [(i, 7.0 if i % 3 == 0 else rng.randrange(300) / 10) for i in range(150)]
    right = [(i, rng.randrange(300) / 10) for i in range(90)]
    got = rk.nearest_value(
        spark.createDataFrame(left, "i long, a double").repartition(4), spark.createDataFrame(right, "rid long, b double").repartition(4), "a", "b", "rid").collect()
    assert len(got) == 150
    for r in got:
        assert r.nearest_id == min(right, key=lambda x: (abs(x[1] - r.a), x[0]))[0]


def test_nearest_value_without_reference(spark):
    left = spark.createDataFrame([(1, 2.0)], "i long, a double")
    right = spark.createDataFrame([], "rid long, b double")
    assert rk.nearest_value(left, right, "a", "b", "rid").first().nearest_id is None


def plain_cut(rows, seed, r):
    import hashlib
    return sorted(hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in rows)[r - 1]


def test_hash_cuts_narrow_to_few_hashes(spark):
    """A key that holds a third of the rows, and buckets far smaller than one prefix."""
    keys = list(range(4000)) + [7] * 2000
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in keys], "k long, c string").repartition(5)
    for digits in (1, 3):
        got = {(r.c, r.slot): r.cut for r in rk.hash_cuts(df, ["c"], ["k"], 9, lambda n: [F.round(n * 0.3), F.round(n * 0.5), n], digits).collect()}
        for c in "ab":
            mine = [k for k in keys if ("a" if k % 3 else "b") == c]
            for slot, share in enumerate((0.3, 0.5, 1.0)):
                assert got[c, slot] == plain_cut(mine, 9, int(len(mine) * share + 0.5))
    hashed = df.select("c", F.md5(F.concat(F.lit("9:"), F.col("k").cast("string"))).alias("_h"))
    hit = spark.createDataFrame([("a", 0, plain_cut([k for k in keys if k % 3], 9, 1000)[:1], 5)], "c string, slot int, _b string, _r long")
    narrow = rk._narrow(hashed, hit, ["c"], 1, 3).first()
    assert len(narrow._b) == 3 and hashed.filter(F.col("_h").startswith(narrow._b) & (F.col("c") == "a")).select("_h").distinct().count() < 20


def test_cuts_of_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rk, "MOST_CUTS", 10)
    df = spark.range(50).select("id", F.col("id").alias("g"))
    with pytest.raises(Exception, match="class domain"):
        rk.hash_cuts(df, ["g"], ["id"], 1, lambda n: [n]).collect()


def test_null_is_a_group_of_running_totals_and_medians(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 8.0), ("x", 5.0), ("x", None)], "g string, v double")
    assert {r.g: r.median for r in rk.exact_median(df, ["g"], "v").collect()} == {None: 3.0, "x": 5.0}
    ones = df.filter("v is not null").withColumn("n", F.lit(1))
    assert sorted(r.cum_n for r in rk.prefix_sums(ones, ["g"], [F.col("v")], ["n"]).collect()) == [1, 1, 2, 3]
