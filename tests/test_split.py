"""Split, sampling and balancing invariants."""

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import split as sp


@pytest.fixture(scope="module")
def rows(spark):
    # one group holds a third of all rows
    data = [(i, "giant" if i % 3 == 0 else f"L{i // 4}", f"c{i % 5}") for i in range(1200)]
    return spark.createDataFrame(data, "id long, lesion string, cls string").repartition(6)


def test_groups_never_straddle(rows):
    cut = sp.group_split(rows, "lesion", 42)
    assert sp.leaking_groups(cut, "lesion").count() == 0
    per = {r.split: r.n for r in cut.groupBy("split").agg(F.count_distinct("lesion").alias("n")).collect()}
    total = sum(per.values())
    for name, share in (("test", 0.15), ("val_calibrate", 0.05), ("val_select", 0.10)):
        assert abs(per[name] - share * total) <= 1.0
    assert cut.count() == rows.count()


def test_split_ignores_partitioning(rows):
    pick = lambda d: sorted((r.id, r.split) for r in sp.group_split(d, "lesion", 7).select("id", "split").collect())
    assert pick(rows) == pick(rows.repartition(1)) == pick(rows.repartition(11, "cls"))


def test_leak_gate_raises(rows):
    leaky = rows.withColumn("split", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    with pytest.raises(Exception, match="group leak"):
        sp.require_no_leak(leaky, "lesion").select("split").collect()


def test_kfold_tests_each_group_once(rows):
    out = sp.group_kfold(rows, "lesion", "cls", 4, 1)
    assert out.count() == 4 * rows.count()
    tests = out.filter("split = 'test'").select("lesion", "fold").distinct().groupBy("lesion").count().select("count").distinct().collect()
    assert [r["count"] for r in tests] == [1]
    assert sp.leaking_groups(out, "lesion", "fold").count() == 0


def test_stratified_counts_are_exact(rows):
    out = sp.stratified_split(rows, "cls", "id", [0.8], ["train", "val"], 3)
    got = {(r.cls, r.split): r["count"] for r in out.groupBy("cls", "split").count().collect()}
    assert all(got[f"c{i}", "train"] == 192 and got[f"c{i}", "val"] == 48 for i in range(5))


def test_folds_are_even(rows):
    got = sp.stratified_folds(rows, "cls", "id", 5, 3).groupBy("cls", "fold").count().collect()
    assert {r["count"] for r in got} == {48} and len(got) == 25


def test_sample_size_and_overdraw(rows):
    assert sp.sample_without_replacement(rows, "id", 17, 2).count() == 17
    assert sp.sample_without_replacement(rows, "id", 99999, 2).count() == 1200


def test_trim_keeps_exactly_the_need(spark, rows):
    real = spark.createDataFrame([(f"r{i}", "c0") for i in range(200)], "id string, cls string")
    kept = sp.trim_to_target(real, rows, "cls", "id", 230, 5).filter("kept").groupBy("cls").count().collect()
    assert {r.cls: r["count"] for r in kept} == {"c0": 30, "c1": 230, "c2": 230, "c3": 230, "c4": 230}


def test_poisson_balancing_hits_equal_shares(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 9 == 0, "rare").otherwise("common").alias("cls"))
    got = {r.cls: r.s for r in sp.poisson_balanced(df, "cls", "id", 1, power=1.0).groupBy("cls").agg(F.sum("copies").alias("s")).collect()}
    assert abs(got["rare"] - 4500) < 4 * 4500**0.5 and abs(got["common"] - 4500) < 4 * 4500**0.5


def test_exact_balancing_draws_n(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 9 == 0, "rare").otherwise("common").alias("cls"))
    out = sp.weighted_with_replacement(df, "cls", "id", 1, power=1.0)
    got = {r.cls: r["count"] for r in out.groupBy("cls").count().collect()}
    assert sum(got.values()) == 900 and abs(got["rare"] - 450) < 4 * 15


def test_jitter_stays_in_range(spark):
    df = spark.range(400).select(F.concat(F.lit("SYNTH_"), F.col("id").cast("string")).alias("image"), F.lit("VASC").alias("cls"))
    out = sp.jitter_metadata(df, "cls", "image", 1)
    a = out.agg(F.min("age_jit"), F.max("age_jit"), F.avg("age_jit"), F.avg((F.col("sex_jit") == "female").cast("int"))).first()
    assert a[0] >= 20 and a[1] <= 90 and abs(a[2] - 50) < 4 and abs(a[3] - 0.5) < 0.1
    assert {r.site_jit for r in out.select("site_jit").distinct().collect()} == {"anterior torso", "posterior torso", "lower extremity", "head/neck"}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sp.jitter_metadata(df.repartition(7), "cls", "image", 1).collect()))


def test_balance_lists_absent_classes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "split string, cls string")
    got = {(r.split, r.cls): (r.n, r.drifts) for r in sp.class_balance(df, "cls").collect()}
    assert got["b", "y"] == (0, True) and len(got) == 4


@pytest.mark.parametrize("cut", [
    lambda d: sp.stratified_split(d, "cls", "id", [0.8], ["a", "b"], 1), lambda d: sp.stratified_folds(d, "cls", "id", 3, 1),
    lambda d: sp.group_split(d, "grp", 1), lambda d: sp.group_kfold(d, "grp", "cls", 3, 1),
])
def test_null_keys_fail_instead_of_falling_into_a_split(spark, cut):
    full = spark.createDataFrame([(i, f"c{i % 2}", f"g{i % 9}") for i in range(60)], "id int, cls string, grp string")
    assert cut(full).count() in (60, 180)
    holes = full.withColumn("cls", F.when(F.col("id") % 4 > 0, F.col("cls"))).withColumn("grp", F.when(F.col("id") % 4 > 0, F.col("grp")))
    with pytest.raises(Exception, match="is null: fill or quarantine"):
        cut(holes).collect()
