"""Split, evaluation and audit runs: what they write, and what they refuse."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import protocol as pt
from tallyvane.sources.sinks import read_params


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"L{i // 3}", f"c{i % 3}", f"h{i}") for i in range(1800)], "id long, lesion string, cls string, sha string").repartition(5)


@pytest.mark.parametrize("mode", ["single", "kfold"])
def test_split_run(spark, rows, tmp_path, mode):
    out = str(tmp_path / mode)
    manifest = pt.run_split(rows, out, "lesion", "cls", mode, 42, k=4).collect()
    folds = 1 if mode == "single" else 4
    written = spark.read.parquet(f"{out}/rows")
    assert written.count() == folds * 1800 == sum(r.n_rows for r in manifest)
    assert len(manifest) == 4 * folds and len({r.run_id for r in manifest}) == 1
    assert written.groupBy("fold", "lesion").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    want = pt.wanted_shares(mode, 4)
    assert abs(sum(want.values()) - 1) < 1e-12
    assert all(abs(r.achieved - want[r.split]) < 0.02 for r in manifest)
    balance = spark.read.parquet(f"{out}/balance")
    assert balance.count() == 12 * folds and balance.agg(F.sum("n")).first()[0] == 1800 * folds
    with pytest.raises(Exception, match="already exists"):
        pt.run_split(rows, out, "lesion", "cls", mode)


def test_copies_go_before_the_split(spark, rows, tmp_path):
    twice = rows.withColumn("rank", F.lit(0)).unionByName(rows.withColumns({"id": F.col("id") + 10_000, "rank": F.lit(1)}))
    got = pt.run_split(twice, str(tmp_path / "o"), "lesion", "cls", copies=("sha", "rank", "id"))
    assert got.agg(F.sum("n_rows")).first()[0] == 1800


def test_split_refuses(spark, rows, tmp_path):
    path = lambda n: str(tmp_path / n)
    with pytest.raises(ValueError, match="no rows"):
        pt.run_split(rows.limit(0), path("a"), "lesion", "cls")
    with pytest.raises(ValueError, match="mode"):
        pt.run_split(rows, path("b"), "lesion", "cls", "other")
    with pytest.raises(ValueError, match="already has"):
        pt.run_split(rows.withColumn("fold", F.lit(1)), path("c"), "lesion", "cls")
    with pytest.raises(Exception, match="null"):
        pt.run_split(rows.withColumn("lesion", F.when(F.col("id") > 5, F.col("lesion"))), path("d"), "lesion", "cls")
    # one group of a third of all rows cannot be balanced: rows are written, a manifest is not
    giant = rows.withColumn("lesion", F.when(F.col("id") % 3 == 0, "giant").otherwise(F.col("lesion")))
    with pytest.raises(ValueError, match="share"):
        pt.run_split(giant, path("e"), "lesion", "cls")
    assert not os.path.exists(path("e") + "/manifest")


@pytest.fixture(scope="module")
def logits(spark):
    near = lambda y, i: [2.5 * (c == y) + ((i * 7 + c * 3) % 10) / 4 for c in range(3)]
    data = [(i, i // 2, i % 3, near((i + (i % 5 == 0)) % 3, i)) for i in range(400)]
    return spark.createDataFrame(data, "row_id long, lesion long, y int, z array<double>")


def test_evaluation_refuses_the_rows_it_judges(logits):
    cal, test = logits.filter("row_id < 200"), logits.filter("row_id >= 200")
    prior = [0.5, 0.25, 0.25]
    for fit_rows in (None, logits, test):
        with pytest.raises(pt.LeakError):
            pt.calibrate_and_evaluate(fit_rows, test, 3, prior)
    # no row is shared, but a lesion is
    with pytest.raises(pt.LeakError, match="lesion"):
        pt.calibrate_and_evaluate(logits.filter("row_id % 2 = 0"), logits.filter("row_id % 2 = 1"), 3, prior, ("row_id", "lesion"))
    pt.require_disjoint(cal, test, ["row_id", "lesion"])
    for bad in ([0.5, 0.5], [0.5, 0.5, 0.5], [1.5, -0.5, 0.0]):
        with pytest.raises(ValueError, match="train_prior"):
            pt.calibrate_and_evaluate(cal, test, 3, bad)


def test_evaluation(spark, logits, tmp_path):
    out = str(tmp_path / "e")
    got = pt.calibrate_and_evaluate(logits.filter("row_id < 200"), logits.filter("row_id >= 200"), 3, [0.5, 0.25, 0.25], out=out, prior_steps=10, unfinished=True)
    value = {(r.name, r.scope, r.key): r.value for r in got.metrics.collect()}
    assert len(value) == 3 + 3 * 4 + 4 * 5 and abs(sum(got.params["target_prior"]) - 1) < 1e-6
    assert value["calibration", "method=dirichlet", "nll"] <= value["calibration", "method=raw", "nll"]
    assert value["headline", "all", "accuracy"] == value["calibration", "method=per_class", "accuracy"]
    assert value["per_class", "cls=0", "support"] == logits.filter("row_id >= 200 and y = 0").count()
    stored = spark.range(1).select(read_params(spark, f"{out}/calibration").alias("p")).first().p
    assert stored.temperature == got.params["temperature"] and list(stored.train_prior) == [0.5, 0.25, 0.25]


def test_audit(spark, logits, tmp_path):
    rows = logits.select("row_id", "lesion", "y", F.col("z").alias("p"), F.lit(0).alias("pred"), F.col("z")[0].alias("conf"), F.when(F.col("row_id") < 390, "male").otherwise("female").alias("sex"))
    same, worse = rows.select("y", "pred"), rows.select("y", F.lit(7).alias("pred"))
    attribution = spark.createDataFrame([(0, "age", 1.0), (0, "age", 3.0), (1, "age", None)], "cls int, feature string, value double")
    out = str(tmp_path / "a")
    got = {(r.name, r.scope, r.key): r.value for r in pt.audit_bundle(rows, "lesion", 3, variants={"no_age": same, "none": worse}, attribution=attribution, out=out).collect()}
    assert got["fairness", "dim=sex/cohort=male", "n"] == 390
    assert got["fairness", "dim=sex/cohort=female", "n"] == 10 and got["fairness", "dim=sex/cohort=female", "macro_f1"] is None
    assert got["missing_metadata", "variant=no_age", "delta"] == 0 and got["missing_metadata", "variant=none", "delta"] < 0
    assert got["attribution", "cls=0/feature=age", "mean"] == 2.0 and got["attribution", "cls=1/feature=age", "mean"] is None
    assert got["selective", "point=1.0", "n"] == 400
    doc = json.loads(spark.read.text(f"{out}/audit").first().value)
    assert {(n, s, k): v for n, scopes in doc.items() for s, keys in scopes.items() for k, v in keys.items()} == got
