import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.llm import quality_fm as q
from tallyvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = q.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 9, 9, 20, 41]), rng.normal(size=5)
    z = 0.3 + sum(m.linear[i] * v for i, v in zip(index, value))
    for a in range(5):
        for b in range(a):
            z += m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b]
    assert m.score(index, value) == pytest.approx(1 / (1 + np.exp(-z)))


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    rows = [(np.array([i % 2, 2 + i % 3]), np.ones(2)) for i in range(200)]
    y = np.array([float(i % 2 == 0) for i in range(200)])
    m = q.train(rows, y, 8, rank=2, steps=100, seed=int(rng.integers(9)))
    assert all((m.score(*r) > 0.5) == bool(t) for r, t in zip(rows, y))


def test_held_out_accuracy(spark):
    got = QUERIES["op1_quality_fm"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert min(r.predicted for r in held if r.toxic and r.quality) == 1  # toxic text of good quality is not this operator's to reject


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "a"), (2, "", 0, "b"), (3, "x " * 200_000, 400_000, "c"), (None, "some words", 10, "d"), (3, "again", 5, "e"), (3, "again", 5, "e")],
        "doc_id long, text string, n_chars long, score string",
    )
    labels = spark.createDataFrame([(3, 1), (3, None), (1, 0), (None, 1)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 2
    assert q.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}
    with pytest.raises(ValueError):
        q.scored(docs.withColumn("n", F.lit(1)), q.train([], np.array([]), 512), score_col="score")


def test_one_row_of_an_id_teaches(spark, monkeypatch):
    rows = [(1, f"text {i % 7} of the first", i) for i in range(50)] + [(i, f"text of {i}", i) for i in (3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in (1, 3, 4, 5, 6)], "doc_id long, quality int")
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 3, 4, 5, 6))
    seen, train = [], q.train
    monkeypatch.setattr(q, "train", lambda rows, y, *a: seen.append((len(rows), int(sum(y)))) or train(rows, y, *a))
    one, two = q.fit(docs, labels, max_rows=20), q.fit(docs.repartition(2), labels, max_rows=20)
    assert zlib.crc32(b"1") % 4 != 2 and seen == [(usable, 1)] * 2
    assert (one.linear == two.linear).all() and one.bias == two.bias
