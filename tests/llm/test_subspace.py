import numpy as np
import pyarrow.dataset as ds
import pytest

from tallyvane.llm import subspace as s


def brute(rows, cosine=0.9):
    ok = {i: np.asarray(v, dtype=float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    near = {i: [] for i in range(len(rows))}
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[i].append(j)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((d, len(near[i]), low, low is None or d == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks,chunk", [(4, 16_384), (8, 50), (3, 7)])
def test_equals_brute_force(spark, blocks, chunk):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in (1, 1, 40, 5, 1, 1, 1, 9) * 6:
        c = rng.normal(size=32)
        for _ in range(size):  # noise around the limit: many pairs just above and just below
            rows.append((n, (c + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3])).tolist()))
            n += 1
    rows += [(1000, rows[2][1]), (1001, rows[2][1]), (1001, rows[2][1]), (1002, [2 * x for x in rows[2][1]]), (1003, None), (1004, []), (1005, [0.0] * 32), (1006, [None] + [1.0] * 31)]
    rows += [(1007, [float("nan")] * 32), (1008, [float("inf")] + [1.0] * 31), (1009, [1.0] * 31), (1010, [1.0] * 30 + [1.01]), (None, rows[3][1]), (None, [-x for x in rows[3][1]]), (1011, [1e300] * 5), (1012, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, cls int, copies int").repartition(4)
    got = sorted((tuple(r) for r in s.near_duplicates(df, blocks=blocks, chunk=chunk).collect()), key=str)
    assert got == brute(rows)
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_check_rows(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = ds.dataset(path).to_table().to_pylist()
    got = sorted((tuple(r) for r in s.near_duplicates(spark.read.parquet(path)).collect()), key=str)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in t])


def test_rotation_keeps_distances():
    x = np.random.default_rng(0).normal(size=(20, 24))
    r, u = s.rotate(x, 3), x / np.linalg.norm(x, axis=1)[:, None]
    assert r.shape == (20, 32) and np.allclose(r @ r.T, u @ u.T)


def test_two_components_equal_brute_force(spark):
    angles = np.random.default_rng(2).uniform(0, 2 * np.pi, 80)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    assert sorted((tuple(r) for r in s.near_duplicates(df).collect()), key=str) == brute(rows)
    assert s.reach_of(2, 4, 0.9) ** 2 > 0.1 and s.reach_of(32, 3, 0.9) ** 2 > 0.2 * 11 / 32
