import re

import numpy as np
import pytest

from tallyvane.llm import minhash as m
from tallyvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w)} - {()} if len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute(rows):
    """component of each (id, text) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    where, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            where[x].append(i)
        for j, k in near.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)], d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_query_equals_brute_force(spark):
    got = sorted(tuple(r) for r in QUERIES["op8_super_minhash"](spark, SF).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == sorted(brute(rows))
    assert sum(not r[3] for r in got) > 20


def test_chains_big_groups_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(150):  # near copies of one text, each with other changes
        w = list(base)
        for p in rng.integers(0, 200, 3):
            w[p] = word()
        rows.append((1000 + i, " ".join(w)))
    chain = [word() for _ in range(100)]
    for i in range(12):  # neighbours are alike, ends are not
        chain[5 * i : 5 * i + 3] = [word() for _ in range(3)]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "x " * 50_000), (8, "x x x x"), (1000, rows[0][1]), (1000, "quite another text of words")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, comp string, n int").repartition(5)
    got = sorted(tuple(r) for r in m.near_duplicates(df).collect())
    assert got == sorted(brute(rows))
    assert len({c for i, _, c, _ in got if 1001 <= i < 1150}) == 1
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_small_parts_and_no_leaders(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    rows = []
    for i in range(80):  # many pairs on either side of the limit
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(1, 5)):
            w[p] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = m.read_sets(df, "doc_id", "text", 4, 120, 2)  # short keys: all candidates
    classes = sets.groupBy("cls").agg(m.F.min("id").alias("id"), m.F.any_value("n").alias("n"), m.F.any_value("bands").alias("bands"))
    want = {d: c for d, _, c, _ in brute(rows)}
    for rounds, leaders, items in ((0, 1, 150), (1, 1, 400), (2, 4, 500_000)):
        comp = m.link(classes, lambda w: m._sets_of(df, "doc_id", "text", 4, w), 80, rounds, leaders, items)
        got = classes.join(comp, "cls").select("id", "comp").collect()
        low = {}
        for r in got:
            low[bytes(r.comp)] = min(low.get(bytes(r.comp), r.id), r.id)
        assert {r.id: low[bytes(r.comp)] for r in got} == want
    assert len(set(want.values())) > 3


def test_estimate(spark):
    rng = np.random.default_rng(5)
    for same, n in ((800, 1000), (40, 50), (9, 10)):
        found = []
        for _ in range(60):
            x = rng.integers(0, 2**63, n + n - same).astype(np.uint64)
            a, b = m.super_minhash(x[:n], 240), m.super_minhash(x[n - same :], 240)
            found.append((a == b).mean())
        true = same / (2 * n - same)
        assert np.mean(found) == pytest.approx(true, abs=0.02)
        assert np.std(found) < 1.1 * np.sqrt(true * (1 - true) / 240)  # no worse than independent hashes


def test_null_ids(spark):
    t = "alpha beta gamma delta epsilon"
    df = spark.createDataFrame([(None, t), (5, t), (None, "only here with five words")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(df).collect()}
    assert got == {(None, 2, 5, False), (5, 2, 5, True), (None, 2, None, True)}


def test_null_ids_link_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*base[:-k], *[f"v{i}" for i in range(k)]]) if k else " ".join(base)
    left, right = near(10), " ".join([f"u{i}" for i in range(10)] + base[10:])  # alike to the base, not to each other
    lone = [f"z{i}" for i in range(60)]
    rows = [(4, left), (None, near(0)), (9, right), (None, " ".join(lone)), (None, " ".join([*lone[:-2], "y", "x"]))]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("9", "4", False), ("None", "4", False), ("None", "None", True), ("None", "None", True)]


def test_sets_of_one_id_are_fetched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):  # one id has thirty texts, each with a near copy under it
        w = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        rows += [(1, " ".join(w)), (1, " ".join([*w[:-1], f"v{i}"]))]
    rows += rows[:1] * 20
    tables, write = {}, m.table
    monkeypatch.setattr(m, "table", lambda df, name: tables.setdefault(name, write(df, name)) if name == "items" else write(df, name))
    asked, fetch = [], m._sets_of

    def counted(df, id_col, text_col, width, wanted):
        texts = df.select(m.col(id_col).alias("id"))
        asked.append((texts.join(wanted, "id").count(), wanted.count()))
        return fetch(df, id_col, text_col, width, wanted)

    monkeypatch.setattr(m, "_sets_of", counted)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(rows) and all(r.kept and r.component_id == 1 for r in got)
    assert asked == [(80, 60)] and tables["items"].count() == 60
