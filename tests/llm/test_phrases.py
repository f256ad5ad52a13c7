import hashlib
import re

import numpy as np
import xxhash

from tallyvane.llm import phrases as p
from tallyvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, window=35):
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = {}
    for w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op9_phrase_automata"](spark, SF).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute(rows)
    assert sum(0 < r[2] < r[1] for r in got) > 5


def odd_rows():
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, long = words(60), words(300)
    rows = [(i, " ".join(words(20) + passage[: 36 + i] + words(15))) for i in range(20)]  # ends differ
    rows += [(100 + i, " ".join(long[i : i + 120])) for i in range(0, 100, 7)]  # overlapping cuts
    rows += [(200, "x " * 3000), (201, "a b " * 400), (202, " ".join(words(10) * 8)), (203, " ".join(passage[:34])), (204, " ".join(passage[:35]) + "\n\n")]
    rows += [(300, None), (301, ""), (302, "\t"), (303, "é " * 34), (304, rows[0][1]), (304, rows[0][1]), (None, " ".join(words(50))), (None, rows[1][1].replace(" ", "\n"))]
    return rows


def test_ends_overlaps_and_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, cid int, tkey string").repartition(4)
    for shard, group in ((50_000, 8 << 20), (3, 500)):
        got = sorted((tuple(r) for r in p.repeated_passages(df, per_shard=shard, per_group=group).collect()), key=str)
        assert got == brute(rows)
    assert p.repeated_passages(df.limit(0)).count() == 0


def test_texts_left(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, cid int, tkey string")
    want = {(d, r, h) for d, n, r, h in brute(rows) if r}
    got = p.without_passages(df)
    assert got.columns == df.columns and got.count() == len(rows)
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()} >= {(d, h) for d, _, h in want}
    untouched = {d: t for (d, t) in rows if d in (203, 300, 301, 302, 303)}
    assert all(r.text == untouched[r.doc_id] for r in got.collect() if r.doc_id in untouched)


def test_phrases_that_share_their_letters(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    by_letters = {}
    for i in range(4000):
        by_letters.setdefault(xxhash.xxh3_64_intdigest(f"q{i}".encode()) & 0xFFFF, []).append(f"q{i}")
    twins = [v[:2] for v in by_letters.values() if len(v) > 1][:40]
    rows = []
    for pair in twins:
        base = words(60)  # the two passages of a pair differ in words of equal letters only
        for one in pair:
            passage = [one if i % 8 == 4 else w for i, w in enumerate(base)]
            rows += [(len(rows) + c, " ".join(words(5) + passage + words(7))) for c in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in p.repeated_passages(df).collect()), key=str) == brute(rows)
    search = p.compiled([1, 2, 3], [b"ab" * 8, b"ab" * 8, b"cd" * 8])
    assert sorted(x for _, found in search.iter("ab" * 8 + "cd" * 8) for x in found) == [1, 2, 3]
