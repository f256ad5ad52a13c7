import math

from tallyvane.llm import divergence
from tests.llm.test_oracle_llm import against_sql


def plain(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_and_odd_rows(spark):
    texts = [None, "", " \n\t", "a " * 30, "x\ny\nx\n\nx \n", "a b c d e f a b c d e", "é# $%&|<>* ü", "one two three four five six seven eight nine ten eleven", "w%d " % 1 + " ".join(f"w{i % 4000}" for i in range(60_000))]
    rows = [(i, t, "en" if i % 2 else None, "z") for i, t in enumerate(texts)] + [(3, texts[3], "en", "z"), (None, "b c", "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, classes string")
    got = divergence.judge(df).collect()
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        for r in (r for r in got if r.doc_id == i):
            n = plain(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert divergence.judge(df.limit(0)).count() == 0


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    lit = lambda v: F.array(*map(F.lit, v))
    got = spark.range(1).select(divergence.js_distance(lit(p), lit(q)), divergence.js_distance(lit(p), lit(p)), divergence.js_distance(lit([1.0, 0.0]), lit([0.0, 1.0]))).first()
    assert abs(got[0] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and got[1] == 0 and got[2] == 1


def test_junk_goes_and_clean_stays(spark):
    got = against_sql(spark, "op2_divergence")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {q: [r.kept for r in got if labels.get(r.doc_id) == q and not r.base_failed] for q in (0, 1)}
    assert sum(kept[0]) / len(kept[0]) < 0.1 and sum(kept[1]) / len(kept[1]) > 0.99


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = divergence.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
