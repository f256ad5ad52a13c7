import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyvane.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    total = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    v = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in v.items():
        close = [x for x in v if near(w, x)]
        best = min(close, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 2 * n else None
        out[w] = (n, len(close))
    rows = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, *out[w], form[w], v[form[w]] if form[w] else None, root))
    return sorted(rows)


def corpus(seed, letters, n_words):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(n_words)]
    weights = [1 / (k + 1) for k in range(n_words)]
    return [(i, " ".join(rng.choices(words, weights, k=400))) for i in range(60)]


def check(spark, docs, **kw):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = sorted(tuple(r) for r in spelling.variants(df, **kw).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == plain(docs)
    return got


@pytest.mark.parametrize("shard_words", [32_768, 7])
def test_equals_brute_force(spark, shard_words):
    """A small shard makes crowded buckets, which are cut in blocks."""
    got = check(spark, corpus(1, "abÀÿ", 1200), shard_words=shard_words)
    assert any(r[3] for r in got) and any(r[5] != (r[3] or r[0]) for r in got)


def test_odd_texts(spark):
    long_word = "pq" * 6000
    docs = [(1, None), (2, ""), (None, "Étage étage ÉTAGE naïve naives naive " * 3), (None, "tabletop " * 2), (4, f"{long_word} {long_word}x {long_word} " * 3), (4, "Tables TABLES tables table_s tables' " * 4),
            (5, "aaaaa aaaaaa aaaaaaa " * 5 + "aaaa " * 9), (5, "aaaaa aaaaaa aaaaaaa " * 5 + "aaaa " * 9), (6, "×÷×÷× ×÷×÷× ×÷×÷× 日本語 a1b2c")]
    check(spark, docs)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_forms(spark):
    docs = [(0, "abcde " * 3 + "abcdf " * 6 + "abcgf " * 12 + "abhgf " * 30)]
    got = {r[0]: r for r in check(spark, docs)}
    assert got["abcde"][5] == "abhgf"


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_index_finds_each_pair_once(letters):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(300)})
    index = spelling.Index(sorted(w[::-1] for w in words))
    back = sorted(words, key=lambda w: w[::-1])
    kept = np.array([len(w) // 2 for w in words])
    for op in (-1, 0, 1):
        q, x = index.near(words, kept, op)
        got = sorted((words[i], back[j]) for i, j in zip(q, x))
        assert got == sorted((a, b) for a in words for b in words if near(a, b) and len(b) - len(a) == op and b.startswith(a[: len(a) // 2]))
