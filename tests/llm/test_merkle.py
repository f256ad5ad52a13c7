import hashlib
import zlib

from tallyvane.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, payload string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc, source, lang, n, _ = row
    return H(f(doc), f(source), f(lang), f(n), f(text))


def tree(nodes):
    """Levels up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if cut else r[4])
            path = way(trees[s], i) + way(top, k)
            proof = H(*[x for pair in path for x in pair])
            for a, b in path:
                node = H(a, node, b)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.verify(merkle.manifest(df)).collect()), key=str)
    assert got == plain(rows)
    return got


def test_odd_rows(spark):
    rows = [
        (3, None, "en", 3, "a\nb"), (1, None, None, None, None), (None, "s", "fr", 1, "x\ny"), (7, "é", "de", 0, ""), (7, "é", "de", 0, ""), (7, "é", "de", 0, "é\n"),
        (8, "z", "en", 10, "a" * 40_000 + "\n"), (4, "b", "", 2, "4:ab\n\n"), (-5, "b", "", 2, "m\n"),
    ]
    got = check(spark, rows)
    assert {True, False} == {r[-1] for r in got}


def test_sizes_around_runs_and_blocks(spark):
    rows = [(i, f"s{n:04d}", "en", i, f"text {i}\n" * (i % 3)) for n in (1, 2, 3, 4, 9, 10, 28, 729, 730, 1500) for i in range(n)]
    check(spark, rows)


def test_many_sources(spark):
    check(spark, [(i, f"source {i}", None, 1, "t\n") for i in range(800)])


def test_one_row_and_none(spark):
    (row,) = check(spark, [(2, "a", "en", 1, "q")])
    assert row[1] == row[2] == row[3] == row[5]
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(merkle.manifest(empty)).count() == 0
