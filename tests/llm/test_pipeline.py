"""Each stage of the pipeline against a plain version, on its own input."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyvane.llm import pii, quality_fm
from tallyvane.llm.encoders import json_tokenizer
from tests.llm.test_phrases import brute as cut_brute
from tests.llm.test_pii import plain_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs.collect())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns or name == "packing"
        out.append(docs.collect())
    return out


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "personal_data", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_quality(spark, stages):
    model = quality_fm.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {d.doc_id for d in stages[0] if model.score(*quality_fm.features(d.text.encode(), d.n_chars, len(model.linear))) >= 0.7}
    assert {d.doc_id for d in stages[1]} == good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in stages[0] if d.doc_id in labels and zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert np.mean([(d.doc_id in good) == labels[d.doc_id] for d in held]) > 0.97


def test_near_duplicates(stages):
    docs = sorted(stages[1], key=lambda d: d.doc_id)
    where, root, sets = {}, {}, {}
    for d in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in d.text))
        s = sets[d.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[d.doc_id] = d.doc_id
        near = {}
        for x in s:
            for j in where.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            where[x].append(d.doc_id)
        for j, n in near.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root[d.doc_id], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {d.doc_id for d in stages[2]} == set(root.values()) and len(stages[2]) < len(stages[1])


def test_passages(stages):
    want = {d: h for d, _, r, h in cut_brute([(d.doc_id, d.text) for d in stages[2]]) if r}
    before = {d.doc_id: d.text for d in stages[2]}
    assert len(stages[3]) == len(before) and want
    for d in stages[3]:
        assert hashlib.sha256(d.text.encode()).hexdigest() == want[d.doc_id] if d.doc_id in want else d.text == before[d.doc_id]
        assert d.n_chars == len(d.text)


def test_personal_data(stages):
    before = {d.doc_id: d.text for d in stages[3]}
    assert len(stages[4]) == len(before)
    for d in stages[4]:
        text = before[d.doc_id]
        for s, e, k in reversed(pii.merged(plain_spans(text))):
            text = f"{text[:s]}<{pii.KINDS[k].upper()}>{text[e:]}"
        assert d.text == text  # no context of these tables is telling enough to add a span
        assert not plain_spans(d.text)


def test_packing(stages):
    t = json_tokenizer(P.path("byte_bpe_50k.json"))
    rows = {}
    for r in stages[5]:
        rows.setdefault(r.doc_id, []).append(r)
    for d in stages[4]:
        ids, at = [*t.encode(d.text, add_special_tokens=False).ids, 1], 0
        for r in sorted(rows[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids) == rows[d.doc_id][0].doc_tokens
    assert set(rows) == {d.doc_id for d in stages[4]}


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "x " * 400), (3, "x " * 400), (3, "other words"), (None, None), (4, "x " * 400)]
    df = spark.createDataFrame([(d, t, None, None, None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    for _, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            got = stage(spark, docs, SF)
            assert "sequence_id" in got.columns or got.columns == df.columns
            n = got.count()
            assert (n == 0) == docs.isEmpty() or stage is corpus_pipeline.quality
    kept = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "3", "3", "None", "None"]


def test_a_repeated_clean_text_stays_once(spark):
    text = " ".join(f"clean{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(7, text, "en"), (7, text, "de"), (7, text, "en"), (None, other, "en"), (None, other, "en"), (8, "short", "en"), (8, None, "en"), (8, "", "en")]
    docs = spark.createDataFrame([(d, t, x, None, None) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.passages):
        docs = stage(spark, docs, SF)
    got = docs.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("7", text), ("None", other), ("8", "short"), ("8", "None"), ("8", "")])
    assert corpus_pipeline.one_row_each(spark.createDataFrame(got, docs.schema)).count() == 5
