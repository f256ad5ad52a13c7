import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyvane.llm import packing
from tallyvane.llm.encoders import json_tokenizer, read_added

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "   ", "a", "Hello world  two spaces\n\n next", "tail ", " lead", "x  y", "it's <|endoftext|> 12 ½ ² été", "\n \n", "word " * 9000,
    "été " * 40 + "\t tab", "a   b    c", "日本語 テスト", "same", "same",
]


def frame(spark, texts):
    rows = [(i, t, "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)


def test_pieces_cover_each_document_and_match_tokenizers(spark):
    got = packing.pack(frame(spark, TEXTS), RANKS, P.PATTERN, group_size=5, length=64, with_ids=True).collect()
    t = json_tokenizer(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        rows = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in rows) == np.asarray(ids, dtype="<u4").tobytes(), text
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
        assert [r.start for r in rows] == list(np.cumsum([0] + [r.length for r in rows])[:-1])
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_added_tokens_are_read_as_the_plain_tokenizer_reads_them(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >  <|endoftext|>\n\n word"]
    got = packing.pack(frame(spark, texts), RANKS, P.PATTERN, with_ids=True, added=read_added(path)).collect()
    assert read_added(path) == {"<|endoftext|>": 50256}
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        mine = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
        assert mine == np.asarray(ids, dtype="<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(5))
def test_tree_equals_plain_first_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 300).tolist()
    rooms, want = [100] * 300, []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next(j for j, r in enumerate(rooms) if r >= sizes[i])
        want.append((i, b, 100 - rooms[b]))
        rooms[b] -= sizes[i]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert sorted(want) == [(i, bins[i], offsets[i]) for i in range(300)]


def test_little_padding(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(pmod(xxhash64(id), 900) as int))").alias("text"))
    got = packing.pack(docs, RANKS, P.PATTERN)
    used, n = got.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used / (2048 * n) > 0.97


def test_empty_table(spark):
    assert packing.pack(frame(spark, TEXTS).limit(0), RANKS, P.PATTERN).count() == 0
