import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from tallyvane.llm import bpe
from tallyvane.llm.encoders import read_ranks
from tallyvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def check(got, texts):
    for r in got:
        text = texts[r.doc_id] or ""
        ids = OWN.encode_ordinary(text)
        assert r.n_tokens == len(ids), text[:80]
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_tiktoken(spark):
    rows = QUERIES["op7_byte_bpe"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_texts(spark):
    texts = [
        None, "", " ", "a", "aaaaaaaaaaaaaaaaaaa", "  two  spaces \n\n\n end  ", "it's we'll I'D", "1234567 ½² Ⅷ", "日本語テスト 한국어 العربية", "🙂👩‍👩‍👧 x", " nbsp em　wide \x85 \x1c\x1d", "é́ combining",
        "<|endoftext|>", "x" * 3000, "qz" * 500 + " " + "ünï" * 200, "tab\tand\r\nlines\x0b\x0c", "abc_def __ -- ==> ''", "z w " * 3,
    ]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, pieces string")
    for frequent in (1, 1000):
        got = bpe.round_trip(df, PATH, P.PATTERN, frequent=frequent).collect()
        assert len(got) == len(rows) + 2
        check(got, texts)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    assert bpe.round_trip(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), PATH, P.PATTERN).first().n_tokens == 2


def test_refuses_ranks_that_are_no_merges():
    import pytest

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 299}
    assert bpe._parts(b"ab", ranks) == (b"a", b"b")
    with pytest.raises(ValueError):
        bpe._parts(b"abc", ranks)


def test_decoding_follows_the_ids(spark):
    """Other ids give other bytes, and what is no id gives nothing."""
    from pyspark.sql import functions as F

    vocabulary = bpe.Vocabulary(spark, PATH)
    ids = OWN.encode_ordinary("Hello wörld 🙂")
    rows = spark.createDataFrame([(ids,), (ids[::-1],), ([],), ([10**6],)], "ids array<int>")
    got = bpe.with_scalars(rows, _b=vocabulary.bytes).select("ids", bpe.let(F.col("_b"), lambda b: bpe.decode(F.col("ids"), b)).alias("hex")).collect()
    assert [r.hex for r in got] == [OWN.decode_bytes(ids).hex(), OWN.decode_bytes(ids[::-1]).hex(), "", None]


def test_windows_hold_every_token_of_a_piece(spark):
    """All tokens of two bytes or more are found with one look for each window, whether a window is a usual one or not."""
    from pyspark.sql import functions as F

    ranks = read_ranks(PATH)
    vocabulary = bpe.Vocabulary(spark, PATH)
    texts = [" dieeineinchge", " orbleerblehaor", "日本語テスト", "ab", "international"]
    raws = [t.encode().decode("latin-1") for t in texts]
    cut = [raw[i : i + bpe.WIDE] for raw in raws for i in range(0, len(raw) - 1, bpe.STEP)]
    rows = bpe.with_scalars(spark.createDataFrame([(w,) for w in set(cut)], "w string"), _m=vocabulary.maps).select("w", bpe.let(F.col("_m"), lambda m: bpe.inside(F.col("w"), m)).alias("e")).collect()
    found = {r.w: r.e for r in rows}
    looks = substrings = 0
    for raw in raws:
        n, got = len(raw), set()
        for i in range(0, n - 1, bpe.STEP):
            entry = found[raw[i : i + bpe.WIDE]]
            longer = [raw[i + x.o : i + x.o + x.k].encode("latin-1") for x in entry.longer or ()]
            got |= set(entry.ranks) | {ranks[t] for t in longer if t in ranks}
            looks += 1 + len(longer)
        inside = [raw[i:j].encode("latin-1") for i in range(n) for j in range(i + 2, n + 1)]
        assert got == {ranks[t] for t in inside if t in ranks}
        substrings += len(inside)
    assert looks * 3 < substrings  # each substring was looked up before
    none = bpe._literal(spark.createDataFrame([], "w string, e struct<ranks:array<int>,longer:array<struct<o:int,k:int>>>"), "w", F.col("e"), bpe.BUCKETS)
    pieces = bpe.with_scalars(spark.createDataFrame([(t,) for t in texts], "piece string"), _m=vocabulary.maps, _s=vocabulary.steps, _b=vocabulary.bytes, _w=none)
    let = bpe.let
    merged = let(F.col("_m"), lambda m: let(F.col("_s"), lambda s: let(F.col("_b"), lambda b: let(F.col("_w"), lambda w: bpe.merge(F.col("piece"), m, s, b, w)))))
    for r in pieces.select("piece", merged.alias("word")).collect():
        ids = OWN.encode_ordinary(r.piece)
        assert r.word.ids == np.asarray(ids, dtype="<u4").tobytes().hex() and r.word.bytes == r.piece.encode().hex()
