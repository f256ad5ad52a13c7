import gzip
import hashlib

from tallyvane.llm import warc
from tallyvane.llm.queries import QUERIES
from pyspark.sql import functions as F

BIG = "<p>é" + "x" * 200
PAGES = [
    (5, "http://a.example.com/1", BIG), (3, "http://b.example.com/1?x#y", BIG), (9, "https://a.example.com:80/", BIG), (7, None, None), (8, "http://a.example.com/1", ""), (10, "x y", "short"), (11, "http://c/", "short"),
    (12, "http://a.example.com/1", "z" * 300_000), (3, "http://b.example.com/1?x#y", BIG), (None, "http://a.example.com/1", BIG), (13, "http://q/\r\nX: y", "a\r\n\r\nb" * 50), (None, "", "only null " * 20),
]


def want(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [p for p, _, g in rows if (g or "").encode() == data and p is not None]
        first = min(same, default=None)
        again = len(data) >= 100 and first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_and_odd_rows(spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in PAGES], "page_id long, url string, html string, surt string, offset int").repartition(3)
    for block in (1, 3, 256):
        got = sorted((tuple(r) for r in warc.round_trip(df, per_block=block).collect()), key=str)
        assert got == want(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    captures, files, folder = warc.archive(df, per_block=2)
    read = warc.read_records(captures, f"{folder}/archive", with_payload=True).collect()
    assert sorted(bytes(r.payload).decode() for r in read if r.payload is not None) == sorted(
        (h or "") for (i, _, h), w in zip(PAGES, [next(x for x in want(PAGES) if x[0] == p[0] and x[2] == hashlib.sha256((p[2] or "").encode()).hexdigest()) for p in PAGES]) if w[3] == "response"
    )
    one = captures.filter("page_id = 12").first()
    store, base = warc.open_store(folder + "/archive")
    raw = store.open_input_file(f"{base}/{one.file}").read_at(one.length, one.offset)
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_lookup_of_single_and_missing_keys(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{i}", f"page {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures, files, folder = warc.archive(df, per_block=16)
    ask = spark.createDataFrame([("http://h3.example.org/10", 10), ("http://h3.example.org/10", 11), ("zzz", 1), ("", None)], "url string, page_id long")
    places = warc.lookup(ask.select(warc.surt(F.col("url")).alias("surt"), "page_id"), files, f"{folder}/index")
    assert [r.page_id for r in warc.read_records(places, f"{folder}/archive").collect()] == [10]
    assert captures.filter("page_id = 10").first().surt == "org,example,h3)/10"


def test_query(spark):
    got = QUERIES["op3_warc_capture_index"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == 250
