import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvane.llm import pii
from tallyvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    """The contract word by word: leftmost matches of the plain patterns, failing ones dropped."""
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = [
                True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0, 9 <= len(d) <= 15,
            ][k]
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.0@+ -9(5é)\n4", max_size=60))
def test_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_known_cases():
    text = "x a.b@c.de 1.2.3.4.5.6.7.8 999.1.1.1 x 4111 1111 1111 1111, +1 (456) 555-2186 a@b.c@d.e @x.y"
    assert pii.base_spans(text) == plain_spans(text) and {k for k, _, _ in pii.base_spans(text)} == {0, 1, 2, 3}


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op6_pii_bootstrap"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain_spans(d.text or ""), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_confident_context_finds_unseen_identifiers(spark):
    texts = [f"Call phone: +1 (20{i}) 555-010{i} today" for i in range(10)] + ["Call phone: 0800-555-77{:02d} now".format(i) for i in range(2)]
    texts += [f"the year {1990 + i} was fine and the {i} of" for i in range(10)] + ["see 0800-555-9999 there"] + [None, "", texts[0], texts[10], "@", "1" * 100_000]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, found string, kind int")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert got[10] == "phone:12:25" and got[11] == "phone:12:25" and got[26] == "phone:12:25"
    assert got[22] == "" and all(got[i] == "" for i in range(12, 22)) and got[23] == got[24] == ""
    masked = {r.doc_id: r for r in pii.masked(df).collect()}
    assert masked[10].text == "Call phone: <PHONE> now" and masked[0].text == "Call phone: <PHONE> today" and masked[0].found == "c"
    assert masked[23].text is None and masked[24].text == "" and masked[22].text == texts[22] and len(masked) == len(rows)
    assert pii.find(df.limit(0)).count() == 0


def test_overlaps_are_replaced_once():
    assert pii.merged([(3, 0, 5), (2, 3, 9), (0, 12, 14)]) == [(0, 9, 2), (12, 14, 0)]
