"""Personal data: fixed rules give seeds; contexts learned from the seeds find further identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import col, table

KINDS = ("email", "ip", "card", "phone")
UNKNOWN = -1

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
TELLING = re.compile(r"[0-9@]")
NUMERIC = re.compile(r"[+(]?[0-9][0-9().+-]*\Z")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in code points; time linear in the text.

    The forms equal the plain patterns. An address is found from its ``@``: no local part can hold
    one, so the leftmost match is the longest run before it that starts after the last match. A
    dotted number never starts within digits, since it could start before them as well.
    """
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            m = AT_DOMAIN.match(text, at) if s < at else None
            if m:
                done = m.end()
                out.append((0, s, done))
            at = text.find("@", max(at + 1, done))
    if ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a mention: the word before, the two before, the words on both sides.

    Words are lower-cased; of a word that reaches further than 160 characters, its near end counts.
    """
    before = text[max(0, start - 160) : start].lower().split()
    after = text[end : end + 160].lower().split()
    one = before[-1] if before else "^"
    return [f"1 {one}", f"2 {' '.join(before[-2:]) or '^'}", f"3 {one} _ {after[0] if after else '$'}"]


def plausible(value: str) -> int:
    """Bit mask of the kinds whose outer form a discovered value may have."""
    digits = len(NOT_DIGIT.sub("", value))
    return (
        ("@" in value.strip("@")) * 1
        | (value.count(".") + value.count(":") >= 3 and digits >= 4) * 2
        | (12 <= digits <= 19 and digits >= 0.7 * len(value)) * 4
        | (7 <= digits <= 15 and digits >= 0.5 * len(value)) * 8
    )


def unknown_mentions(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans with a digit or an ``@`` that no rule took; numbers in a row count as one."""
    if not TELLING.search(text):
        return []
    taken = sorted((s, e) for _, s, e in known)
    out: list[tuple[int, int]] = []
    k, numeric = 0, False
    for m in TOKEN.finditer(text):
        if not TELLING.search(m.group()):
            numeric = False
            continue
        s, e = m.span()
        while s < e and text[s] in "\"'([<{,;:":
            s += 1
        while e > s and text[e - 1] in "\"')]>},;:.!?":
            e -= 1
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= e or k < len(taken) and taken[k][0] < e:
            numeric = False
            continue
        plain = bool(NUMERIC.match(text, s, e))
        if numeric and plain and text[out[-1][1] : s] == " ":
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
        numeric = plain
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


SPAN = "struct<kind:int,start:int,end:int>"
MENTION = "struct<kind:int,start:int,end:int,value:bigint,forms:int,patterns:array<string>>"


def read_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and all mentions of each row, written once; values are kept as hashes only."""
    kind = dict(df.dtypes)[id_col]
    n = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, text_key string, {n}, base_sha256 string, base array<{SPAN}>, mentions array<{MENTION}>"
    arrow = lambda fields: pa.list_(pa.struct([(a, {"int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}[b]) for a, b in fields]))
    span_type = arrow([("kind", "int"), ("start", "int"), ("end", "int")])
    mention_type = arrow([("kind", "int"), ("start", "int"), ("end", "int"), ("value", "bigint"), ("forms", "int"), ("patterns", "array<string>")])

    def mention(text: str, k: int, s: int, e: int) -> dict:
        value = text[s:e]
        key = xxhash.xxh3_64_intdigest(value.lower()) - (1 << 63)
        return {"kind": k, "start": s, "end": e, "value": key, "forms": plausible(value), "patterns": contexts(text, s, e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, base, mentions = [[] for _ in KINDS], [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                for i, c in enumerate(counts):
                    c.append(sum(k == i for k, _, _ in spans))
                digests.append(_digest(spans))
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                own = [mention(text, k, s, e) for k, s, e in spans]
                mentions.append(own + [mention(text, UNKNOWN, s, e) for s, e in unknown_mentions(text, spans)])
            cols = [b.column("doc_id"), b.column("text_key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(base, span_type), pa.array(mentions, mention_type)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mentions"])

    text = col(text_col).cast("string")
    rows = df.select(col(id_col).alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    return table(rows.mapInArrow(run, schema), "mentions")


def score_patterns(mentions: DataFrame, rounds: int = 2, min_support: int = 5, passing: float = 0.5) -> DataFrame:
    """Confidence of each pattern for each kind: (pattern, c0 .. c3).

    Patterns and the values they surround form a graph. A seed value is certain. A pattern's
    confidence in a kind is the sum over its different values of their score for that kind,
    divided by their number plus one; below ``min_support`` of that sum it is zero. The score of a
    value no rule knows is one minus the product of (1 - confidence) over its patterns that reach
    ``passing``. Both are computed in turn ``rounds`` times, as joins and map-side combined sums
    over distinct edges, so copies of a text or a hot value do not add up.
    """
    ks = range(len(KINDS))
    edges = table(
        mentions.select(F.inline("mentions")).select("value", "kind", "forms", F.explode("patterns").alias("pattern")).distinct(), "edges"
    )
    sums = [F.sum((F.col("kind") == k).cast("double")).alias(f"s{k}") for k in ks]
    seeds = table(edges.groupBy("pattern").agg(F.count("*").alias("n"), *sums), "patterns")
    conf = lambda have: [F.when(have(k) >= min_support, F.least(F.lit(0.999), have(k) / (F.col("n") + 1))).otherwise(0.0).alias(f"c{k}") for k in ks]
    scores = table(seeds.select("pattern", *conf(lambda k: F.col(f"s{k}"))).filter(F.greatest(*[f"c{k}" for k in ks]) > 0), "scores")
    unknown = edges.filter(F.col("kind") == UNKNOWN).select("value", "forms", "pattern")
    for _ in range(rounds - 1):
        may = lambda k: F.when((F.col("forms").bitwiseAND(F.lit(1 << k)) > 0) & (F.col(f"c{k}") >= passing), F.log(1 - F.col(f"c{k}"))).otherwise(0.0)
        values = table(unknown.join(scores, "pattern").groupBy("value").agg(*[(1 - F.exp(F.sum(may(k)))).alias(f"i{k}") for k in ks]), "values")
        gained = table(unknown.join(values, "value").groupBy("pattern").agg(*[F.sum(f"i{k}").alias(f"g{k}") for k in ks]), "gained")
        both = seeds.join(gained, "pattern", "left")
        scores = table(
            both.select("pattern", *conf(lambda k: F.col(f"s{k}") + F.coalesce(f"g{k}", F.lit(0.0)))).filter(F.greatest(*[f"c{k}" for k in ks]) > 0), "scores"
        )
    return scores


def discovered(mentions: DataFrame, scores: DataFrame, accept: float = 0.8) -> DataFrame:
    """Spans that confident patterns find, per different text: (text_key, found).

    A mention takes the kind of the most confident pattern around it, at ``accept`` or more,
    among the kinds whose outer form it has; ties go to the kind listed first.
    """
    ks = range(len(KINDS))
    open_ones = (
        mentions.select("text_key", F.inline("mentions")).filter(F.col("kind") == UNKNOWN)
        .select("text_key", "start", "end", "forms", F.explode("patterns").alias("pattern")).distinct()
    )
    strong = scores.filter(F.greatest(*[f"c{k}" for k in ks]) >= accept)
    option = lambda k: F.when((F.col(f"c{k}") >= accept) & (F.col("forms").bitwiseAND(F.lit(1 << k)) > 0), F.struct(F.col(f"c{k}").alias("c"), F.lit(-k).alias("k")))
    best = (
        open_ones.join(strong, "pattern").select("text_key", "start", "end", F.greatest(*[option(k) for k in ks], F.lit(None)).alias("o")).filter("o is not null")
        .groupBy("text_key", "start", "end").agg(F.max("o").alias("o"))
    )
    span = F.struct((-F.col("o.k")).cast("int").alias("kind"), "start", "end")
    return table(best.groupBy("text_key").agg(F.array_sort(F.collect_list(span)).alias("found")), "found")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.8, rounds: int = 2, min_support: int = 5) -> DataFrame:
    """Operator 6. Per row: doc_id, counts and digest of the rule spans, all spans.

    Seeds are what fixed rules find in the whole text. Their contexts become patterns, the graph
    of patterns and values is scored by ``score_patterns``, and mentions that no rule took but a
    confident pattern surrounds are added; rule spans always stay. The counts are of rule spans.

    Defined cases: a null text counts as empty; empty texts have no span; equal texts have equal
    spans, and count once as evidence; a null or repeated doc_id changes nothing; columns other
    than the two named are not read; an empty table gives an empty result.
    """
    rows = read_mentions(df, id_col, text_col)
    found = discovered(rows, score_patterns(rows, rounds, min_support), accept)
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.join(found, "text_key", "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"))


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``df`` with each span of the text replaced by ``<KIND>``.

    Overlapping spans are replaced as one, by the kind listed first. Null texts stay null.
    """
    rows = read_mentions(df, id_col, text_col)
    accept = options.pop("accept", 0.8)
    found = discovered(rows, score_patterns(rows, **options), accept)
    at = df.columns.index(text_col)
    keyed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    wide = keyed.join(found, "text_key", "left").select("row.*", F.col("found").alias("_found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, more in zip(b.column(at), b.column(len(b.columns) - 1), strict=True):
                text = value.as_py()
                spans = base_spans(text or "") + [(s["kind"], s["start"], s["end"]) for s in more.as_py() or []]
                parts, done = [], 0
                for s, e, k in merged(spans):
                    parts += [text[done:s], f"<{KINDS[k].upper()}>"]
                    done = e
                out.append(text if not spans else "".join([*parts, text[done:]]))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return wide.mapInArrow(run, T.StructType(df.schema.fields))


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, kind) that cover the same places."""
    out: list[tuple[int, int, int]] = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if out and s < out[-1][1]:
            a, b, first = out[-1]
            out[-1] = (a, max(b, e), min(first, k))
        else:
            out.append((s, e, k))
    return out
