"""Byte-level BPE with Spark's higher-order functions: ranked merges folded over byte arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import col, table
from tallyvane.llm.encoders import read_ranks

#: Powers of two well above the number of keys, so that few share a bucket.
BUCKETS = 1 << 18
#: Bytes of a window of a piece, and how far the next one lies; tokens of up to SHORT bytes that begin before it are inside.
WIDE, STEP, SHORT = 5, 2, 4
#: Windows whose tokens are kept; those of others are looked up where they stand.
WINDOWS = 100_000
NONE = 2**31 - 1
#: Around each token while merging; no byte has these numbers.
OPEN, CLOSE = "\u0100", "\u0101"


def let(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _literal(df: DataFrame, key: str, value: Column, buckets: int) -> Column:
    """A map as one scalar: an array of small maps, found by the hash of the key.

    Spark searches a map key by key; cut into far more buckets than keys it is found at once.
    """
    maps = df.groupBy(F.hash(key).bitwiseAND(buckets - 1).alias("b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))).alias("m"))
    filled = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    in_order = F.sort_array(F.collect_list(F.struct("b", "m")))
    return table(filled.agg(F.transform(in_order, lambda x: F.map_from_entries(x["m"])).alias("all")), "literal").scalar()


def _find(maps: Column, key: Column, buckets: int = BUCKETS) -> Column:
    """Value of ``key`` in such a map, or null."""
    return F.try_element_at(F.get(maps, F.hash(key).bitwiseAND(buckets - 1)), key)


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``; None for one byte."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        low, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if low >= top:
            raise ValueError(f"token {token!r} is not made by merges of lower rank")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Vocabulary:
    """Ranks of a file as three scalars: by a token its rank and the lengths of longer tokens that begin so; by id the merge, and the bytes.

    Bytes are characters of the same number here, so that Spark's string functions work on them.
    Its size is that of the file, whatever the input.
    """

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        text = lambda x: x.decode("latin-1")
        longer: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > SHORT:
                longer.setdefault(token[:SHORT], set()).add(len(token))
        rows = []
        for token, r in ranks.items():
            both = _parts(token, ranks)
            merge = (OPEN + text(both[0]) + CLOSE + OPEN + text(both[1]) + CLOSE, OPEN + text(token) + CLOSE) if both else (None, None)
            rows.append((text(token), r, sorted(longer.pop(token, ())) or None, *merge, r.to_bytes(4, "little").hex(), token.hex()))
        # beginnings of longer tokens that are no tokens themselves
        rows += [(text(token), None, sorted(lengths), None, None, None, None) for token, lengths in longer.items()]
        tokens = table(spark.createDataFrame(rows, "token string, rank int, longer array<int>, pair string, joined string, id_hex string, token_hex string"), "vocabulary")
        self.maps = _literal(tokens, "token", F.struct("rank", "longer"), BUCKETS)
        # an id is its place here; ids that the file does not use are null
        known = tokens.filter(F.col("rank").isNotNull()).select("rank", F.struct("pair", "joined", "id_hex").alias("step"), "token_hex")
        ids = spark.range(max(ranks.values(), default=0) + 1).select(F.col("id").cast("int").alias("rank")).join(known, "rank", "left")
        in_order = F.sort_array(F.collect_list(F.struct("rank", "step", "token_hex")))
        both = table(ids.agg(F.transform(in_order, lambda x: x["step"]).alias("steps"), F.transform(in_order, lambda x: x["token_hex"]).alias("bytes")), "by_id")
        self.steps, self.bytes = both.select("steps").scalar(), both.select("bytes").scalar()


def decode(ids: Column, bytes_by_id: Column) -> Column:
    """Bytes that an array of ids stands for, in hex; null if one of them is no id."""
    pieces = F.transform(ids, lambda i: F.get(bytes_by_id, i))
    return let(pieces, lambda found: F.when(F.forall(found, lambda p: p.isNotNull()), F.array_join(found, "")))


def windows(raw: Column) -> Column:
    """Where the windows of a string of two bytes or more begin, from 1."""
    return F.sequence(F.lit(1), F.length(raw) - 1, F.lit(STEP))


def inside(window: Column, maps: Column) -> Column:
    """Of a window the ranks of the tokens up to SHORT bytes that begin in its first STEP bytes, and offset and length of longer ones that may begin there."""
    at = lambda o, k: F.when(F.length(window) >= o + k, _find(maps, F.substring(window, o + 1, k)))
    ranks = F.array(*[at(o, k)["rank"] for o in range(STEP) for k in range(2, SHORT + 1)])
    longer = F.concat(*[F.coalesce(F.transform(at(o, SHORT)["longer"], lambda k: F.struct(F.lit(o).alias("o"), k.alias("k"))), F.array().cast("array<struct<o:int,k:int>>")) for o in range(STEP)])
    return F.struct(F.filter(ranks, lambda r: r.isNotNull()).alias("ranks"), F.when(F.size(longer) > 0, longer).alias("longer"))


def merge(piece: Column, maps: Column, steps: Column, bytes_by_id: Column, seen: Column) -> Column:
    """Ids of one piece (a string) and the bytes decoded from them, in hex: a fold of ranked merges over its bytes.

    The tokens that occur in the piece are looked up window by window (``seen`` has what is inside
    the usual ones) and sorted by rank, and the fold applies the merge of each to all places at once,
    from left to right. A merge only makes pairs of higher rank, so this is what merging the lowest
    pair again and again gives.
    """
    def tokens_at(raw: Column, i: Column) -> Column:
        window = F.substring(raw, i, F.lit(WIDE))
        more = lambda found: F.filter(F.transform(found["longer"], lambda x: _find(maps, F.substring(raw, i + x["o"], x["k"]))["rank"]), lambda r: r.isNotNull())
        return let(F.coalesce(_find(seen, window), inside(window, maps)), lambda found: F.when(found["longer"].isNull(), found["ranks"]).otherwise(F.concat(found["ranks"], more(found))))

    def of_bytes(raw: Column) -> Column:
        ranked = F.sort_array(F.array_distinct(F.flatten(F.transform(windows(raw), lambda i: tokens_at(raw, i)))))
        start = F.regexp_replace(raw, "(?s)(.)", f"{OPEN}$1{CLOSE}")
        folded = F.aggregate(ranked, start, lambda s, r: F.replace(s, F.get(steps, r)["pair"], F.get(steps, r)["joined"]))
        return F.transform(F.regexp_extract_all(folded, F.lit(f"(?s){OPEN}([^{CLOSE}]+){CLOSE}"), F.lit(1)), lambda t: _find(maps, t)["rank"])

    joined = lambda ids: F.struct(F.array_join(F.transform(ids, lambda i: F.get(steps, i)["id_hex"]), "").alias("ids"), decode(ids, bytes_by_id).alias("bytes"))
    whole = lambda raw: let(_find(maps, raw)["rank"], lambda r: let(F.when(r.isNotNull(), F.array(r)).otherwise(of_bytes(raw)), joined))
    return let(as_bytes(piece), whole)


def as_bytes(piece: Column) -> Column:
    """Each byte of a string as the character of its number."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def pieces(text: Column, pattern: str) -> Column:
    """Matches of the pattern over the whole text; white space and letters as in Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """Scalars as columns that the next projection reads once each, inside ``let``.

    Spark allows no subquery in a lambda, but merges two projections when the second reads a
    column once; the scalar then stays a reference and is not copied into every row.
    """
    return df.select("*", *[v.alias(k) for k, v in scalars.items()])


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 200_000) -> DataFrame:
    """(doc_id, words): per match of every text its ids and the bytes decoded from these ids, in hex."""
    vocabulary = Vocabulary(df.sparkSession, path)
    rows = df.select(col(id_col).alias("doc_id"), pieces(F.coalesce(col(text_col).cast("string"), F.lit("")), pattern).alias("pieces"))
    counted = rows.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    short = table(counted.filter(F.octet_length("piece") <= 64), "pieces")
    top = table(short.orderBy(F.desc("n"), "piece").limit(frequent).select("piece"), "frequent")
    # windows of different pieces: most of these are rare, and rare ones are merged where they stand
    raw = short.select(as_bytes(F.col("piece")).alias("raw")).filter(F.length("raw") > 1)
    cut = raw.select(F.explode(F.transform(windows(F.col("raw")), lambda i: F.substring("raw", i, F.lit(WIDE)))).alias("window"))
    usual = table(cut.groupBy("window").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "window").limit(WINDOWS).select("window"), "windows")
    looked = with_scalars(usual.repartition(32, "window"), _maps=vocabulary.maps).select("window", let(F.col("_maps"), lambda m: inside(F.col("window"), m)).alias("inside"))
    scalars = {"_maps": vocabulary.maps, "_steps": vocabulary.steps, "_bytes": vocabulary.bytes, "_seen": _literal(table(looked, "inside"), "window", F.col("inside"), BUCKETS)}
    with_all = lambda body: let(F.col("_maps"), lambda m: let(F.col("_steps"), lambda s: let(F.col("_bytes"), lambda d: let(F.col("_seen"), lambda w: body(m, s, d, w)))))
    dealt = with_scalars(top.repartition(32, "piece"), **scalars)
    known = table(dealt.select("piece", with_all(lambda *v: merge(F.col("piece"), *v)).alias("word")), "known")
    buckets = 1 << (4 * frequent).bit_length()
    words = _literal(known, "piece", F.col("word"), buckets)
    one = lambda p, k, v: F.coalesce(_find(k, p, buckets), merge(p, *v))
    all_words = with_all(lambda *v: let(F.col("_words"), lambda k: F.transform("pieces", lambda p: one(p, k, v))))
    return with_scalars(rows, **scalars, _words=words).select("doc_id", all_words.alias("words"))


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 200_000) -> DataFrame:
    """Operator 7. Per row: id, n_tokens, ids_sha256, decoded_sha256.

    Ranked merges are folded over the bytes of distinct words by higher-order functions, with the
    ranks as a literal. The ``frequent`` most frequent pieces of all documents are encoded once and
    become a literal themselves; others are folded where they stand. So do the tokens inside the
    WINDOWS most usual windows of five bytes of the different pieces, which saves looking up every
    substring. A text never moves: all that is shuffled are counts of pieces and windows. Decoding takes the ids alone: an array holds the bytes of each
    id, found by the id, and they are concatenated.

    Defined cases: null and empty texts have no ids; a null or repeated id changes nothing; pieces
    of equal count are taken in their own order, which changes no result; long texts and long
    pieces are encoded whole; an empty table gives an empty result; columns other than the two
    named are not read. The file must rank all 256 single bytes, and each longer token after the
    two it is merged from, as byte-level vocabularies do; else it is refused.
    """
    encoded = encode(df, path, pattern, id_col, text_col, frequent)
    whole = lambda name: F.unhex(F.array_join(F.transform("words", lambda w: w[name]), "")).alias(name)
    both = encoded.select("doc_id", whole("ids"), whole("bytes"))
    return both.select(
        F.col("doc_id").alias(id_col), F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
