"""Quality rules by distribution divergence, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, table

#: Character classes in the order they are taken out of a text; "other" is what is left.
CLASSES = {"lower": "[a-z]+", "space": "[ \\t-\\r]+", "upper": "[A-Z]+", "digit": "[0-9]+", "beyond": "[^\\x00-\\x7F]+", "stop": "[.,;:!?'\"()-]+"}
WINDOW = 5
BUCKETS = 4096
#: Languages below this share of all words are measured against the whole corpus.
LEAST_LANGUAGE = 0.01
EVERY = "*"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _base(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, text and words of each row; a null text is empty."""
    rows = df.select(col(id_col).alias("doc_id"), F.coalesce(col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("*", _words(F.col("text")).alias("words"))


def _class_lengths(rows: DataFrame) -> DataFrame:
    """Column ``classes``: code points per class. Each class shortens what the next has to read."""
    left, parts = F.col("text"), []
    for i, pattern in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"_left{i}", F.regexp_replace(left, pattern, ""))
        parts.append(F.length(left) - F.length(f"_left{i}"))
        left = F.col(f"_left{i}")
    parts.append(F.length(left))
    return rows.withColumn("classes", F.array(*[p.cast("bigint") for p in parts])).drop(*[f"_left{i}" for i in range(len(CLASSES))])


def references(rows: DataFrame, min_share: float) -> DataFrame:
    """Per language: class shares and the shares of its common words, over all documents.

    A word is common when it makes up ``min_share`` of the words of a language. Two passes find
    exactly these: words are counted by hash bucket first, and only words in buckets that reach
    the share by themselves are counted one by one. Rows: at most 1 / LEAST_LANGUAGE languages and
    ``EVERY``, each with at most 1 / min_share words, so the table is small at any input size.
    """
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")
    in_words = rows.select("lang", F.explode("words").alias("w"))
    counts = table(in_words.groupBy("lang", bucket).agg(F.count("*").alias("n")), "buckets")
    total = counts.agg(F.sum("n").alias("n"))
    languages = counts.groupBy("lang").agg(F.sum("n").alias("all_words")).filter(F.col("all_words") >= LEAST_LANGUAGE * total.scalar())
    languages = table(languages.unionByName(total.select(F.lit(EVERY).alias("lang"), F.col("n").alias("all_words")).filter("n is not null")), "languages")
    by_bucket = counts.unionByName(counts.groupBy("b").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("lang"), "b", "n"))
    heavy = table(by_bucket.join(F.broadcast(languages), "lang").filter(F.col("n") >= min_share * F.col("all_words")).select("lang", "b"), "heavy")
    anywhere = heavy.select("b").distinct()  # at most (1 / LEAST_LANGUAGE + 1) / min_share rows, and BUCKETS
    found = in_words.withColumn("b", bucket).join(F.broadcast(anywhere), "b").groupBy("lang", "w").agg(F.count("*").alias("n"))
    found = table(found, "frequent")
    every = found.groupBy("w").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("lang"), "w", "n")
    common = (
        found.unionByName(every).join(F.broadcast(languages), "lang").filter((F.col("n") >= min_share * F.col("all_words")) & (F.length("w") <= 64))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("w").alias("h"), (F.col("n") / F.col("all_words")).alias("p")))).alias("common"))
    )
    k = len(CLASSES) + 1
    shapes = rows.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(k)])
    shapes = table(shapes, "shapes")
    shapes = shapes.unionByName(shapes.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).select(F.lit(EVERY).alias("lang"), *[f"c{i}" for i in range(k)]))
    whole = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(k)])
    shapes = shapes.select("lang", F.array(*[F.col(f"c{i}") / F.when(whole > 0, whole) for i in range(k)]).alias("ref_classes"))
    return languages.select("lang").join(shapes, "lang").join(common, "lang", "left").select("lang", "ref_classes", "common")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base two of two arrays of shares of equal length, 0 to 1."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_share: float = 0.005, min_chars: int = 200,
    min_words: int = 40, max_class_distance: float = 0.25, max_word_distance: float = 0.35,
) -> DataFrame:
    """Operator 2. Per document the base counts, base_failed, kept and both distances.

    The classes of a document's characters and its common words are compared with the shares in
    all documents of its language. A document is rejected when the base rule fails or a distance
    passes its limit; a distance counts only from ``min_chars`` characters or ``min_words`` words
    on. Everything stays within a row after the references are known: the only shuffles are
    counts per language and bucket or word, summed before they move, so no document's text moves
    and no hot language or word meets in one task.

    Repeats: the 64-bit hashes of all five-word windows are compared by ``array_distinct``, and
    only a text with an equal pair sorts them with their places to mark the words covered.

    Defined cases: null and empty texts have no words, all counts zero, and fail the base rule; a
    null or rare language is measured against the whole corpus; a null or repeated id changes
    nothing, repeated rows are each judged; an empty table gives an empty result; columns other
    than the three named are not read.
    """
    rows = _class_lengths(_base(df, id_col, text_col, lang_col))
    refs = references(rows, min_share)
    no_words = F.array().cast("array<struct<h:bigint,p:double>>")
    every = table(refs, "references")
    fallback = every.filter(F.col("lang") == EVERY)
    joined = rows.join(F.broadcast(every.filter(F.col("lang") != EVERY)), "lang", "left").select(
        "doc_id", "text", "words", "classes",
        F.coalesce("ref_classes", fallback.select("ref_classes").scalar()).alias("ref_classes"),
        F.coalesce("common", fallback.select("common").scalar(), no_words).alias("common"),
    )
    n = F.size("words")
    at = lambda i: F.col("words")[i]
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)])))
    counted = joined.select(
        "doc_id", "classes", "ref_classes", "common", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")).alias("_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("_windows"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    marked = counted.select(
        "doc_id", "classes", "ref_classes", "common", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
        F.transform("common", lambda c: c["h"]).alias("_keys"), F.col("_hashes"),
    )
    last = F.size("_sorted") - 1
    same = lambda a, b: F.col("_sorted")[a]["h"] == F.col("_sorted")[b]["h"]
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: (F.when(j > 0, same(F.greatest(j - 1, F.lit(0)), j)).otherwise(False)) | (F.when(j < last, same(j, F.least(j + 1, last))).otherwise(False)))
    placed = marked.select(
        "*", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda j: F.col("_sorted")[j]["i"]))).alias("_places"),
        F.filter("_hashes", lambda h: F.array_contains(F.col("_keys"), h)).alias("_hits"),
    )
    covered = F.aggregate(
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"]
    )
    per_word = F.transform("_keys", lambda k: (F.size("_hits") - F.size(F.array_remove(F.col("_hits"), k))) / F.greatest(F.col("n_words"), F.lit(1)))
    size = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    measured = placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        size.alias("_size"), F.transform("classes", lambda c: c / F.greatest(size, F.lit(1))).alias("_p"), "ref_classes",
        F.concat(per_word, F.array(1 - F.size("_hits") / F.greatest(F.col("n_words"), F.lit(1)))).alias("_w"),
        F.concat(F.transform("common", lambda c: c["p"]), F.array(1 - F.aggregate("common", F.lit(0.0), lambda s, c: s + c["p"]))).alias("_ref_w"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    class_distance = F.when(F.col("_size") >= min_chars, js_distance(F.col("_p"), F.col("ref_classes")))
    word_distance = F.when(F.col("n_words") >= min_words, js_distance(F.col("_w"), F.col("_ref_w")))
    verdict = measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), class_distance.alias("class_distance"), word_distance.alias("word_distance")
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return verdict.withColumn("kept", ~F.col("base_failed") & near)
