"""Substring dedup: passages that recur anywhere are confirmed, compiled into automata and located."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import as_bytes, col, signed, table, window_hashes, word_hashes, words_of

ANCHOR = 8  # words of a phrase
BLOCKS = 256  # rows a shard's phrases travel in
RUN = 28  # windows in one row at most, so that a 32-bit mask holds them


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of every run of ``width`` values, in log(width) passes."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window and the anchors a document has to show.

    The anchor of a window is the lowest hash among its phrases of ``ANCHOR`` words, so equal
    windows have equal anchors wherever they stand. A document shows each anchor once, or twice
    if it stands at two places or more.
    """
    low = sliding(grams, per_window)
    pad = np.zeros(per_window - 1, dtype=np.uint64)
    chosen = grams[sliding(np.concatenate([pad, low, pad]), per_window, np.maximum) == grams]
    value, n = np.unique(chosen, return_counts=True)
    return low, np.repeat(value, np.minimum(n, 2))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def read_documents(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Per row: id, key of its text, number of words, digest of all its words, anchors."""
    kind, per_window = dict(df.dtypes)[id_col], window - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, own = [], [], []
            for text in as_bytes(b.column("text")):
                words = words_of(text)
                n.append(len(words))
                digest.append(_digest(words))
                own.append(signed(anchors(window_hashes(word_hashes(words), ANCHOR), per_window)[1]) if len(words) >= window else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("tkey"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(own, pa.list_(pa.int64()))], ["id", "tkey", "n", "digest", "anchors"]
            )

    rows = _keyed(df, id_col, text_col)
    return table(rows.mapInArrow(run, f"id {kind}, tkey string, n long, digest string, anchors array<long>"), "documents")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return df.select(col(id_col).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("tkey"), text.alias("text"))


def recurring_anchors(classes: DataFrame, per_shard: int) -> DataFrame:
    """Anchors at two places or more: (anchor, seed, shard).

    The shard comes from the text an anchor is first seen in, so the anchors of one passage, and
    the documents that hold it, meet in one shard.
    """
    own = F.xxhash64("tkey").alias("seed")
    counted = classes.select(own, F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("c"), F.min("seed").alias("seed"))
    found = table(counted.filter("c > 1").select("anchor", "seed"), "anchors")
    n_shards = max(1, -(-found.count() // per_shard))
    return found.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(n_shards)).cast("int"))


def route(df: DataFrame, classes: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per different text that shows a recurring anchor: cid, seed, text, its anchors and their shards."""
    shown = classes.select("cid", F.explode("anchors").alias("anchor")).distinct()
    per_class = shown.join(found, "anchor").groupBy("cid").agg(F.collect_list(F.struct("anchor", "seed", "shard")).alias("route"))
    routed = classes.select("cid", "tkey", F.col("id").alias("rep"), "copies").join(per_class, "cid")
    texts = _keyed(df, id_col, text_col).withColumnRenamed("id", "rep")
    # one of the copies is enough; a null id equals a null id here
    same = (texts["tkey"] == routed["tkey"]) & texts["rep"].eqNullSafe(routed["rep"])
    return table(texts.join(routed, same).select("cid", "copies", F.xxhash64(routed["tkey"]).alias("seed"), texts["text"].alias("text"), "route"), "routed")


def phrases_of(routed: DataFrame) -> DataFrame:
    """Letters of each recurring anchor: (shard, anchor, phrase)."""
    wanted = F.filter("route", lambda r: r["seed"] == F.col("seed"))
    first = routed.select("text", F.transform(wanted, lambda r: F.struct(r["anchor"].alias("anchor"), r["shard"].alias("shard"))).alias("own")).filter(F.size("own") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, anchor, phrase = [], [], []
            for text, own in zip(as_bytes(b.column("text")), b.column("own").to_pylist(), strict=True):
                hashes = word_hashes(words_of(text))
                grams = signed(window_hashes(hashes, ANCHOR))
                value, at = np.unique(grams, return_index=True)
                short = letters(hashes)
                for r in own:
                    p = at[np.searchsorted(value, r["anchor"])]
                    shard.append(r["shard"])
                    anchor.append(r["anchor"])
                    phrase.append(short[2 * p : 2 * (p + ANCHOR)])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(anchor, pa.int64()), pa.array(phrase, pa.binary())], ["shard", "anchor", "phrase"])

    return first.mapInArrow(run, "shard int, anchor long, phrase binary").dropDuplicates(["anchor"])


def letters(hashes: np.ndarray) -> bytes:
    """Two letters a word, from its hash: an alphabet of 256, as automata search their edges one by one."""
    return (hashes & np.uint64(0xFFFF)).astype("<u2").tobytes()


def compiled(anchor: list[int], phrase: list[bytes]) -> ahocorasick.Automaton:
    """Automaton over the letters of phrases; the value of some letters is the anchors of all phrases that have them."""
    shared: dict[str, list[int]] = {}
    for a, p in zip(anchor, phrase, strict=True):
        shared.setdefault(p.decode("latin-1"), []).append(a)
    out = ahocorasick.Automaton()
    # an automaton replaces the value of a word that is added again, so each is added once
    for key, own in shared.items():
        out.add_word(key, tuple(own))
    out.make_automaton()
    return out


def locate(routed: DataFrame, per_group: int, window: int) -> DataFrame:
    """Every place of every recurring phrase, as runs of windows.

    Documents stream through the automata of the shards whose phrases they hold. The documents of
    a shard are dealt into groups of about ``per_group`` bytes, each with a copy of the shard's
    phrases, so a passage that a third of all documents hold is searched by many tasks. Rows:
    cid, copies, anchor, start, the hashes of consecutive windows with that anchor, and their hash.
    """
    per_window = window - ANCHOR + 1
    shards = routed.select("cid", "copies", "text", F.explode(F.array_distinct(F.transform("route", lambda r: r["shard"]))).alias("shard"))
    sizes = table(shards.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("bytes") / per_group)).cast("int").alias("groups")), "groups")
    dealt = shards.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("cid"), F.col("groups")).cast("int").alias("part"), "cid", "copies", "text")
    # phrases travel in blocks, a few hundred a row, to every group of their shard
    block = F.pmod(F.xxhash64("anchor"), F.lit(BLOCKS))
    blocks = table(phrases_of(routed).groupBy("shard", block.alias("block")).agg(F.collect_list(F.struct("anchor", "phrase")).alias("items")), "phrases")
    words = blocks.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "items")

    def run(phrases: pa.Table, docs: pa.Table) -> pa.Table:
        rows, parts = [], []
        if docs.num_rows and phrases.num_rows:
            items = phrases["items"].combine_chunks().flatten()
            search = compiled(items.field("anchor").to_pylist(), items.field("phrase").to_pylist())
            for cid, copies, text in zip(docs["cid"].to_pylist(), docs["copies"].to_pylist(), as_bytes(docs["text"]), strict=True):
                hashes = word_hashes(words_of(text))
                # letters may agree by chance; a window counts only if its own anchor was found
                hits: set[int] = set()
                for _, found in search.iter(letters(hashes).decode("latin-1")):
                    hits.update(found)
                if not hits:
                    continue
                low = signed(sliding(window_hashes(hashes, ANCHOR), per_window))
                begins = [0, *(np.flatnonzero(low[1:] != low[:-1]) + 1).tolist()]
                wins = None
                for b, e, a in zip(begins, [*begins[1:], len(low)], low[begins].tolist(), strict=True):
                    if a in hits:
                        wins = signed(window_hashes(hashes, window)) if wins is None else wins
                        for s in range(b, e, RUN):
                            own = wins[s : min(s + RUN, e)]
                            parts.append(own)
                            rows.append((cid, copies, a, s, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)))
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))
        return pa.table({"cid": cols[0], "copies": cols[1], "anchor": cols[2], "start": cols[3], "wins": lists, "run": cols[4]})

    both = words.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part"))
    return table(both.applyInArrow(run, "cid long, copies long, anchor long, start long, wins array<long>, run long"), "located")


def confirm(located: DataFrame) -> DataFrame:
    """Which windows of which text recur: (cid, start, mask), one bit a window.

    Equal runs are folded into one row with a count first. A run at two places or more recurs
    whole. Of the others each window is looked up among all windows of the same anchor.
    """
    runs = table(located.groupBy("anchor", "run").agg(F.sum("copies").alias("c"), F.any_value("wins").alias("wins")), "runs")
    whole = F.expr("shiftleft(1L, size(wins)) - 1")
    sure = runs.filter("c > 1").select("anchor", "run", whole.alias("mask"))
    several = runs.groupBy("anchor").agg(F.count("*").alias("k"), F.min("c").alias("least"), F.max(F.size(F.array_distinct("wins")) < F.size("wins")).alias("own"))
    doubtful = several.filter("least = 1 and (k > 1 or own)").select("anchor")
    wins = runs.join(doubtful, "anchor").select("anchor", "run", "c", F.posexplode("wins").alias("at", "win"))
    wins = table(wins, "windows")
    again = wins.groupBy("anchor", "win").agg(F.sum("c").alias("total")).filter("total > 1").select("anchor", "win")
    bit = F.expr("shiftleft(1L, at)")
    partly = wins.filter("c = 1").join(again, ["anchor", "win"]).groupBy("anchor", "run").agg(F.bit_or(bit).alias("mask"))
    masks = table(sure.unionByName(partly), "masks")
    return located.select("cid", "anchor", "run", "start").join(masks, ["anchor", "run"]).select("cid", "start", "mask")


def _cover(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words a confirmed window covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        for i in range(s["mask"].bit_length()):
            if s["mask"] >> i & 1:
                change[s["start"] + i] += 1
                change[s["start"] + i + window] -= 1
    return np.cumsum(change[:-1]) > 0


def judged(df: DataFrame, id_col: str, text_col: str, window: int, per_shard: int, per_group: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``read_documents`` gives them, and (tkey, n_removed, digest, left) of each text that loses words."""
    rows = read_documents(df, id_col, text_col, window)
    folded = rows.filter("anchors is not null").groupBy("tkey").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("anchors").alias("anchors"))
    classes = table(folded.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    routed = route(df, classes, recurring_anchors(classes, per_shard), id_col, text_col)
    covers = confirm(locate(routed, per_group, window)).groupBy("cid").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    # a text that occurs twice goes whole; only single ones are cut
    cut = routed.filter("copies = 1").select("cid", "text").join(covers, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digest, left = [], [], []
            for text, spans in zip(as_bytes(b.column("text")), b.column("spans"), strict=True):
                words = words_of(text)
                gone = _cover(len(words), spans.as_py(), window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(gone.sum()))
                digest.append(_digest(kept))
                left.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary()).cast(pa.string())], ["cid", "n_removed", "digest", "left"])

    done = cut.mapInArrow(run, "cid long, n_removed long, digest string, left string")
    partly = classes.filter("copies = 1").select("cid", "tkey").join(done, "cid").select("tkey", "n_removed", "digest", "left")
    whole = classes.filter("copies > 1").select("tkey", F.col("n").alias("n_removed"), F.lit(_digest([])).alias("digest"), F.lit("").alias("left"))
    return rows, table(partly.unionByName(whole), "judged")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, per_shard: int = 120_000, per_group: int = 8 << 20) -> DataFrame:
    """Operator 9. Per row: id, n_words, n_removed, kept_sha256.

    A word goes when a window of ``window`` words that covers it stands at a second place of any
    document. Every window has an anchor, the phrase of eight words in it with the lowest hash;
    anchors are counted over all documents, those at two places or more are compiled into sharded
    Aho-Corasick automata, the documents that hold some are streamed through them, and the windows
    around each hit are confirmed by 64-bit hashes within their anchor. Equal texts are folded
    before that. Counts are summed before they move; a phrase of very many documents is searched
    in many groups, and joined back as a plain exchange that Spark splits.

    Defined cases: null and empty texts have no words; texts shorter than a window lose nothing;
    a text that occurs twice or more and has a window loses all its words, in every copy; a null
    or repeated id changes nothing, each row counts as a document; an empty table gives an empty
    result; columns other than the two named are not read.
    """
    if window < ANCHOR:
        raise ValueError(f"window must be {ANCHOR} words or more")
    rows, cut = judged(df, id_col, text_col, window, per_shard, per_group)
    cut = cut.select("tkey", F.col("n_removed").alias("r"), F.col("digest").alias("d"))
    return rows.join(cut, "tkey", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("r", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("d", "digest").alias("kept_sha256")
    )


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, per_shard: int = 120_000, per_group: int = 8 << 20) -> DataFrame:
    """All rows and columns of ``df``; texts that lose words become the words left, joined by a space."""
    _, cut = judged(df, id_col, text_col, window, per_shard, per_group)
    keyed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("tkey"))
    both = keyed.join(cut.select("tkey", F.col("left").alias("new_text")), "tkey", "left")
    pick = lambda c: F.coalesce("new_text", F.col("row").getField(c)) if c == text_col else F.col("row").getField(c)
    out = both.select(*[pick(c).alias(c) for c in df.columns])
    return out.to(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields]))
