"""Merkle manifest of a dataset: leaves, subroots by source, one root, and a proof per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, placed, table

ARITY = 3
#: Levels that one block hashes, and its leaves.
DEPTH = 6
BLOCK = ARITY**DEPTH
HEX = 64


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbours cannot run into each other."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(node: Column, segments: Column) -> Column:
    """The root that a node and the siblings on its way up give."""
    return F.aggregate(segments, node, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def _parents(level: Column) -> Column:
    """Next level of a block: each 3 x 64 characters of the level's string hashed to 64."""
    width = ARITY * HEX
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _levels(bottom: Column, more: Column) -> Column:
    """All levels of a block as strings (bytes, so that a substring is found at once), leaves first.

    ``more``: the group has other blocks, so this one is hashed DEPTH times even if one node is left.
    """
    def climb(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(more | (F.octet_length(top) > HEX), F.concat(levels, F.array(_parents(top)))).otherwise(levels)
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(bottom), climb)


def _segments(levels: Column, i: Column) -> Column:
    """Per level the siblings left and right of leaf ``i`` in its run: what flanks it in the string."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(DEPTH + 1)])

    def at(level: Column, k: Column) -> Column:
        j = F.floor(i / powers[k]).cast("int")
        return F.struct(
            F.substring(level, (j - j % ARITY) * HEX + 1, (j % ARITY) * HEX).cast("string").alias("left"),
            F.substring(level, (j + 1) * HEX + 1, (ARITY - 1 - j % ARITY) * HEX).cast("string").alias("right"),
        )
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of consecutive nodes (_group, _pos, _n, node, payload), each with its levels."""
    block = F.floor(F.col("_pos") / BLOCK)
    rows = nodes.groupBy("_group", block.alias("block")).agg(
        F.first("_n").alias("n"), F.array_sort(F.collect_list(F.struct((F.col("_pos") - block * BLOCK).cast("int").alias("i"), "node", "payload"))).alias("rows"))
    bottom = F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary")
    made = rows.select("_group", "block", "n", F.transform("rows", lambda r: r["payload"]).alias("payloads"), _levels(bottom, F.col("n") > BLOCK).alias("levels"))
    return table(made, "blocks")


def paths(nodes: DataFrame, above=None) -> DataFrame:
    """Per node its way up: (_group, _pos, payload, segments, subroot, root).

    Blocks of 729 nodes hash six levels on their own; their tops are the nodes of the next round, so
    a group of any size takes a few rounds and never meets in one task. ``above`` maps the tops of
    whole groups (_group, top, floor) to (_group, floor, segments, root); without it a top is the root.
    """
    floors, current = [], nodes
    while True:
        blocks = _blocks(current)
        floors.append(blocks)
        higher = blocks.filter(F.col("n") > BLOCK)
        if higher.isEmpty():
            break
        current = higher.select(
            "_group", F.col("block").alias("_pos"), F.ceil(F.col("n") / BLOCK).alias("_n"), F.element_at("levels", -1).cast("string").alias("node"), F.lit(None).cast("string").alias("payload"))
    tops = None
    for k, blocks in enumerate(floors):
        done = blocks.filter(F.col("n") <= BLOCK).select("_group", F.element_at("levels", -1).cast("string").alias("top"), F.lit(k).alias("floor"))
        tops = done if tops is None else tops.unionByName(done)
    none = F.array().cast("array<struct<left:string,right:string>>")
    ends = above(tops) if above else tops.select("_group", "floor", "top", none.alias("segments"), F.col("top").alias("root"))
    way = None
    for k in reversed(range(len(floors))):
        ups = ends.filter(F.col("floor") == k).select("_group", F.lit(0).cast("bigint").alias("block"), "segments", F.col("top").alias("subroot"), "root")
        if way is not None:
            ups = ups.unionByName(way.select("_group", F.col("_pos").alias("block"), "segments", "subroot", "root"))
        places = F.transform("payloads", lambda p, i: F.struct(i.alias("i"), p.alias("payload"), F.concat(_segments(F.col("levels"), i), F.col("segments")).alias("segments")))
        found = floors[k].join(ups, ["_group", "block"]).select("_group", "block", "subroot", "root", F.explode(places).alias("at"))
        way = found.select("_group", (F.col("block") * BLOCK + F.col("at.i")).alias("_pos"), "at.payload", "at.segments", "subroot", "root")
    return way


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """Operator 12. Per row: (id, leaf, subroot, root, segments, tampered).

    A leaf is the digest of a row's fields. The leaves of a source, by id, are hashed three by
    three to its subroot, the subroots of all sources, by name, to the root. Each aligned block
    keeps its levels as strings of 64 characters a node: parents are hashed of fixed-width
    substrings, and the substrings that flank a node are its siblings. ``segments`` are these
    siblings from the leaf to the root; ``tampered`` is the leaf of the row as an attacker would
    leave it (new lines cut from the text where 2 divides the CRC-32 of the id), for verification.

    Texts never move: they are hashed where they are read. A source of any size is numbered over
    ranges and hashed in blocks. Defined cases: a null value is ``-``; null sources are one source,
    before all others; null ids come first and are not tampered with; rows that repeat an id are in
    order of their leaves; empty texts are values of length 0; an empty table has no rows and no
    root; columns other than the five named are not read.
    """
    doc, text = col(id_col), col(text_col).cast("string")
    values = lambda t: leaf(doc, col(source_col), col(lang_col), col(chars_col), t)
    hit = F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(2)) == 0, F.lit(False)) & (F.instr(text, "\n") > 0)
    own = docs.select(doc.alias("id"), col(source_col).cast("string").alias("source"), values(text).alias("leaf"), F.when(hit, values(F.replace(text, F.lit("\n"), F.lit("")))).alias("other"))
    leaves = placed(own, F.col("source"), [F.col("id"), F.col("leaf")])

    def sources(tops: DataFrame) -> DataFrame:
        laid = placed(tops.select(F.col("_group.g").alias("source"), F.col("_group").alias("own"), "top", "floor"), F.lit("all"), [F.col("source")])
        nodes = laid.select("_group", "_pos", "_n", F.col("top").alias("node"), F.struct("own", "floor", "top").alias("payload"))
        return table(paths(nodes).select(F.col("payload.own").alias("_group"), "payload.floor", "payload.top", "segments", "root"), "sources")

    nodes = leaves.select("_group", "_pos", "_n", F.col("leaf").alias("node"), F.struct("id", "leaf", "other").alias("payload"))
    return paths(nodes, sources).select(
        F.col("payload.id").alias(id_col), "payload.leaf", "subroot", "root", "segments", F.coalesce("payload.other", "payload.leaf").alias("tampered"))


def verify(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Proof digests and the roots folded from the tampered leaves with the kept siblings."""
    siblings = F.array_join(F.flatten(F.transform("segments", lambda s: F.array(s["left"], s["right"]))), "")
    folded = made.select("*", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("segments")).alias("folded_root"))
    return folded.select(col(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
