"""Connected components and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.storage import cut_lineage

#: A key with more than 1/HOT_SHARE of the rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``left`` joined with its one row of ``right`` per key (kept without one), however hot a key is.

    Rows of hot keys meet their partner by broadcast - there are at most ``HOT_SHARE`` hot keys,
    whatever the size - and all others by shuffle. A null key has no partner.
    """
    counts = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    hot = cut_lineage(counts.filter(F.col("_c") * HOT_SHARE > total).select(on, F.lit(True).alias("_hot")))
    hot_right = F.broadcast(hot.join(right, on, "left"))
    extra = [c for c in right.columns if c != on]
    flagged = left.join(F.broadcast(hot), on, "left")
    known = flagged.filter(F.col("_hot")).drop("_hot").join(hot_right.drop("_hot"), on)
    # null keys do not go through the shuffle, where they would all meet
    bare = flagged.filter(F.col(on).isNull()).drop("_hot").select("*", *[F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in extra])
    cold = flagged.filter(F.col("_hot").isNull() & F.col(on).isNotNull()).drop("_hot").join(right, on, "left")
    return known.unionByName(cold).unionByName(bare)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every end of an undirected edge; the root is the smallest id of its component.

    Each round every node learns the smallest id among its neighbours, hangs its larger neighbours on
    it (large step) and then its smaller ones (small step); the depth of the forest halves in
    practice, so rounds grow with the logarithm of the longest path. Edges only shrink, are reliably
    checkpointed each round, and a checksum of them ends the loop. Self-loops and null ends carry no
    link and are dropped, so an id that has only those is not returned.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    tree = cut_lineage(ends.filter("hi <> lo").distinct())
    seen = None
    while (now := state(tree)) != seen and now[0]:
        seen = now
        lowest = tree.select(F.inline(F.array(F.struct(F.col("hi").alias("n"), F.col("lo").alias("m")), F.struct(F.col("lo").alias("n"), F.col("hi").alias("m"))))).groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("m"))
        # large step: each larger neighbour of a node goes to the smallest id that the node sees
        raised = cut_lineage(tree.join(lowest, tree["lo"] == lowest["n"]).select("hi", F.col("m").alias("lo")))
        # small step: what a node hangs on is hung on the smallest of these
        least = raised.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = raised.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        tree = cut_lineage(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
    return tree.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(tree.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
