"""Exact order statistics without gathering any group into one task.

Two tools cover every rank, cut, median and running total of the package:

* ``hash_cuts``   - the t-th smallest seeded hash of each group. Rows are then kept or
  split by comparing their own hash with the cut, so no row is ever shuffled to be selected.
* ``prefix_sums`` - running totals over a global order, range-partitioned so that a hot
  group is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.encode import order_key
from tallyvane.operators.graph import join_hot
from tallyvane.storage import cut_lineage

NOTHING = ""    # sorts before every md5
EVERYTHING = "g"  # sorts after every md5
PREFIX_DIGITS = 3
MD5_DIGITS = 32
#: Cuts that are broadcast at most: classes x cuts, some bytes each.
MOST_CUTS = 100_000


def hash_cuts(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed: int | str,
    targets: Callable[[Column], Sequence[Column]],
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Per group, the hash at each target rank: columns (by..., slot, cut).

    ``by`` is empty or a class domain. ``targets`` maps the group's row count to 1-based ranks. ``hash <= cut`` then selects
    exactly that many rows. Two histograms by hash prefix narrow each rank down to one bucket in
    16**(2 digits) of its group; only that bucket's hashes are ranked, equal ones counted first, so
    what one task sorts stays small at any size and however often a key repeats.
    """
    by = list(by)
    hashed = df.select(*by, order_key(seed, *[F.col(k) for k in key]).alias("_h"))
    counts = hashed.groupBy(*by, F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("_c"))
    # at most 16**digits rows per group reach this window
    whole = Window.partitionBy(*by)
    placed = counts.select(
        "*", F.sum("_c").over(whole).alias("_n"), F.sum("_c").over(whole.orderBy("_b")).alias("_upto")
    )
    slots = placed.select(
        "*", F.posexplode(F.array(*[t.cast("long") for t in targets(F.col("_n"))])).alias("slot", "_t")
    )
    first = _rank_holder(slots, by, "_b", F.col("_t"))
    second = _narrow(hashed, first, by, digits, 2 * digits)
    exact = _narrow(hashed, second, by, 2 * digits, MD5_DIGITS).select(*by, "slot", F.col("_b").alias("cut"))
    outside = (
        slots.filter((F.col("_t") <= 0) | (F.col("_t") > F.col("_n")))
        .select(*by, "slot", F.when(F.col("_t") <= 0, NOTHING).otherwise(EVERYTHING).alias("cut"))
        .distinct()
    )
    return exact.unionByName(outside)


def _rank_holder(upto: DataFrame, by: list[str], bucket: str, rank: Column) -> DataFrame:
    """The bucket whose rows hold a rank, and the rank that is left inside it: one row per group and slot."""
    return upto.filter((rank > F.col("_upto") - F.col("_c")) & (rank <= F.col("_upto"))).select(
        *by, "slot", F.col(bucket).alias("_b"), (rank - F.col("_upto") + F.col("_c")).alias("_r")
    )


def _narrow(hashed: DataFrame, hit: DataFrame, by: list[str], digits: int, wider: int) -> DataFrame:
    """From a bucket of ``digits`` hash digits per group and slot to one of ``wider`` digits."""
    # one row per class and cut; a ``by`` that is no class domain is refused, not broadcast
    many = F.count("*").over(Window.partitionBy(F.lit(1)))
    checked = hit.withColumn("_r", F.when(many <= MOST_CUTS, F.col("_r")).otherwise(
        F.raise_error(F.lit(f"more than {MOST_CUTS} cuts: group by a class domain")).cast("long")))
    inside = hashed.withColumn("_b", F.substring("_h", 1, digits)).join(F.broadcast(checked), by + ["_b"])
    counts = inside.groupBy(*by, "slot", "_r", F.substring("_h", 1, wider).alias("_b")).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "slot").orderBy("_b")))
    return _rank_holder(upto, by, "_b", F.col("_r"))


def cut_array(cuts: DataFrame) -> Column:
    """Ungrouped cuts as one scalar array, slot order."""
    return cuts.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "cut"))), lambda s: s["cut"])
    ).scalar()


def cut_map(cuts: DataFrame, by: str) -> Column:
    """Cuts per class as a scalar map class -> array. ``by`` must be a class domain (small)."""
    arrays = cuts.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "cut"))), lambda s: s["cut"]).alias("cuts")
    )
    return arrays.agg(F.map_from_entries(F.collect_list(F.struct(F.col(by), F.col("cuts"))))).scalar()


def take_per_class(
    df: DataFrame, by: str, key: str, seed: int | str, n: Callable[[Column], Column], flag: str = "kept"
) -> DataFrame:
    """Flag an exact, seeded number of rows of each class, in one projection."""
    cuts = hash_cuts(df, [by], [key], seed, lambda total: [n(total)])
    chosen = F.try_element_at(F.lit(cut_map(cuts, by)), F.col(by))
    return df.withColumn(flag, order_key(seed, F.col(key)) <= F.get(chosen, F.lit(0)))


def slot_of(hash_col: Column, cuts: Column, n_cuts: int) -> Column:
    """How many cuts lie strictly below the hash: the index of its block."""
    total = F.lit(0)
    for i in range(n_cuts):
        total = total + F.when(hash_col > F.get(cuts, F.lit(i)), 1).otherwise(0)
    return total


def join_groups(rows: DataFrame, per_group: DataFrame, group: Sequence[str], exact: Sequence[str] = ()) -> DataFrame:
    """Inner join on group columns in which null is a group like any other, and on ``exact`` columns."""
    renamed = per_group.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[F.col(e).alias(f"_e_{e}") for e in exact], *[c for c in per_group.columns if c not in (*group, *exact)])
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    for e in exact:
        on = on & (F.col(e) == F.col(f"_e_{e}"))
    return rows.join(renamed, on).drop(*[f"_g_{g}" for g in group], *[f"_e_{e}" for e in exact])


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Inclusive running totals ``cum_<v>`` within each group along ``order``.

    Rows are range-partitioned on (group, order); each task sums its own range and adds the
    total of the ranges before it. ``order`` must be a total order within a group: pre-aggregate
    equal keys first, which also removes hot ties.
    """
    group = list(group)
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    per_range = ranged.groupBy(*group, "_pid").agg(*[F.sum(v).alias(f"_o_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *group, "_pid",
        *[F.coalesce(F.sum(f"_o_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    running = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_groups(ranged, offsets, group, ["_pid"])
        .select(
            *df.columns,
            *[(F.sum(v).over(running) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values],
        )
    )


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Median of a numeric column by group, nulls ignored.

    Equal values are counted first; the two middle ranks are then read from running counts, so a
    group of any size is spread over the cluster.
    """
    group = list(group)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    run = prefix_sums(counted, group, [F.col(value)], ["n"])
    total = run.groupBy(*group).agg(F.max("cum_n").alias("_total"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    covers = lambda r: (F.col("cum_n") - F.col("n") < r) & (F.col("cum_n") >= r)
    return (
        join_groups(run, total, group)
        .filter(covers(low) | covers(high))
        .groupBy(*group)
        .agg(
            ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2.0).alias(out)
        )
    )


def nearest_value(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, right_id: str, out: str = "nearest_id"
) -> DataFrame:
    """JN6. For each left row the right row with the closest value, lowest id on a tie.

    Distinct values of both sides are laid out in one range-partitioned order. Each left value
    looks at the last right value before it and the first one after it; where that neighbour lies
    in another range it comes from a table of one row per range.
    """
    ref = right.filter(F.col(right_value).isNotNull()).groupBy(F.col(right_value).alias("_v")).agg(F.min(right_id).alias("_id"))
    ask = left.filter(F.col(left_value).isNotNull()).select(F.col(left_value).alias("_v")).distinct()
    line = (
        ref.select("_v", F.struct("_v", "_id").alias("_ref"))
        .unionByName(ask.select("_v", F.lit(None).cast(f"struct<_v:double,_id:{dict(right.dtypes)[right_id]}>").alias("_ref")))
        .repartitionByRange("_v")
        .withColumn("_pid", F.spark_partition_id())
    )
    line = cut_lineage(line)
    edges = line.groupBy("_pid").agg(F.max("_ref").alias("_hi"), F.min("_ref").alias("_lo"))
    # one row per range
    edges = edges.select(
        "_pid",
        F.max("_hi").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_lo").over(Window.orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    # both directions look back: a frame that reaches forward is rescanned for every row
    upward = Window.partitionBy("_pid").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("_pid").orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = (
        line.join(edges, "_pid")
        .select(
            "_v", "_ref",
            F.coalesce(F.max("_ref").over(upward), F.col("_before")).alias("_p"),
            F.coalesce(F.min("_ref").over(downward), F.col("_after")).alias("_q"),
        )
        .filter(F.col("_ref").isNull())
    )
    dp, dq = F.abs(F.col("_p")["_v"] - F.col("_v")), F.abs(F.col("_q")["_v"] - F.col("_v"))
    best = (
        F.when(F.col("_q").isNull(), F.col("_p"))
        .when(F.col("_p").isNull(), F.col("_q"))
        .when(dp < dq, F.col("_p")).when(dq < dp, F.col("_q"))
        .when(F.col("_p")["_id"] <= F.col("_q")["_id"], F.col("_p")).otherwise(F.col("_q"))
    )
    answer = found.select(F.col("_v").alias(left_value), best["_id"].alias(out), best["_v"].alias(f"{out}_value")).distinct()
    return join_hot(left, answer, left_value)
