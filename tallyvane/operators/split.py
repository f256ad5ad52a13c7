"""Splitting, sampling and balancing.

Every selection compares a seeded hash of the row's key with cut values (see ``ranking``), so the
same seed gives the same rows on any partitioning and rows are never shuffled to be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.encode import order_key, uniform
from tallyvane.functions.text import json_fingerprint
from tallyvane.storage import cut_lineage
from tallyvane.operators.graph import join_hot
from tallyvane.operators.ranking import cut_array, cut_map, hash_cuts, slot_of

SPLITS = ["test", "val_calibrate", "val_select", "train"]
SYNTH_AGE = {"AK": (70.0, 10.0), "SCC": (65.0, 12.0), "DF": (45.0, 12.0), "VASC": (50.0, 15.0)}
SYNTH_SITES = {
    "AK": ["head/neck", "upper extremity", "trunk"],
    "SCC": ["head/neck", "upper extremity", "lower extremity"],
    "DF": ["lower extremity", "trunk", "upper extremity"],
    "VASC": ["trunk", "lower extremity", "head/neck"],
}


def required(df: DataFrame, *names: str) -> DataFrame:
    """``df`` that fails as soon as a row has no value in one of the columns."""
    kinds = dict(df.dtypes)
    stop = lambda c: F.raise_error(F.lit(f"{c} is null: fill or quarantine such rows before splitting")).cast(kinds[c])
    return df.withColumns({c: F.coalesce(F.col(c), stop(c)) for c in names})


def stratified_split(df: DataFrame, by: str, key: str, fracs: Sequence[float], names: Sequence[str], seed: int | str) -> DataFrame:
    """SPL1/SPL6. Exact per-class split: the first round(f·n) hashes of a class, then the next.

    ``fracs`` are the shares of all names but the last, which takes the remainder.
    """
    def targets(n: Column) -> list[Column]:
        edge, out = 0.0, []
        for f in fracs:
            edge += f
            out.append(F.round(n * F.lit(round(edge, 10))))
        return out
    df = required(df, by)
    cuts = hash_cuts(df, [by], [key], seed, targets)
    h = order_key(seed, F.col(key))
    mine = F.try_element_at(cut_map(cuts, by), F.col(by))
    block = slot_of(h, mine, len(fracs))
    return df.withColumn("split", F.get(F.array(*[F.lit(n) for n in names]), block))


def stratified_folds(df: DataFrame, by: str, key: str, k: int, seed: int | str) -> DataFrame:
    """SPL5. Fold number floor((rank − 1)·k / n) within each class."""
    df = required(df, by)
    cuts = hash_cuts(df, [by], [key], seed, lambda n: [F.ceil(F.lit(j) * n / F.lit(k)) for j in range(1, k)])
    mine = F.try_element_at(cut_map(cuts, by), F.col(by))
    return df.withColumn("fold", slot_of(order_key(seed, F.col(key)), mine, k - 1))


def _group_targets(fracs: Sequence[float]):
    """Ranks at which test, calibrate and select end, each a ceiling of what is left."""
    def targets(n: Column) -> list[Column]:
        out, used, spent = [], F.lit(0).cast("long"), 0.0
        for f in fracs:
            used = used + F.ceil((n - used) * F.lit(f / (1.0 - spent)))
            spent += f
            out.append(used)
        return out
    return targets


def group_split(
    df: DataFrame, group: str, seed: int | str, test: float = 0.15, calibrate: float = 0.05, select: float = 0.10
) -> DataFrame:
    """SPL2. Four-way split in which a group never straddles two splits.

    Shares are shares of *groups*: 15% test, then 5% calibrate and 10% select of the total from
    what remains. The split is a function of the group id alone, so a giant group needs no
    shuffle and cannot leak.
    """
    df = required(df, group)
    groups = df.select(group).distinct()
    cuts = hash_cuts(groups, [], [group], seed, _group_targets([test, calibrate, select]))
    block = slot_of(order_key(seed, F.col(group)), cut_array(cuts), 3)
    return df.withColumn("split", F.get(F.array(*[F.lit(s) for s in SPLITS]), block))


def group_class(df: DataFrame, group: str, by: str) -> DataFrame:
    """Most frequent class of each group, smallest class on a tie."""
    counts = df.groupBy(group, by).agg(F.count("*").alias("_c"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("_c")).alias("neg"), F.col(by).alias("cls")))["cls"].alias("_cls"))


def group_kfold(df: DataFrame, group: str, by: str, k: int, seed: int | str, calibrate: float = 0.05, select: float = 0.10) -> DataFrame:
    """SPL3. Stratified group k-fold: (row columns..., fold, split) with k rows per input row.

    Groups are dealt to folds within their dominant class. For each fold its own groups are the
    test split; the others are carved into calibrate, select and train by a fold-specific hash.
    """
    df = required(df, group, by)
    # one row per group, read several times below
    dealt = cut_lineage(stratified_folds(cut_lineage(group_class(df, group, by)), "_cls", group, k, seed).select(group, F.col("fold").alias("_home")))
    dealt = dealt.select(group, "_home", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    rest = dealt.filter(F.col("fold") != F.col("_home")).withColumn("_key", F.concat_ws("|", "fold", group))
    def targets(n: Column) -> list[Column]:
        cal = F.ceil(n * F.lit(calibrate / 0.85))
        return [cal, cal + F.ceil((n - cal) * F.lit(select / 0.80))]
    cuts = hash_cuts(rest, ["fold"], ["_key"], seed, targets)
    mine = F.try_element_at(cut_map(cuts, "fold"), F.col("fold"))
    block = slot_of(order_key(seed, F.concat_ws("|", "fold", F.col(group))), mine, 2)
    named = F.when(F.col("fold") == F.col("_home"), "test").otherwise(
        F.get(F.array(F.lit("val_calibrate"), F.lit("val_select"), F.lit("train")), block)
    )
    # a row meets one row of its group, with all folds in it, and is copied only after that
    folds = cut_lineage(dealt.select(group, "fold", named.alias("split")).groupBy(group).agg(F.collect_list(F.struct("fold", "split")).alias("_folds")))
    rest = [c for c in df.columns if c != group]
    return join_hot(df, folds, group).select(group, *rest, F.inline("_folds"))


def leaking_groups(df: DataFrame, group: str, fold: str | None = None) -> DataFrame:
    """SET4. Groups present in more than one split (of the same fold). Empty when sound."""
    keys = [group] + ([fold] if fold else [])
    return df.groupBy(*keys).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def require_no_leak(df: DataFrame, group: str) -> DataFrame:
    """SET4 as a gate: the rows unchanged, or a failed query naming three leaking groups."""
    leak = leaking_groups(df, group).orderBy(group).limit(3).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(group).cast("string"))), ", ").alias("s")
    ).scalar()
    checked = F.when(leak == "", F.col("split")).otherwise(
        F.raise_error(F.concat(F.lit("group leak between splits, e.g. "), leak)).cast("string")
    )
    return df.withColumn("split", checked)


def class_balance(df: DataFrame, by: str, tolerance_pp: float = 2.0) -> DataFrame:
    """AGG2. Share of each class in each split against its share of all rows."""
    counts = df.groupBy("split", by).agg(F.count("*").alias("n"))
    # at most splits x classes rows from here on
    every = counts.agg(F.collect_set(by)).scalar()
    spine = counts.select("split").distinct().select("split", F.explode(every).alias(by))
    full = spine.join(counts, ["split", by], "left").select("split", by, F.coalesce("n", F.lit(0)).alias("n"))
    in_split, in_class, everyone = Window.partitionBy("split"), Window.partitionBy(by), Window.partitionBy()
    share = F.col("n") / F.sum("n").over(in_split)
    overall = F.sum("n").over(in_class) / F.sum("n").over(everyone)
    return full.select("split", by, "n", share.alias("share"), overall.alias("target")).withColumn(
        "drifts", F.abs(F.col("share") - F.col("target")) > tolerance_pp / 100.0
    )


def split_manifest(df: DataFrame, group: str, config: dict[str, object], wanted: dict[str, float] | None = None, tolerance: float = 0.05) -> DataFrame:
    """SPL4. One row per split with sizes, group counts, achieved share and a stable run id.

    With ``wanted`` shares the query fails where a share of rows is further off than ``tolerance``,
    as when one group is too large to be balanced.
    """
    run = json_fingerprint({k: F.lit(str(v)) for k, v in config.items()})
    sizes = df.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"))
    achieved = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())  # one row per split
    out = sizes.select(run.alias("run_id"), "split", "n_rows", "n_groups", achieved.alias("achieved"))
    if wanted is None:
        return out
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))]), F.col("split")), F.lit(0.0))
    off = F.concat(F.lit("split "), F.col("split"), F.lit(" has a share of "), F.round("achieved", 4).cast("string"), F.lit(", wanted "), share.cast("string"))
    return out.withColumn("achieved", F.when(F.abs(F.col("achieved") - share) <= tolerance, F.col("achieved")).otherwise(F.raise_error(off).cast("double")))


def sample_without_replacement(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """SPL8. Exactly ``n`` rows (or all): a seeded hash cut, no sort of the table."""
    cut = hash_cuts(df.select(key), [], [key], seed, lambda total: [F.lit(n).cast("long")])
    return df.filter(order_key(seed, F.col(key)) <= cut_array(cut)[0])


def trim_to_target(real: DataFrame, synth: DataFrame, by: str, key: str, target: int, seed: int | str) -> DataFrame:
    """SPL9. Synthetic rows with ``kept``: at most target − real(class) stay, the excess is set aside."""
    have = real.groupBy(by).agg(F.count("*").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct(by, "c")))).scalar()
    # the class is part of the group key, so the need is known where targets are computed
    cuts = hash_cuts(synth, [by], [key], seed, lambda n: [
        F.greatest(F.lit(0), F.lit(target) - F.coalesce(F.try_element_at(have, F.col(by)), F.lit(0)))
    ])
    mine = F.try_element_at(cut_map(cuts, by), F.col(by))
    return synth.withColumn("kept", order_key(seed, F.col(key)) <= F.get(mine, F.lit(0)))


def shortfall(real: DataFrame, synth: DataFrame, by: str, target: int) -> DataFrame:
    """SPL9. Per class: real, synthetic, needed and how many are missing or in excess."""
    both = real.select(by, F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(synth.select(by, F.lit(0).alias("r"), F.lit(1).alias("s")))
    counts = both.groupBy(by).agg(F.sum("r").alias("n_real"), F.sum("s").alias("n_synth"))
    need = F.greatest(F.lit(0), F.lit(target) - F.col("n_real"))
    return counts.select(
        by, "n_real", "n_synth", need.cast("long").alias("needed"),
        F.greatest(F.lit(0), need - F.col("n_synth")).cast("long").alias("missing"),
        F.greatest(F.lit(0), F.col("n_synth") - need).cast("long").alias("excess"),
    )


def poisson_balanced(df: DataFrame, by: str, key: str, seed: int | str, power: float = 0.5) -> DataFrame:
    """SPL7. Sampling with replacement at weight n^-power: Poisson copies per row, expected total N.

    The count of copies is the inverse CDF of a seeded uniform, so it repeats on a re-run. Row
    rates are 1/n-bounded, so ``copies`` is small and the draw stays a projection.
    """
    counts = df.groupBy(by).agg(F.count("*").cast("double").alias("n"))
    # sum over rows of n^-power = sum over classes of n^(1-power)
    lam = counts.select(by, F.pow("n", F.lit(-power)).alias("w"), F.pow("n", F.lit(1.0 - power)).alias("m"), "n").agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct(by, "w"))).alias("w"), F.sum("m").alias("m"), F.sum("n").alias("n")
        )
    ).scalar()
    rows = df.withColumn("_lam", lam)
    lam = F.col("_lam")
    rows = rows.withColumns({"_rate": F.try_element_at(lam["w"], F.col(by)) * lam["n"] / lam["m"], "_u": uniform(F.lit(seed), F.col(key))})
    rate, u = F.col("_rate"), F.col("_u")
    # walk the CDF; state = (k, pmf, cdf). 1 - 2^-52 is reached long before the bound.
    bound = (F.lit(20) + F.ceil(rate + 10 * F.sqrt(rate))).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(1), bound),
        F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("pmf"), F.exp(-rate).alias("cdf")),
        lambda s, i: F.when(u < s["cdf"], s).otherwise(F.struct(
            i.alias("k"), (s["pmf"] * rate / i).alias("pmf"), (s["cdf"] + s["pmf"] * rate / i).alias("cdf"))),
        lambda s: s["k"],
    )
    return rows.withColumn("copies", walk).drop("_lam", "_rate", "_u")


def weighted_with_replacement(df: DataFrame, by: str, key: str, seed: int | str, power: float = 0.5) -> DataFrame:
    """SPL7, exact form: N draws; each draw picks a class by weight, then a uniform row of it.

    Draws are made per class as one row per draw and matched to rows by (class, rank bucket, rank),
    so no class is gathered.
    """
    total = df.count()
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    edges = Window.orderBy(by)  # one row per class
    table = counts.select(
        by, "n", F.sum(F.pow(F.col("n").cast("double"), F.lit(1.0 - power))).over(edges).alias("hi"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(1.0 - power))).over(Window.partitionBy()).alias("all"),
    )
    arr = table.agg(F.array_sort(F.collect_list(F.struct((F.col("hi") / F.col("all")).alias("hi"), F.col(by).alias("cls"), "n")))).scalar()
    draws = df.sparkSession.range(total).select("id", uniform(F.lit(seed), F.lit("class"), F.col("id")).alias("_u"), arr.alias("_t"))
    picked = draws.select("id", F.coalesce(F.filter("_t", lambda s: F.col("_u") < s["hi"])[0], F.element_at("_t", -1)).alias("c"))
    wanted = picked.select(
        "id", F.col("c")["cls"].alias(by),
        (F.floor(uniform(F.lit(seed), F.lit("row"), F.col("id")) * F.col("c")["n"]) + 1).alias("_rank"),
    )
    return wanted.join(class_ranks(df, by, key, seed), [by, "_rank"]).drop("_rank").withColumnRenamed("id", "draw")


def class_ranks(df: DataFrame, by: str, key: str, seed: int | str, digits: int = 3) -> DataFrame:
    """Rank of every row in its class by seeded hash: bucket offset + rank within the bucket."""
    h = df.withColumn("_h", order_key(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy(by, "_b").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy("_b"))
    offsets = counts.select(by, "_b", (upto - F.col("_c")).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h"))
    return h.join(offsets, [by, "_b"]).withColumn("_rank", inside + F.col("_o")).drop("_h", "_b", "_o")


def append_synthetic(real: DataFrame, synth: DataFrame, by: str, medians: DataFrame, numeric: Sequence[str], flags: Sequence[str], whole: Sequence[str] = ()) -> DataFrame:
    """SPL10. Real rows plus synthetic ids that take their class's median metadata.

    Booleans follow the strict one-half rule, floats are rounded to one decimal, ``whole``
    columns truncate. ``medians`` has one row per class.
    """
    filled = synth.join(medians, by, "left")
    cols = [by, "image"] + [
        (F.coalesce(F.col(f"med_{c}"), F.lit(0.0)).cast("int") if c in whole else F.round(F.coalesce(F.col(f"med_{c}"), F.lit(0.0)), 1)).alias(c)
        for c in numeric
    ] + [(F.coalesce(F.col(f"med_{c}"), F.lit(0.0)) > 0.5).alias(c) for c in flags]
    return real.select(by, "image", *numeric, *flags).unionByName(filled.select(*cols))


def jitter_metadata(
    df: DataFrame, by: str, key: str, seed: int | str,
    ages: dict[str, tuple[float, float]] = SYNTH_AGE, sites: dict[str, list[str]] = SYNTH_SITES,
) -> DataFrame:
    """SPL11. Seeded jitter of synthetic rows: age ~ N(mean, sd) of the class, clipped to 20..90 and
    rounded; sex even; site uniform from the class's list, 'trunk' then front or back."""
    u = lambda tag: uniform(F.lit(seed), F.lit(tag), F.col(key))
    normal = F.sqrt(-2.0 * F.log(F.greatest(u("age1"), F.lit(2.0**-52)))) * F.cos(F.lit(6.283185307179586) * u("age2"))
    mean = sd = F.lit(None).cast("double")
    place = F.lit(None).cast("string")
    for cls, (m, s) in ages.items():
        mean = F.when(F.col(by) == cls, float(m)).otherwise(mean)
        sd = F.when(F.col(by) == cls, float(s)).otherwise(sd)
    for cls, options in sites.items():
        pick = F.get(F.array(*[F.lit(o) for o in options]), F.floor(u("site") * len(options)).cast("int"))
        place = F.when(F.col(by) == cls, pick).otherwise(place)
    return df.select(
        "*",
        F.bround(F.least(F.greatest(mean + sd * normal, F.lit(20.0)), F.lit(90.0))).alias("age_jit"),
        F.when(u("sex") < 0.5, "female").otherwise("male").alias("sex_jit"),
        F.when(place == "trunk", F.when(u("side") < 0.5, "anterior torso").otherwise("posterior torso")).otherwise(place).alias("site_jit"),
    )
