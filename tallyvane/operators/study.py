"""Study protocol: identity groups, paired comparisons, held-out datasets and equalised odds.

These are the parts of the protocol that only plans name (SURVEY §2.14): who may share a split, how
sure a difference between two models is, what transfers between datasets, who is served worse.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators.graph import components, join_hot
from tallyvane.operators.metrics import MIN_COHORT, ratio, summary
from tallyvane.operators.split import SPLITS, group_split, stratified_split
from tallyvane.storage import cut_lineage

#: Prime of the replicate hashes, 2^31 - 1.
PRIME = 2**31 - 1


# ---- identity groups ------------------------------------------------------------

def identity_groups(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Adds ``group``: rows that share any id, directly or through other rows, are one group.

    Ids of several columns (patient, lesion, visit, ...) are nodes, a row links the ids it holds, and
    a group is a connected component, named by its smallest ``column:id``. Taking the first id that
    a row has (``coalesce``) would leak a patient with two lesions. Rows without any id have a
    null group. Links are distinct id pairs, far fewer than rows; a hot id is joined by broadcast.
    """
    nodes = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in ids]))
    rows = df.withColumn("_nodes", nodes).withColumn("_node", F.get("_nodes", F.lit(0)))
    links = rows.filter(F.size("_nodes") > 1).select(F.col("_node").alias("a"), F.explode(F.slice("_nodes", 2, len(ids))).alias("b")).distinct()
    roots = components(links).select(F.col("id").alias("_node"), "root")
    return join_hot(rows.drop("_nodes"), roots, "_node").withColumn("group", F.coalesce("root", "_node")).select(*df.columns, "group")


def identity_split(df: DataFrame, ids: Sequence[str], key: str, by: str, seed: int | str, test: float = 0.15, calibrate: float = 0.05, select: float = 0.10) -> DataFrame:
    """Four-way split: by identity group where a row has an id, else stratified by class.

    No id of any of the columns ever straddles two splits. Adds ``group`` and ``split``.
    """
    # read several times by the cuts below, so the components and joins are not repeated
    rows = cut_lineage(identity_groups(df, ids))
    grouped = group_split(rows.filter(F.col("group").isNotNull()), "group", seed, test, calibrate, select)
    free = stratified_split(rows.filter(F.col("group").isNull()), by, key, [test, calibrate, select], SPLITS, seed)
    return grouped.unionByName(free)


def straddling_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per id column: ids seen, and ids that rows of more than one split hold (0 when sound)."""
    held = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("id"))) for c in ids]))
    per_id = df.select("split", F.inline(held)).groupBy("column", "id").agg((F.count_distinct("split") > 1).alias("straddles"))
    return per_id.groupBy("column").agg(F.count("*").alias("n_ids"), F.count_if("straddles").alias("n_straddling"))


# ---- paired bootstrap -------------------------------------------------------------

def poisson_cuts(limit: int = PRIME) -> list[int]:
    """v in [0, limit) at or above the k-th cut draws at least k + 1 copies: Poisson of mean 1."""
    cuts, mass, k = [], math.exp(-1.0), 0
    total = mass
    while (cut := math.floor(limit * total)) < limit - 1:
        cuts.append(cut)
        k += 1
        mass /= k
        total += mass
    return cuts


def replicate_keys(seed: int | str, n: int) -> list[tuple[int, int]]:
    """(factor, shift) of each replicate; replicate r weighs row hash h by (factor h + shift) mod PRIME."""
    digest = lambda r: hashlib.md5(f"{seed}:replicate:{r}".encode()).hexdigest()
    return [(int(digest(r)[:15], 16) % (PRIME - 1) + 1, int(digest(r)[15:30], 16) % PRIME) for r in range(n)]


def replicate_sums(df: DataFrame, cell: Sequence[str], key: str, replicates: int, seed: int | str) -> DataFrame:
    """(cell..., n, weights): rows of each cell, and their total weight in each bootstrap replicate.

    A row's weight in a replicate is Poisson(1), drawn from a hash of its key, so replicates need no
    shuffle and no copy of a row. All replicates of a block of rows are one matrix; a task sends one
    vector per cell, and vectors of a cell are added. Sizes are cells x replicates, whatever the rows.
    """
    draws = np.array(replicate_keys(seed, replicates), dtype=np.int64).reshape(-1, 2)
    cuts = np.array(poisson_cuts(), dtype=np.int64)
    names = list(cell)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in names)))
            code = {c: i for i, c in enumerate(dict.fromkeys(cells))}
            at = np.fromiter((code[c] for c in cells), dtype=np.int64, count=len(cells))
            order = np.argsort(at, kind="stable")
            hashes = batch.column("_hash").to_numpy()[order]
            edges = np.searchsorted(at[order], np.arange(len(code) + 1))
            for c, i in code.items():
                mine = totals.setdefault(c, np.zeros(replicates + 1, dtype=np.int64))
                mine[0] += edges[i + 1] - edges[i]
                for k in range(edges[i], edges[i + 1], 4096):
                    h = hashes[k : min(k + 4096, edges[i + 1])]
                    v = (h[:, None] * draws[None, :, 0] + draws[None, :, 1]) % PRIME
                    mine[1:] += np.searchsorted(cuts, v, side="right").sum(axis=0)
        if totals:
            columns = [pa.array(v) for v in zip(*totals)]
            types = [schema_types[c] for c in names]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)] + [pa.array([t.tobytes() for t in totals.values()], pa.binary())], [*names, "_sums"])

    schema = ", ".join(f"{n} {t}" for n, t in df.select(*names).dtypes)
    from pyspark.sql.pandas.types import to_arrow_type
    schema_types = {f.name: to_arrow_type(f.dataType) for f in df.select(*names).schema}

    def add(rows: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b, dtype=np.int64) for b in rows.column("_sums").to_pylist())
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in names}, "n": pa.array([int(whole[0])], pa.int64()), "weights": pa.array([whole[1:].tolist()], pa.list_(pa.int64()))})

    row_hash = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint") % PRIME
    hashed = df.select(*names, row_hash.alias("_hash"))
    sums = hashed.mapInArrow(partial, f"{schema}, _sums binary")
    return sums.groupBy(*names).applyInArrow(add, f"{schema}, n bigint, weights array<bigint>")


def paired_bootstrap(df: DataFrame, key: str, k: int, y: str = "y", a: str = "pred_a", b: str = "pred_b", replicates: int = 200, seed: int | str = 42) -> DataFrame:
    """(replicate, model, n, accuracy, macro_f1); replicate -1 is the sample itself.

    Both models are weighed by the same draws, so their difference is paired. Macro-F1 is over the
    ``k`` labels. Every number comes from at most k^3 cells.
    """
    cells = replicate_sums(df.select(F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(key).alias("_key")), ["y", "a", "b"], "_key", replicates, seed)
    long = cells.select("y", "a", "b", F.posexplode(F.concat(F.array("n"), "weights")).alias("at", "n"))
    both = long.select((F.col("at") - 1).alias("replicate"), "y", "n", F.inline(F.array(
        F.struct(F.lit("a").alias("model"), F.col("a").alias("pred")), F.struct(F.lit("b").alias("model"), F.col("b").alias("pred")))))
    by = ["replicate", "model"]
    conf = both.groupBy(*by, "y", "pred").agg(F.sum("n").alias("n")).filter("n > 0")
    return summary(conf, by, k).select(*by, "n", "accuracy", "macro_f1")


def bootstrap_interval(replicated: DataFrame, level: float = 0.95) -> DataFrame:
    """Per metric: difference b - a in the sample, its percentile interval and the share of replicates at or under 0."""
    one = lambda m: F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), m(x).alias("d")) for x in ("accuracy", "macro_f1")]))
    of = lambda model, x: F.max(F.when(F.col("model") == model, F.col(x)))
    diffs = replicated.groupBy("replicate").agg(*[F.round(of("b", x) - of("a", x), 12).alias(x) for x in ("accuracy", "macro_f1")]).select("replicate", one(F.col))
    drawn = F.when(F.col("replicate") >= 0, F.col("d"))
    low = (1.0 - level) / 2.0
    return diffs.groupBy("metric").agg(
        F.count(drawn).alias("replicates"), F.max(F.when(F.col("replicate") < 0, F.col("d"))).alias("difference"),
        F.percentile(drawn, F.lit(low)).alias("low"), F.percentile(drawn, F.lit(1.0 - low)).alias("high"),
        F.avg(F.when(F.col("replicate") >= 0, (F.col("d") <= 0).cast("double"))).alias("share_not_better"),
    )


# ---- McNemar ------------------------------------------------------------------------

def log_factorial(n: Column) -> Column:
    """ln n!: from the exact product up to 15, beyond it by Stirling's series (error under 1e-11)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double"))).otherwise(series)


def binomial_two_sided(n: Column, k: Column) -> Column:
    """Exact two-sided P of min(k, n - k) or fewer heads in n fair throws; 1 for no throw.

    Terms are summed from the largest down by their ratios. They shrink faster than a geometric
    series beyond 9 standard deviations, where the rest is under 1e-17 of the sum.
    """
    low = F.least(k, n - k).cast("bigint")
    first = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * math.log(2.0))
    steps = F.least(low, F.ceil(9.0 * F.sqrt(n.cast("double"))) + 60)
    walk = F.aggregate(
        F.filter(F.sequence(F.lit(0).cast("bigint"), steps), lambda i: i > 0),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: sc.let(s["term"] * (low - i + 1) / (n - low + i), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * first * walk))


def mcnemar(df: DataFrame, by: Sequence[str] = (), y: str = "y", a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """McNemar's test of two models on the same rows: the 2 x 2 counts, exact P and corrected chi-square.

    ``only_a`` and ``only_b`` are the rows that just one of them has right. Without such rows the
    models do not differ: P is 1 and the statistic 0. Rows with a null in truth or prediction count
    as wrong.
    """
    right = lambda p: F.coalesce(F.col(y) == F.col(p), F.lit(False))
    ra, rb = right(a), right(b)
    counts = df.groupBy(*by).agg(
        F.count_if(ra & rb).alias("both"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"), F.count_if(~ra & ~rb).alias("neither"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    return counts.withColumns({"statistic": ratio(gap * gap, n), "p_exact": binomial_two_sided(n, F.col("only_a"))})


# ---- leave one dataset out -----------------------------------------------------------

def held_out_roles(df: DataFrame, dataset: str, held: object, key: str, seed: int | str, val: float = 0.1) -> DataFrame:
    """``split`` when one dataset is held out: it is the test, a seeded share of the others is ``val``."""
    from tallyvane.functions.encode import uniform
    inner = F.when(uniform(F.lit(seed), F.col(key)) < val, "val").otherwise("train")
    return df.withColumn("split", F.when(F.col(dataset).eqNullSafe(F.lit(held)), "test").otherwise(inner))


def held_out_sizes(df: DataFrame, dataset: str, by: str) -> DataFrame:
    """(held_out, class, n_train, n_test) for every dataset: the others' counts are total minus own."""
    counts = df.groupBy(F.col(dataset).alias("held_out"), F.col(by).alias("cls")).agg(F.count("*").alias("own"))
    # datasets x classes rows from here on
    every = counts.agg(F.collect_set("cls")).scalar()
    spine = counts.select("held_out").distinct().select("held_out", F.explode(every).alias("cls"))
    full = spine.join(counts, ["held_out", "cls"], "left").select("held_out", "cls", F.coalesce("own", F.lit(0).cast("bigint")).alias("own"))
    totals = full.groupBy("cls").agg(F.sum("own").alias("all"))
    return full.join(totals, "cls").select("held_out", "cls", (F.col("all") - F.col("own")).alias("n_train"), F.col("own").alias("n_test"))


def transfer_matrix(df: DataFrame, dataset: str, y: str, features: str, width: int, datasets: Sequence[object], k: int) -> DataFrame:
    """(left_out, tested_on, n, accuracy, macro_f1): each dataset's rows judged by each model that left one out.

    The model is the class means of a feature vector. Its sums and counts by (dataset, class) come
    from one scan; the means without a dataset are total minus own, so no model needs a scan or a
    copy of its training rows. A second scan predicts all models' labels of a row at once; rows are
    copied per model only after they are counted by (dataset, truth, predictions). The diagonal
    is the held-out transfer. A class that only the left-out dataset has is never predicted.
    """
    names = list(datasets)
    place = F.array_position(F.array(*[F.lit(d) for d in names]), F.col(dataset)).cast("int")
    rows = df.filter(F.col(dataset).isin(names)).select((place - 1).alias("d"), F.col(y).cast("int").alias("y"), F.col(features).cast("array<double>").alias("x"))
    sums = rows.groupBy("d", "y").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("s"))
    # at most datasets x classes rows of ``width`` sums, whatever the input
    count, total = np.zeros((len(names), k)), np.zeros((len(names), k, width))
    for r in sums.collect():
        count[r["d"], r["y"]], total[r["d"], r["y"]] = r["n"], r["s"]
    others, mean = count.sum(axis=0) - count, total.sum(axis=0) - total
    means = [[(mean[d, c] / others[d, c]).tolist() if others[d, c] else None for c in range(k)] for d in range(len(names))]
    held = df.sparkSession.createDataFrame([(means,)], "m array<array<array<double>>>").agg(F.first("m")).scalar()
    judged = rows.withColumn("_m", held)

    def label(model: Column) -> Column:
        far = lambda mean: F.when(mean.isNotNull(), F.aggregate(F.zip_with("x", mean, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)).otherwise(F.lit(float("inf")))
        distances = F.transform(model, far)
        return sc.let(distances, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))
    counted = judged.select("d", "y", F.transform("_m", label).alias("preds")).groupBy("d", "y", "preds").agg(F.count("*").alias("n"))
    by = ["left_out", "tested_on"]
    conf = counted.select(F.get(F.array(*[F.lit(d) for d in names]), F.col("d")).alias("tested_on"), "y", "n", F.posexplode("preds").alias("_i", "pred"))
    conf = conf.withColumn("left_out", F.get(F.array(*[F.lit(d) for d in names]), F.col("_i"))).groupBy(*by, "y", "pred").agg(F.sum("n").alias("n"))
    return summary(conf, by, k).select(*by, "n", "accuracy", "macro_f1")


# ---- equalised odds --------------------------------------------------------------------

def cohort_lattice(df: DataFrame, bands: dict[str, Column], y: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts (crossing, cohort, y, pred, n) of every crossing of the attributes, in one aggregate.

    Grouping sets count all crossings together; rows are folded by (attributes, y, pred) first.
    ``crossing`` names the attributes, ``cohort`` their values; a null attribute is in no cohort of
    a crossing that names it. The empty crossing is all rows.
    """
    names = list(bands)
    folded = df.select(F.col(y).alias("y"), F.col(pred).alias("pred"), *[c.alias(n) for n, c in bands.items()]).groupBy(*names, "y", "pred").agg(F.count("*").alias("_n"))
    sets = [[*s, "y", "pred"] for r in range(len(names) + 1) for s in combinations(names, r)]
    every = [F.col(c) for c in [*names, "y", "pred"]]
    counted = folded.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.sum("_n").alias("n"), *[F.grouping(n).alias(f"_{n}") for n in names])
    named = lambda n, v: F.when(F.col(f"_{n}") == 0, v)
    live = F.lit(True)
    for n in names:
        live = live & ((F.col(f"_{n}") == 1) | F.col(n).isNotNull())
    return counted.filter(live).select(
        F.concat_ws(" x ", *[named(n, F.lit(n)) for n in names]).alias("crossing"), F.concat_ws(" | ", *[named(n, F.col(n)) for n in names]).alias("cohort"), "y", "pred", "n")


def cohort_odds(lattice: DataFrame, positive: Sequence[int], labels: int | None = None, least: int = MIN_COHORT) -> DataFrame:
    """Per cohort: rows, TPR and FPR of the binary head ``class in positive``, and macro-F1.

    Cohorts under ``least`` rows are left out; a rate without rows to rate is null.
    """
    by = ["crossing", "cohort"]
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint"))
    truth, said = F.col("y").isin(list(positive)), F.col("pred").isin(list(positive))
    rates = lattice.groupBy(*by).agg(
        (count(truth & said) / F.nullif(count(truth), F.lit(0).cast("bigint"))).alias("tpr"), (count(~truth & said) / F.nullif(count(~truth), F.lit(0).cast("bigint"))).alias("fpr"))
    return summary(lattice, by, labels).join(rates, by).filter(F.col("n") >= least).select(*by, "n", "tpr", "fpr", "macro_f1")


def equalised_odds(odds: DataFrame) -> DataFrame:
    """Per crossing: the widest difference of TPR and of FPR between its cohorts, and the larger of both."""
    gap = lambda c: F.max(c) - F.min(c)
    return odds.filter("crossing <> ''").groupBy("crossing").agg(F.count("*").alias("n_cohorts"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap")).withColumn(
        "odds_gap", F.greatest("tpr_gap", "fpr_gap"))


def cohort_deficits(odds: DataFrame, limit: float = 0.10) -> DataFrame:
    """Macro-F1 of each cohort under that of all rows; ``flagged`` when the deficit exceeds ``limit``."""
    everyone = odds.filter("crossing = ''").agg(F.max("macro_f1")).scalar()
    deficit = everyone - F.col("macro_f1")
    return odds.filter("crossing <> ''").select("crossing", "cohort", "n", "macro_f1", deficit.alias("deficit"), (deficit > limit).alias("flagged"))
