"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.storage import scratch_path

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name}`")


def table(df: DataFrame, name: str) -> DataFrame:
    """Rows written as Parquet to the folder the cluster shares, and read again from there.

    It cuts the lineage: a lost executor costs a re-read and no recomputation, and what is not
    deterministic in ``df`` (row numbers) is fixed from here on.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """Values of a string column as UTF-8, one at a time."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def words_of(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: ``bytes.split`` cuts at exactly these six characters."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64)


FACTOR = 0xD6E8FEB86659FD93
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of FACTOR and of its inverse modulo 2**64, kept per worker."""
    if len(_powers[0]) < n:
        for i, f in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(2 * n, f, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive words; order counts.

    A polynomial in an odd factor: running sums give every window in a few passes of any width.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers_of(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.cumsum(hashes * up)
        out = sums[width - 1 :].copy()
        out[1:] -= sums[: n - 1]
        return mix(out * down[:n] + GOLDEN)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (id, comp), comp the smallest id reachable.

    Alternating large and small stars: each round hangs every node on the smallest node it can
    see, until nothing changes. The number of rounds is logarithmic in practice. A round's minima
    are written before they are joined, so both sides of the join are plain exchanges, and a hub
    that owns a large share of the links is split by Spark. Ids may be of any ordered type; links
    with a null end or of a node to itself are ignored. Nodes without links are not returned; an
    empty input gives an empty table.
    """
    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(col(a).isNotNull() & col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "links",
    )
    before = stats(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        e1 = table(large, "large")
        low1 = table(e1.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = e1.join(low1, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(moved.unionByName(low1.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = stats(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)


def placed(df: DataFrame, group: Column, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their place in a group of any size, written once.

    Adds ``_group`` (``group`` in a struct, so that null is a group like any other), ``_pos`` (from 0
    along ``order``), ``_n`` (rows of the group), ``_part`` (the range the row lies in) and for each
    of ``sums`` a ``_before_<name>``, its total over the rows of the group before this one. Rows are
    dealt by range of (group, order), so a hot group is spread over many tasks; each range is summed
    on its own and moved by what lies before it, from a table of one row per group and range. Rows
    equal in all of ``order`` are told apart by where they were read and may swap places. ``order``
    should be short values (a digest in place of a text), since bounds of ranges pass the driver.
    """
    keys = [group.asc_nulls_first(), *[o.asc_nulls_first() for o in order], F.col("_tie").asc()]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = table(
        ranged.select(*df.columns, F.struct(group.alias("g")).alias("_group"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")),
        "placed",
    )
    per_part = laid.groupBy("_group", "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    whole = Window.partitionBy("_group")
    above = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_group", "_part", "_first", F.sum("_rows").over(whole).alias("_n"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(above), F.lit(0)).alias(f"_shift_{s}") for s in sums],
    )
    inside = Window.partitionBy("_group", "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    return laid.join(offsets, ["_group", "_part"]).select(
        *df.columns, "_group", "_part", "_n", (F.col("_shift") + F.col("_seq") - F.col("_first")).alias("_pos"),
        *[(F.col(f"_shift_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"_before_{s}") for s in sums],
    )
