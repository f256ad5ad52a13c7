"""Sums of long vectors: one binary value per task, added up in a tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one task adds.
FAN_IN = 32


def add_vectors(parts: DataFrame, keys: Sequence[str], column: str = "sums", fan_in: int = FAN_IN, last: int = 1, tasks: int | None = None) -> DataFrame:
    """Partial sums (keys..., bytes of float64) added per key: one row per key, ``fan_in`` vectors a task.

    ``parts`` holds a row per task and key, so levels grow with the logarithm of the number of tasks
    and no task or driver ever holds more than ``fan_in`` vectors of a key. ``last`` 2 leaves out the
    last level: up to ``fan_in`` rows per key remain. ``tasks`` is the number of tasks, where known.
    """
    schema = ", ".join(f"{n} {t}" for n, t in parts.select(*keys, column).dtypes)

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for value in rows.column(column):
            v = np.frombuffer(value.as_py(), dtype=np.float64)
            total = v.copy() if total is None else total + v
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, column: pa.array([total.tobytes()], pa.binary())})

    def level(df: DataFrame, lanes: int) -> DataFrame:
        """One row per key and lane."""
        dealt = df.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        return dealt.groupBy(*keys, "_lane").applyInArrow(lambda rows: add(rows), schema)

    tasks, lanes = tasks or max(parts.rdd.getNumPartitions(), 1), 1
    while lanes * fan_in < tasks:
        lanes *= fan_in
    while lanes >= last:
        parts = level(parts, lanes)
        lanes //= fan_in
    return parts


def collect_sum(parts: DataFrame, column: str = "sums", fan_in: int = FAN_IN, tasks: int | None = None) -> np.ndarray | None:
    """The sum of all partial vectors on the driver, which receives at most ``fan_in`` of them; None without any."""
    rows = add_vectors(parts.select(column), [], column, fan_in, 2, tasks).collect()
    return np.sum([np.frombuffer(r[column], dtype=np.float64) for r in rows], axis=0) if rows else None
