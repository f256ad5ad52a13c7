"""Structured Streaming forms of intake, upsert and drift monitoring."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyvane.functions import scores as sc
from tallyvane.operators.dedup import latest_by_key
from tallyvane.operators.joins import intake_errors
from tallyvane.storage import child_names, path_exists, remove


def ingest_directory(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """STM1. Files that arrived since the last run, each exactly once (file source + checkpoint)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def validate_stream(rows: DataFrame, js: str, good: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """STM2. Accepted and rejected documents to two tables.

    A batch may be repeated after a failure, so each batch overwrites its own partition.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("errors", intake_errors(F.col(js))).withColumn("batch", F.lit(batch_id)).persist()
        part = lambda df, path: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        part(checked.filter(F.size("errors") == 0).drop("errors"), good)
        part(checked.filter(F.size("errors") > 0), rejects)
        checked.unpersist()
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(rows: DataFrame, key: str, order: list[str], table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """STM3. Table with the newest row per key, in ``buckets`` by hash of the key.

    A version is a manifest: for each bucket the batch that wrote it last. A batch reads and rewrites
    only the buckets of its own keys and points to all others as they are. Repeating a batch rebuilds
    the same buckets from the same predecessor; without a complete predecessor, or with versions of
    another run in the folder, it fails. What neither of the last two versions points to is removed.
    """
    spark, schema = rows.sparkSession, rows.schema
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def sink(batch: DataFrame, batch_id: int) -> None:
        have = _predecessors(spark, table, batch_id)
        was = {r["bucket"]: r["batch"] for r in _manifest(spark, table, batch_id - 1).collect()} if batch_id > 0 else {}  # one row per bucket
        keyed = batch.withColumn("_bucket", bucket).persist()
        touched = [r["_bucket"] for r in keyed.select("_bucket").distinct().collect()]
        old = _open(spark, table, {b: was[b] for b in touched if b in was}, schema)
        merged = latest_by_key(keyed.drop("_bucket").unionByName(old), key, order).withColumn("_bucket", bucket)
        merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/rows-{batch_id}")
        keyed.unpersist()
        now = {**was, **{b: batch_id for b in touched}}
        entries = spark.createDataFrame([(b, v, schema.json()) for b, v in now.items()] or [(-1, batch_id, schema.json())], "bucket int, batch long, schema string")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{table}/v={batch_id}")
        for v in have:
            if v < batch_id - 1:
                remove(spark, f"{table}/v={v}")
        held = {(b, v) for m in (was, now) for b, v in m.items()}
        for name in child_names(spark, table):
            v = int(name[5:]) if name.startswith("rows-") else batch_id
            if v < batch_id - 1:
                for part in child_names(spark, f"{table}/{name}"):
                    if part.startswith("_bucket=") and (int(part[8:]), v) not in held:
                        remove(spark, f"{table}/{name}/{part}")
                if not any(x == v for _, x in held):
                    remove(spark, f"{table}/{name}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _predecessors(spark: SparkSession, table: str, batch_id: int) -> list[int]:
    """Complete versions; fails without the one that ``batch_id`` builds on."""
    have = versions(spark, table)
    if batch_id - 1 not in have and (batch_id > 0 or any(v > 0 for v in have)):
        raise RuntimeError(f"{table} has no complete version {batch_id - 1} to build on")
    return have


def _manifest(spark: SparkSession, table: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{table}/v={version}").filter("bucket >= 0").select("bucket", "batch")


def _open(spark: SparkSession, table: str, where: dict[int, int], schema: StructType) -> DataFrame:
    """Rows of buckets, each in the folder of the batch that wrote it."""
    paths = [f"{table}/rows-{v}/_bucket={b}" for b, v in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, table: str, merge):
    """Batch sink that makes version v of a table from version v - 1 and batch v.

    Repeating a batch rebuilds the same version from the same predecessor. Without a complete
    predecessor, or with versions of another run in the folder, it fails rather than start anew.
    Of older versions only the predecessor is kept.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        have = _predecessors(spark, table, batch_id)
        old = spark.read.schema(batch.schema).parquet(f"{table}/v={batch_id - 1}") if batch_id > 0 else None
        batch.persist()  # read more than once, and it may stand on a state store
        merge(old, batch).write.mode("overwrite").parquet(f"{table}/v={batch_id}")
        batch.unpersist()
        for v in have:
            if v < batch_id - 1:
                remove(spark, f"{table}/v={v}")

    return sink


def versions(spark: SparkSession, table: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    found = [int(n[2:]) for n in child_names(spark, table) if n.startswith("v=")]
    return sorted(v for v in found if path_exists(spark, f"{table}/v={v}/_SUCCESS"))


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest complete version, whether or not the last run found anything new."""
    have = versions(spark, table)
    if not have:
        raise FileNotFoundError(f"{table} has no complete version")
    rows = spark.read.parquet(f"{table}/v={have[-1]}")
    if rows.columns != ["bucket", "batch", "schema"]:
        return rows
    entries = rows.collect()  # one row per bucket
    return _open(spark, table, {r["bucket"]: r["batch"] for r in entries if r["bucket"] >= 0}, StructType.fromJson(json.loads(entries[0]["schema"])))


def keep_windows(monitor: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """STM4. Monitor windows in a versioned table: each batch replaces the windows it changed.

    In update mode the watermark lets finished windows leave the state.
    """
    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch if old is None else old.join(batch.select("window_start"), "window_start", "left_anti").unionByName(batch)

    sink = _versions(monitor.sparkSession, table, merge)
    return monitor.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_monitor(rows: DataFrame, ts: str, k: int, window: str, late: str, threshold: float = 0.7) -> DataFrame:
    """STM4. Per time window: volume, uncertain share, mean probability and predicted share of each class.

    Works on a stream (with its watermark) and on a table alike.
    """
    scored = rows.select(ts, "p", F.array_max("p").alias("conf"), sc.argmax(F.col("p")).alias("pred"))
    if rows.isStreaming:
        scored = scored.withWatermark(ts, late)
    out = scored.groupBy(F.window(ts, window).alias("w")).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("conf") < threshold, 1.0).otherwise(0.0)).alias("uncertain_rate"),
        F.array(*[F.avg(F.col("p")[i]) for i in range(k)]).alias("prior"),
        F.array(*[F.avg(F.when(F.col("pred") == i, 1.0).otherwise(0.0)) for i in range(k)]).alias("pred_share"),
    )
    return out.select(F.col("w.start").alias("window_start"), "n", "uncertain_rate", "prior", "pred_share")


def drifted(prior: Column, reference: list[float], limit: float) -> Column:
    """L-infinity distance of a window's prior from the reference is above ``limit``."""
    gaps = [F.abs(prior[i] - float(r)) for i, r in enumerate(reference)]
    return F.greatest(*gaps) > limit
