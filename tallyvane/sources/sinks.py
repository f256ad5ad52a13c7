"""Sinks: split tables, JSON reports, logs, quarantine and parameter assets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.storage import params_path, path_exists

PARAMS_SCHEMA = (
    "temperature double, class_temperature array<double>, weight array<array<double>>, bias array<double>, "
    "scales array<double>, train_prior array<double>, target_prior array<double>, threshold double"
)


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """SNK1. Split tables and manifests; CSV keeps a missing value distinct from an empty string."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "\\N")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK2. One JSON document per row, null fields kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK3. JSON-lines log; earlier lines are never rewritten."""
    df.write.mode("append").json(path)


def quarantine_lines(manifest: DataFrame) -> DataFrame:
    """SNK4. Failed records only, with the first line of their error."""
    return manifest.filter(~F.col("ok")).select("id", "failed_stage", F.split("error", "\n")[0].alias("error"))


def write_quarantine(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    quarantine_lines(manifest).write.mode(mode).option("sep", "\t").option("header", False).csv(path)


def rewrite_path(df: DataFrame, column: str, root: str, cls: Column, key: Column, ext: str = "png") -> DataFrame:
    """SNK5. dir/class/id.ext; callers write the result as a new version."""
    return df.withColumn(column, F.concat(F.lit(root + "/"), cls, F.lit("/"), key, F.lit(f".{ext}")))


def write_uncertain(df: DataFrame, path: str, threshold: float = 0.7, conf: str = "conf") -> DataFrame:
    """SNK6. Low-confidence predictions as CSV and JSON, computed once and read back for both."""
    rows = df.filter(F.col(conf) < threshold)
    rows.write.parquet(f"{path}/rows")
    kept = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    write_table(kept, f"{path}/csv", fmt="csv")
    write_json(kept, f"{path}/json")
    return kept


def write_params(spark: SparkSession, values: dict, path: str) -> None:
    write_json(spark.createDataFrame([values], PARAMS_SCHEMA), path)


def read_params(spark: SparkSession, path: str) -> Column:
    """SRC11. The one-row parameter table as a scalar struct; every asset may be absent."""
    return one_row(spark.read.schema(PARAMS_SCHEMA).json(path))


def one_row(df: DataFrame) -> Column:
    return df.select(F.struct("*")).scalar()


def cached_by_config(spark: SparkSession, name: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """SRC12. Read-through table in the shared folder, keyed by the hash of its configuration.

    A complete write leaves a _SUCCESS marker; a half-written one is replaced.
    """
    path = params_path(spark, fingerprint, name)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
