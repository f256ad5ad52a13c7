"""Streaming queries (STM1-STM4): the tables are replayed through a file source to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.plans.curate import INTAKE_SQL, intake
from tallyvane.plans.fixtures import K, PRED, predictions, table
from tallyvane.plans.registry import query, r, rounded, rq
from tallyvane.storage import scratch_path
from tallyvane.streaming import intake as st


def replay(df, name: str, files: int = 4):
    """Write the rows as several files and open them as a stream; returns (stream, source path)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path), path


@query("stm1_incremental_ingest", "SELECT event_id, user_id, value FROM events")
def stm1(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "value")
    _, source = replay(rows, "ingest")
    target, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    for _ in range(2):  # the second run finds nothing new
        st.ingest_directory(spark, source, rows.schema, target, state, 2).awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


@query("stm2_stream_validation", "WITH " + INTAKE_SQL + " SELECT 'good' AS side, count(*) AS n FROM ik WHERE event_id % 6 = 0 UNION ALL SELECT 'reject', count(*) FROM ik WHERE event_id % 6 <> 0")
def stm2(spark, sf):
    stream, _ = replay(intake(spark, sf), "intake")
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "reject")
    st.validate_stream(stream, "js", good, bad, scratch_path(spark, "intake-state")).awaitTermination()
    count = lambda path, side: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(good, "good").unionByName(count(bad, "reject"))


@query("stm3_latest_upsert", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stm3(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    stream, _ = replay(rows, "cases")
    target = scratch_path(spark, "latest")
    q = st.upsert_latest(stream, "user_id", ["ts", "event_id"], target, scratch_path(spark, "latest-state"))
    q.awaitTermination()
    return st.read_latest(spark, target).select("user_id", "ts", "event_id")


@query("stm4_score_monitor", "WITH " + PRED + f""", ev AS (SELECT event_id AS row_id, ts FROM events), j AS (SELECT date_trunc('day', ts) AS w, conf, pred, row_id FROM pr JOIN ev USING (row_id)),
p0 AS (SELECT row_id, p FROM pl WHERE k = 0)
SELECT w AS window_start, count(*) AS n, {rq('avg(CASE WHEN conf < 0.2 THEN 1.0::DOUBLE ELSE 0 END)')} AS uncertain_rate, {rq('avg(p)')} AS prior_0, {rq('avg(CASE WHEN pred = 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS share_0 FROM j JOIN p0 USING (row_id) GROUP BY 1""")
def stm4(spark, sf):
    when = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = predictions(spark, sf).select("row_id", "p").join(when, "row_id").select("ts", "p")
    stream, _ = replay(rows, "scores")
    monitor = st.score_monitor(stream, "ts", K, "1 day", "400 days", threshold=0.2)
    target = scratch_path(spark, "monitor")
    st.keep_windows(monitor, target, scratch_path(spark, "monitor-state")).awaitTermination()
    out = st.read_latest(spark, target)
    return rounded(out.select("window_start", "n", "uncertain_rate", F.col("prior")[0].alias("prior_0"), F.col("pred_share")[0].alias("share_0")), "uncertain_rate", "prior_0", "share_0")
