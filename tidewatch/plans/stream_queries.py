"""Streams over files that the tables are written to, run to their end, as rows.

A row far in the future moves the watermark past the data, so that what waits for it is given out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as c
from tidewatch.plans.catalog_queries import ALERTS, raw_alerts
from tidewatch.plans.registry import SAMPLES, ms, r6, register, samples, table
from tidewatch.session import work_path
from tidewatch.streaming import feeds

FUTURE = "2034-01-01 00:00:00"


def stream_of(df: DataFrame, name: str, files_per_trigger: int = 1000) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All rows that the stream gives out over the files that are there."""
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("q_st1_alert_feed", f"SELECT fingerprint, state, id % 5 AS kind, count(*) AS n FROM ({ALERTS}) GROUP BY ALL")
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_alerts(spark, sf_dir)
    labels = F.map_concat("labels", F.create_map(F.lit("kind"), (F.col("id") % 5).cast("string")))
    alert = F.struct("fingerprint", F.col("state").alias("status"), labels.alias("labels"), "annotations", c.iso(F.col("starts_at")).alias("startsAt"), c.iso(F.col("ends_at")).alias("endsAt"), F.col("generator_url").alias("generatorURL"), F.col("dashboard_url").alias("dashboardURL"), F.col("panel_url").alias("panelURL"))
    batches = rows.groupBy("starts_at", F.floor(F.col("id") / 1000).alias("batch")).agg(F.collect_list(alert).alias("alerts"))
    path = work_path(spark, "alert-lines")
    # alerts have no id, so batches of a day may hold the same; their numbers tell them from lines that are delivered again
    batches.select(F.to_json(F.struct(c.iso(F.col("starts_at")).alias("receivedAt"), "batch", F.struct("alerts").alias("payload"))).alias("value")).write.text(path)
    spark.read.text(path).repartition(3).write.mode("append").text(path)  # delivered again, in other files
    out = work_path(spark, "alert-store")
    feeds.store_alerts(feeds.alert_feed(spark, path), out, work_path(spark, "alert-state"))
    stored = spark.read.parquet(out)
    return stored.groupBy("fingerprint", "state", F.col("labels")["kind"].cast("bigint").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def two_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("message"), "event_type")
    future = spark.createDataFrame([(-1, -1, "click"), (-2, -2, "error")], "user_id bigint, message bigint, event_type string").select("user_id", F.lit(FUTURE).cast("timestamp").alias("ts"), "message", "event_type")
    every = rows.unionByName(future)
    return tuple(stream_of(every.where(F.col("event_type") == k).drop("event_type"), f"stream-{k}") for k in ("click", "error"))


@register("q_st2_continuous_and", "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR")
def st2(spark, sf_dir):
    left, right = two_streams(spark, sf_dir)
    met = finished(feeds.continuous_and(left, right, "user_id", "1 hour"), "and")
    return met.select(F.col("left_message").alias("left_id"), F.col("right_message").alias("right_id"))


@register("q_st3_continuous_unless", "SELECT event_id AS left_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR)")
def st3(spark, sf_dir):
    left, right = two_streams(spark, sf_dir)
    return finished(feeds.continuous_unless(left, right, "user_id", "1 hour"), "unless").where("left_message >= 0").select(F.col("left_message").alias("left_id"))


def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as a stream, with one of the far future in every series."""
    rows = samples(spark, sf_dir).select("series_key", "t", "v")
    future = rows.select("series_key").distinct().select("series_key", F.lit(FUTURE).cast("timestamp").alias("t"), F.lit(1e9).alias("v"))
    return stream_of(rows.unionByName(future), "live")


@register("q_st4_live_runs", f"""WITH {SAMPLES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY t) AS i FROM samples),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY series_key ORDER BY t) AS run FROM numbered WHERE v < 20)
SELECT series_key, epoch_ms(min(t)) AS start_ms, epoch_ms(max(t)) AS end_ms, min(v) AS min_v, max(v) AS max_v, count(*) AS n FROM islands GROUP BY series_key, run""")  # fmt: skip
def st4(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, feeds.ROCKSDB)
    try:
        runs = finished(feeds.live_runs(live_samples(spark, sf_dir), 20.0), "runs")
    finally:
        spark.conf.set(key, before)
    return runs.select("series_key", ms("start_t").alias("start_ms"), ms("end_t").alias("end_ms"), "min_v", "max_v", "n")


@register("q_st5_live_stats", f"""WITH {SAMPLES}, control AS (SELECT series_key, avg(v) AS cm, stddev_pop(v) AS cs FROM samples GROUP BY 1)
SELECT series_key, epoch_ms(time_bucket(INTERVAL 6 HOUR, t)) AS from_ms, round(avg(v), 6) AS mean, count(v) AS n, round((avg(v) - any_value(cm)) / any_value(cs), 6) AS z FROM samples JOIN control USING (series_key) GROUP BY 1, 2""")  # fmt: skip
def st5(spark, sf_dir):
    control = samples(spark, sf_dir).groupBy("series_key").agg(F.avg("v").alias("control_mean"), F.stddev_pop("v").alias("control_stddev"))
    path = work_path(spark, "control")
    control.write.parquet(path)
    live = feeds.live_stats(live_samples(spark, sf_dir), spark.read.schema(control.schema).parquet(path), "6 hours")
    rows = finished(live, "stats").where(F.col("from_ts") < "2030-01-01")
    return rows.select("series_key", ms("from_ts").alias("from_ms"), r6("mean").alias("mean"), "n", r6("z").alias("z"))
