"""Where queries are registered with their SQL, and the tables that queries derive from the given ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_INSIDE = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"


def plain(sql: str) -> str:
    """SQL in which milliseconds are floored, as Spark floors them, and values half way are rounded up on both sides."""
    sql = re.sub(rf"epoch_ms\(({_INSIDE})\)", r"(epoch_us(\1) // 1000)", sql)
    return re.sub(rf"round\(({_INSIDE}), 6\)", r"round((\1) * 1.000000000001, 6)", sql)


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = plain(sql)
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A table that a query derives from the named ones, by SQL that DuckDB reads as well."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def r6(c: Column | str) -> Column:
    """Rounded to six places; like the SQL's, a small negative number becomes a negative zero, where Spark's has no sign."""
    v = (F.col(c) if isinstance(c, str) else c) * F.lit(1.000000000001)
    return F.signum(v) * F.abs(F.round(v, 6))


def ms(c: Column | str) -> Column:
    return F.unix_millis(c)


def samples(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """`events` as samples: one series for each event type, or for each type and user."""
    labels = [F.lit("event_type"), F.col("event_type")] + ([F.lit("user"), F.col("user_id").cast("string")] if by_user else [])
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("v"), F.lit("A").alias("ref_id"), F.create_map(*labels).alias("labels"), "event_type", "user_id", "event_id")
    key = F.concat(F.lit("A|event_type="), F.col("event_type"), *([F.lit(",user="), F.col("user_id").cast("string")] if by_user else []))
    return rows.withColumn("series_key", key)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident for each day that has events."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    days = table(spark, sf_dir, "events").select(day.alias("starts_at")).where("starts_at is not null").distinct()
    return days.select(F.date_format("starts_at", "yyyy-MM-dd").alias("incident_id"), "starts_at", (F.col("starts_at") + F.expr("interval 1 day")).alias("ends_at"))


#: The same tables in SQL, for a WITH clause.
SAMPLES = "samples AS (SELECT event_id, event_type, user_id, ts AS t, value AS v, 'A|event_type=' || event_type AS series_key FROM events)"
USER_SAMPLES = "samples AS (SELECT event_id, event_type, user_id, ts AS t, value AS v, 'A|event_type=' || event_type || ',user=' || user_id AS series_key FROM events)"
INCIDENTS = """incidents AS (
  SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%d') AS incident_id, date_trunc('day', ts)::TIMESTAMP AS starts_at,
         date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS ends_at
  FROM events WHERE ts IS NOT NULL)"""
WINDOWS = f"""{INCIDENTS}, windows AS (
  SELECT incident_id, 'incident' AS role, 'incident' AS label, 0 AS ord, starts_at AS from_ts, ends_at AS to_ts FROM incidents
  UNION ALL SELECT incident_id, 'pre', 'pre-incident', 1, starts_at - greatest(INTERVAL 30 MINUTE, ends_at - starts_at), starts_at FROM incidents
  UNION ALL SELECT incident_id, 'control', 'prior-hour', 2, starts_at - INTERVAL 1 HOUR, ends_at - INTERVAL 1 HOUR FROM incidents
  UNION ALL SELECT incident_id, 'control', 'yesterday', 3, starts_at - INTERVAL 1 DAY, ends_at - INTERVAL 1 DAY FROM incidents
  UNION ALL SELECT incident_id, 'control', 'last-week', 4, starts_at - INTERVAL 7 DAY, ends_at - INTERVAL 7 DAY FROM incidents),
flagged AS (
  SELECT w.*, w.role = 'control' AND w.from_ts < i.to_ts AND i.from_ts < w.to_ts AS overlaps_incident
  FROM windows w JOIN windows i ON w.incident_id = i.incident_id AND i.role = 'incident')"""
EFFECTIVE = "coalesce(nullif({sd}, 0), nullif(abs({mean}) * 0.01, 0), 1e-9)"
