"""Alerts that a webhook has stored, one batch a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAP = "map<string,string>"
ALERT = f"struct<fingerprint:string,status:string,labels:{MAP},annotations:{MAP},startsAt:string,endsAt:string,generatorURL:string,dashboardURL:string,panelURL:string>"
BATCH = f"receivedAt string, payload struct<alerts:array<{ALERT}>>, _bad string"


def flatten_batches(batches: DataFrame) -> DataFrame:
    """One row for each alert of each batch, with its `position` there and, where it is known, the batch's `place` in the store."""
    place = ["place"] if "place" in batches.columns else []
    rows = batches.select(F.try_to_timestamp("receivedAt").alias("received_at"), *place, F.posexplode("payload.alerts").alias("position", "a"))
    return rows.select(
        "received_at", "a.fingerprint", F.col("a.status").alias("state"), "a.labels", "a.annotations", F.try_to_timestamp("a.startsAt").alias("starts_at"),
        F.try_to_timestamp("a.endsAt").alias("ends_at"), F.col("a.generatorURL").alias("generator_url"), F.col("a.dashboardURL").alias("dashboard_url"), F.col("a.panelURL").alias("panel_url"),
        *place, "position",
    )


def parse_batches(lines: DataFrame) -> DataFrame:
    """Batches from rows with a JSON text in `value`, with the rows' other columns; torn or bad lines are left out."""
    more = [c for c in lines.columns if c != "value"]
    parsed = lines.select(F.from_json("value", BATCH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("b"), *more)
    return parsed.where("b is not null and b._bad is null").select("b.receivedAt", "b.payload", *more)


def read_alert_store(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of a store; `place` orders its lines: by file, by where in the file a task began, and by line from there.

    The numbers depend on how files are split; their order doesn't, as a task reads its lines in a row.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    return flatten_batches(parse_batches(lines))
