"""Columnar query results: as long samples, as tables, and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import iso, series_key

FIELD = "struct<name:string,type:string,labels:map<string,string>>"
FRAME = f"struct<refId:string,fields:array<{FIELD}>,values:array<array<string>>>"
RESULTS = f"map<string,struct<error:string,frames:array<{FRAME}>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON document a line: `results`, by the key of the query."""
    return spark.read.schema(f"results {RESULTS}").json(path)


def frame_errors(results: DataFrame) -> DataFrame:
    """ref_id and message of each query that failed; the others go on."""
    return results.select(F.explode("results").alias("ref_id", "r")).where("r.error is not null").select("ref_id", F.col("r.error").alias("message"))


def _frames(results: DataFrame, *keep: str) -> DataFrame:
    good = results.select(*keep, F.explode("results").alias("key", "r")).where("r.error is null")
    frames = good.select(*keep, "key", F.posexplode("r.frames").alias("frame", "f"))
    return frames.select(*keep, F.coalesce("f.refId", "key").alias("ref_id"), "frame", "f.fields", "f.values")


def frame_samples(results: DataFrame, *keep: str) -> DataFrame:
    """One row for each point of each numeric field: ref_id, labels, series_key, t, v.

    The first field of type `time` is the axis; a frame without one is skipped, and so are fields of other types. A value that
    is no number is null; a point without a time is left out.
    """
    frames = _frames(results, *keep).withColumn("axis", F.array_position(F.transform("fields", lambda f: f["type"]), "time") - 1).where("axis >= 0")
    fields = frames.select(*keep, "ref_id", "axis", "values", F.posexplode("fields").alias("at", "field")).where("field.type = 'number'")
    points = fields.select(*keep, "ref_id", "field.labels", F.explode(F.arrays_zip(F.get("values", F.col("axis").cast("int")).alias("t"), F.get("values", F.col("at")).alias("v"))).alias("p"))
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    rows = points.where(F.col("p.t").try_cast("double").isNotNull()).select(*keep, "ref_id", labels.alias("labels"), F.timestamp_millis(F.col("p.t").try_cast("double").try_cast("bigint")).alias("t"), F.col("p.v").try_cast("double").alias("v"))
    return rows.withColumn("series_key", series_key(F.col("ref_id"), F.col("labels")))


def frame_rows(results: DataFrame, *keep: str) -> DataFrame:
    """Each frame as a table: ref_id, frame, row, names and cells (text, in the schema's order; times in ISO, null if short)."""
    frames = _frames(results, *keep).where("size(values) > 0")
    longest = F.array_max(F.transform("values", lambda v: F.size(v)))
    rows = frames.where(longest > 0).withColumn("row", F.explode(F.sequence(F.lit(0), longest - 1)))

    def cell(field, i):
        text = F.get(F.get("values", i), F.col("row"))
        return F.when(field["type"] == "time", iso(F.timestamp_millis(text.try_cast("double").try_cast("bigint")))).otherwise(text)

    return rows.select(*keep, "ref_id", "frame", "row", F.transform("fields", lambda f: f["name"]).alias("names"), F.transform("fields", cell).alias("cells"))
