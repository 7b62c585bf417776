"""The metric index as a table: builds that replace each other whole, with their age and the version of their schema.

`entries/build=<id>` holds the rows of a build, by connection, and `builds/<id>` one row for each connection that it is of.
The latter is written when the former is there, in a folder of its own, so that savers don't share one: a build is seen
whole or not at all, and a reader goes on with the one it began with. Of a connection the build saved last counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
TTL_MS = 6 * 3_600_000
BUILD = "connection_id string, build string, built_at timestamp, schema_version int, saved bigint"


def save_index(entries: DataFrame, path: str, built_at: Column | None = None, version: int = VERSION, connections: Sequence[str] | None = None) -> str:
    """Store `entries` (with connection_id) in place of what their connections had; the build's id.

    `connections` are those that the build is of, also where it has no entries for them; by default those with entries.
    """
    spark = entries.sparkSession
    build = uuid.uuid4().hex
    entries.write.partitionBy("connection_id").parquet(f"{path}/entries/build={build}")
    if connections is None:
        own = spark.read.schema(T.StructType(entries.schema.fields)).parquet(f"{path}/entries/build={build}").select("connection_id").distinct()
    else:
        own = spark.createDataFrame([(c,) for c in connections], "connection_id string")
    stamp = [F.lit(build).alias("build"), (built_at if built_at is not None else F.current_timestamp()).alias("built_at"), F.lit(version).alias("schema_version"), F.lit(time.time_ns()).alias("saved")]
    own.select(F.col("connection_id").cast("string"), *stamp).coalesce(1).write.parquet(f"{path}/builds/{build}")
    return build


def current_builds(spark: SparkSession, path: str) -> DataFrame:
    """The build that counts of each connection: connection_id, build, built_at, schema_version, saved."""
    try:
        every = spark.read.schema(BUILD).parquet(f"{path}/builds/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BUILD)
    row = F.struct("saved", "build", "built_at", "schema_version")
    return every.groupBy("connection_id").agg(F.max(row).alias("last")).select("connection_id", "last.build", "last.built_at", "last.schema_version", "last.saved")


def load_fresh_index(spark: SparkSession, path: str, schema: str | T.StructType, now: Column | None = None, ttl_ms: int = TTL_MS, version: int = VERSION, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Entries, with built_at and schema_version, of the builds of this version that are no older than `ttl_ms`.

    `schema` is that of the entries; a column that a build was saved without is null there, or what `defaults` says. A
    connection whose last build isn't fresh has no entries, whatever it had before.
    """
    now = now if now is not None else F.current_timestamp()
    age = F.unix_millis(now) - F.unix_millis("built_at")
    fresh = current_builds(spark, path).where((F.col("schema_version") == version) & (age <= ttl_ms)).drop("saved")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = fresh.collect()  # one row a connection
    fields = T.StructType([*[f for f in schema.fields if f.name != "connection_id"], T.StructField("build", T.StringType()), T.StructField("connection_id", T.StringType())])
    if not found:
        rows = spark.createDataFrame([], fields)
    else:
        rows = spark.read.schema(fields).option("basePath", f"{path}/entries").parquet(*sorted({f"{path}/entries/build={r.build}" for r in found}))
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value))
    stamps = spark.createDataFrame(found, fresh.schema)
    return rows.join(F.broadcast(stamps), ["connection_id", "build"]).select(*schema.names, "built_at", "schema_version")
