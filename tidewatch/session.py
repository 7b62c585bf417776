"""Session defaults shared by the library, the tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use `_` for `.` after the `spark` prefix is added by the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of `spark.checkpoint.dir`, or in a temporary one where that is unset and Spark runs locally."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base and app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
    return f"{(base or _own[app]).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the work folder: for windows, statistics and other small results that several steps read."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
