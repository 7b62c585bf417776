"""The batch operators on streams: alert feeds, continuous log joins, live runs and live window statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.columns import above, below, finite
from tidewatch.operators.alerts import normalize_alerts
from tidewatch.sources.alerts import flatten_batches, parse_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alert_feed(spark: SparkSession, path: str, files_per_trigger: int = 1000, late: str | None = "1 day") -> DataFrame:
    """Normalised alerts of the JSON lines that arrive in a folder; a line that is delivered again gives nothing.

    A digest of each line is kept for `late` after its file arrived, by the files' own times, so lines may be delivered
    again within that time, in files of any name; what a line says of its time doesn't matter. A file whose own
    time is longer before the newest one's than that is not taken. None turns this off.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).format("text").load(path)
    arrived = lines.select("value", F.sha2("value", 256).alias("digest"), F.col("_metadata.file_modification_time").alias("arrived"))
    if late is not None:
        arrived = arrived.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])
    batches = parse_batches(arrived.drop("digest", "arrived"))
    return normalize_alerts(flatten_batches(batches))


def store_alerts(feed: DataFrame, path: str, checkpoint: str):
    """Append a feed to a table, exactly once, until the folder is read; returns the finished query."""
    query = feed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def _near(left: DataFrame, right: DataFrame, on: str, within: str, late: str) -> tuple[DataFrame, DataFrame, Column]:
    a = left.select(F.col(on).cast("string").alias("key"), F.col("ts").alias("left_ts"), F.col("message").alias("left_message")).withWatermark("left_ts", late)
    b = right.select(F.col(on).cast("string").alias("right_key"), F.col("ts").alias("right_ts"), F.col("message").alias("right_message")).withWatermark("right_ts", late)
    close = (F.col("key") == F.col("right_key")) & (F.col("right_ts") >= F.col("left_ts") - F.expr(f"interval {within}")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {within}"))
    return a, b, close


def continuous_and(left: DataFrame, right: DataFrame, on: str, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of events of two streams with one key, near each other in time; state is dropped behind the watermark."""
    a, b, close = _near(left, right, on, within, late)
    return a.join(b, close).drop("right_key")


def continuous_unless(left: DataFrame, right: DataFrame, on: str, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of the left without one of the right near them; given out once the watermark rules a match out."""
    a, b, close = _near(left, right, on, within, late)
    return a.join(b, close, "left_outer").where("right_key is null").select("key", "left_ts", "left_message")


def live_stats(samples: DataFrame, control: DataFrame, step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Statistics of each series in tumbling windows against a stored control (series_key, control_mean, control_stddev)."""
    v = finite(F.col("v"))
    rows = samples.withWatermark("t", late).groupBy(F.window("t", step).alias("w"), "series_key")
    stats = rows.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.count(v).alias("n"), F.count_if(v != 0).alias("n_nonzero"))
    spread = F.coalesce(F.nullif("control_stddev", F.lit(0.0)), F.nullif(F.abs("control_mean") * 0.01, F.lit(0.0)), F.lit(1e-9))
    joined = stats.join(control, "series_key", "left")
    return joined.select("series_key", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "mean", "stddev", "n", "n_nonzero", ((F.col("mean") - F.col("control_mean")) / spread).alias("z"))


RUN = "series_key string, start_t timestamp, end_t timestamp, min_v double, max_v double, n bigint"


class RunProcessor(StatefulProcessor):
    """The open run of each series over batches; a run is given out when a sample ends it, or time has passed it.

    A task holds the samples that one trigger brings of one series, so the trigger's size (`maxFilesPerTrigger`) bounds it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_t timestamp, end_t timestamp, min_v double, max_v double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        t = np.concatenate([f["t"].to_numpy("datetime64[us]") for f in frames])
        order = np.argsort(t, kind="stable")
        t, v, on = t[order], *(np.concatenate([f[c].to_numpy() for f in frames])[order] for c in ("v", "crosses"))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]])))
        starts, ends = edges[::2], edges[1::2]
        least, most = (f.reduceat(v[on], np.cumsum(ends - starts) - (ends - starts)) if len(starts) else v[:0] for f in (np.minimum, np.maximum))
        runs = [[pd.Timestamp(t[a]), pd.Timestamp(t[b - 1]), lo, hi, int(b - a)] for a, b, lo, hi in zip(starts, ends, least.tolist(), most.tolist(), strict=True)]
        if self.open.exists():
            before = list(self.open.get())
            if on[0]:
                first = runs[0]
                runs[0] = [before[0], first[1], min(before[2], first[2]), max(before[3], first[3]), before[4] + first[4]]
            else:
                runs.insert(0, before)
        goes_on = bool(on[-1])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if goes_on:
            self.open.update(tuple(runs[-1]))
            self.handle.registerTimer(int(pd.Timestamp(runs[-1][1]).timestamp() * 1000) + 1)
        elif self.open.exists():
            self.open.clear()
        yield self.table([(key[0], *r) for r in runs[: len(runs) - goes_on]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = []
        if self.open.exists():
            done.append((key[0], *self.open.get()))
            self.open.clear()
        yield self.table(done)

    def close(self) -> None:
        pass

    @staticmethod
    def table(rows: Sequence[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["series_key", "start_t", "end_t", "min_v", "max_v", "n"]).astype({"start_t": "datetime64[us]", "end_t": "datetime64[us]", "min_v": "float64", "max_v": "float64", "n": "int64"})


def live_runs(samples: DataFrame, threshold: float, direction: str = "below", late: str = "10 minutes") -> DataFrame:
    """Runs of samples beyond a threshold, carried over batches.

    The session needs the RocksDB state store. Samples behind the watermark are dropped; a run is also given out once the
    watermark has passed its last sample, so a later sample that goes on with it begins a new run.
    """
    crosses = (below if direction == "below" else above)(F.col("v"), F.lit(threshold))
    rows = samples.select("series_key", "t", "v", crosses.alias("crosses")).withWatermark("t", late)
    return rows.groupBy("series_key").transformWithStateInPandas(RunProcessor(), RUN, "append", "EventTime")
