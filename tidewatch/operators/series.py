"""Statistics, baselines and runs of series.

Operators that need the order of a series work in chunks of time and stitch the chunks, so that one very long series is
never sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import DAY, above, at_least, below, effective_stddev, finite

Z, SIGMA, EXCURSION = 3.0, 2.0, 2.0
MAX_POINTS, MAX_RUNS = 2000, 1000


def _spread(v: Column, kind: Callable[[Column], Column]) -> Column:
    """`kind` of the values, and zero where all are equal.

    Merging parts of equal values leaves some 1e-15 where a part has three or more, which `effective_stddev` would take for a deviation.
    """
    return F.when(F.min(v) == F.max(v), 0.0).otherwise(kind(v))


def series_stats(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, stddev (of the population), min, max, n and n_nonzero of the finite values, for each of `keys`.

    Equal values are their own mean and don't deviate, however they are dealt over tasks.
    """
    v = finite(F.col("v"))
    mean = F.when((F.min(v) == F.max(v)) & (F.min(v) != 0), F.min(v)).otherwise(F.avg(v))
    return samples.groupBy(*keys).agg(mean.alias("mean"), _spread(v, F.stddev_pop).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), F.count_if(v != 0).alias("n_nonzero"))


def pooled_baseline(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pooled_mean, pooled_stddev and n_controls over windows with values, each weighing the same."""
    spread = F.sqrt(F.avg(F.col("stddev") * F.col("stddev")) + _spread(F.col("mean"), F.var_pop))
    return stats.where("n > 0").groupBy(*keys).agg(F.avg("mean").alias("pooled_mean"), spread.alias("pooled_stddev"), F.count(F.lit(1)).alias("n_controls"))


def classify_baseline(joined: DataFrame, z: float = Z) -> DataFrame:
    """`z` and `class` for rows with mean, n, n_nonzero of the incident and pooled_mean, pooled_stddev (null: no control)."""
    none = (F.coalesce("n", F.lit(0)) == 0) | F.col("pooled_mean").isNull()
    zero = (F.col("pooled_mean") == 0) & (F.col("pooled_stddev") == 0) & (F.col("n_nonzero") > 0)
    score = (F.col("mean") - F.col("pooled_mean")) / effective_stddev(F.col("pooled_mean"), F.col("pooled_stddev"))
    rows = joined.withColumn("z", F.when(~none & ~zero, score))
    kind = (
        F.when(none, "insufficient-data")
        .when(zero, "baseline-all-zero")
        .when(at_least(F.abs("z"), F.lit(z)), "statistically-unusual")
        .otherwise("common-during-normal-operations")
    )
    return rows.withColumn("class", kind)


def recurring_match(classified: DataFrame, control_stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and `recurring`: the first control, by `ord`, near the incident's mean, for common series only."""
    common = classified.where("class = 'common-during-normal-operations'").select(*keys, F.col("mean").alias("_mean"))
    near = F.abs(F.col("mean") - F.col("_mean")) <= 1.5 * F.coalesce(F.nullif("stddev", F.lit(0.0)), F.lit(1.0))
    return common.join(control_stats.where("n > 0"), list(keys)).where(near).groupBy(*keys).agg(F.min_by("label", "ord").alias("recurring"))


def _chunk(chunk_ms: int) -> Column:
    return F.floor(F.unix_millis("t") / chunk_ms)


def runs_of(samples: DataFrame, keys: Sequence[str], side: Column, chunk_ms: int = DAY, ties: Sequence[str] = ()) -> DataFrame:
    """The maximal runs of samples with one and the same `side` (null ends a run): side, start_t, end_t, duration_ms, min_v,
    max_v, n. Gaps in time do not end a run.

    Runs are found within chunks of time. Only the first and the last of a chunk can go on in another one, so these alone,
    two rows a chunk at most, are put in the order of the whole series; those between stay with their chunk.
    """
    along = Window.partitionBy(*keys, "_chunk").orderBy("t", *ties)
    rows = samples.withColumn("_chunk", _chunk(chunk_ms)).withColumn("_side", side)
    rows = rows.withColumns({"_i": F.row_number().over(along), "_end": F.lead(F.lit(True)).over(along).isNull(), "_was": F.lag("_side").over(along)})
    rows = rows.withColumn("_new", (F.col("_i") == 1) | ~F.col("_was").eqNullSafe(F.col("_side"))).withColumn("_run", F.count_if("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # a run has one side, so grouping by it too changes no group, and spares a sort that the first of texts would need
    parts = rows.groupBy(*keys, "_chunk", "_run", F.col("_side").alias("side")).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.count(F.lit(1)).alias("n"), (F.min("_i") == 1).alias("_first"), F.bool_or("_end").alias("_last"))
    # at the ends of a chunk a stretch without a side counts too: it parts the runs around it
    edge = F.col("_first") | F.col("_last")
    parts = parts.where(edge | F.col("side").isNotNull()).withColumn("_of", F.when(~edge, F.col("_chunk")))
    stitched = Window.partitionBy(*keys, "_of").orderBy("_chunk", "_run")
    goes_on = F.col("_of").isNull() & F.col("_first") & F.coalesce(F.lag("side").over(stitched).eqNullSafe(F.col("side")), F.lit(False))
    numbered = parts.withColumn("_new", F.when(goes_on & F.lag("_chunk").over(stitched).isNotNull(), 0).otherwise(1)).withColumn("_id", F.sum("_new").over(stitched)).where("side is not null")
    whole = numbered.groupBy(*keys, "_of", "side", "_id").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.sum("n").alias("n"))
    return whole.select(*keys, "side", "start_t", "end_t", (F.unix_millis("end_t") - F.unix_millis("start_t")).alias("duration_ms"), "min_v", "max_v", "n")


def threshold_runs(samples: DataFrame, keys: Sequence[str], threshold: Column, direction: str = "below", chunk_ms: int = DAY, ties: Sequence[str] = ()) -> DataFrame:
    """The maximal runs of samples strictly beyond `threshold`: start_t, end_t, duration_ms, min_v, max_v, n.

    Null, NaN and other samples end a run; gaps in time do not. `threshold` may use the samples' columns.
    """
    crossing = (below if direction == "below" else above)(F.col("v"), threshold)
    return runs_of(samples, keys, F.when(crossing, direction), chunk_ms, ties).drop("side")


def brief_excursions(samples: DataFrame, keys: Sequence[str], width: float = EXCURSION, chunk_ms: int = DAY) -> DataFrame:
    """Runs beyond pooled_mean +- `width` deviations, of both directions in one pass, for samples with the pooled columns."""
    spread = width * effective_stddev(F.col("pooled_mean"), F.col("pooled_stddev"))
    side = F.when(below(F.col("v"), F.col("pooled_mean") - spread), "below").when(above(F.col("v"), F.col("pooled_mean") + spread), "above")
    return runs_of(samples, keys, side, chunk_ms).withColumnRenamed("side", "direction")


def cap_runs(runs: DataFrame, keys: Sequence[str], most: int = MAX_RUNS) -> DataFrame:
    """The first `most` runs of each key by start, with `total`."""
    own = Window.partitionBy(*keys)
    # counted beside the order, as runs are dear to find twice
    placed = runs.withColumns({"_i": F.row_number().over(own.orderBy("start_t", "end_t")), "total": F.count(F.lit(1)).over(own)})
    return placed.where(F.col("_i") <= most).drop("_i")


def onset(samples: DataFrame, baseline: DataFrame, keys: Sequence[str], sigma: float = SIGMA) -> DataFrame:
    """`onset`: the first sample `sigma` deviations or more from the baseline's mean and stddev; no row where there is none."""
    base = baseline.where("mean is not null and not isnan(mean)").select(*keys, F.col("mean").alias("_mean"), F.col("stddev").alias("_stddev"))
    away = F.abs(F.col("v") - F.col("_mean")) / effective_stddev(F.col("_mean"), F.col("_stddev"))
    return samples.join(base, list(keys)).where(at_least(away, F.lit(sigma))).groupBy(*keys).agg(F.min("t").alias("onset"))


def primary_onset(onsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return onsets.groupBy(*keys).agg(F.min("onset").alias("primary_onset"))


def ranked(samples: DataFrame, keys: Sequence[str], chunk_ms: int = DAY, ties: Sequence[str] = ()) -> DataFrame:
    """`samples` with `i` (from 0, by time) and `total` within each of `keys`, ranked chunk by chunk."""
    rows = samples.withColumn("_chunk", _chunk(chunk_ms))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).withColumn("total", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("t", *ties))
    return rows.withColumn("_i", inside).join(sizes, [*keys, "_chunk"]).withColumn("i", F.col("_i") + F.col("_before") - 1).drop("_i", "_before", "_chunk")


def downsample(samples: DataFrame, keys: Sequence[str], most: int = MAX_POINTS, chunk_ms: int = DAY, ties: Sequence[str] = ()) -> DataFrame:
    """At most `most` evenly strided samples of each of `keys`, the last always among them, with `total`."""
    rows = ranked(samples, keys, chunk_ms, ties)
    # j is the least with floor(j n / most) >= i, in whole numbers
    rows = rows.withColumn("_j", F.expr(f"(i * {most} + total - 1) div total"))
    strided = (F.expr(f"(_j * total) div {most}") == F.col("i")) & (F.col("_j") < most - 1)
    kept = (F.col("total") <= most) | strided | (F.col("i") == F.col("total") - 1)
    return rows.where(kept).drop("_j")


def resolution(samples: DataFrame, keys: Sequence[str], chunk_ms: int = DAY) -> DataFrame:
    """points, gap_ms (the upper median of the gaps) and span_ms over the distinct times, for two times or more.

    Gaps are counted by value, and the median is the first value at which the running count passes half. Distinct gaps are
    distinct whole numbers whose sum is within the series' span, so a series has few: 251,000 at most in a year, and
    fewer than 1.5 million in 30 years, whatever the number of its samples.
    """
    times = samples.where("t is not null").select(*keys, F.unix_millis("t").alias("ms"), _chunk(chunk_ms).alias("_chunk")).distinct()
    ends = times.groupBy(*keys, "_chunk").agg(F.max("ms").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_end")
    last = F.lag("ms").over(Window.partitionBy(*keys, "_chunk").orderBy("ms"))
    rows = times.withColumn("_last", last).join(ends, [*keys, "_chunk"]).withColumn("gap", F.col("ms") - F.coalesce("_last", "_before"))
    counts = rows.where("gap is not null").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    upto = F.sum("_n").over(own.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(own), "_span": F.sum(F.col("gap") * F.col("_n")).over(own)})
    half = F.expr("_all div 2")
    return found.where((F.col("_upto") > half) & (F.col("_upto") - F.col("_n") <= half)).select(*keys, (F.col("_all") + 1).alias("points"), F.col("gap").alias("gap_ms"), F.col("_span").alias("span_ms"))


def window_report(tagged: DataFrame, keys: Sequence[str], threshold: Column | None = None, direction: str = "above", include_points: bool = False, most: int = MAX_POINTS, provenance: str = "panel") -> dict[str, DataFrame]:
    """What one asks of samples in windows: `stats` and, with a threshold, `runs` of all points, and `points` if wanted.

    Points are downsampled only where they are given out. `provenance` says where the query came from; hand-written ones
    (`adhoc`) are marked so in the verdict.
    """
    out = {"stats": series_stats(tagged, keys).withColumn("provenance", F.lit(provenance))}
    if threshold is not None:
        out["runs"] = cap_runs(threshold_runs(tagged, keys, threshold, direction), keys)
    if include_points:
        out["points"] = downsample(tagged, keys, most)
    return out
