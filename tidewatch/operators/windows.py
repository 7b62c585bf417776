"""Incident, preceding and control windows, and the samples that fall into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import DAY, HOUR, MINUTE, SECOND, WEEK, later, overlaps

CONTROLS = (("prior-hour", HOUR), ("yesterday", DAY), ("last-week", WEEK))
LEAST_BEFORE = 30 * MINUTE
LONGEST = 720 * HOUR
OPEN_LONGEST = 24 * HOUR
#: Bucket widths to choose from.
STEPS = (SECOND, 5 * SECOND, 10 * SECOND, 30 * SECOND, MINUTE, 5 * MINUTE, 10 * MINUTE, 30 * MINUTE, HOUR, 6 * HOUR, DAY)


def compute_windows(incidents: DataFrame, offsets: Sequence[tuple[str, int]] = CONTROLS, before_ms: int | None = None, now: Column | None = None) -> DataFrame:
    """incident_id, role, label, ord, from_ts, to_ts for rows with incident_id, starts_at and ends_at.

    An open incident ends now. An end before the start is an error.
    """
    end = F.coalesce("ends_at", now if now is not None else F.current_timestamp())
    end = F.when(end < F.col("starts_at"), F.raise_error(F.lit("an incident ends before it starts"))).otherwise(end)
    rows = incidents.select("incident_id", "starts_at", end.alias("ends_at"))
    span = (F.unix_micros("ends_at") - F.unix_micros("starts_at")) / 1000
    before = F.lit(before_ms) if before_ms is not None else F.greatest(F.lit(LEAST_BEFORE), span)

    def window(role: str, label: str, order: int, start: Column, stop: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(label).alias("label"), F.lit(order).alias("ord"), start.alias("from_ts"), stop.alias("to_ts"))

    start, stop = F.col("starts_at"), F.col("ends_at")
    each = [window("incident", "incident", 0, start, stop), window("pre", "pre-incident", 1, later(start, -before.cast("bigint")), start)]
    each += [window("control", label, 2 + i, later(start, F.lit(-ms)), later(stop, F.lit(-ms))) for i, (label, ms) in enumerate(offsets)]
    return rows.select("incident_id", F.inline(F.array(*each)))


def check_windows(incidents: DataFrame, longest_ms: int = LONGEST, open_longest_ms: int = OPEN_LONGEST, now: Column | None = None) -> DataFrame:
    """incident_id, `problem` and `fatal` for incidents too long or empty, and open ones that have run for long.

    The last is a warning only, and so is not `fatal`: searches of logs and panels go on with it. A good one has no row.
    """
    end = F.coalesce("ends_at", now if now is not None else F.current_timestamp())
    span = (F.unix_micros(end) - F.unix_micros("starts_at")) / 1000
    problem = (
        F.when(span <= 0, "the window is empty")
        .when(span > longest_ms, "the window is longer than the look-back limit")
        .when(F.col("ends_at").isNull() & (span > open_longest_ms), "the incident is open and long; give it an end")
    )
    fatal = (span <= 0) | (span > longest_ms)
    return incidents.select("incident_id", problem.alias("problem"), fatal.alias("fatal")).where("problem is not null")


def flag_overlaps(windows: DataFrame) -> DataFrame:
    """`windows` with overlaps_incident: whether a control overlaps its incident."""
    own = windows.where("role = 'incident'").select("incident_id", F.col("from_ts").alias("_from"), F.col("to_ts").alias("_to"))
    meets = overlaps(F.col("from_ts"), F.col("to_ts"), F.col("_from"), F.col("_to"))
    return windows.join(own, "incident_id", "left").withColumn("overlaps_incident", (F.col("role") == "control") & F.coalesce(meets, F.lit(False))).drop("_from", "_to")


def exclude_overlapping(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows without overlapping controls, and (incident_id, excluded labels in order) of those left out."""
    flagged = flag_overlaps(windows)
    out = flagged.where("overlaps_incident").groupBy("incident_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("excluded"))
    return flagged.where("not overlaps_incident").drop("overlaps_incident"), out


def tag_windows(samples: DataFrame, windows: DataFrame, bucket_ms: int = 6 * HOUR) -> DataFrame:
    """Each sample once for every window that it falls into, both ends included.

    The range join is an equi-join on time buckets. A literal filter on the least and the greatest time reaches the scan,
    as the join's own condition would not.
    """
    ends = windows.agg(F.min("from_ts").alias("lo"), F.max("to_ts").alias("hi")).first()
    near = samples.where(F.col("t").between(F.lit(ends.lo), F.lit(ends.hi)))
    bucket = lambda c: F.floor(F.unix_millis(c) / bucket_ms)
    spread = windows.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("from_ts")), bucket(F.col("to_ts")))))
    joined = near.withColumn("_bucket", bucket(F.col("t"))).join(spread, "_bucket")
    return joined.where((F.col("t") >= F.col("from_ts")) & (F.col("t") <= F.col("to_ts"))).drop("_bucket")


def bucket_step(span_ms: int, max_points: int = 2000, step_ms: int | None = None) -> int:
    """The least width that gives at most `max_points` buckets; an explicit one wins."""
    return step_ms or next((s for s in STEPS if s >= span_ms / max_points), DAY)


def bucketize(samples: DataFrame, span_ms: int, max_points: int = 2000, step_ms: int | None = None) -> DataFrame:
    """Means of the finite values of each series in buckets: series_key, t (the bucket's start), v."""
    step = bucket_step(span_ms, max_points, step_ms)
    at = F.timestamp_millis(F.floor(F.unix_millis("t") / step) * step)
    value = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return samples.groupBy("series_key", at.alias("t")).agg(F.avg(value).alias("v"))


def resolve_ranges(requests: DataFrame, now: Column) -> DataFrame:
    """from_ts and to_ts from the explicit pair, else the link's, else the dashboard's saved one.

    Columns explicit_from, explicit_to, link_from, link_to, saved_from, saved_to are texts: `now`, `now-N` with a unit of
    s m h d w M y, epoch milliseconds, or ISO. Rounding (`/d`) and anything else is an error; so is a row without a range.
    """

    def instant(text: Column) -> Column:
        n = F.regexp_extract(text, r"^now-(\d+)([smhdwMy])$", 1)
        unit = F.regexp_extract(text, r"^now-(\d+)([smhdwMy])$", 2)
        count = F.nullif(n, F.lit("")).cast("bigint")
        span = F.create_map(*[F.lit(x) for pair in {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY, "w": WEEK}.items() for x in pair])
        months = F.when(unit == "M", count).when(unit == "y", 12 * count)
        return (
            F.when(text == "now", now)
            .when(months.isNotNull(), F.timestamp_micros(F.unix_micros(now - F.make_interval(months=months.cast("int")))))
            .when(n != "", later(now, -count * F.element_at(span, unit)))
            .when(text.rlike(r"^\d+$"), F.timestamp_millis(F.when(text.rlike(r"^\d+$"), text).cast("bigint")))
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
            .otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp"))
        )

    def pick(which: str) -> Column:
        pairs = [F.when(F.col(f"{p}_from").isNotNull() & F.col(f"{p}_to").isNotNull(), F.col(f"{p}_{which}")) for p in ("explicit", "link", "saved")]
        return F.coalesce(*pairs, F.raise_error(F.lit("no time range")).cast("string"))

    return requests.select("*", instant(pick("from")).alias("from_ts"), instant(pick("to")).alias("to_ts"))
