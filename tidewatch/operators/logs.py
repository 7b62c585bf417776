"""Joins of log streams on a shared identifier, their truncation guard, and log search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.skew import look_up, pairs
from tidewatch.session import stored

CAP = 500
#: Parts of a stream that are ranked apart.
PARTS = 256


def streams(named: Mapping[str, DataFrame], on: str) -> DataFrame:
    """One table of all streams: stream, key, ts, message."""
    parts = [df.select(F.lit(name).alias("stream"), F.col(on).cast("string").alias("key"), "ts", "message") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts).where("key is not null")


def cap_stream(events: DataFrame, most: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The first `most` events of each stream by time, and fetched, total and truncated of each stream.

    The first of each of `PARTS` parts of a stream are taken, and of these the first, so no task sorts a whole stream.
    """
    by_time = ["ts", "key", "message"]
    within = Window.partitionBy("stream", "_part").orderBy(*by_time)
    parts = events.withColumn("_part", F.pmod(F.xxhash64(*by_time), F.lit(PARTS)))
    first = parts.withColumn("_i", F.row_number().over(within)).where(F.col("_i") <= most).drop("_part")
    kept = first.withColumn("_i", F.row_number().over(Window.partitionBy("stream").orderBy(*by_time))).where(F.col("_i") <= most).drop("_i")
    stats = events.groupBy("stream").agg(F.count(F.lit(1)).alias("total")).withColumn("fetched", F.least("total", F.lit(most)))
    return kept, stats.withColumn("truncated", F.col("total") > F.col("fetched"))


def correlate_logs(events: DataFrame, names: Sequence[str], how: str, stats: DataFrame | None = None) -> DataFrame:
    """key, completeness and n_events by one of three operators; `events_of` has the events themselves.

    `and`: keys on every stream. `or`: every key; complete where all streams have it. `unless`: keys of the first stream
    that no other has. One shuffle of counts on the key, after map-side aggregation, serves any number of streams and any
    number of events of one key. `stats` of capped streams adds a column `truncated`; `unless` with a truncated stream on
    the right is an error when the rows are computed, as keys could seem absent.
    """
    if how not in ("and", "or", "unless"):
        raise ValueError(f"no such operator: {how}")
    own = events.where(F.col("stream").isin(list(names)))
    # a set of stream names is as small as their number
    grouped = own.groupBy("key").agg(F.collect_set("stream").alias("_on"), F.count(F.lit(1)).alias("n_events"))
    whole = F.size("_on") == len(set(names))
    if how == "and":
        rows = grouped.where(whole)
    elif how == "or":
        rows = grouped
    else:
        rows = grouped.where((F.size("_on") == 1) & (F.get("_on", F.lit(0)) == names[0]))
    done = F.lit("partial") if how == "unless" else F.when(whole, "complete").otherwise("partial")
    rows = rows.select("key", done.alias("completeness"), "n_events")
    if stats is None:
        return rows
    cut = F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated")
    unsure = F.coalesce(F.bool_or(F.col("truncated") & F.col("stream").isin(list(names[1:]))), F.lit(False)).alias("_unsure")
    state = stats.agg(cut, unsure)
    if how == "unless":
        state = state.where(F.assert_true(~F.col("_unsure"), "truncated streams can't show that a key is absent").isNull())
    return rows.join(F.broadcast(state.drop("_unsure")))  # one row


def events_of(found: DataFrame, events: DataFrame, names: Sequence[str]) -> DataFrame:
    """The events of all streams in `names` with a key that `found` has, one row each."""
    return events.where(F.col("stream").isin(list(names))).join(found.select("key"), "key", "left_semi")


def _side(events: DataFrame, key: str, name: str) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col("ts").alias(f"{name}_ts"), F.col("message").alias(f"{name}_message")).where("key is not null")


def join_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, within_ms: int | None = None) -> DataFrame:
    """Each event of the left with each of the right whose key, of another name, is equal, and near in time if asked.

    A key that many events of either side share, in one stretch of time if that is bounded, is dealt over a grid of tasks.
    """
    a, b = _side(left, left_key, "left"), _side(right, right_key, "right")
    if within_ms is None:
        return pairs(a, b, ["key"])
    # events that are near lie in the same stretch of time or in neighbouring ones
    stretch = lambda ts: F.floor(F.unix_millis(ts) / F.lit(max(1, within_ms)))
    a = a.withColumn("_at", stretch("left_ts"))
    b = b.withColumn("_at", F.explode(F.array(*[stretch("right_ts") + F.lit(d) for d in (-1, 0, 1)])))
    near = F.abs(F.unix_millis("left_ts") - F.unix_millis("right_ts")) <= within_ms
    return pairs(a, b, ["key", "_at"]).where(near).drop("_at")


def join_to_one(many: DataFrame, one: DataFrame, many_key: str, one_key: str, keep: bool = False) -> DataFrame:
    """Each event of `many` with the one event of the other side that has its key: many_ts, many_message, one_ts, one_message.

    A key that occurs more than once on that side, and on the first, is an error when the rows are computed, as which one is
    meant can't be told; with `keep` events without a partner stay. Swap the sides for the other direction.
    """
    sizes = _side(many, many_key, "many").groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    single = _side(one, one_key, "one").groupBy("key").agg(F.count(F.lit(1)).alias("_ones"), F.min(F.struct("one_ts", "one_message")).alias("_one"))
    table = stored(single.join(sizes, "key"), "one-side")
    found = look_up(_side(many, many_key, "many"), table, ["key"], "_n", "left" if keep else "inner")
    clear = F.assert_true(F.coalesce(F.col("_ones") == 1, F.lit(True)), "a key has several events on the side that must have one").isNull()
    return found.where(clear).select("key", "many_ts", "many_message", "_one.one_ts", "_one.one_message")


def search_logs(logs: DataFrame, where: Column | Mapping[str, str], from_ts: Column, to_ts: Column, limit: int = CAP, ties: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """The first `limit` messages of the window that match, by time, and `total`; `where` is a predicate or label values."""
    if isinstance(where, Mapping):
        where = reduce(lambda a, b: a & b, [F.coalesce(F.col("labels")[k] == v, F.lit(False)) for k, v in where.items()], F.lit(True))
    found = logs.where(where & (F.col("ts") >= from_ts) & (F.col("ts") <= to_ts))
    return found.orderBy("ts", *ties).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))
