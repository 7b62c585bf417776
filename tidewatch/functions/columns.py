"""Column expressions that the operators share.

Comparisons guard against NaN, which Spark orders above every number; aggregates skip what is not finite.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY, WEEK = 1_000, 60_000, 3_600_000, 86_400_000, 604_800_000


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(v: Column) -> Column:
    """`v` where it is a finite number, else null."""
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def above(v: Column, threshold: Column) -> Column:
    return F.coalesce((v > threshold) & ~F.isnan(v) & ~F.isnan(threshold), F.lit(False))


def below(v: Column, threshold: Column) -> Column:
    return F.coalesce((v < threshold) & ~F.isnan(v) & ~F.isnan(threshold), F.lit(False))


def at_least(v: Column, threshold: Column) -> Column:
    return F.coalesce((v >= threshold) & ~F.isnan(v) & ~F.isnan(threshold), F.lit(False))


def effective_stddev(mean: Column, stddev: Column) -> Column:
    """The deviation, or one per cent of the mean where it is zero, or a tiny number where both are."""
    return F.coalesce(F.nullif(stddev, F.lit(0.0)), F.nullif(F.abs(mean) * 0.01, F.lit(0.0)), F.lit(1e-9))


def later(ts: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + ms.cast("bigint") * 1000)


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Windows that only touch do not overlap."""
    return (a_from < b_to) & (b_from < a_to)


def series_key(ref_id: Column, labels: Column) -> Column:
    """`ref|k=v,k=v` with the labels sorted by code unit."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(ref_id, F.lit("|"), F.array_join(pairs, ","))


def match_labels(labels: Column, wanted: Mapping[str, str]) -> Column:
    """All wanted pairs are there, case-sensitive."""
    every = F.lit(True)
    for k, v in wanted.items():
        every = every & F.coalesce(labels[k] == v, F.lit(False))
    return every


def match_text(text: str, *columns: Column) -> Column:
    """Any column contains the text, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return found


def label_overlap(primary: Column, candidate: Column) -> Column:
    """How many pairs of `primary` hold in `candidate`, whose values are strings."""
    return F.size(F.filter(F.map_entries(primary), lambda e: F.element_at(candidate, e["key"]) == e["value"]))


def label_overlap_lists(primary: Column, candidate: Column) -> Column:
    """How many pairs of `primary` occur in `candidate`, whose values are lists."""
    return F.size(F.filter(F.map_entries(primary), lambda e: F.array_contains(F.element_at(candidate, e["key"]), e["value"])))


def number_text(v: Column) -> Column:
    """A double as text, whole numbers without a fraction; null and numbers that are not finite as they are."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_text(ms: Column) -> Column:
    """Milliseconds in their largest whole unit."""
    text = F.concat(ms.cast("string"), F.lit("ms"))
    for unit, size in (("s", SECOND), ("m", MINUTE), ("h", HOUR), ("d", DAY)):
        text = F.when((ms % size == 0) & (ms != 0), F.concat((ms / size).cast("bigint").cast("string"), F.lit(unit))).otherwise(text)
    return text


def dashboard_link(base: Column, uid: Column, panel_id: Column, from_ts: Column, to_ts: Column, variables: Column | None = None) -> Column:
    """A link to a dashboard with the panel, the window and `var-` parameters, where these are known."""
    parts = [
        F.concat(F.lit("viewPanel="), panel_id.cast("string")),
        F.concat(F.lit("from="), F.unix_millis(from_ts).cast("string")),
        F.concat(F.lit("to="), F.unix_millis(to_ts).cast("string")),
    ]
    if variables is not None:
        pairs = F.transform(F.array_sort(F.map_entries(variables)), lambda e: F.concat(F.lit("var-"), F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
        parts.append(F.nullif(F.array_join(pairs, "&"), F.lit("")))
    query = F.concat_ws("&", *parts)
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/d/"), F.url_encode(uid), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folder_link(base: Column, uid: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/dashboards/f/"), F.url_encode(uid))


def log_link(base: Column, query: Column, from_ts: Column, to_ts: Column, stream: Column | None = None) -> Column:
    """A link to a log search in a fixed window."""
    path = F.lit("/search") if stream is None else F.when(stream.isNull(), "/search").otherwise(F.concat(F.lit("/streams/"), F.url_encode(stream), F.lit("/search")))
    return F.concat(F.rtrim(base, F.lit("/")), path, F.lit("?q="), F.url_encode(query), F.lit("&rangetype=absolute&from="), F.url_encode(iso(from_ts)), F.lit("&to="), F.url_encode(iso(to_ts)))


