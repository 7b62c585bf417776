"""Cases of statistics, baselines, runs, windows and scores with exact results, and properties on random series."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as c
from tidewatch.operators import correlate, series, verdict, windows

NAN, INF = float("nan"), float("inf")
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def points(spark, values, key="s", first=0):
    rows = [(key, i, v) for i, v in enumerate(values, first)]
    df = spark.createDataFrame(rows, "series_key string, minute int, v double")
    return df.withColumn("t", F.timestamp_millis(F.col("minute") * 60000)).drop("minute")


def runs(spark, values, threshold, direction="below", chunk_ms=c.DAY):
    out = series.threshold_runs(points(spark, values), ["series_key"], F.lit(float(threshold)), direction, chunk_ms)
    return sorted((r.s, r.e, r.duration_ms, r.min_v, r.max_v, r.n) for r in out.select(F.unix_millis("start_t").alias("s"), F.unix_millis("end_t").alias("e"), "duration_ms", "min_v", "max_v", "n").collect())


@pytest.mark.parametrize(
    ("values", "threshold", "direction", "want"),
    [
        ([1, 1, 0.5, 0.2, 0.9, 1, 1], 1, "below", [(120000, 240000, 120000, 0.2, 0.9, 3)]),
        ([1, 0.5, 1, 1, 0.3, 0.4, 1], 1, "below", [(60000, 60000, 0, 0.5, 0.5, 1), (240000, 300000, 60000, 0.3, 0.4, 2)]),
        ([1, 0.5, 1], 1, "below", [(60000, 60000, 0, 0.5, 0.5, 1)]),
        ([0.5, None, 0.5], 1, "below", [(0, 0, 0, 0.5, 0.5, 1), (120000, 120000, 0, 0.5, 0.5, 1)]),
        ([1, 5, 6, 1], 3, "above", [(60000, 120000, 60000, 5.0, 6.0, 2)]),
        ([1, 1, 1], 1, "below", []),
        ([1, NAN, 5], 3, "above", [(120000, 120000, 0, 5.0, 5.0, 1)]),
        ([1, INF, 5], 3, "above", [(60000, 120000, 60000, 5.0, INF, 2)]),
    ],
)
def test_runs(spark, values, threshold, direction, want):
    assert runs(spark, [None if v is None else float(v) for v in values], threshold, direction) == want


def test_runs_do_not_depend_on_chunks(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 1.0, 2.0, None, NAN]) for _ in range(300)]
    want = runs(spark, values, 1.5)
    assert want == runs(spark, values, 1.5, chunk_ms=7 * c.MINUTE) == runs(spark, values, 1.5, chunk_ms=c.MINUTE)
    assert sum(r[5] for r in want) == sum(v is not None and not math.isnan(v) and v < 1.5 for v in values)


def test_runs_go_on_over_gaps_in_time(spark):
    df = points(spark, [0.0, 0.0]).unionByName(points(spark, [0.0, 5.0], first=10_000))
    assert [r.n for r in series.threshold_runs(df, ["series_key"], F.lit(1.0)).collect()] == [3]


def test_only_the_ends_of_chunks_are_put_in_order(spark):
    """Of alternating samples nearly every one is a run; what is sorted over a whole series is two runs a chunk."""
    values = [float(i % 2) for i in range(6_000)]
    out = series.threshold_runs(points(spark, values), ["series_key"], F.lit(0.5), chunk_ms=c.HOUR)
    assert out.count() == 3_000
    plan = series.runs_of(points(spark, values), ["series_key"], F.when(F.col("v") < 0.5, "low"), c.HOUR)._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line]
    assert whole and all("_chunk" in line or "_of" in line for line in whole)


def test_sides_change_at_the_ends_of_chunks(spark):
    rng = random.Random(3)
    values = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(400)]
    side = F.when(F.col("v") < 0, "low").when(F.col("v") > 0, "high")
    want = []
    for i, v in enumerate(values):
        if v and want and want[-1][0] == v and want[-1][2] == i - 1:
            want[-1][2] = i
        elif v:
            want.append([v, i, i])
    for chunk in (c.MINUTE, 3 * c.MINUTE, c.DAY):
        found = series.runs_of(points(spark, values), ["series_key"], side, chunk).select("side", F.unix_millis("start_t") / 60_000, F.unix_millis("end_t") / 60_000, "n").collect()
        assert sorted(tuple(r) for r in found) == sorted(("low" if v < 0 else "high", a, b, b - a + 1) for v, a, b in want)


def stats(spark, values):
    rows = series.series_stats(points(spark, values), ["series_key"]).collect()
    return rows[0] if rows else None


def test_stats(spark):
    r = stats(spark, [1.0, None, 3.0])
    assert (r.n, r["mean"], r["min"], r["max"], r.n_nonzero) == (2, 2.0, 1.0, 3.0, 2)
    assert stats(spark, []) is None
    assert stats(spark, [0.0, None, 0.0, 5.0]).n_nonzero == 1
    r = stats(spark, [NAN, INF, -INF, 2.0])
    assert (r.n, r["mean"], r.stddev) == (1, 2.0, 0.0)


def classified(spark, incident, *controls):
    own = series.series_stats(points(spark, incident), ["series_key"]) if incident else spark.createDataFrame([("s", None, None, None, None, 0, 0)], "series_key string, mean double, stddev double, min double, max double, n long, n_nonzero long")
    parts = [series.series_stats(points(spark, v), ["series_key"]).withColumn("label", F.lit(str(i))).withColumn("ord", F.lit(i)) for i, v in enumerate(controls)]
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p)
    return series.classify_baseline(own.join(series.pooled_baseline(frame, ["series_key"]), "series_key", "left")).first(), frame, own


@pytest.mark.parametrize(
    ("incident", "controls", "want"),
    [
        ([100, 102, 98, 105], [[10, 11, 9, 10], [9, 10, 11, 10]], "statistically-unusual"),
        ([10, 11, 9, 10], [[10, 11, 9, 10, 12, 8], [9, 10, 11, 10, 8, 12]], "common-during-normal-operations"),
        ([1, 2, 3], [[]], "insufficient-data"),
        ([], [[1, 2, 3]], "insufficient-data"),
        ([0] * 9 + [1], [[0] * 10, [0] * 10], "baseline-all-zero"),
        ([0, 0, 0, 0], [[0] * 4], "common-during-normal-operations"),
        ([5, 5, 5, 5], [[5] * 4], "common-during-normal-operations"),
        ([20] * 4, [[10] * 4, [20] * 4, [30] * 4], "common-during-normal-operations"),
    ],
)
def test_classes(spark, incident, controls, want):
    row, _, _ = classified(spark, [float(v) for v in incident], *[[float(v) for v in x] for x in controls])
    assert row["class"] == want
    assert (row.z is None) == (want in ("insufficient-data", "baseline-all-zero"))


def test_spread_between_windows_counts(spark):
    row, _, _ = classified(spark, [20.0] * 4, [10.0] * 4, [20.0] * 4, [30.0] * 4)
    assert row.pooled_stddev == pytest.approx(math.sqrt(200 / 3))


def test_short_dip_is_an_excursion(spark):
    values = [0.0 if 100 <= i <= 102 else 1.0 for i in range(200)]
    base = spark.createDataFrame([("s", 1.0, 0.0)], "series_key string, pooled_mean double, pooled_stddev double")
    rows = series.brief_excursions(points(spark, values).join(base, "series_key"), ["series_key"]).collect()
    assert [(r.duration_ms, r.min_v, r.max_v, r.n, r.direction) for r in rows] == [(120000, 0.0, 0.0, 3, "below")]


def test_recurring(spark):
    row, frame, own = classified(spark, [10.0, 11.0], [100.0, 101.0], [10.0, 11.0])
    rows = series.recurring_match(series.classify_baseline(own.join(series.pooled_baseline(frame, ["series_key"]), "series_key")), frame, ["series_key"]).collect()
    assert [r.recurring for r in rows] == ["1"]


def onset(spark, baseline, incident):
    base = series.series_stats(points(spark, [float(v) for v in baseline]), ["series_key"])
    rows = series.onset(points(spark, incident), base, ["series_key"]).select(F.unix_millis("onset").alias("ms")).collect()
    return rows[0].ms if rows else None


def test_onset(spark):
    assert onset(spark, [10] * 10, [10.0, 10.0, 50.0, 51.0]) == 120000
    assert onset(spark, [10, 11, 9, 10, 11, 9], [10.0, 11.0, 10.0]) is None
    assert onset(spark, [10] * 10, [10.0, NAN, INF, 51.0]) == 120000


def test_downsample(spark):
    df = points(spark, [float(i) for i in range(1000)])
    rows = series.downsample(df, ["series_key"], 5).orderBy("t").collect()
    assert [r.v for r in rows] == [0, 200, 400, 600, 999] and {r.total for r in rows} == {1000}
    assert series.downsample(df, ["series_key"], 1000).count() == 1000


@pytest.mark.parametrize(("n", "most", "chunk"), [(21_600, 2000, c.HOUR), (17, 16, c.MINUTE), (7, 3, c.DAY), (100, 1, c.DAY)])
def test_downsample_keeps_the_stride(spark, n, most, chunk):
    df = spark.range(n).select(F.lit("s").alias("series_key"), F.timestamp_millis(F.col("id") * 1000).alias("t"), F.col("id").cast("double").alias("v"))
    kept = sorted(int(r.v) for r in series.downsample(df, ["series_key"], most, chunk).collect())
    assert kept == sorted({*(i * n // most for i in range(most - 1)), n - 1})


def test_dip_is_in_the_runs_though_no_sample_of_it_is_kept(spark):
    df = spark.range(21_600).select(F.lit("s").alias("series_key"), F.timestamp_millis(F.col("id") * 1000).alias("t"), F.when(F.col("id").between(1, 3), 0.0).otherwise(1.0).alias("v"))
    assert [(r.n, r.min_v) for r in series.threshold_runs(df, ["series_key"], F.lit(1.0)).collect()] == [(3, 0.0)]
    kept = series.downsample(df, ["series_key"])
    assert kept.count() == 2000 and kept.where("v = 0").count() == 0


def test_resolution(spark):
    df = spark.createDataFrame([("s", 0), ("s", 10), ("s", 10), ("s", 40), ("s", 60), ("one", 5)], "series_key string, x long").withColumn("t", F.timestamp_millis("x"))
    assert [(r.series_key, r.points, r.gap_ms, r.span_ms) for r in series.resolution(df, ["series_key"]).collect()] == [("s", 4, 20, 60)]


def incidents(spark, *rows):
    return spark.createDataFrame(rows, "incident_id string, starts_at timestamp, ends_at timestamp")


def test_gaps_are_counted(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(n)) for k, n in (("a", 50), ("b", 100_000), ("c", 10**9)) for _ in range(rng.randrange(200, 300))] + [("one", 5), ("one", 5), ("two", 5), ("two", 12)]
    df = spark.createDataFrame(rows, "series_key string, ms long").selectExpr("series_key", "timestamp_millis(ms) AS t")
    want = {}
    for k in {k for k, _ in rows}:
        times = sorted({m for q, m in rows if q == k})
        gaps = sorted(b - a for a, b in zip(times, times[1:], strict=False))
        if gaps:
            want[k] = (len(times), gaps[len(gaps) // 2], times[-1] - times[0])
    for chunk in (c.DAY, 1_000):
        found = series.resolution(df, ["series_key"], chunk)
        assert {r.series_key: (r.points, r.gap_ms, r.span_ms) for r in found.collect()} == want
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_windows(spark):
    rows = windows.compute_windows(incidents(spark, ("a", at(0), at(10)))).collect()
    by = {r.label: (r.from_ts, r.to_ts) for r in rows}
    assert by["pre-incident"] == (at(-30), at(0)) and by["yesterday"] == (at(-1440), at(-1430)) and len(by) == 5
    assert windows.compute_windows(incidents(spark, ("a", at(0), at(10))), offsets=()).count() == 2
    long = windows.compute_windows(incidents(spark, ("a", at(0), at(90))))
    assert long.where("role = 'pre'").first().from_ts == at(-90)
    open_ = windows.compute_windows(incidents(spark, ("a", at(0), None)), now=F.lit(at(5)))
    assert open_.where("role = 'incident'").first().to_ts == at(5)
    with pytest.raises(Exception, match="ends before it starts"):
        windows.compute_windows(incidents(spark, ("a", at(10), at(0)))).collect()


def test_overlapping_controls(spark):
    kept, out = windows.exclude_overlapping(windows.compute_windows(incidents(spark, ("a", at(0), at(61)), ("b", at(0), at(60)))))
    assert {(r.incident_id, tuple(r.excluded)) for r in out.collect()} == {("a", ("prior-hour",))}
    assert kept.where("incident_id = 'b'").count() == 5


def test_samples_at_both_ends_are_inside(spark):
    rows = windows.compute_windows(incidents(spark, ("a", dt.datetime(1970, 1, 1, 0, 1), dt.datetime(1970, 1, 1, 0, 3))), offsets=())
    tagged = windows.tag_windows(points(spark, [1.0] * 6), rows).where("role = 'incident'")
    assert tagged.count() == 3
    assert windows.tag_windows(points(spark, [1.0]), rows.limit(0)).count() == 0


def test_samples_filter_reaches_the_scan(spark, small):
    from tidewatch.plans import series_queries as q

    plan = q.tagged(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "NestedLoop" not in plan


def test_steps():
    assert windows.bucket_step(2_000_000, 2000) == 1000 and windows.bucket_step(2_000_001, 2000) == 5000
    assert windows.bucket_step(10**12, 10) == c.DAY and windows.bucket_step(1, step_ms=77) == 77


def test_window_checks(spark):
    rows = windows.check_windows(incidents(spark, ("empty", at(0), at(0)), ("long", at(0), at(60 * 721)), ("open", at(0), None), ("good", at(0), at(5))), now=F.lit(at(60 * 25)))
    assert {r.incident_id for r in rows.collect()} == {"empty", "long", "open"}


def scored(spark, incident, before):
    own = series.series_stats(points(spark, [float(v) for v in incident]), ["series_key"])
    pre = series.series_stats(points(spark, [float(v) for v in before]), ["series_key"])
    first = series.onset(points(spark, [float(v) for v in incident]), pre, ["series_key"])
    joined = own.join(pre.select("series_key", F.col("mean").alias("pooled_mean"), F.col("stddev").alias("pooled_stddev")), "series_key", "left").join(first, "series_key", "left")
    labels = F.create_map(F.lit("a"), F.lit("1"))
    return correlate.score_candidates(joined.withColumns({"primary_onset": F.timestamp_millis(F.lit(60000)), "labels": labels, "primary_labels": labels})).first()


def test_scores(spark):
    presence, flat, spike = scored(spark, [0, 5, 5, 5], [0, 0, 0, 0]), scored(spark, [0] * 4, [0] * 4), scored(spark, [100, 102, 98, 105], [10, 11, 9, 10])
    assert presence.score > 0 and flat.score == 0 and spike.z > 3 and spike.score > 3
    assert presence.magnitude == pytest.approx(3 * 3 / 4) and presence.score == pytest.approx(2.25 * 2 * 2)


FACTS = "class string, z double, n_excursions int, threshold_crossed boolean, candidates array<struct<title:string,score:double>>, adhoc boolean, warnings array<string>"
HIT = [("Checkout", 2.0), ("Checkout", 1.5), ("Payments", 0.5)]


@pytest.mark.parametrize(
    ("facts", "want"),
    [
        (("insufficient-data", None, 0, None, HIT, False, []), ("inconclusive", "low", "unknown")),
        (("baseline-all-zero", None, 1, True, [], False, []), ("real-anomaly", "medium", "isolated")),
        (("baseline-all-zero", None, 1, None, HIT, False, []), ("inconclusive", "medium", "1 dashboards: Checkout")),
        (("baseline-all-zero", None, 1, False, [], False, []), ("inconclusive", "low", "isolated")),
        (("statistically-unusual", 9.0, 0, True, HIT, False, []), ("real-anomaly", "high", "1 dashboards: Checkout")),
        (("statistically-unusual", 9.0, 0, None, [], False, []), ("real-anomaly", "medium", "isolated")),
        (("statistically-unusual", 9.0, 0, False, [], False, []), ("inconclusive", "low", "isolated")),
        (("common-during-normal-operations", 0.1, 2, True, [], False, []), ("inconclusive", "low", "isolated")),
        (("common-during-normal-operations", 0.1, 0, None, [], False, []), ("likely-false-positive", "medium", "none")),
    ],
)
def test_verdicts(spark, facts, want):
    row = verdict.summarize_findings(spark.createDataFrame([facts], FACTS)).first()
    assert (row.verdict, row.confidence, row.scope) == want
    assert ("whether the threshold was crossed" in row.missing) == (facts[3] is None)


def test_handwritten_evidence_and_warnings_carry_over(spark):
    row = verdict.summarize_findings(spark.createDataFrame([("statistically-unusual", 9.0, 0, True, [], True, ["w"])], FACTS)).first()
    assert row.missing == ["w"] and any("hand-written" in r for r in row.reasons)


def test_rounding_keeps_the_sign_of_zero(spark):
    import duckdb

    from tidewatch.plans.registry import plain, r6

    values = [-4e-16, -0.0, 0.0, 4e-16, -4.9e-7, -1.2345675, 2.5, NAN, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(r6("v")).collect()]
    sql = plain("SELECT round(v, 6) FROM (SELECT unnest($v::DOUBLE[]) AS v)")
    assert list(map(repr, got)) == [repr(r[0]) for r in duckdb.connect().execute(sql, {"v": values}).fetchall()]


def test_runs_are_sorted_once_a_step(spark):
    found = series.threshold_runs(points(spark, [1.0, 9.0, 9.0, 1.0]), ["series_key"], F.lit(5.0), "above")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Window [") == 4  # two for each: within chunks, and over their ends
    assert series.cap_runs(found, ["series_key"])._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_verdicts_score_once_and_take_errors_alone(spark, small):
    from tidewatch.plans import series_queries

    seen, own = [], series.series_stats
    try:
        series.series_stats = lambda rows, keys: seen.append({r[0] for r in rows.select("series_key").distinct().collect()}) or own(rows, keys)
        series_queries.verdicts(spark, small)
    finally:
        series.series_stats = own
    assert all(k.startswith("A|event_type=error,") for k in seen[0]) and seen[0]


def test_equal_values_do_not_deviate_however_they_are_dealt(spark):
    """Parts of three to twelve values, of series whose only value is 0.01, 0.02 and so on; a pooled one has five equal windows."""
    rows = spark.range(0, 30_000, 1, 5).select((F.col("id") % 997).alias("k"), ((F.col("id") % 997 + 1) / 100).alias("v"), F.lit(None).cast("timestamp").alias("t"))
    found = series.series_stats(rows, ["k"]).where("stddev <> 0 or mean <> min or mean <> max")
    assert found.count() == 0
    windows_ = spark.range(0, 4_985, 1, 2).select((F.col("id") % 997).alias("k"), ((F.col("id") % 997 + 1) / 100).alias("mean"), F.lit(0.0).alias("stddev"), F.lit(1).alias("n"))
    assert series.pooled_baseline(windows_, ["k"]).where("pooled_stddev <> 0").count() == 0
