"""Windows, statistics, baselines, runs and correlation over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as c
from tidewatch.operators import correlate, series, verdict, windows
from tidewatch.plans.registry import EFFECTIVE, SAMPLES, USER_SAMPLES, WINDOWS, incidents, ms, r6, register, samples
from tidewatch.session import stored

KEYS = ["incident_id", "series_key"]
WINDOW = ["incident_id", "role", "label", "ord", "series_key"]


def all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.compute_windows(incidents(spark, sf_dir))


def kept_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(windows.exclude_overlapping(all_windows(spark, sf_dir))[0], "windows")


def tagged(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    return windows.tag_windows(samples(spark, sf_dir, by_user), kept_windows(spark, sf_dir))


TAGGED = f"""{WINDOWS}, tagged AS (
  SELECT s.*, w.incident_id, w.role, w.label, w.ord, w.from_ts, w.to_ts
  FROM samples s JOIN flagged w ON s.t >= w.from_ts AND s.t <= w.to_ts AND NOT w.overlaps_incident)"""
STATS = f"""{TAGGED}, stats AS (
  SELECT incident_id, role, label, ord, series_key, avg(v) AS mean, stddev_pop(v) AS stddev, min(v) AS min, max(v) AS max,
         count(v) AS n, count(CASE WHEN v <> 0 THEN 1 END) AS n_nonzero
  FROM tagged WHERE isfinite(v) OR v IS NULL GROUP BY ALL),
pooled AS (
  SELECT incident_id, series_key, avg(mean) AS pooled_mean, sqrt(avg(stddev * stddev) + var_pop(mean)) AS pooled_stddev, count(*) AS n_controls
  FROM stats WHERE role = 'control' AND n > 0 GROUP BY ALL)"""
CLASSED = f"""{STATS}, joined AS (
  SELECT s.*, pooled_mean, pooled_stddev, n_controls FROM stats s LEFT JOIN pooled USING (incident_id, series_key) WHERE role = 'incident'),
scored AS (
  SELECT *, CASE WHEN n = 0 OR pooled_mean IS NULL OR (pooled_mean = 0 AND pooled_stddev = 0 AND n_nonzero > 0) THEN NULL
                 ELSE (mean - pooled_mean) / {EFFECTIVE.format(mean="pooled_mean", sd="pooled_stddev")} END AS z FROM joined),
classed AS (
  SELECT *, CASE WHEN n = 0 OR pooled_mean IS NULL THEN 'insufficient-data'
                 WHEN pooled_mean = 0 AND pooled_stddev = 0 AND n_nonzero > 0 THEN 'baseline-all-zero'
                 WHEN abs(z) >= 3 THEN 'statistically-unusual' ELSE 'common-during-normal-operations' END AS class FROM scored)"""


@register("q_f1_windows", f"WITH {WINDOWS} SELECT incident_id, role, label, ord, epoch_ms(from_ts) AS from_ms, epoch_ms(to_ts) AS to_ms FROM windows")
def f1(spark, sf_dir):
    return all_windows(spark, sf_dir).select("incident_id", "role", "label", "ord", ms("from_ts").alias("from_ms"), ms("to_ts").alias("to_ms"))


@register("q_f1_checks", "SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 3 = 0 THEN 'the window is empty' WHEN o_orderkey % 3 = 1 THEN 'the window is longer than the look-back limit' ELSE 'the incident is open and long; give it an end' END AS problem, o_orderkey % 3 < 2 AS fatal FROM orders WHERE o_orderkey % 4 <> 3")
def f1_checks(spark, sf_dir):
    """Orders as incidents: empty, too long, open for two days, or good."""
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    span = F.when(key % 3 == 0, 0).when(key % 3 == 1, 721).otherwise(48)
    span = F.when(key % 4 == 3, 5).otherwise(span)
    end = F.when((key % 4 == 3) | (key % 3 != 2), c.later(start, span.cast("bigint") * c.HOUR))
    now = c.later(F.col("starts_at"), F.lit(48 * c.HOUR))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("incident_id"), start.alias("starts_at"), end.alias("ends_at"))
    return windows.check_windows(orders, now=now)


@register("q_f2_overlaps", f"WITH {WINDOWS} SELECT a.incident_id, a.label AS a, b.label AS b FROM windows a JOIN windows b ON a.incident_id = b.incident_id AND a.ord < b.ord AND a.from_ts < b.to_ts AND b.from_ts < a.to_ts")
def f2(spark, sf_dir):
    a = all_windows(spark, sf_dir).select("incident_id", F.col("label").alias("a"), F.col("ord").alias("ao"), F.col("from_ts").alias("af"), F.col("to_ts").alias("at"))
    b = all_windows(spark, sf_dir).select("incident_id", F.col("label").alias("b"), F.col("ord").alias("bo"), F.col("from_ts").alias("bf"), F.col("to_ts").alias("bt"))
    met = a.join(b, "incident_id").where((F.col("ao") < F.col("bo")) & c.overlaps(F.col("af"), F.col("at"), F.col("bf"), F.col("bt")))
    return met.select("incident_id", "a", "b")


@register("q_f3_kept", f"WITH {WINDOWS} SELECT incident_id, label FROM flagged WHERE NOT overlaps_incident")
def f3(spark, sf_dir):
    return kept_windows(spark, sf_dir).select("incident_id", "label")


@register("q_f3_excluded", f"WITH {WINDOWS} SELECT incident_id, string_agg(label, ',' ORDER BY ord) AS excluded FROM flagged WHERE overlaps_incident GROUP BY incident_id")
def f3_excluded(spark, sf_dir):
    out = windows.exclude_overlapping(all_windows(spark, sf_dir))[1]
    return out.select("incident_id", F.array_join("excluded", ",").alias("excluded"))


@register("q_f4_tagged", f"WITH {SAMPLES}, {TAGGED} SELECT incident_id, label, event_id, series_key FROM tagged")
def f4(spark, sf_dir):
    return tagged(spark, sf_dir).select("incident_id", "label", "event_id", "series_key")


RANGES = """WITH requests AS (
  SELECT o_orderkey AS id, o_orderdate AS d,
         CASE o_orderkey % 5 WHEN 0 THEN 'now-6h' WHEN 1 THEN CAST(epoch_ms(o_orderdate) AS VARCHAR) END AS ef,
         CASE o_orderkey % 5 WHEN 0 THEN 'now' WHEN 1 THEN CAST(epoch_ms(o_orderdate) + 60000 AS VARCHAR) END AS et,
         CASE o_orderkey % 5 WHEN 2 THEN 'now-2d' WHEN 3 THEN 'now-1M' END AS lf, CASE o_orderkey % 5 WHEN 2 THEN 'now-90s' WHEN 3 THEN 'now-1w' END AS lt
  FROM orders)
SELECT id,
  epoch_ms(CASE id % 5 WHEN 0 THEN TIMESTAMP '2024-03-31 12:00:00' - INTERVAL 6 HOUR WHEN 1 THEN d WHEN 2 THEN TIMESTAMP '2024-03-31 12:00:00' - INTERVAL 2 DAY
    WHEN 3 THEN TIMESTAMP '2024-02-29 12:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END) AS from_ms,
  epoch_ms(CASE id % 5 WHEN 0 THEN TIMESTAMP '2024-03-31 12:00:00' WHEN 1 THEN d + INTERVAL 1 MINUTE WHEN 2 THEN TIMESTAMP '2024-03-31 12:00:00' - INTERVAL 90 SECOND
    WHEN 3 THEN TIMESTAMP '2024-03-24 12:00:00' ELSE TIMESTAMP '2023-03-31 12:00:00' END) AS to_ms
FROM requests"""


@register("q_f6_ranges", RANGES)
def f6(spark, sf_dir):
    key = F.col("o_orderkey") % 5
    day = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"),
        F.when(key == 0, "now-6h").when(key == 1, day.cast("string")).alias("explicit_from"),
        F.when(key == 0, "now").when(key == 1, (day + 60000).cast("string")).alias("explicit_to"),
        F.when(key == 2, "now-2d").when(key == 3, "now-1M").alias("link_from"),
        F.when(key == 2, "now-90s").when(key == 3, "now-1w").alias("link_to"),
        F.lit("2024-01-01T00:00:00Z").alias("saved_from"),
        F.lit("now-1y").alias("saved_to"),
    )
    return windows.resolve_ranges(requests, F.lit("2024-03-31 12:00:00").cast("timestamp")).select("id", ms("from_ts").alias("from_ms"), ms("to_ts").alias("to_ms"))


@register("q_f7_buckets", f"WITH {SAMPLES} SELECT series_key, epoch_ms(t) // 3600000 * 3600000 AS t_ms, round(avg(CASE WHEN isfinite(v) THEN v END), 6) AS v FROM samples GROUP BY ALL")
def f7(spark, sf_dir):
    return windows.bucketize(samples(spark, sf_dir), 30 * c.DAY, 1000).select("series_key", ms("t").alias("t_ms"), r6("v").alias("v"))


@register("q_f15_series_key", f"WITH {USER_SAMPLES} SELECT series_key, count(*) AS n FROM samples GROUP BY ALL")
def f15(spark, sf_dir):
    rows = samples(spark, sf_dir, by_user=True).select(c.series_key(F.col("ref_id"), F.col("labels")).alias("series_key"))
    return rows.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))


def stats(spark, sf_dir, by_user=False):
    return stored(series.series_stats(tagged(spark, sf_dir, by_user), WINDOW), "stats")


@register("q_a1_series_stats", f"WITH {SAMPLES}, {STATS} SELECT incident_id, label, series_key, round(mean, 6) AS mean, round(stddev, 6) AS stddev, min, max, n, n_nonzero FROM stats")
def a1(spark, sf_dir):
    return stats(spark, sf_dir).select("incident_id", "label", "series_key", r6("mean").alias("mean"), r6("stddev").alias("stddev"), "min", "max", "n", "n_nonzero")


def pooled(rows: DataFrame) -> DataFrame:
    return series.pooled_baseline(rows.where("role = 'control'"), KEYS)


@register("q_a2_pooled", f"WITH {SAMPLES}, {STATS} SELECT incident_id, series_key, round(pooled_mean, 6) AS pooled_mean, round(pooled_stddev, 6) AS pooled_stddev, n_controls FROM pooled")
def a2(spark, sf_dir):
    return pooled(stats(spark, sf_dir)).select(*KEYS, r6("pooled_mean").alias("pooled_mean"), r6("pooled_stddev").alias("pooled_stddev"), "n_controls")


@register("q_a3_effective_stddev", f"WITH {SAMPLES}, {STATS} SELECT incident_id, label, series_key, round({EFFECTIVE.format(mean='mean', sd='stddev')}, 6) AS eff FROM stats")
def a3(spark, sf_dir):
    return stats(spark, sf_dir).select("incident_id", "label", "series_key", r6(c.effective_stddev(F.col("mean"), F.col("stddev"))).alias("eff"))


def classified(rows: DataFrame) -> DataFrame:
    """The incident's series against their pooled controls; a series without any control stays."""
    return series.classify_baseline(rows.where("role = 'incident'").join(pooled(rows), KEYS, "left"))


CLASS_COLUMNS = "incident_id, series_key, n, round(mean, 6) AS mean, round(pooled_mean, 6) AS pooled_mean, round(pooled_stddev, 6) AS pooled_stddev, round(z, 6) AS z, class"


def class_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "n", r6("mean").alias("mean"), r6("pooled_mean").alias("pooled_mean"), r6("pooled_stddev").alias("pooled_stddev"), r6("z").alias("z"), "class")


@register("q_a4_classes", f"WITH {SAMPLES}, {CLASSED} SELECT {CLASS_COLUMNS} FROM classed")
def a4(spark, sf_dir):
    return class_columns(classified(stats(spark, sf_dir)))


@register("q_j1_controls_by_series", f"WITH {USER_SAMPLES}, {CLASSED} SELECT {CLASS_COLUMNS} FROM classed")
def j1(spark, sf_dir):
    return class_columns(classified(stats(spark, sf_dir, by_user=True)))


@register("q_a5_recurring", f"""WITH {SAMPLES}, {CLASSED} SELECT a.incident_id, a.series_key, arg_min(s.label, s.ord) AS recurring
FROM classed a JOIN stats s ON a.incident_id = s.incident_id AND a.series_key = s.series_key AND s.role = 'control' AND s.n > 0
WHERE a.class = 'common-during-normal-operations' AND abs(s.mean - a.mean) <= 1.5 * coalesce(nullif(s.stddev, 0), 1) GROUP BY ALL""")  # fmt: skip
def a5(spark, sf_dir):
    rows = stats(spark, sf_dir)
    return series.recurring_match(classified(rows), rows.where("role = 'control'"), KEYS)


RUNS = """rows AS (SELECT *, coalesce({on}, false) AS crosses FROM {source}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t) AS i FROM rows),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY t) AS run FROM numbered WHERE crosses),
runs AS (SELECT {keys}, min(t) AS start_t, max(t) AS end_t, epoch_ms(max(t)) - epoch_ms(min(t)) AS duration_ms, min(v) AS min_v, max(v) AS max_v, count(*) AS n
         FROM islands GROUP BY {keys}, run)"""
RUN_COLUMNS = "epoch_ms(start_t) AS start_ms, epoch_ms(end_t) AS end_ms, duration_ms, min_v, max_v, n"


def run_columns(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.select(*keys, ms("start_t").alias("start_ms"), ms("end_t").alias("end_ms"), "duration_ms", "min_v", "max_v", "n")


for _direction, _sign, _at in (("below", "<", 20.0), ("above", ">", 80.0)):

    def _runs(spark, sf_dir, direction=_direction, at=_at):
        return run_columns(series.threshold_runs(samples(spark, sf_dir), ["series_key"], F.lit(at), direction), "series_key")

    register(f"q_r1_runs_{_direction}", f"WITH {SAMPLES}, {RUNS.format(on=f'v {_sign} {_at} AND NOT isnan(v)', source='samples', keys='series_key')} SELECT series_key, {RUN_COLUMNS} FROM runs")(_runs)


PRE = f"""{STATS}, based AS (SELECT incident_id, series_key, mean, stddev FROM stats WHERE role = 'pre' AND mean IS NOT NULL),
onsets AS (
  SELECT t.incident_id, t.series_key, min(t.t) AS onset FROM tagged t JOIN based b USING (incident_id, series_key)
  WHERE t.role = 'incident' AND NOT isnan(t.v) AND abs(t.v - b.mean) / {EFFECTIVE.format(mean="b.mean", sd="b.stddev")} >= 2 GROUP BY ALL)"""


def onsets(spark, sf_dir, by_user=False):
    rows = tagged(spark, sf_dir, by_user)
    base = series.series_stats(rows.where("role = 'pre'"), KEYS)
    return series.onset(rows.where("role = 'incident'"), base, KEYS)


@register("q_r2_onset", f"WITH {SAMPLES}, {PRE} SELECT incident_id, series_key, epoch_ms(onset) AS onset_ms FROM onsets")
def r2(spark, sf_dir):
    return onsets(spark, sf_dir).select(*KEYS, ms("onset").alias("onset_ms"))


@register("q_r3_primary_onset", f"WITH {USER_SAMPLES}, {PRE} SELECT incident_id, epoch_ms(min(onset)) AS onset_ms FROM onsets WHERE series_key LIKE 'A|event_type=error,%' GROUP BY ALL")
def r3(spark, sf_dir):
    own = onsets(spark, sf_dir, by_user=True).where(F.col("series_key").startswith("A|event_type=error,"))
    return series.primary_onset(own, ["incident_id"]).select("incident_id", ms("primary_onset").alias("onset_ms"))


EXCURSIONS = f"""{STATS}, inside AS (
  SELECT t.*, pooled_mean, {EFFECTIVE.format(mean="pooled_mean", sd="pooled_stddev")} AS eff FROM tagged t JOIN pooled USING (incident_id, series_key) WHERE t.role = 'incident'),
low AS (WITH {RUNS.format(on="v < pooled_mean - 2 * eff AND NOT isnan(v)", source="inside", keys="incident_id, series_key")} SELECT *, 'below' AS direction FROM runs),
high AS (WITH {RUNS.format(on="v > pooled_mean + 2 * eff AND NOT isnan(v)", source="inside", keys="incident_id, series_key")} SELECT *, 'above' AS direction FROM runs),
excursions AS (SELECT * FROM low UNION ALL SELECT * FROM high)"""


def excursions(spark, sf_dir, by_user=False):
    rows = tagged(spark, sf_dir, by_user)
    base = pooled(series.series_stats(rows.where("role = 'control'"), WINDOW))
    return series.brief_excursions(rows.where("role = 'incident'").join(base, KEYS), KEYS)


@register("q_r4_excursions", f"WITH {SAMPLES}, {EXCURSIONS} SELECT incident_id, series_key, direction, {RUN_COLUMNS} FROM excursions")
def r4(spark, sf_dir):
    return run_columns(excursions(spark, sf_dir), *KEYS, "direction")


@register("q_u2_union_of_runs", f"WITH {SAMPLES}, {EXCURSIONS} SELECT incident_id, direction, count(*) AS runs, sum(n) AS points FROM excursions GROUP BY ALL")
def u2(spark, sf_dir):
    return excursions(spark, sf_dir).groupBy("incident_id", "direction").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("points"))


@register("q_r5_downsample", f"""WITH {SAMPLES}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_key) AS total FROM samples),
kept AS (SELECT DISTINCT series_key, (j * total) // 300 AS i FROM (SELECT DISTINCT series_key, total FROM numbered), generate_series(0, 298) s(j) WHERE total > 300)
SELECT n.series_key, event_id, epoch_ms(t) AS t_ms, v, total FROM numbered n LEFT JOIN kept k ON n.series_key = k.series_key AND n.i = k.i
WHERE total <= 300 OR k.i IS NOT NULL OR n.i = total - 1""")  # fmt: skip
def r5(spark, sf_dir):
    return series.downsample(samples(spark, sf_dir), ["series_key"], 300).select("series_key", "event_id", ms("t").alias("t_ms"), "v", "total")


@register("q_r6_capped_runs", f"""WITH {SAMPLES}, {RUNS.format(on="v < 20.0", source="samples", keys="series_key")}
SELECT series_key, {RUN_COLUMNS}, total FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY start_t, end_t) AS i, count(*) OVER (PARTITION BY series_key) AS total FROM runs) WHERE i <= 25""")  # fmt: skip
def r6_capped(spark, sf_dir):
    runs = series.cap_runs(series.threshold_runs(samples(spark, sf_dir), ["series_key"], F.lit(20.0)), ["series_key"], 25)
    return runs.select("series_key", ms("start_t").alias("start_ms"), ms("end_t").alias("end_ms"), "duration_ms", "min_v", "max_v", "n", "total")


@register("q_a12_resolution", f"""WITH {SAMPLES}, times AS (SELECT DISTINCT series_key, epoch_ms(t) AS m FROM samples),
gaps AS (SELECT series_key, m, m - lag(m) OVER (PARTITION BY series_key ORDER BY m) AS gap FROM times),
ranked AS (SELECT series_key, gap, row_number() OVER (PARTITION BY series_key ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY series_key) AS k FROM gaps WHERE gap IS NOT NULL)
SELECT t.series_key, count(*) AS points, any_value(r.gap) AS gap_ms, max(m) - min(m) AS span_ms FROM times t JOIN ranked r ON t.series_key = r.series_key AND r.i = r.k // 2 GROUP BY t.series_key""")  # fmt: skip
def a12(spark, sf_dir):
    return series.resolution(samples(spark, sf_dir), ["series_key"])


SCORED = f"""{PRE}, marks AS (SELECT incident_id, min(onset) AS primary_onset FROM onsets WHERE series_key LIKE 'A|event_type=error,%' GROUP BY ALL),
joined2 AS (
  SELECT s.*, regexp_extract(s.series_key, 'event_type=([^,]*)', 1) AS kind, regexp_extract(s.series_key, 'user=(.*)$', 1) AS usr, b.mean AS pm, b.stddev AS ps, b.mean IS NOT NULL AS has, onset, primary_onset
  FROM stats s LEFT JOIN based b USING (incident_id, series_key) LEFT JOIN onsets USING (incident_id, series_key) LEFT JOIN marks USING (incident_id)
  WHERE s.role = 'incident'),
zs AS (SELECT *, pm = 0 AND ps = 0 AND n_nonzero > 0 AS zero, CASE WHEN n > 0 AND has AND NOT (pm = 0 AND ps = 0 AND n_nonzero > 0) THEN (mean - pm) / {EFFECTIVE.format(mean="pm", sd="ps")} END AS z FROM joined2),
cands AS (
  SELECT *, epoch_ms(onset) - epoch_ms(primary_onset) AS lag_ms, (CASE WHEN usr = '8' THEN 1 ELSE 0 END) AS overlap,
         CASE WHEN zero AND n > 0 AND has THEN 3.0 * n_nonzero / greatest(n, 1) ELSE coalesce(z, 0) END AS magnitude FROM zs WHERE kind <> 'error'),
ranks AS (
  SELECT *, abs(magnitude) * (1 + overlap) * (1 + coalesce(1 / (1 + abs(lag_ms) / 60000), 0)) AS score FROM cands)"""


def scored(spark, sf_dir, rows=None):
    """Series of other event types as candidates; the primary panel shows errors, and its alert names user 8."""
    rows = tagged(spark, sf_dir, by_user=True) if rows is None else rows
    own = series.series_stats(rows.where("role = 'incident'"), [*KEYS, "event_type", "user_id"])
    base = stored(series.series_stats(rows.where("role = 'pre'"), KEYS).where("n > 0"), "before")
    first = series.onset(rows.where("role = 'incident'"), base, KEYS)
    primary = series.primary_onset(first.where(F.col("series_key").startswith("A|event_type=error,")), ["incident_id"])
    base = base.select(*KEYS, F.col("mean").alias("pooled_mean"), F.col("stddev").alias("pooled_stddev"))
    joined = own.where("event_type <> 'error'").join(base, KEYS, "left").join(first, KEYS, "left").join(primary, "incident_id", "left")
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    facts = joined.withColumn("labels", labels).withColumn("primary_labels", F.create_map(F.lit("event_type"), F.lit("error"), F.lit("user"), F.lit("8")))
    return correlate.score_candidates(facts)


@register("q_j2_pre_window_by_series", f"WITH {USER_SAMPLES}, {SCORED} SELECT incident_id, series_key, n, round(pm, 6) AS pre_mean, round(z, 6) AS z FROM ranks")
def j2(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, "n", r6("pooled_mean").alias("pre_mean"), r6("z").alias("z"))


@register("q_a7_scores", f"WITH {USER_SAMPLES}, {SCORED} SELECT incident_id, series_key, round(magnitude, 6) AS magnitude, overlap::INT AS overlap, lag_ms, round(score, 6) AS score FROM ranks")
def a7(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, r6("magnitude").alias("magnitude"), "overlap", "lag_ms", r6("score").alias("score"))


@register("q_t1_top_candidates", f"""WITH {USER_SAMPLES}, {SCORED} SELECT incident_id, series_key, round(score, 6) AS score, rank::INT AS rank, total FROM (
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, series_key) AS rank, count(*) OVER (PARTITION BY incident_id) AS total FROM ranks) WHERE rank <= 10""")  # fmt: skip
def t1(spark, sf_dir):
    return correlate.top_candidates(scored(spark, sf_dir), ["incident_id"]).select(*KEYS, r6("score").alias("score"), "rank", "total")


@register("q_tool_detect_correlated", f"""WITH {USER_SAMPLES}, {SCORED} SELECT incident_id, series_key, class, round(z, 6) AS z, lag_ms, round(score, 6) AS score, rank::INT AS rank FROM (
SELECT *, CASE WHEN n = 0 OR NOT has THEN 'insufficient-data' WHEN zero THEN 'baseline-all-zero' WHEN abs(z) >= 3 THEN 'statistically-unusual' ELSE 'common-during-normal-operations' END AS class,
row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, series_key) AS rank FROM ranks) WHERE rank <= 10""")  # fmt: skip
def detect(spark, sf_dir):
    return correlate.top_candidates(scored(spark, sf_dir), ["incident_id"]).select(*KEYS, "class", r6("z").alias("z"), "lag_ms", r6("score").alias("score"), "rank")


@register("q_tool_validate_baseline", f"""WITH {SAMPLES}, {CLASSED}, inside AS (
  SELECT t.*, pooled_mean, {EFFECTIVE.format(mean="pooled_mean", sd="pooled_stddev")} AS eff FROM tagged t JOIN pooled USING (incident_id, series_key) WHERE t.role = 'incident'),
low AS (WITH {RUNS.format(on="v < pooled_mean - 2 * eff", source="inside", keys="incident_id, series_key")} SELECT incident_id, series_key, count(*) AS k FROM runs GROUP BY ALL),
high AS (WITH {RUNS.format(on="v > pooled_mean + 2 * eff", source="inside", keys="incident_id, series_key")} SELECT incident_id, series_key, count(*) AS k FROM runs GROUP BY ALL),
out AS (SELECT incident_id, string_agg(label, ',' ORDER BY ord) AS excluded FROM flagged WHERE overlaps_incident GROUP BY incident_id)
SELECT c.incident_id, c.series_key, round(z, 6) AS z, class, (coalesce(low.k, 0) + coalesce(high.k, 0))::BIGINT AS n_excursions, excluded
FROM classed c LEFT JOIN low USING (incident_id, series_key) LEFT JOIN high USING (incident_id, series_key) LEFT JOIN out USING (incident_id)""")  # fmt: skip
def validate_baseline(spark, sf_dir):
    """Each incident's series against the pooled controls, with excursions and the controls left out."""
    kept, out = windows.exclude_overlapping(all_windows(spark, sf_dir))
    rows = windows.tag_windows(samples(spark, sf_dir), stored(kept, "windows"))
    by_window = stored(series.series_stats(rows, WINDOW), "stats")
    base = stored(pooled(by_window), "pooled")
    beyond = series.brief_excursions(rows.where("role = 'incident'").join(base, KEYS), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"))
    judged = series.classify_baseline(by_window.where("role = 'incident'").join(base, KEYS, "left")).join(beyond, KEYS, "left").join(out, "incident_id", "left")
    return judged.select(*KEYS, r6("z").alias("z"), "class", F.coalesce("k", F.lit(0)).alias("n_excursions"), F.array_join("excluded", ",").alias("excluded"))


@register("q_f16_window_report", f"""WITH {SAMPLES}, {TAGGED}, inside AS (SELECT * FROM tagged WHERE role = 'incident'),
{RUNS.format(on="v > 80.0", source="inside", keys="incident_id, series_key")}, counted AS (SELECT incident_id, series_key, count(*) AS runs, sum(n) AS points_in_runs FROM runs GROUP BY ALL)
SELECT i.incident_id, i.series_key, count(*) AS points, round(avg(v), 6) AS mean, max(v) AS max, coalesce(any_value(runs), 0) AS runs, coalesce(any_value(points_in_runs), 0)::BIGINT AS points_in_runs
FROM inside i LEFT JOIN counted USING (incident_id, series_key) GROUP BY i.incident_id, i.series_key""")  # fmt: skip
def f16(spark, sf_dir):
    """Statistics and runs of all points; the points themselves are another, optional, output."""
    rows = tagged(spark, sf_dir).where("role = 'incident'")
    own = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), F.avg(c.finite(F.col("v"))).alias("mean"), F.max(c.finite(F.col("v"))).alias("max"))
    runs = series.threshold_runs(rows, KEYS, F.lit(80.0), "above").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("points_in_runs"))
    report = own.join(runs, KEYS, "left")
    return report.select(*KEYS, "points", r6("mean").alias("mean"), "max", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("points_in_runs", F.lit(0)).alias("points_in_runs"))


VERDICT = f"""{SCORED}{EXCURSIONS[len(STATS):]}, facts AS (
  SELECT incident_id, series_key, rank, title, score FROM (
    SELECT incident_id, series_key, kind || ' of ' || usr AS title, score, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, series_key) AS rank FROM ranks) WHERE rank <= 10),
confirmed AS (SELECT incident_id, count(*) FILTER (WHERE score >= 1) AS k FROM facts GROUP BY ALL),
brief AS (SELECT incident_id, series_key, count(*) AS n_excursions FROM excursions GROUP BY ALL),
beyond AS (SELECT incident_id, series_key, count(*) AS over FROM tagged WHERE role = 'incident' AND v > 95 AND NOT isnan(v) GROUP BY ALL),
left_out AS (SELECT incident_id, string_agg(label, ',' ORDER BY ord) AS excluded FROM flagged WHERE overlaps_incident GROUP BY incident_id),
primary_ AS (
  SELECT s.incident_id, s.series_key, s.n, s.mean, s.n_nonzero, p.pooled_mean, p.pooled_stddev, coalesce(n_excursions, 0) AS n_excursions, excluded,
    CASE WHEN regexp_extract(s.series_key, 'user=(.*)$', 1)::INT % 3 > 0 THEN over IS NOT NULL END AS crossed,
    p.pooled_mean = 0 AND p.pooled_stddev = 0 AND s.n_nonzero > 0 AS zero,
    CASE WHEN s.n > 0 AND NOT coalesce(zero, false) THEN (s.mean - p.pooled_mean) / {EFFECTIVE.format(mean="p.pooled_mean", sd="p.pooled_stddev")} END AS z
  FROM stats s LEFT JOIN pooled p USING (incident_id, series_key) LEFT JOIN brief USING (incident_id, series_key) LEFT JOIN beyond USING (incident_id, series_key) LEFT JOIN left_out USING (incident_id)
  WHERE s.role = 'incident' AND s.series_key LIKE 'A|event_type=error,%'),
cl AS (SELECT *, CASE WHEN n = 0 OR pooled_mean IS NULL THEN 'insufficient-data' WHEN zero THEN 'baseline-all-zero' WHEN abs(z) >= 3 THEN 'statistically-unusual' ELSE 'common-during-normal-operations' END AS class FROM primary_),
judged AS (SELECT cl.*, coalesce(k, 0) AS k,
  CASE class WHEN 'insufficient-data' THEN 'inconclusive' WHEN 'baseline-all-zero' THEN CASE WHEN crossed THEN 'real-anomaly' ELSE 'inconclusive' END
       WHEN 'statistically-unusual' THEN CASE WHEN crossed = false THEN 'inconclusive' ELSE 'real-anomaly' END
       ELSE CASE WHEN n_excursions > 0 THEN 'inconclusive' ELSE 'likely-false-positive' END END AS verdict,
  CASE class WHEN 'insufficient-data' THEN 'low' WHEN 'baseline-all-zero' THEN CASE WHEN coalesce(crossed, false) OR coalesce(k, 0) > 0 THEN 'medium' ELSE 'low' END
       WHEN 'statistically-unusual' THEN CASE WHEN crossed THEN 'high' WHEN crossed = false THEN 'low' ELSE 'medium' END
       ELSE CASE WHEN n_excursions > 0 THEN 'low' ELSE 'medium' END END AS confidence
  FROM cl LEFT JOIN confirmed USING (incident_id))"""


@register("q_a8_verdict", f"WITH {USER_SAMPLES}, {VERDICT} SELECT incident_id, series_key, class, verdict, confidence, k::INT AS n_confirmed FROM judged")
def a8(spark, sf_dir):
    """Every user's errors as the primary series, with its own crossings of a threshold, excursions and controls left out."""
    return verdicts(spark, sf_dir).select(*KEYS, "class", "verdict", "confidence", F.size("confirmed").alias("n_confirmed"))


def verdicts(spark, sf_dir):
    """Two users of three have an alert whose threshold is 95."""
    kept, left_out = windows.exclude_overlapping(all_windows(spark, sf_dir))
    # tagged once: statistics, runs, excursions and scores are all of these rows
    rows = windows.tag_windows(samples(spark, sf_dir, by_user=True), stored(kept, "windows"))
    rows = stored(rows.select(*WINDOW, "event_type", "user_id", "t", "v"), "tagged")
    error = F.col("series_key").startswith("A|event_type=error,")
    by_window = stored(series.series_stats(rows.where(error), WINDOW), "stats")
    base = stored(pooled(by_window), "pooled")
    inside = rows.where((F.col("role") == "incident") & error)
    crossings = series.threshold_runs(inside, KEYS, F.lit(95.0), "above").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("crossings"))
    brief = series.brief_excursions(inside.join(base, KEYS), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_excursions"))
    own = series.classify_baseline(by_window.where((F.col("role") == "incident") & error).join(base, KEYS, "left"))
    best = correlate.top_candidates(scored(spark, sf_dir, rows), ["incident_id"], total=False)
    title = F.concat(F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"))
    listed = best.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("rank", title.alias("title"), "score"))).alias("candidates"))
    facts = own.join(crossings, KEYS, "left").join(brief, KEYS, "left").join(listed, "incident_id", "left").join(left_out, "incident_id", "left")
    alerted = F.regexp_extract("series_key", "user=(.*)$", 1).cast("int") % 3 > 0
    facts = facts.withColumns({
        "candidates": F.coalesce("candidates", F.array().cast("array<struct<rank:int,title:string,score:double>>")),
        "threshold_crossed": F.when(alerted, F.col("crossings").isNotNull()),
        "n_excursions": F.coalesce("n_excursions", F.lit(0)),
        "adhoc": F.lit(False),
        "warnings": F.transform(F.coalesce("excluded", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(" overlaps the incident"))),
    })
    return verdict.summarize_findings(facts)


@register("q_a9_scope", f"""WITH {USER_SAMPLES}, {VERDICT}, titles AS (SELECT incident_id, title, min(rank) AS rank FROM facts WHERE score >= 1 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY rank) AS i, count(*) OVER (PARTITION BY incident_id) AS k FROM titles),
listed AS (SELECT incident_id, k || ' dashboards: ' || string_agg(title, ', ' ORDER BY i) FILTER (WHERE i <= 5) || CASE WHEN k > 5 THEN ' and ' || (k - 5) || ' more' ELSE '' END AS scope FROM numbered GROUP BY incident_id, k)
SELECT cl.incident_id, cl.series_key, CASE WHEN class = 'insufficient-data' THEN 'unknown' WHEN class = 'common-during-normal-operations' AND n_excursions = 0 THEN 'none' ELSE coalesce(scope, 'isolated') END AS scope
FROM cl LEFT JOIN listed USING (incident_id)""")  # fmt: skip
def a9(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*KEYS, "scope")


@register("q_tool_summarize_findings", f"""WITH {USER_SAMPLES}, {VERDICT} SELECT incident_id, series_key, verdict, confidence,
(CASE WHEN class = 'common-during-normal-operations' AND n_excursions > 0 THEN 2 ELSE 1 END + CASE WHEN class <> 'common-during-normal-operations' AND n_excursions > 0 THEN 1 ELSE 0 END + CASE WHEN crossed IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k > 0 THEN 1 ELSE 0 END)::INT AS n_reasons,
concat_ws('; ', replace(excluded, ',', ' overlaps the incident; ') || ' overlaps the incident', CASE WHEN crossed IS NULL THEN 'whether the threshold was crossed' END) AS missing FROM judged""")  # fmt: skip
def summarize(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*KEYS, "verdict", "confidence", F.size("reasons").alias("n_reasons"), F.array_join("missing", "; ").alias("missing"))


REPORT = f"""WITH FRAMES, {TAGGED}, {RUNS.format(on="v > 80.0", source="tagged", keys="incident_id, label, series_key")}, counted AS (SELECT incident_id, label, series_key, count(*) AS runs FROM runs GROUP BY ALL)
SELECT t.incident_id, t.label, t.series_key, count(v) AS n, round(avg(v), 6) AS mean, coalesce(any_value(runs), 0) AS runs, least(count(*), 40) AS points, 'PROVENANCE' AS provenance
FROM tagged t LEFT JOIN counted USING (incident_id, label, series_key) GROUP BY 1, 2, 3"""


def _report(spark, sf_dir, provenance, by_user=False):
    keys = ["incident_id", "label", "series_key"]
    rows = stored(tagged(spark, sf_dir, by_user).select(*keys, "t", "v"), "tagged")  # read four times
    out = series.window_report(rows, keys, F.lit(80.0), include_points=True, most=40, provenance=provenance)
    runs = out["runs"].groupBy(*keys).agg(F.first("total").alias("runs"))
    points = out["points"].groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    rows = out["stats"].join(runs, keys, "left").join(points, keys)
    return rows.select(*keys, "n", r6("mean").alias("mean"), F.coalesce("runs", F.lit(0)).alias("runs"), "points", "provenance")


@register("q_tool_execute_query_window", REPORT.replace("FRAMES", SAMPLES).replace("PROVENANCE", "panel"))
def execute_window(spark, sf_dir):
    """Every window of every incident: statistics, runs above a threshold, and how many points a chart would get."""
    return _report(spark, sf_dir, "panel")


@register("q_tool_execute_adhoc_query", REPORT.replace("FRAMES", USER_SAMPLES).replace("PROVENANCE", "adhoc"))
def execute_adhoc(spark, sf_dir):
    """The same report over series that no panel shows: one for each event type and user."""
    return _report(spark, sf_dir, "adhoc", by_user=True)
