"""Sources, sinks, log joins and masking over `events`, `conversations` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import logs, mask, windows
from tidewatch.operators.catalog import live_values, materialize_values, union_sources
from tidewatch.plans.registry import SAMPLES, USER_SAMPLES, ms, register, samples, table
from tidewatch.session import work_path
from tidewatch.sources import csv, frames, index_store
from tidewatch.sources.logs import promote_labels

# frames


def results(spark, sf_dir):
    """One document for a thousand events: a frame for each event type; errors of odd ones failed. Written and read as JSON lines."""
    batch = F.floor(F.col("event_id") / 1000)
    points = F.sort_array(F.collect_list(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value")))
    by = table(spark, sf_dir, "events").groupBy(batch.alias("batch"), "event_type").agg(points.alias("p"))
    field = lambda name, kind, labels=None: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), (labels if labels is not None else F.lit(None).cast("map<string,string>")).alias("labels"))
    text = lambda f: F.transform("p", lambda x: f(x).cast("string"))
    frame = F.struct(
        F.lit(None).cast("string").alias("refId"),
        F.array(field("note", "string"), field("Time", "time"), field("v", "number", F.create_map(F.lit("event_type"), F.col("event_type")))).alias("fields"),
        F.array(text(lambda x: x["event_id"]), text(lambda x: x["t"]), text(lambda x: x["value"])).alias("values"),
    )
    failed = (F.col("event_type") == "error") & (F.col("batch") % 2 == 1)
    one = F.struct(F.when(failed, "timeout").alias("error"), F.when(~failed, F.array(frame)).alias("frames"))
    docs = by.select("batch", F.col("event_type").alias("key"), one.alias("r")).groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("key", "r"))).alias("results"))
    path = work_path(spark, "frames")
    docs.select("results").write.json(path)
    return frames.read_results(spark, path)


GOOD = "NOT (event_type = 'error' AND (event_id // 1000) % 2 = 1)"


@register("q_s1_frame_samples", f"SELECT 'A' || '' AS x, event_type AS ref_id, event_type || '|event_type=' || event_type AS series_key, epoch_ms(ts) AS t_ms, value AS v FROM events WHERE {GOOD}")
def s1(spark, sf_dir):
    return frames.frame_samples(results(spark, sf_dir)).select(F.lit("A").alias("x"), "ref_id", "series_key", ms("t").alias("t_ms"), "v")


@register("q_s1e_frame_errors", "SELECT 'error' AS ref_id, 'timeout' AS message FROM (SELECT DISTINCT event_id // 1000 AS d FROM events WHERE event_type = 'error' AND (event_id // 1000) % 2 = 1)")
def s1e(spark, sf_dir):
    return frames.frame_errors(results(spark, sf_dir))


@register("q_s2_frame_rows", f"SELECT event_type AS ref_id, 'note,Time,v' AS names, event_id::VARCHAR AS note, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events WHERE {GOOD}")
def s2(spark, sf_dir):
    rows = frames.frame_rows(results(spark, sf_dir))
    return rows.select("ref_id", F.array_join("names", ",").alias("names"), F.get("cells", F.lit(0)).alias("note"), F.get("cells", F.lit(1)).alias("at"))


@register("q_s10_frame_suffixes", f"SELECT event_type AS ref_id, d, event_type || CASE WHEN count(*) OVER (PARTITION BY event_type) > 1 THEN '-' || row_number() OVER (PARTITION BY event_type ORDER BY d) ELSE '' END AS suffix FROM (SELECT DISTINCT event_type, event_id // 1000 AS d FROM events WHERE {GOOD})")
def s10(spark, sf_dir):
    """The frames of all documents as one batch, which repeats every ref."""
    note = F.get("cells", F.lit(0)).cast("bigint")
    rows = frames.frame_rows(results(spark, sf_dir)).select("ref_id", F.floor(note / 1000).alias("d")).distinct()
    named = csv.frame_suffixes(rows.select("ref_id", F.col("d").alias("frame")))
    return named.select("ref_id", F.col("frame").alias("d"), "suffix")


@register("q_s10_frame_files", f"SELECT event_type AS suffix, event_id::VARCHAR AS note, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events WHERE {GOOD}")
def s10_files(spark, sf_dir):
    path = work_path(spark, "frames-csv")
    csv.export_frames(frames.frame_rows(results(spark, sf_dir)).withColumn("frame", F.lit(0)), path)
    back = spark.read.csv(path)
    return back.select("suffix", F.col("_c0").alias("note"), F.col("_c1").alias("at"))


# logs


def messages(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("source"), F.col("props").alias("message"), F.col("props").alias("fields"))
    return promote_labels(rows)


@register("q_s3_log_labels", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS source, json_extract_string(props, '$.k') AS k FROM events")
def s3(spark, sf_dir):
    return messages(spark, sf_dir).select("id", "source", F.col("labels")["k"].alias("k"))


TOTALS = "SELECT event_id AS id, ts FROM events WHERE json_extract_string(props, '$.k') = '42' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'"


def search(spark, sf_dir):
    return logs.search_logs(messages(spark, sf_dir), {"k": "42"}, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp"), 20)


@register("q_t5_log_search", f"SELECT id, epoch_ms(ts) AS t_ms FROM ({TOTALS}) ORDER BY ts, id LIMIT 20")
def t5(spark, sf_dir):
    return search(spark, sf_dir)[0].select("id", ms("ts").alias("t_ms"))


@register("q_t5_log_total", f"SELECT count(*) AS total FROM ({TOTALS})")
def t5_total(spark, sf_dir):
    return search(spark, sf_dir)[1]


def turns(spark, sf_dir):
    """Each role of `conversations` as a log stream, a second for each turn."""
    rows = table(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_millis(F.col("turn") * 1000)).withColumnRenamed("text", "message")
    return logs.streams({r: rows.where(F.col("role") == r) for r in ("user", "assistant", "system")}, "conv_id")


ROLES = "SELECT conv_id::VARCHAR AS key, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY conv_id"


@register("q_j3_and", f"SELECT key, 'complete' AS completeness, u + a AS n_events FROM ({ROLES}) WHERE u > 0 AND a > 0")
def j3(spark, sf_dir):
    return logs.correlate_logs(turns(spark, sf_dir), ["user", "assistant"], "and")


@register("q_j4_or", f"SELECT key, CASE WHEN u > 0 AND s > 0 THEN 'complete' ELSE 'partial' END AS completeness, u + s AS n_events FROM ({ROLES}) WHERE u + s > 0")
def j4(spark, sf_dir):
    return logs.correlate_logs(turns(spark, sf_dir), ["user", "system"], "or")


@register("q_j5_unless", f"SELECT key, 'partial' AS completeness, u AS n_events FROM ({ROLES}) WHERE u > 0 AND s = 0")
def j5(spark, sf_dir):
    return logs.correlate_logs(turns(spark, sf_dir), ["user", "system"], "unless")


@register("q_j6_and_of_three", f"SELECT key, 'complete' AS completeness, u + a + s AS n_events FROM ({ROLES}) WHERE u > 0 AND a > 0 AND s > 0")
def j6(spark, sf_dir):
    return logs.correlate_logs(turns(spark, sf_dir), ["user", "assistant", "system"], "and")


@register("q_j7_within", "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'error' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 3600000")
def j7(spark, sf_dir):
    """Clicks and errors of one user, keyed by differently named columns, within an hour of each other."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("message"), "event_type")
    right = rows.where("event_type = 'error'").withColumnRenamed("user_id", "uid")
    return logs.join_pairs(rows.where("event_type = 'click'"), right, "user_id", "uid", 3_600_000).select(F.col("left_message").alias("left_id"), F.col("right_message").alias("right_id"))


@register("q_j7_pairs", "SELECT a.user_id::VARCHAR AS key, count(*) AS n, max(a.event_id + b.event_id) AS most FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'error' GROUP BY 1")
def j7_pairs(spark, sf_dir):
    """Clicks and errors of one user, whenever they were."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("message"), "event_type")
    met = logs.join_pairs(rows.where("event_type = 'click'"), rows.where("event_type = 'error'").withColumnRenamed("user_id", "uid"), "user_id", "uid")
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("left_message") + F.col("right_message")).alias("most"))


@register("q_j7_many_to_one", """SELECT e.event_id, epoch_ms(e.ts) - epoch_ms(l.ts) AS after_ms FROM events e JOIN (
SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1) l USING (user_id)""")  # fmt: skip
def j7_one(spark, sf_dir):
    """Every event with its user's first purchase, of which each user has one."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("message"), "event_type")
    first = rows.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("uid")).agg(F.min("ts").alias("ts"), F.lit(None).cast("bigint").alias("message"))
    met = logs.join_to_one(rows, first, "user_id", "uid")
    return met.select(F.col("many_message").alias("event_id"), (ms("many_ts") - ms("one_ts")).alias("after_ms"))


CAPPED = "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY turn, conv_id::VARCHAR, text) AS i FROM conversations) WHERE i <= 60)"


@register("q_j8_capped_and", f"WITH {CAPPED} SELECT conv_id::VARCHAR AS key, count(*) AS n_events, (SELECT max(k) > 60 FROM (SELECT count(*) AS k FROM conversations GROUP BY role)) AS truncated FROM capped WHERE role <> 'system' GROUP BY conv_id HAVING count(DISTINCT role) = 2")
def j8(spark, sf_dir):
    kept, stats = logs.cap_stream(turns(spark, sf_dir), 60)
    return logs.correlate_logs(kept, ["user", "assistant"], "and", stats).select("key", "n_events", "truncated")


@register("q_j8_stream_stats", "SELECT role AS stream, count(*) AS total, least(count(*), 60) AS fetched, count(*) > 60 AS truncated FROM conversations GROUP BY role")
def j8_stats(spark, sf_dir):
    return logs.cap_stream(turns(spark, sf_dir), 60)[1].select("stream", "total", F.col("fetched").cast("bigint").alias("fetched"), "truncated")


@register("q_j3_events", f"SELECT conv_id::VARCHAR AS key, role AS stream, turn FROM conversations WHERE role IN ('user', 'assistant') AND conv_id::VARCHAR IN (SELECT key FROM ({ROLES}) WHERE u > 0 AND a > 0)")
def j3_events(spark, sf_dir):
    every = turns(spark, sf_dir)
    found = logs.correlate_logs(every, ["user", "assistant"], "and")
    return logs.events_of(found, every, ["user", "assistant"]).select("key", "stream", F.expr("unix_seconds(ts)").alias("turn"))


@register("q_tool_correlate_logs", f"SELECT key, CASE WHEN u > 0 AND a > 0 AND s > 0 THEN 'complete' ELSE 'partial' END AS completeness, u + a + s AS n_events FROM ({ROLES})")
def tool_correlate(spark, sf_dir):
    return logs.correlate_logs(turns(spark, sf_dir), ["user", "assistant", "system"], "or").select("key", "completeness", "n_events")


@register("q_u1_union", "SELECT 'c' || (user_id % 3) AS connection_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def u1(spark, sf_dir):
    """The same question to three connections, as one table with the connection's name."""
    rows = table(spark, sf_dir, "events")
    answers = {f"c{i}": rows.where(F.col("user_id") % 3 == i) for i in range(3)}
    return union_sources(answers).groupBy("connection_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("q_u3_distinct_times", f"WITH {SAMPLES} SELECT DISTINCT series_key, epoch_ms(t) AS t_ms FROM samples")
def u3(spark, sf_dir):
    return samples(spark, sf_dir).select("series_key", ms("t").alias("t_ms")).distinct()


# masking and CSV


EMAIL = "[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}"


@register("q_f17_redact", f"SELECT doc_id, md5(regexp_replace(text, '(?i){EMAIL}', '[REDACTED]', 'g')) AS text_md5, text AS kept, '[REDACTED]' AS password, source FROM documents")
def f17(spark, sf_dir):
    """Mail addresses in any text; the value of a key that names a secret; nothing in an exempt key."""
    docs = table(spark, sf_dir, "documents")
    nested = docs.select("doc_id", F.struct("text", F.struct(F.col("source").alias("password"), F.col("text").alias("url")).alias("inner")).alias("d"), "source")
    masked = mask.redact(nested, [EMAIL], exempt=("url",))
    return masked.select("doc_id", F.md5("d.text").alias("text_md5"), F.col("d.inner.url").alias("kept"), F.col("d.inner.password").alias("password"), "source")


@register("q_s9_neutral_cells", """WITH cells AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '=' WHEN 1 THEN ' =' WHEN 2 THEN '-1.5' WHEN 3 THEN '@' WHEN 4 THEN 'a=' WHEN 5 THEN '+2' ELSE chr(9) || '-' END ||
CASE WHEN doc_id % 7 IN (2, 5) THEN '' ELSE text END AS cell FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3, 6) THEN '''' || cell ELSE cell END AS cell FROM cells""")  # fmt: skip
def s9(spark, sf_dir):
    n = F.col("doc_id") % 7
    lead = F.when(n == 0, "=").when(n == 1, " =").when(n == 2, "-1.5").when(n == 3, "@").when(n == 4, "a=").when(n == 5, "+2").otherwise("\t-")
    cells = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.when(n.isin(2, 5), "").otherwise(F.col("text"))).alias("cell"))
    return csv.neutralize_cells(cells)


@register("q_s8_csv_documents", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def s8(spark, sf_dir):
    """Whole texts, with their line breaks, quotes and commas, written as CSV and read back; CSV doesn't tell null from empty."""
    path = work_path(spark, "documents-csv")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv.read_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


DAILY = "SELECT date_trunc('day', ts) AS d, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"


def daily(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rows.groupBy("series_key", F.date_trunc("day", "t").alias("t")).agg(F.count("v").cast("double").alias("v"), F.first("ref_id").alias("ref_id"), F.first("labels").alias("labels"))


@register("q_s7_wide_csv", "SELECT strftime(d, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, " + ", ".join(f"nullif({k}, 0)::VARCHAR AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + f" FROM ({DAILY})")
def s7(spark, sf_dir):
    path = work_path(spark, "wide-csv")
    csv.export_wide_csv(daily(spark, sf_dir), path)
    back = csv.read_csv(spark, path)
    return back.select("timestamp", *[F.col(f"`event_type={k}`").alias(k) for k in ("click", "error", "purchase", "signup", "view")])


@register("q_j15_outer_align", "SELECT epoch_ms(d) AS t_ms, " + ", ".join(f"nullif({k}, 0) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + f" FROM ({DAILY})")
def j15(spark, sf_dir):
    wide = csv.wide(daily(spark, sf_dir))
    return wide.select(F.unix_millis(F.to_timestamp("timestamp")).alias("t_ms"), *[F.col(f"`event_type={k}`").cast("bigint").alias(k) for k in ("click", "error", "purchase", "signup", "view")])


@register("q_t6_sorted_export", f"WITH {SAMPLES} SELECT epoch_ms(t) AS t_ms, series_key, row_number() OVER (PARTITION BY series_key ORDER BY t)::INT AS line FROM samples")
def t6(spark, sf_dir):
    """The place of each sample in its series' export, which is sorted by time."""
    from tidewatch.operators.series import ranked

    return ranked(samples(spark, sf_dir), ["series_key"]).select(ms("t").alias("t_ms"), "series_key", (F.col("i") + 1).cast("int").alias("line"))


@register("q_tool_export_panel_csv", f"WITH {USER_SAMPLES} SELECT strftime(date_trunc('day', t), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, user_id % 25 AS shard, count(*) AS n FROM samples WHERE event_type = 'error' GROUP BY 1, 2")
def tool_export(spark, sf_dir):
    """The errors of each of 25 shards of users: the panel's series are the columns."""
    own = samples(spark, sf_dir).where("event_type = 'error'").withColumn("shard", (F.col("user_id") % 25).cast("string"))
    by = own.groupBy("shard", F.date_trunc("day", "t").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    by = by.select(F.lit("A").alias("ref_id"), F.create_map(F.lit("shard"), F.col("shard")).alias("labels"), F.concat(F.lit("A|shard="), F.col("shard")).alias("series_key"), "t", "v")
    path = work_path(spark, "panel-csv")
    csv.export_wide_csv(by, path)
    back = csv.read_csv(spark, path)
    long = back.unpivot(["timestamp"], [c for c in back.columns if c != "timestamp"], "series", "n").where("n is not null")
    return long.select("timestamp", F.regexp_extract("series", r"shard=(\d+)", 1).cast("bigint").alias("shard"), F.col("n").cast("bigint").alias("n"))


@register("q_s6_fresh_index", """SELECT 'c' || (user_id % 5) AS connection_id, event_type AS metric, count(*) AS n FROM events
WHERE user_id % 5 IN (0, 1, 4) AND (user_id % 5 = 4 OR event_type <> 'error') GROUP BY ALL""")  # fmt: skip
def s6(spark, sf_dir):
    """Five connections: c0 and c1 are built again without errors, c2 again by another version, c3 by an old build saved later, c4 once."""
    path = work_path(spark, "index")
    at = lambda text: F.lit(text).cast("timestamp")
    entries = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("connection_id"), F.col("event_type").alias("metric"))
    of = lambda *ids: entries.where(F.col("connection_id").isin(*ids))
    index_store.save_index(entries, path, built_at=at("2024-01-29 20:00:00"))
    index_store.save_index(of("c0", "c1").where("metric <> 'error'"), path, built_at=at("2024-01-30 00:30:00"))
    index_store.save_index(of("c2"), path, built_at=at("2024-01-30 00:30:00"), version=0)
    index_store.save_index(of("c3"), path, built_at=at("2024-01-29 12:00:00"))
    fresh = index_store.load_fresh_index(spark, path, entries.schema, now=at("2024-01-30 01:00:00"))
    return fresh.groupBy("connection_id", "metric").agg(F.count(F.lit(1)).alias("n"))


@register("q_tool_search_logs", "SELECT event_id AS id, epoch_ms(ts) AS t_ms FROM events WHERE props LIKE '%7%' ORDER BY ts, event_id LIMIT 500")
def tool_search(spark, sf_dir):
    where = F.contains("message", F.lit("7"))
    return logs.search_logs(messages(spark, sf_dir), where, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-31").cast("timestamp"))[0].select("id", ms("ts").alias("t_ms"))


@register("q_f8_f10_live_values", f"""WITH {USER_SAMPLES}, days AS (SELECT DISTINCT date_trunc('day', t) AS d FROM samples)
SELECT DISTINCT strftime(d, '%Y-%m-%d') AS incident_id, regexp_extract(user_id::VARCHAR, '^(1.)', 1) AS value FROM samples JOIN days ON t >= d AND t <= d + INTERVAL 1 DAY WHERE regexp_matches(user_id::VARCHAR, '^(1.)')""")  # fmt: skip
def f10(spark, sf_dir):
    from tidewatch.plans.registry import incidents

    own = windows.compute_windows(incidents(spark, sf_dir)).where("role = 'incident'")
    return materialize_values(samples(spark, sf_dir, by_user=True), own, "user", "/^(?<user>1.)/")




@register("q_f10_variables", f"""WITH {USER_SAMPLES}, days AS (SELECT DISTINCT strftime(date_trunc('day', t), '%Y-%m-%d') AS incident_id, date_trunc('day', t) AS d FROM samples WHERE t IS NOT NULL),
held AS (SELECT DISTINCT incident_id, event_type, user_id::VARCHAR AS u FROM samples JOIN days ON t >= d AND t <= d + INTERVAL 1 DAY),
found AS (SELECT DISTINCT incident_id, 'last' AS name, CASE WHEN length(u) > 1 THEN right(u, 1) ELSE u END AS value FROM held UNION SELECT incident_id, 'kind', upper(event_type[1]) || substr(event_type, 2) FROM held WHERE event_type[1] = 'E' UNION SELECT incident_id, 'type', event_type FROM held)
SELECT incident_id, name, value FROM found UNION ALL SELECT incident_id, name, NULL FROM days CROSS JOIN (SELECT unnest(['kind', 'other', 'custom', 'broken', 'none']) AS name)""")  # fmt: skip
def f10_variables(spark, sf_dir):
    """Variables that stand for all, looked up in each day: some have values, some a pattern that fits none, some no way to be looked up."""
    from tidewatch.plans.registry import incidents

    own = windows.compute_windows(incidents(spark, sf_dir)).where("role = 'incident'")
    tags = lambda label: f'SHOW TAG VALUES FROM "m" WITH KEY = "{label}" WHERE $timeFilter'
    rows = [
        ("last", "query", tags("user"), "/^[0-9]+([0-9])$|^[(0-9)]$/", "influxdb"), ("kind", "query", tags("event_type"), "/^E/", "influxdb"), ("type", "query", tags("event_type"), None, "influxdb"),
        ("other", "query", "label_values(up)", None, "prometheus"), ("custom", "custom", tags("user"), None, "influxdb"), ("broken", "query", tags("user"), "/(/", "influxdb"), ("none", "query", tags("absent"), None, "influxdb"),
    ]
    variables = spark.createDataFrame([(*r, ["$__all"], None, None) for r in rows], "name string, type string, query string, regex string, datasource_type string, current array<string>, options array<string>, all_value string")
    found, unresolved = live_values(variables, {}, samples(spark, sf_dir, by_user=True), own)
    return found.unionByName(unresolved.withColumn("value", F.lit(None).cast("string")))
