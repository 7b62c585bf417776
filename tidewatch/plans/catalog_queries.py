"""Panels, the metric index, alerts and knowledge, over tables derived from `lineitem`, `orders`, `supplier` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import columns as c
from tidewatch.operators import alerts, catalog, correlate, knowledge, render, windows
from tidewatch.plans.registry import SAMPLES, USER_SAMPLES, derive, ms, r6, register, samples, table
from tidewatch.session import stored
from tidewatch.sources.alerts import flatten_batches, parse_batches

PANEL = ["connection_id", "dashboard_uid", "panel_id"]

TARGETS = """
SELECT 'c' || (l_suppkey % 3) AS connection_id, 'd' || (l_suppkey % 40) AS dashboard_uid, 'Board ' || (l_suppkey % 40) AS dashboard_title,
       l_orderkey % 50 AS panel_id, 'Panel ' || (l_orderkey % 50) AS panel_title, l_orderkey * 10 + l_linenumber AS target_pos, 'r' || l_linenumber AS ref_id,
       CASE WHEN l_partkey % 11 = 0 THEN '$ds' WHEN l_partkey % 11 = 1 THEN '-- Dashboard --' WHEN l_partkey % 11 = 2 THEN 'gone' || (l_suppkey % 4) ELSE 'ds' || (l_partkey % 11) END AS datasource_uid,
       CASE WHEN l_linenumber % 3 = 0 THEN 'sum by (svc) (rate(metric_' || (l_partkey % 20) || '{svc="s' || (l_suppkey % 5) || '"}[5m]))'
            WHEN l_linenumber % 3 = 1 THEN 'metric_' || (l_partkey % 20) || '{svc="s' || (l_suppkey % 5) || '", env!="dev"} > 5 and up' END AS expr,
       CASE WHEN l_linenumber % 3 = 2 THEN 'SELECT mean("v") FROM "db"."rp"."metric_' || (l_partkey % 20) || '" WHERE "svc" = ''s' || (l_suppkey % 5) || ''' AND $timeFilter GROUP BY time(1m)' END AS query,
       CASE WHEN l_linenumber % 3 = 2 THEN l_partkey % 2 = 0 END AS raw_query,
       CASE WHEN l_linenumber % 3 = 2 THEN 'built_' || (l_partkey % 20) END AS measurement, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem"""
METRICS = f"""targets AS ({TARGETS}), entries AS (
  SELECT *, 'metric_' || (l_partkey % 20) AS metric FROM targets WHERE l_linenumber % 3 <> 2 OR l_partkey % 2 = 0
  UNION ALL SELECT *, 'up' FROM targets WHERE l_linenumber % 3 = 1
  UNION ALL SELECT *, 'built_' || (l_partkey % 20) FROM targets WHERE l_linenumber % 3 = 2 AND l_partkey % 2 = 1),
index_ AS (
  SELECT connection_id, metric, dashboard_uid, dashboard_title, panel_id, panel_title, svc FROM (
    SELECT *, CASE WHEN l_linenumber % 3 = 2 AND l_partkey % 2 = 1 THEN NULL ELSE 's' || (l_suppkey % 5) END AS svc,
           row_number() OVER (PARTITION BY metric, connection_id, dashboard_uid, panel_id ORDER BY target_pos, ref_id) AS i FROM entries) WHERE i = 1)"""


def targets(spark, sf_dir):
    tags = F.array().cast("array<struct<key:string,operator:string,value:string>>")
    return derive(spark, sf_dir, TARGETS, "lineitem").withColumn("tags", tags)


def index(spark, sf_dir):
    return catalog.build_metric_index(targets(spark, sf_dir))


@register("q_f26_query_info", f"WITH {METRICS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, metric FROM entries")
def f26(spark, sf_dir):
    rows = catalog.extract_query_info(targets(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode("metrics").alias("metric"))


@register("q_f26_labels", f"""WITH targets AS ({TARGETS}), pairs AS (SELECT 'svc' AS key, 's' || (l_suppkey % 5) AS value FROM targets WHERE l_linenumber % 3 <> 2 OR l_partkey % 2 = 0
UNION ALL SELECT 'env', 'dev' FROM targets WHERE l_linenumber % 3 = 1) SELECT key, value, count(*) AS n FROM pairs GROUP BY ALL""")  # fmt: skip
def f26_labels(spark, sf_dir):
    rows = catalog.extract_query_info(targets(spark, sf_dir)).select(F.explode("label_pairs").alias("p"))
    return rows.groupBy(F.col("p.key").alias("key"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@register("q_f18_active_fields", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN raw_query THEN query END AS query, CASE WHEN NOT raw_query THEN measurement END AS measurement FROM ({TARGETS}) WHERE raw_query IS NOT NULL")
def f18(spark, sf_dir):
    rows = catalog.active_query_fields(targets(spark, sf_dir)).where("raw_query is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "query", "measurement")


@register("q_a15_metric_index", f"WITH {METRICS} SELECT connection_id, metric, dashboard_uid, dashboard_title, panel_id, panel_title, svc FROM index_")
def a15(spark, sf_dir):
    return index(spark, sf_dir).withColumn("svc", F.get(F.try_element_at("labels", F.lit("svc")), F.lit(0))).drop("labels")


@register("q_a15_coverage", f"WITH {METRICS}, known AS (SELECT DISTINCT connection_id, dashboard_uid FROM targets) SELECT k.connection_id, count(DISTINCT k.dashboard_uid) + 1 AS discovered, count(DISTINCT i.dashboard_uid) AS scanned FROM known k LEFT JOIN index_ i USING (connection_id, dashboard_uid) GROUP BY 1")
def a15_coverage(spark, sf_dir):
    """Each connection lists one dashboard more than has targets."""
    rows = targets(spark, sf_dir).select("connection_id", F.col("dashboard_uid").alias("uid")).distinct()
    more = rows.select("connection_id", F.lit("bare").alias("uid")).distinct()
    return catalog.index_coverage(rows.unionByName(more), index(spark, sf_dir))


KNOWLEDGE = """
SELECT 'c0' AS connection_id, 'k' || (doc_id % 25) AS dashboard_uid, doc_id AS panel_id, doc_id AS at, CASE doc_id % 4 WHEN 0 THEN 'Knowledge: Key' || (doc_id % 60) WHEN 1 THEN 'knowledge:  key' || (doc_id % 60) || ' ' WHEN 2 THEN 'KNOWLEDGE: key' || (doc_id % 60) ELSE 'Notes' END AS title,
       CASE WHEN doc_id % 3 = 0 THEN 'see ```json' || chr(10) || '{"id": ' || doc_id || ', "links": ["/d/d' || (doc_id % 17) || '/x"]}' || chr(10) || '``` more ```json' || chr(10) || '{"second": 2}' || chr(10) || '``` end'
            WHEN doc_id % 3 = 1 THEN '```json' || chr(10) || '{bad' || chr(10) || '```' ELSE 'plain ' || doc_id END AS content
FROM documents"""
FIRST = f"""panels AS (SELECT *, lower(trim(regexp_extract(title, '(?i)^knowledge:\\s*(.+)$', 1))) AS product_key FROM ({KNOWLEDGE})),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dashboard_uid, product_key ORDER BY "at", panel_id) AS i FROM panels WHERE product_key <> '') WHERE i = 1)"""
PRIMARY = "primary_ AS (SELECT dashboard_uid || ':' || panel_id AS incident_id, connection_id, dashboard_uid, panel_id, metric FROM index_ WHERE dashboard_uid IN ('d1', 'd2') AND connection_id = 'c1')"
#: A primary panel's product: its dashboard and those that the knowledge panels of its key link to.
SCOPE = f"""{FIRST}, scope AS (SELECT DISTINCT incident_id, dashboard_uid FROM primary_
  UNION SELECT DISTINCT p.incident_id, 'd' || (f.panel_id % 17) FROM primary_ p JOIN firsts f ON f.product_key = 'key' || p.panel_id WHERE f.panel_id % 3 = 0)"""
CANDIDATES = f"""WITH {METRICS}, {PRIMARY}, {SCOPE}, cands AS (
  SELECT p.incident_id, i.connection_id, i.dashboard_uid, i.panel_id, min(i.metric) AS metric, count(DISTINCT i.metric) AS n_shared FROM index_ i JOIN (SELECT DISTINCT incident_id, metric FROM primary_) p ON i.metric = p.metric
  WHERE NOT EXISTS (SELECT 1 FROM primary_ q WHERE q.incident_id = p.incident_id AND q.connection_id = i.connection_id AND q.dashboard_uid = i.dashboard_uid AND q.panel_id = i.panel_id)
  GROUP BY ALL), tiers AS (
  SELECT *, CASE WHEN connection_id = 'c1' AND EXISTS (SELECT 1 FROM scope s WHERE s.incident_id = cands.incident_id AND s.dashboard_uid = cands.dashboard_uid) THEN 'product' WHEN connection_id = 'c1' THEN 'connection' ELSE 'all' END AS tier FROM cands)"""


def candidates(spark, sf_dir):
    """The panels of two dashboards as primaries, with the metric that most panels have."""
    own = stored(index(spark, sf_dir), "index")
    primary = own.where("dashboard_uid in ('d1', 'd2') and connection_id = 'c1'").withColumn("incident_id", F.concat_ws(":", "dashboard_uid", F.col("panel_id").cast("string")))
    return correlate.candidate_panels(own, primary), primary


def tiered(spark, sf_dir):
    cands, primary = candidates(spark, sf_dir)
    home = primary.select("incident_id", F.col("connection_id").alias("home")).distinct()
    return correlate.tier_candidates(cands, home, product_scope(spark, sf_dir, primary))


def product_scope(spark, sf_dir, primary):
    """The dashboards of each incident's product: its own and those that its knowledge panels link to."""
    linked = knowledge.related_uids(known(spark, sf_dir), "json", "product_key").withColumnRenamed("uid", "dashboard_uid")
    keyed = primary.select("incident_id", F.concat(F.lit("key"), F.col("panel_id").cast("string")).alias("product_key")).distinct()
    declared = keyed.join(linked, "product_key").select("incident_id", "dashboard_uid")
    return declared.unionByName(primary.select("incident_id", "dashboard_uid")).distinct()


@register("q_j9_candidate_panels", f"{CANDIDATES} SELECT * FROM cands")
def j9(spark, sf_dir):
    return candidates(spark, sf_dir)[0]


@register("q_j10_tiers", f"{CANDIDATES} SELECT incident_id, connection_id, dashboard_uid, panel_id, tier FROM tiers")
def j10(spark, sf_dir):
    return tiered(spark, sf_dir).select("incident_id", *PANEL, "tier")


@register("q_j10_containment", f"{CANDIDATES} SELECT incident_id, count(*) FILTER (WHERE tier = 'product') AS n_product, count(*) FILTER (WHERE tier = 'connection') AS n_connection, count(*) FILTER (WHERE tier = 'all') AS n_all, count(*) FILTER (WHERE tier = 'connection') = 0 AS contained FROM tiers GROUP BY 1")
def j10_containment(spark, sf_dir):
    return correlate.containment(tiered(spark, sf_dir))


@register("q_u5_product_scope", f"WITH {METRICS}, {PRIMARY}, {SCOPE} SELECT incident_id, dashboard_uid FROM scope")
def u5(spark, sf_dir):
    return product_scope(spark, sf_dir, candidates(spark, sf_dir)[1])


DATASOURCES = "SELECT 'c' || (n_nationkey % 3) AS connection_id, 'ds' || (n_nationkey // 3 + 2) AS uid, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'metrics' ELSE 'logs' END AS type FROM nation"


def datasources(spark, sf_dir):
    return derive(spark, sf_dir, DATASOURCES.replace("//", "div"), "nation")


@register("q_j11_broken_datasources", f"WITH targets AS ({TARGETS}), ds AS ({DATASOURCES}) SELECT DISTINCT connection_id, dashboard_uid, panel_id, datasource_uid FROM targets t WHERE datasource_uid NOT LIKE '$%' AND datasource_uid <> '-- Dashboard --' AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.connection_id = t.connection_id AND ds.uid = t.datasource_uid)")
def j11(spark, sf_dir):
    return catalog.broken_datasources(targets(spark, sf_dir), datasources(spark, sf_dir)).select(*PANEL, "datasource_uid")


@register("q_j13_resolved_datasources", f"""WITH ds AS ({DATASOURCES}), refs AS (SELECT p_partkey AS id, 'c' || (p_partkey % 3) AS connection_id, CASE p_partkey % 3 WHEN 0 THEN 'ds' || (p_partkey % 13) WHEN 1 THEN 'NATION_' || (p_partkey % 30) ELSE p_name END AS ref FROM part)
SELECT id, ref, coalesce((SELECT uid FROM ds WHERE ds.connection_id = refs.connection_id AND ds.uid = ref), (SELECT min(uid) FROM ds WHERE ds.connection_id = refs.connection_id AND ds.name = ref), ref) AS resolved FROM refs""")  # fmt: skip
def j13(spark, sf_dir):
    refs = derive(spark, sf_dir, "SELECT p_partkey AS id, 'c' || (p_partkey % 3) AS connection_id, CASE p_partkey % 3 WHEN 0 THEN 'ds' || (p_partkey % 13) WHEN 1 THEN 'NATION_' || (p_partkey % 30) ELSE p_name END AS ref FROM part", "part")
    return catalog.resolve_datasource(refs, datasources(spark, sf_dir)).select("id", "ref", "resolved")


@register("q_f14_text_filter", f"SELECT connection_id, uid FROM ({DATASOURCES}) WHERE contains(lower(name), 'nation_1') OR contains(lower(type), 'nation_1')")
def f14(spark, sf_dir):
    return datasources(spark, sf_dir).where(c.match_text("Nation_1", F.col("name"), F.col("type"))).select("connection_id", "uid")


RULES = "SELECT 'rule' || o_orderkey AS uid, 'Rule ' || (o_orderkey % 100) AS title, 'f' || (o_custkey % 5) AS folder_uid, CASE WHEN o_orderkey % 4 <> 0 THEN 'c' || (o_custkey % 3) END AS connection_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'd' || (o_custkey % 40) END AS dashboard_uid, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 90 END AS panel_id FROM orders"
BACKED = f"WITH targets AS ({TARGETS}), rules AS ({RULES}), panels AS (SELECT DISTINCT connection_id, dashboard_uid, panel_id, panel_title FROM targets), backed AS (SELECT connection_id, dashboard_uid, panel_id, panel_title, count(*) AS n_rules, string_agg(r.uid, ',' ORDER BY r.uid) AS rules FROM panels JOIN rules r USING (connection_id, dashboard_uid, panel_id) GROUP BY ALL)"


def backed(spark, sf_dir):
    return catalog.alert_backed_panels(targets(spark, sf_dir), derive(spark, sf_dir, RULES, "orders"))


@register("q_j12_alert_backed", f"{BACKED} SELECT * FROM backed")
def j12(spark, sf_dir):
    rows = backed(spark, sf_dir)
    return rows.select(*PANEL, "panel_title", F.size("rules").cast("bigint").alias("n_rules"), F.array_join(F.transform("rules", lambda r: r["uid"]), ",").alias("rules"))


@register("q_t4_alert_overview", f"{BACKED} SELECT connection_id, dashboard_uid, panel_id, n_rules, (SELECT count(*) FROM backed) AS total FROM backed ORDER BY n_rules DESC, connection_id, dashboard_uid, panel_id LIMIT 20")
def t4(spark, sf_dir):
    return catalog.alert_overview(backed(spark, sf_dir)).select(*PANEL, F.col("n_rules").cast("bigint").alias("n_rules"), "total")


HITS = {"text": "overlap > 0 OR contains(lower(dashboard_title), 'board 2')", "metric": "metric = 'metric_3'"}
SEARCH = """found AS (SELECT * FROM (SELECT *, (CASE WHEN svc = 's1' THEN 1 ELSE 0 END) AS overlap FROM index_) WHERE (HITS) AND dashboard_uid <> 'd1'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, dashboard_uid, panel_id ORDER BY overlap DESC, metric) AS i FROM found) WHERE i = 1)"""


def found(spark, sf_dir, metric=None):
    """Panels of one metric, or, without one, by a label value or a text."""
    return catalog.search_index(index(spark, sf_dir), {"svc": "s1"}, metric, "Board 2", "d1")


@register("q_r9_search_dedupe", f"WITH {METRICS}, {SEARCH.replace('HITS', HITS['text'])} SELECT connection_id, dashboard_uid, panel_id, metric, overlap::INT AS overlap FROM best")
def r9(spark, sf_dir):
    return found(spark, sf_dir).select(*PANEL, "metric", "overlap")


META = "SELECT 'c' || (s_suppkey % 3) AS connection_id, 'd' || (s_suppkey % 40) AS dashboard_uid, max(s_suppkey) AS updated, CASE WHEN max(s_suppkey) % 2 = 0 THEN 'alice' ELSE 'bob' END AS updated_by FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1, 2"
RELATED = f"""{BACKED}, {METRICS[METRICS.index("entries AS"):]}, {SEARCH}, meta AS ({META}), ranks AS (
  SELECT b.connection_id, b.dashboard_uid, b.panel_id, b.metric, k.panel_id IS NOT NULL AS alert_backed, overlap, updated, coalesce(updated_by = 'alice', false) AS same_author
  FROM best b LEFT JOIN backed k USING (connection_id, dashboard_uid, panel_id) LEFT JOIN meta USING (connection_id, dashboard_uid))"""


@register("q_t2_related_panels", f"{RELATED.replace('HITS', HITS['metric'])} SELECT connection_id, dashboard_uid, panel_id, metric, alert_backed, overlap::INT AS overlap, same_author, (SELECT count(*) FROM ranks) AS total FROM ranks ORDER BY alert_backed DESC, overlap DESC, same_author DESC, updated DESC NULLS LAST, connection_id, dashboard_uid, panel_id LIMIT 20")
def t2(spark, sf_dir):
    rows = catalog.rank_related(found(spark, sf_dir, "metric_3"), backed(spark, sf_dir), derive(spark, sf_dir, META, "supplier"), "alice")
    return rows.select(*PANEL, "metric", "alert_backed", "overlap", "same_author", "total")


@register("q_tool_find_related", f"{RELATED.replace('HITS', HITS['text'])} SELECT connection_id, dashboard_uid, panel_id, metric, alert_backed, overlap::INT AS overlap, same_author, updated FROM ranks")
def find_related(spark, sf_dir):
    rows = catalog.related(found(spark, sf_dir), backed(spark, sf_dir), derive(spark, sf_dir, META, "supplier"), "alice")
    return rows.select(*PANEL, "metric", "alert_backed", "overlap", "same_author", "updated")


@register("q_a6_label_overlap", "SELECT event_id, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + CASE WHEN user_id = 8 THEN 1 ELSE 0 END)::INT AS overlap FROM events")
def a6(spark, sf_dir):
    primary = F.create_map(F.lit("event_type"), F.lit("error"), F.lit("user"), F.lit("8"), F.lit("other"), F.lit("x"))
    rows = samples(spark, sf_dir, by_user=True)
    return rows.select("event_id", c.label_overlap(primary, F.col("labels")).alias("overlap"))


PANELS = """SELECT connection_id, dashboard_uid, panel_id, min(panel_title) AS panel_title, min(target_pos) AS at, bool_and(datasource_uid = '-- Dashboard --') AS is_mirror, panel_id % 9 <> 0 AS has_targets, panel_id % 4 = 0 AS has_links FROM targets GROUP BY connection_id, dashboard_uid, panel_id"""


@register("q_f20_mirror_panels", f"WITH targets AS ({TARGETS}) SELECT connection_id, dashboard_uid, l_orderkey % 5000 AS panel_id, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS mirrored FROM targets GROUP BY ALL HAVING bool_and(datasource_uid = '-- Dashboard --')")
def f20(spark, sf_dir):
    rows = targets(spark, sf_dir).withColumns({"panel_id": F.col("l_orderkey") % 5000, "mirrored_id": F.col("l_linenumber").cast("string")})
    return catalog.mirror_panels(rows).withColumn("mirrored", F.array_join("mirrored", ","))


@register("q_f21_duplicate_panels", """WITH panels AS (SELECT l_suppkey % 40 AS d, l_orderkey % 500 AS p, 'T' || (l_partkey % 3) AS t, l_orderkey, l_linenumber, l_partkey FROM lineitem),
n AS (SELECT d, p, count(*) AS k, count(*) FILTER (WHERE t = 'T1') AS hits FROM panels GROUP BY ALL)
SELECT 'd' || d AS dashboard_uid, p AS panel_id, t AS panel_title, l_orderkey, l_partkey, NOT (k = 1 OR hits = 1) AS ambiguous FROM panels JOIN n USING (d, p) WHERE k = 1 OR hits <> 1 OR t = 'T1'""")  # fmt: skip
def f21(spark, sf_dir):
    rows = derive(spark, sf_dir, "SELECT 'c' AS connection_id, 'd' || (l_suppkey % 40) AS dashboard_uid, l_orderkey % 500 AS panel_id, 'T' || (l_partkey % 3) AS panel_title, l_orderkey, l_partkey FROM lineitem", "lineitem")
    return catalog.find_panel(rows, "T1").select("dashboard_uid", "panel_id", "panel_title", "l_orderkey", "l_partkey", F.col("problem").isNotNull().alias("ambiguous"))


@register("q_f23_panel_survey", f"""WITH targets AS ({TARGETS}), panels AS ({PANELS}), kinds AS (
SELECT *, CASE WHEN NOT has_targets THEN 'non-queryable' WHEN is_mirror THEN 'mirror' WHEN row_number() OVER (PARTITION BY connection_id, dashboard_uid, (NOT is_mirror AND has_targets) ORDER BY "at", panel_id) <= 25 THEN 'executable' ELSE 'beyond-limit' END AS coverage FROM panels)
SELECT connection_id, dashboard_uid, panel_id, coverage, count(*) OVER (PARTITION BY connection_id, dashboard_uid, coverage) AS total FROM kinds""")  # fmt: skip
def f23(spark, sf_dir):
    targets(spark, sf_dir).createOrReplaceTempView("targets")
    return catalog.survey_panels(spark.sql(PANELS)).select(*PANEL, "coverage", "total")


KINDS = ("click", "error", "purchase", "signup", "view")


@register("q_tool_render_dashboard", f"""WITH targets AS ({TARGETS}), panels AS ({PANELS}), {SAMPLES}, kinds AS (
SELECT *, CASE WHEN NOT has_targets THEN 'non-queryable' WHEN is_mirror THEN 'mirror' WHEN row_number() OVER (PARTITION BY connection_id, dashboard_uid, (NOT is_mirror AND has_targets) ORDER BY "at", panel_id) <= 25 THEN 'executable' ELSE 'beyond-limit' END AS coverage,
  TIMESTAMP '2024-01-31 00:00:00' - to_days((substr(dashboard_uid, 2)::INT % 29 + 1)) AS from_ts, from_ts + INTERVAL 1 DAY AS to_ts, 'A|event_type=' || {list(KINDS)}[panel_id % 5 + 1] AS series_key FROM panels),
asked AS (SELECT DISTINCT from_ts, to_ts, series_key FROM kinds WHERE coverage = 'executable'),
stats AS (SELECT from_ts, to_ts, series_key, 'executable' AS coverage, count(v) AS n, round(avg(v), 6) AS mean, max(v) AS max, least(count(*), 50) AS points FROM asked JOIN samples s USING (series_key) WHERE t >= from_ts AND t <= to_ts GROUP BY ALL)
SELECT connection_id, dashboard_uid, panel_id, coverage, n, mean, max, points, 'https://g.example.com/d/' || dashboard_uid || '?viewPanel=' || panel_id || '&from=' || epoch_ms(from_ts) || '&to=' || epoch_ms(to_ts) || '&var-svc=s1' AS url
FROM kinds LEFT JOIN stats USING (from_ts, to_ts, series_key, coverage)""")  # fmt: skip
def render_dashboard(spark, sf_dir):
    """Every dashboard in its saved range of a day: each panel shows one kind of events."""
    targets(spark, sf_dir).createOrReplaceTempView("targets")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("panel_id") % 5).cast("int"))
    panels = spark.sql(PANELS).withColumn("series_key", F.concat(F.lit("A|event_type="), kind))
    ago = F.expr("cast(substring(dashboard_uid, 2) as int) % 29")
    saved = panels.select("connection_id", "dashboard_uid").distinct().select(
        "*", *[F.lit(None).cast("string").alias(f"{p}_{w}") for p in ("explicit", "link") for w in ("from", "to")],
        F.concat(F.lit("now-"), (ago + 1).cast("string"), F.lit("d")).alias("saved_from"), F.concat(F.lit("now-"), ago.cast("string"), F.lit("d")).alias("saved_to"),
    )
    ranges = windows.resolve_ranges(saved, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("connection_id", "dashboard_uid", "from_ts", "to_ts")
    shown, points = render.render_dashboards(panels, ranges, samples(spark, sf_dir), most=50)
    drawn = points.groupBy(*render.ASKED).agg(F.count(F.lit(1)).alias("points")).withColumn("coverage", F.lit("executable"))
    rows = shown.join(drawn, [*render.ASKED, "coverage"], "left")
    url = c.dashboard_link(F.lit("https://g.example.com"), F.col("dashboard_uid"), F.col("panel_id"), F.col("from_ts"), F.col("to_ts"), F.create_map(F.lit("svc"), F.lit("s1")))
    return rows.select(*PANEL, "coverage", "n", r6("mean").alias("mean"), "max", "points", url.alias("url"))


@register("q_f29_inventory", f"WITH targets AS ({TARGETS}), panels AS ({PANELS}) SELECT connection_id, dashboard_uid, count(*) AS panels, count(*) FILTER (WHERE has_targets) AS with_targets, count(*) FILTER (WHERE has_links) AS with_links, 'svc' AS variables FROM panels GROUP BY ALL")
def f29(spark, sf_dir):
    targets(spark, sf_dir).createOrReplaceTempView("targets")
    panels = spark.sql(PANELS)
    variables = panels.select("connection_id", "dashboard_uid").distinct().select("*", F.lit("svc").alias("name"), F.lit("query").alias("type"), F.lit("s1").alias("current"), F.lit(True).alias("multi"))
    rows = catalog.dashboard_inventory(panels, variables)
    return rows.withColumn("variables", F.array_join(F.transform("variables", lambda v: v["name"]), ","))


INNER = "array<struct<id:bigint,title:string,type:string,datasource:string,targets:array<struct<ref_id:string,datasource:string>>>>"


def nested(spark, sf_dir):
    """A dashboard for each order: panels for its lines, the odd ones in a row, with the panel's or their own datasource."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("id"), "l_partkey")
    target = F.struct(F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("ref_id"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("ds"), (F.col("l_partkey") % 11).cast("string"))).alias("datasource"))
    panels = rows.groupBy("l_orderkey", "id").agg(F.sort_array(F.collect_list(target)).alias("targets"))
    mixed = F.when(F.col("id") % 7 == 6, catalog.MIXED).otherwise(F.concat(F.lit("ds"), (F.col("id") % 7).cast("string")))
    fields = {"id": F.col("id"), "title": F.concat(F.lit("P"), F.col("id").cast("string")), "type": F.lit("graph"), "datasource": mixed, "targets": F.col("targets")}
    panel = F.struct(*[v.alias(k) for k, v in fields.items()])
    inner = panels.where("id % 2 = 1").groupBy("l_orderkey").agg(F.collect_list(panel).alias("panels"))
    shelf = F.struct(F.lit(100).cast("bigint").alias("id"), F.lit("row").alias("title"), F.lit("row").alias("type"), F.lit(None).cast("string").alias("datasource"), F.array().cast("array<struct<ref_id:string,datasource:string>>").alias("targets"), "panels")
    alone = F.struct(*[v.alias(k) for k, v in fields.items()], F.array().cast(INNER).alias("panels"))
    both = inner.select("l_orderkey", shelf.alias("p")).unionByName(panels.where("id % 2 = 0").select("l_orderkey", alone.alias("p")))
    uid = F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))
    boards = both.groupBy("l_orderkey").agg(F.collect_list("p").alias("panels"))
    return boards.select(F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("connection_id"), uid.alias("uid"), uid.alias("title"), "panels")


SOURCE = "CASE WHEN l_partkey % 2 = 0 THEN 'ds' || (l_partkey % 11) WHEN l_linenumber % 7 = 6 THEN NULL ELSE 'ds' || (l_linenumber % 7) END"


@register("q_s5_panel_targets", f"SELECT 'd' || l_orderkey AS dashboard_uid, l_linenumber::BIGINT AS panel_id, 'r' || l_partkey AS ref_id, {SOURCE} AS datasource_uid FROM lineitem")
def s5(spark, sf_dir):
    return catalog.panel_targets(catalog.flatten_panels(nested(spark, sf_dir))).select("dashboard_uid", "panel_id", "ref_id", "datasource_uid")


@register("q_tool_resolve_panel_queries", f"""WITH ds AS ({DATASOURCES}), t AS (SELECT 'c' || (l_orderkey % 3) AS connection_id, 'd' || l_orderkey AS dashboard_uid, l_linenumber::BIGINT AS panel_id, 'r' || l_partkey AS ref_id, {SOURCE} AS source FROM lineitem)
SELECT t.connection_id, dashboard_uid, panel_id, ref_id, source AS datasource_uid, max(ds.type) AS type FROM t LEFT JOIN ds ON ds.connection_id = t.connection_id AND ds.uid = source GROUP BY t.connection_id, dashboard_uid, panel_id, ref_id, source""")  # fmt: skip
def resolve_panels(spark, sf_dir):
    """The distinct queries of every panel with the datasource that each resolves to, and its type where it exists."""
    rows = catalog.panel_targets(catalog.flatten_panels(nested(spark, sf_dir))).select(*PANEL, "ref_id", F.col("datasource_uid").alias("ref")).distinct()
    sources = datasources(spark, sf_dir)
    types = sources.select("connection_id", F.col("uid").alias("resolved"), "type")
    resolved = catalog.resolve_datasource(rows, sources).join(types, ["connection_id", "resolved"], "left")
    return resolved.select(*PANEL, "ref_id", F.col("resolved").alias("datasource_uid"), "type")


@register("q_f19_panel_links", "SELECT 'd' || (s_suppkey % 40) AS dashboard_uid, s_suppkey AS panel_id, f AS field, s_name AS title, 'https://x/' || s_suppkey || coalesce(f, '') AS url FROM supplier, unnest([NULL, 'cpu']) AS t(f) WHERE f IS NULL OR s_suppkey % 2 = 0")
def f19(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    link = lambda f: F.struct(F.col("s_name").alias("title"), F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string"), F.lit(f)).alias("url"))
    override = F.struct(F.when(F.col("s_suppkey") % 2 == 0, "byName").otherwise("byType").alias("matcher"), F.lit("cpu").alias("field"), F.array(link("cpu")).alias("links"))
    panels = rows.select(F.lit("c0").alias("connection_id"), F.concat(F.lit("d"), (F.col("s_suppkey") % 40).cast("string")).alias("dashboard_uid"), F.col("s_suppkey").alias("panel_id"), F.array(link("")).alias("default_links"), F.array(override).alias("overrides"))
    return catalog.panel_links(panels).drop("connection_id")


@register("q_u4_distinct_dashboards", "SELECT DISTINCT 'c' || (s_suppkey % 3) AS connection_id, 'd' || (s_suppkey % 40) AS uid FROM supplier WHERE (s_suppkey % 40) % 5 <> 0")
def u4(spark, sf_dir):
    pages = derive(spark, sf_dir, "SELECT 'c' || (s_suppkey % 3) AS connection_id, 'd' || (s_suppkey % 40) AS uid, CASE WHEN (s_suppkey % 40) % 5 = 0 THEN 'dash-folder' ELSE 'dash-db' END AS type FROM supplier", "supplier")
    return catalog.distinct_dashboards(pages).drop("type")


@register("q_f9_filter_by_values", f"WITH {SAMPLES} SELECT event_id FROM samples WHERE event_type IN ('error', 'view')")
def f9(spark, sf_dir):
    return catalog.filter_by_values(samples(spark, sf_dir), "event_type", ["error", "view"]).select("event_id")


@register("q_f8_variable_values", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'x,y' WHEN 1 THEN 'all' WHEN 2 THEN 'a,b' ELSE '' END AS values, s_suppkey % 4 = 3 AS unresolved FROM supplier")
def f8(spark, sf_dir):
    n = F.col("s_suppkey") % 4
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    variables = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(n == 0, "given").otherwise("other").alias("name"), words("$__all").alias("current"),
        F.when(n == 1, "all").alias("all_value"), F.when(n == 2, words("$__all", "a", "b")).otherwise(F.array().cast("array<string>")).alias("options"),
    )
    rows = catalog.resolve_variable_values(variables, {"given": ["x", "y"]})
    return rows.select("id", F.array_join("values", ",").alias("values"), "unresolved")


@register("q_f11_filter_break_out", f"WITH {USER_SAMPLES} SELECT event_type, count(*) AS n FROM samples WHERE user_id = 8 GROUP BY 1")
def f11(spark, sf_dir):
    spec = catalog.breakout_filter(catalog.breakout_filter({}, "user", "8"), "user", "8")
    return catalog.apply_filters(samples(spark, sf_dir, by_user=True), spec).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("q_f12_group_break_out", f"WITH {USER_SAMPLES} SELECT event_type, user_id::VARCHAR AS user, round(sum(v), 6) AS v, count(v) AS n FROM samples GROUP BY ALL")
def f12(spark, sf_dir):
    groups, _ = catalog.breakout_group(["event_type"], "user")
    return catalog.aggregate_by(samples(spark, sf_dir, by_user=True), groups).select("event_type", "user", F.round(F.col("v") * F.lit(1.000000000001), 6).alias("v"), "n")


@register("q_a10_metric_catalog", "SELECT p_name AS metric, (SELECT count(DISTINCT p_name) FROM part WHERE contains(lower(p_name), 're')) AS total FROM part WHERE contains(lower(p_name), 're') GROUP BY 1 ORDER BY 1 LIMIT 50")
def a10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("metric"))
    return catalog.metric_catalog(rows, "RE")


@register("q_a10_label_keys", "SELECT unnest(['brand', 'type']) AS label FROM (SELECT 1 FROM part WHERE p_name = 'red widget' LIMIT 1)")
def a10_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("metric"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("labels"))
    return catalog.label_keys(rows, "red widget")


@register("q_a11_label_values", "SELECT p_brand AS value, count(*) AS n, (SELECT count(DISTINCT p_brand) FROM part WHERE p_name = 'red widget') AS total FROM part WHERE p_name = 'red widget' GROUP BY 1 ORDER BY 1 LIMIT 50")
def a11(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("metric"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("labels"))
    return catalog.label_values(rows, "red widget", "brand")


@register("q_a14_totals", f"WITH {METRICS} SELECT metric, panel_id, total FROM (SELECT metric, panel_id, row_number() OVER (PARTITION BY metric ORDER BY connection_id, dashboard_uid, panel_id) AS i, count(*) OVER (PARTITION BY metric) AS total FROM index_) WHERE i <= 5")
def a14(spark, sf_dir):
    return catalog.panels_of_metrics(stored(index(spark, sf_dir), "index")).select("metric", "panel_id", "total")


@register("q_a16_failed_sources", "SELECT DISTINCT 'c' || c_nationkey AS connection_id FROM customer WHERE 'c' || c_nationkey NOT IN (SELECT 'c' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def a16(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("connection_id"))
    got = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("connection_id"))
    return catalog.failed_sources(expected, got)


@register("q_j20_paired_sources", "SELECT 'm' || s_suppkey AS metric_id, 'l' || p_partkey AS log_id, 'tag' || (s_suppkey % 10) AS shared FROM supplier JOIN part ON s_suppkey % 10 = p_partkey % 10")
def j20(spark, sf_dir):
    tags = lambda k: F.array(F.concat(F.lit("tag"), (F.col(k) % 10).cast("string")), F.concat(F.lit("own"), F.col(k).cast("string")))
    metrics = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), tags("s_suppkey").alias("tags"))
    other = table(spark, sf_dir, "part").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("id"), F.transform(tags("p_partkey"), lambda t: F.replace(t, F.lit("own"), F.lit("log"))).alias("tags"))
    return catalog.pair_sources(metrics, other, lambda tags: F.array_join(tags, ","))


# alerts

ALERTS = """
SELECT 'c' || (o_custkey % 3) AS connection_id, o_orderkey AS id, 'fp' || (o_orderkey % 4000) AS fingerprint, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'firing' END AS state,
       'a' || (o_custkey % 20) AS alertname, o_orderpriority AS priority, o_orderdate AS starts_at, o_orderdate + INTERVAL 1 DAY AS ends_at,
       CASE WHEN o_orderkey % 5 = 0 THEN 'd' || (o_custkey % 40) END AS uid_note, CASE o_orderkey % 10 WHEN 0 THEN ' 7 ' WHEN 5 THEN 'seven' END AS panel_note,
       CASE WHEN o_orderkey % 5 = 1 THEN 'https://host' || (o_custkey % 6) || '.example.com/d/d' || (o_custkey % 40) || '/name?viewPanel=panel-' || (o_orderkey % 50) || '&var-svc=s' || (o_custkey % 5) || '&var-bad=%22x&from=1' END AS panel_url,
       CASE WHEN o_orderkey % 5 = 2 THEN 'https://HOST' || (o_custkey % 6) || '.example.com/d-solo/d' || (o_custkey % 40) || '?panelId=' || (o_orderkey % 50) END AS dashboard_url,
       CASE WHEN o_orderkey % 5 = 3 THEN 'https://host' || (o_custkey % 6) || '.example.com/alerting/grafana/r1/view' END AS generator_url
FROM orders"""


def raw_alerts(spark, sf_dir):
    rows = derive(spark, sf_dir, ALERTS, "orders")
    labels = F.create_map(F.lit("alertname"), F.col("alertname"), F.lit("priority"), F.col("priority"))
    notes = F.create_map(F.lit("__dashboardUid__"), F.col("uid_note"), F.lit("__panelId__"), F.col("panel_note"))
    return rows.select("connection_id", "id", "fingerprint", "state", labels.alias("labels"), F.map_filter(notes, lambda k, v: v.isNotNull()).alias("annotations"), F.col("starts_at").cast("timestamp").alias("starts_at"), F.col("ends_at").cast("timestamp").alias("ends_at"), "panel_url", "dashboard_url", "generator_url")


@register("q_f27_normal_alerts", f"""SELECT id, alertname AS alert_name, CASE id % 5 WHEN 0 THEN uid_note WHEN 1 THEN regexp_extract(panel_url, '/d/([^/]+)', 1) WHEN 2 THEN regexp_extract(dashboard_url, '/d-solo/([^?]+)', 1) END AS dashboard_uid,
CASE WHEN id % 10 = 0 THEN 7 WHEN id % 5 IN (1, 2) THEN id % 50 END AS panel_id, CASE WHEN id % 5 = 1 THEN 'svc=' || regexp_extract(panel_url, 'var-svc=(s.)', 1) ELSE '' END AS variables, CASE WHEN state = 'resolved' THEN epoch_ms(ends_at) END AS ends_ms,
CASE WHEN id % 10 = 5 THEN 'the annotated panel id is not a number: seven' WHEN id % 5 = 1 THEN 'unsafe values of variables were dropped: bad' WHEN id % 5 >= 3 THEN 'no link to a dashboard' ELSE '' END AS warnings FROM ({ALERTS})""")  # fmt: skip
def f27(spark, sf_dir):
    rows = alerts.normalize_alerts(raw_alerts(spark, sf_dir))
    variables = F.array_join(F.transform("variables", lambda v: F.concat_ws("=", v["name"], v["value"])), ",")
    return rows.select("id", "alert_name", "dashboard_uid", "panel_id", variables.alias("variables"), ms("ends_at").alias("ends_ms"), F.array_join("warnings", "; ").alias("warnings"))


@register("q_f27_link_kinds", f"SELECT id, CASE id % 5 WHEN 1 THEN 'dashboard' WHEN 2 THEN 'dashboard' WHEN 3 THEN 'alert-rule' END AS kind FROM ({ALERTS})")
def f27_kinds(spark, sf_dir):
    return raw_alerts(spark, sf_dir).select("id", alerts.link_kind(F.coalesce("panel_url", "dashboard_url", "generator_url")).alias("kind"))


@register("q_f28_thresholds", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'gt ' || (o_custkey % 9) WHEN 1 THEN 'within_range 1, ' || (o_custkey % 9) END AS threshold FROM orders")
def f28(spark, sf_dir):
    n, p = F.col("o_orderkey") % 3, (F.col("o_custkey") % 9).cast("string")
    query = lambda ref, kind, params: F.struct(F.lit(ref).alias("ref_id"), kind.alias("type"), params.alias("params"))
    data = F.array(query("A", F.lit(None).cast("string"), F.array().cast("array<string>")), query("B", F.when(n == 0, "gt").otherwise("within_range"), F.when(n == 0, F.array(p)).otherwise(F.array(F.lit("1"), p))))
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(n == 2, "A").otherwise("B").alias("condition"), data.alias("data"))
    return alerts.describe_threshold(rules).select("id", "threshold")


def connections(spark, sf_dir):
    """Five regions answer to hosts 0 to 4, and all but the first to host 3 as well."""
    rows = table(spark, sf_dir, "region")
    url = F.concat(F.lit("https://Host"), F.col("r_regionkey").cast("string"), F.lit(".example.com:3000/"))
    return rows.select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("id"), url.alias("url"), F.when(F.col("r_regionkey") > 0, F.array(F.lit("HOST3.example.com"))).alias("match_hosts"))


@register("q_j14_connections", f"SELECT id, CASE WHEN id % 5 IN (0, 4) THEN 'no-host' WHEN h = 3 THEN 'ambiguous' WHEN h < 5 THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN id % 5 IN (1, 2, 3) AND h < 5 AND h <> 3 THEN 'c' || h END AS connection_id FROM (SELECT id, CAST(regexp_extract(lower(coalesce(panel_url, dashboard_url, generator_url)), 'host([0-9])', 1) AS VARCHAR) AS hs, TRY_CAST(hs AS INT) AS h FROM ({ALERTS}))")
def j14(spark, sf_dir):
    return alerts.resolve_connections(raw_alerts(spark, sf_dir).drop("connection_id"), connections(spark, sf_dir)).select("id", "status", "connection_id")


def store(spark, sf_dir):
    """Batches of some of one day's alerts as JSON lines, in the order of their numbers; those of every third day are torn."""
    rows = raw_alerts(spark, sf_dir)
    alert = F.struct("fingerprint", F.col("state").alias("status"), "labels", "annotations", c.iso(F.col("starts_at")).alias("startsAt"), c.iso(F.col("ends_at")).alias("endsAt"), F.col("generator_url").alias("generatorURL"), F.col("dashboard_url").alias("dashboardURL"), F.col("panel_url").alias("panelURL"))
    batches = rows.groupBy("starts_at", F.floor(F.col("id") / 1000).alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", alert.alias("alert"))), lambda a, b: F.signum(a["id"] - b["id"]).cast("int")), lambda x: x["alert"]).alias("alerts"))
    line = F.to_json(F.struct(c.iso(c.later(F.col("starts_at"), F.lit(3_600_000))).alias("receivedAt"), F.struct("alerts").alias("payload")))
    torn = F.dayofmonth("starts_at") % 3 == 0
    place = F.struct(F.lit("store").alias("file"), F.lit(0).alias("block"), F.col("line"))
    return flatten_batches(parse_batches(batches.select(F.when(torn, F.left(line, F.lit(40))).otherwise(line).alias("value"), place.alias("place"))))


STORED = f"stored AS (SELECT *, starts_at + INTERVAL 1 HOUR AS received_at, id // 1000 AS line FROM ({ALERTS}) WHERE day(starts_at) % 3 <> 0)"


@register("q_s4_alert_store", f"WITH {STORED} SELECT fingerprint, state, epoch_ms(received_at) AS received_ms, alertname, coalesce(panel_url, dashboard_url, generator_url) AS url FROM stored")
def s4(spark, sf_dir):
    return store(spark, sf_dir).select("fingerprint", "state", ms("received_at").alias("received_ms"), F.col("labels")["alertname"].alias("alertname"), F.coalesce("panel_url", "dashboard_url", "generator_url").alias("url"))


@register("q_r7_latest_batch", f"WITH {STORED} SELECT fingerprint, state, epoch_ms(received_at) AS received_ms FROM stored WHERE (received_at, line) = (SELECT max((received_at, line)) FROM stored)")
def r7(spark, sf_dir):
    return alerts.latest_alert(store(spark, sf_dir)).select("fingerprint", "state", ms("received_at").alias("received_ms"))


NEWEST = f"WITH {STORED} SELECT fingerprint, state, epoch_ms(received_at) AS received_ms, alertname, coalesce(panel_url, dashboard_url, generator_url) AS url FROM stored"


def stored_alert(rows):
    return rows.select("fingerprint", "state", ms("received_at").alias("received_ms"), F.col("labels")["alertname"].alias("alertname"), F.coalesce("panel_url", "dashboard_url", "generator_url").alias("url"))


@register("q_r7_by_fingerprint", f"{NEWEST} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY received_at DESC, line DESC, id) = 1")
def r7_fingerprint(spark, sf_dir):
    return stored_alert(alerts.alert_by_fingerprint(store(spark, sf_dir)))


@register("q_r7_recent", f"{NEWEST} ORDER BY received_at DESC, line DESC, id LIMIT 20")
def r7_recent(spark, sf_dir):
    return stored_alert(alerts.recent_alerts(store(spark, sf_dir)))


@register("q_r7_recent_batches", f"{NEWEST} QUALIFY dense_rank() OVER (ORDER BY received_at DESC, line DESC) <= 20")
def r7_batches(spark, sf_dir):
    return stored_alert(alerts.recent_batches(store(spark, sf_dir)))


FIRING = f"""WITH f AS (SELECT * FROM ({ALERTS}) WHERE alertname = 'a7' AND priority = '5-LOW')
SELECT connection_id, id, epoch_ms(starts_at) AS starts_ms, coalesce(panel_url, dashboard_url, generator_url) AS link, total FROM (
SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY starts_at DESC, fingerprint) AS i, count(*) OVER (PARTITION BY connection_id) AS total FROM f) WHERE i <= 50"""


def firing(spark, sf_dir):
    return alerts.firing_alerts(raw_alerts(spark, sf_dir), {"alertname": "a7", "priority": "5-LOW"}).select("connection_id", "id", ms("starts_at").alias("starts_ms"), "link", "total")


register("q_t3_firing_alerts", FIRING)(firing)


@register("q_f13_label_filter", f"SELECT id FROM ({ALERTS}) WHERE alertname = 'a3' AND priority = '1-URGENT'")
def f13(spark, sf_dir):
    return raw_alerts(spark, sf_dir).where(c.match_labels(F.col("labels"), {"alertname": "a3", "priority": "1-URGENT"})).select("id")


@register("q_f22_links", f"""SELECT id, 'https://g.example.com/d/b' || (id % 7) || '?viewPanel=' || (id % 50) || '&from=' || epoch_ms(starts_at) || '&to=' || epoch_ms(ends_at) || '&var-name=' || alertname AS dashboard,
'https://g.example.com/dashboards/f/f' || (id % 5) AS folder, 'https://l.example.com/search?q=id%3A' || id || '&rangetype=absolute&from=' || replace(strftime(starts_at, '%Y-%m-%dT%H:%M:%S.%g'), ':', '%3A') || 'Z&to=' || replace(strftime(ends_at, '%Y-%m-%dT%H:%M:%S.%g'), ':', '%3A') || 'Z' AS log FROM ({ALERTS})""")  # fmt: skip
def f22(spark, sf_dir):
    rows = raw_alerts(spark, sf_dir)
    text = lambda p, n: F.concat(F.lit(p), (F.col("id") % n).cast("string"))
    board = c.dashboard_link(F.lit("https://g.example.com/"), text("b", 7), F.col("id") % 50, F.col("starts_at"), F.col("ends_at"), F.create_map(F.lit("name"), F.col("labels")["alertname"]))
    log = c.log_link(F.lit("https://l.example.com"), F.concat(F.lit("id:"), F.col("id").cast("string")), F.col("starts_at"), F.col("ends_at"))
    return rows.select("id", board.alias("dashboard"), c.folder_link(F.lit("https://g.example.com"), text("f", 5)).alias("folder"), log.alias("log"))


# knowledge


def known(spark, sf_dir):
    return knowledge.extract_knowledge(derive(spark, sf_dir, KNOWLEDGE, "documents"))


@register("q_f24_knowledge", f"""WITH {FIRST} SELECT dashboard_uid, panel_id, product_key, CASE WHEN panel_id % 3 = 0 THEN '{{"id":' || panel_id || ',"links":["/d/d' || (panel_id % 17) || '/x"]}}' END AS json,
CASE panel_id % 3 WHEN 0 THEN 'see  more ```json' || chr(10) || '{{"second": 2}}' || chr(10) || '``` end' ELSE content END AS prose, panel_id % 3 = 1 AS parse_error FROM firsts""")  # fmt: skip
def f24(spark, sf_dir):
    return known(spark, sf_dir).drop("connection_id")


@register("q_f25_related_uids", f"WITH {FIRST} SELECT DISTINCT dashboard_uid, 'd' || (panel_id % 17) AS uid FROM firsts WHERE panel_id % 3 = 0")
def f25(spark, sf_dir):
    return knowledge.related_uids(known(spark, sf_dir), "json", "dashboard_uid")


@register("q_f25_page_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)', 1)) AS uid FROM pages")
def f25_pages(spark, sf_dir):
    """Page links, read as links to dashboards."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", 'href="/(?=[A-Za-z]+)([A-Za-z]+)', 'href="/d/$1"').alias("h"))
    only = pages.withColumn("h", F.array_join(F.regexp_extract_all("h", F.lit('href="(/d/[A-Za-z]+)"'), 1), " "))
    return knowledge.related_uids(only, "h", "page_id")


@register("q_j17_all_matches", f"WITH {FIRST} SELECT dashboard_uid, panel_id, product_key FROM firsts WHERE product_key IN ('key4', 'key8', 'key13')")
def j17(spark, sf_dir):
    keys = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, " KEY4 ").when(F.col("r_regionkey") == 1, "Key8\n").otherwise("key13").alias("key"))
    return knowledge.knowledge_matches(known(spark, sf_dir), keys).select("dashboard_uid", "panel_id", "product_key")


FOLDERS = "SELECT p_partkey AS uid, CASE WHEN p_partkey > 1 THEN floor(p_partkey / 2)::BIGINT END AS parent_uid FROM part WHERE p_partkey > 0"


def folders(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_partkey > 0")
    return rows.select(F.col("p_partkey").alias("uid"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent_uid"))


WALK = f"WITH RECURSIVE folders AS ({FOLDERS}), walk AS (SELECT uid, parent_uid AS ancestor, 1 AS depth FROM folders WHERE parent_uid IS NOT NULL UNION ALL SELECT w.uid, f.parent_uid, depth + 1 FROM walk w JOIN folders f ON f.uid = w.ancestor WHERE f.parent_uid IS NOT NULL AND depth < 10)"


@register("q_j18_ancestors", f"{WALK} SELECT uid, ancestor, depth FROM walk")
def j18(spark, sf_dir):
    rows = folders(spark, sf_dir)
    return knowledge.folder_ancestors(spark, rows, rows.select("uid"))


BELOW = f"""WITH RECURSIVE folders AS ({FOLDERS}), walk AS (
  SELECT uid AS root, uid, 0 AS depth FROM folders UNION ALL SELECT w.root, f.uid, depth + 1 FROM walk w JOIN folders f ON f.parent_uid = w.uid),
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, uid) - 1 AS nth FROM walk), boards AS (
  SELECT c_custkey AS uid, c_name AS title, c_custkey % 1000 AS folder_uid FROM customer),
held AS (SELECT root, b.uid, title, nth FROM placed p JOIN boards b ON b.folder_uid = p.uid WHERE nth < 500)"""


def boards(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("title"), (F.col("c_custkey") % 1000).alias("folder_uid"))


def contents(spark, sf_dir, recursive):
    """What every folder of the tree holds: customers as dashboards."""
    rows = folders(spark, sf_dir).withColumn("title", F.concat(F.lit("Folder "), F.col("uid").cast("string")))
    return knowledge.folder_contents(rows, boards(spark, sf_dir), rows.select(F.col("uid").alias("root")), recursive)


@register("q_j19_descendants", f"{BELOW} SELECT root, uid, depth, nth FROM placed WHERE nth < 500")
def j19(spark, sf_dir):
    return contents(spark, sf_dir, True).folders.withColumnRenamed("at", "nth")


@register("q_j19_dashboards", f"{BELOW} SELECT * FROM (SELECT root, uid, title, row_number() OVER (PARTITION BY root ORDER BY nth, uid) AS place FROM held) WHERE place <= 200")
def j19_dashboards(spark, sf_dir):
    return contents(spark, sf_dir, True).dashboards


@register("q_tool_list_folder", f"""{BELOW}, direct AS (SELECT parent_uid AS root, count(*) AS n FROM folders WHERE parent_uid IS NOT NULL GROUP BY 1), forms AS (SELECT unnest([true, false]) AS recursive),
boards_of AS (SELECT root, count(*) AS n, count(*) FILTER (WHERE nth = 0) AS own FROM held GROUP BY 1), sizes AS (SELECT root, count(*) AS n FROM placed GROUP BY 1)
SELECT s.root, recursive, coalesce(CASE WHEN recursive THEN b.n ELSE b.own END, 0) AS dashboards_total, coalesce(d.n, 0) AS subfolders_total,
CASE WHEN recursive THEN least(s.n, 500) ELSE 1 END AS folders_scanned, recursive AND s.n > 500 AS truncated FROM sizes s CROSS JOIN forms LEFT JOIN direct d USING (root) LEFT JOIN boards_of b USING (root)""")  # fmt: skip
def list_folder(spark, sf_dir):
    """Both forms of the listing of every folder, with what each leaves out."""
    whole, one = (contents(spark, sf_dir, r).summary.withColumn("recursive", F.lit(r)) for r in (True, False))
    return whole.unionByName(one)


ATTACH = f"""{WALK}, {FIRST}, al AS (SELECT o_orderkey AS alert_id, o_orderkey % 2000 AS folder, 'key' || (o_custkey % 60) AS k0, 'key' || (o_custkey % 7) AS k1 FROM orders),
keys AS (SELECT alert_id, 0 AS position, k0 AS key FROM al UNION ALL SELECT alert_id, 1, k1 FROM al),
best AS (SELECT alert_id, key, min(position) AS position FROM keys GROUP BY ALL),
homes AS (SELECT DISTINCT dashboard_uid, 10 * substr(dashboard_uid, 2)::BIGINT AS home FROM firsts),
up AS (SELECT uid, ancestor, depth FROM walk UNION ALL SELECT uid, uid, 0 FROM folders),
walked AS (SELECT a.alert_id, arg_min(h.dashboard_uid, u.depth) AS near, min(u.depth) AS depth FROM al a JOIN up u ON u.uid = a.folder JOIN homes h ON h.home = u.ancestor GROUP BY 1),
hits AS (SELECT b.alert_id, f.dashboard_uid, f.panel_id, f.product_key, b.position, CASE WHEN f.dashboard_uid = w.near THEN w.depth END AS depth
  FROM best b JOIN firsts f ON f.product_key = b.key LEFT JOIN walked w USING (alert_id)),
attached AS (SELECT alert_id, dashboard_uid, panel_id, product_key, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY depth IS NULL, dashboard_uid, position, panel_id) AS i FROM hits) WHERE i = 1)"""


@register("q_j16_attached_knowledge", f"{ATTACH} SELECT * FROM attached")
def j16(spark, sf_dir):
    """Alerts in folders of the tree; every tenth folder is the home of a knowledge dashboard."""
    rows = folders(spark, sf_dir)
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), (F.col("o_orderkey") % 2000).alias("at"), F.array(F.concat(F.lit("  Key"), (F.col("o_custkey") % 60).cast("string"), F.lit(" ")), F.concat(F.lit("key"), (F.col("o_custkey") % 7).cast("string"))).alias("k"))
    keys = own.select("alert_id", F.posexplode("k").alias("position", "key"))
    asked = own.select(F.col("at").alias("uid")).distinct()
    up = knowledge.folder_ancestors(spark, rows, rows.select("uid").join(asked, "uid", "left_semi"), own=True)
    panels = stored(known(spark, sf_dir), "knowledge")
    homes = panels.select("dashboard_uid").distinct().withColumn("home", F.expr("10 * cast(substring(dashboard_uid, 2) as bigint)"))
    up = up.join(homes, F.col("ancestor") == F.col("home"), "left_semi")  # folders without knowledge lead to nothing
    above = own.join(up, F.col("at") == F.col("uid")).select("alert_id", F.col("ancestor").alias("folder"), "depth")
    found = knowledge.attach_knowledge(own.select("alert_id"), keys, above, panels, homes)
    return found.select("alert_id", "dashboard_uid", "panel_id", "product_key", "depth")


@register("q_tool_get_alert_context", f"""{ATTACH}, ctx AS (SELECT id, alertname AS alert_name, state, CASE id % 5 WHEN 0 THEN uid_note WHEN 1 THEN regexp_extract(panel_url, '/d/([^/]+)', 1) WHEN 2 THEN regexp_extract(dashboard_url, '/d-solo/([^?]+)', 1) END AS dashboard_uid,
TRY_CAST(regexp_extract(lower(coalesce(panel_url, dashboard_url, generator_url)), 'host([0-9])', 1) AS INT) AS h FROM ({ALERTS}))
SELECT id, alert_name, state, ctx.dashboard_uid, CASE WHEN h < 5 AND h <> 3 THEN 'c' || h END AS connection_id, k.dashboard_uid AS knowledge_uid, k.panel_id AS knowledge_panel, k.product_key FROM ctx LEFT JOIN attached k ON k.alert_id = ctx.id""")  # fmt: skip
def alert_context(spark, sf_dir):
    """Each alert with what it links to, the connection that its host belongs to, and its knowledge panel."""
    rows = alerts.normalize_alerts(raw_alerts(spark, sf_dir).drop("connection_id"))
    rows = alerts.resolve_connections(rows, connections(spark, sf_dir)).select("id", "alert_name", "state", "dashboard_uid", "connection_id")
    own = j16(spark, sf_dir).select(F.col("alert_id").alias("id"), F.col("dashboard_uid").alias("knowledge_uid"), F.col("panel_id").alias("knowledge_panel"), "product_key")
    return rows.join(own, "id", "left").select("id", "alert_name", "state", "dashboard_uid", "connection_id", "knowledge_uid", "knowledge_panel", "product_key")


@register("q_tool_get_product_context", f"""WITH {FIRST} SELECT o_custkey % 60 AS k, count(DISTINCT o_orderkey) AS asked, any_value(n) AS panels, any_value(links) AS links FROM orders
JOIN (SELECT product_key, count(*) AS n, count(DISTINCT CASE WHEN panel_id % 3 = 0 THEN panel_id % 17 END) AS links FROM firsts GROUP BY 1) ON product_key = 'key' || (o_custkey % 60) GROUP BY 1""")  # fmt: skip
def product_context(spark, sf_dir):
    """The products that customers ask for: every knowledge panel of the key, and the dashboards that these link to."""
    panels = known(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 60).alias("k")).agg(F.countDistinct("o_orderkey").alias("asked"))
    asked = asked.withColumn("product_key", F.concat(F.lit("key"), F.col("k").cast("string")))
    matches = knowledge.knowledge_matches(panels, asked.select(F.col("product_key").alias("key")))
    linked = knowledge.related_uids(matches, "json", "product_key").groupBy("product_key").agg(F.countDistinct("uid").alias("links"))
    counts = matches.groupBy("product_key").agg(F.count(F.lit(1)).alias("panels"))
    rows = asked.join(counts, "product_key").join(linked, "product_key", "left")
    return rows.select("k", "asked", "panels", F.coalesce("links", F.lit(0)).alias("links"))
