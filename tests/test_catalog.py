"""Cases of sources, sinks, log joins, panels, alerts, knowledge and masking."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as c
from tidewatch.functions.patterns import BadPattern, stored_pattern
from tidewatch.operators import alerts, catalog, knowledge, logs, mask, skew
from tidewatch.session import work_path
from tidewatch.sources import csv, frames, index_store
from tidewatch.sources.alerts import read_alert_store
from tidewatch.streaming import feeds
from tidewatch.sources.logs import promote_labels


def written(spark, *lines):
    path = work_path(spark, "t")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_frames(spark):
    path = written(
        spark,
        '{"results": {"A": {"frames": [{"fields": [{"name": "Time", "type": "time"}, {"name": "x", "type": "number", "labels": {"host": "b", "az": "1"}}, {"name": "s", "type": "string"}, {"name": "y", "type": "number"}], "values": [[0, 60000], [1, null], ["p", "q"], [3]]}]}}}',
        '{"results": {"B": {"error": "timeout"}, "C": {"frames": [{"fields": [{"name": "v", "type": "number"}], "values": [[1]]}]}}}',
    )
    results = frames.read_results(spark, path)
    rows = {(r.series_key, r.ms, r.v) for r in frames.frame_samples(results).select("series_key", F.unix_millis("t").alias("ms"), "v").collect()}
    assert rows == {("A|az=1,host=b", 0, 1.0), ("A|az=1,host=b", 60000, None), ("A|", 0, 3.0), ("A|", 60000, None)}
    assert [(r.ref_id, r.message) for r in frames.frame_errors(results).collect()] == [("B", "timeout")]
    cells = sorted(tuple(r.cells) for r in frames.frame_rows(results).where("ref_id = 'A'").collect())
    assert cells == [("1970-01-01T00:00:00.000Z", "1", "p", "3"), ("1970-01-01T00:01:00.000Z", None, "q", None)]


def test_log_labels(spark):
    df = spark.createDataFrame([("1", None, "m", '{"n": 5, "b": true, "none": null, "_id": "x", "source": "y", "s": "t", "o": {"k": 1}}')], "id string, source string, message string, fields string").withColumn("ts", F.current_timestamp())
    row = promote_labels(df).first()
    assert row.source == "unknown" and row.labels == {"n": "5", "b": "true", "s": "t", "o": '{"k":1}'}


def test_torn_lines_of_the_alert_store(spark):
    path = written(spark, '{"receivedAt": "2024-01-01T00:00:00Z", "payload": {"alerts": [{"fingerprint": "a", "status": "firing", "labels": {"x": "1"}}]}}', '{"receivedAt": "2024-01-0', "", "nonsense")
    assert [(r.fingerprint, r.labels) for r in read_alert_store(spark, path).collect()] == [("a", {"x": "1"})]


def test_column_names():
    assert csv.column_names([("A", {"job": "node", "host": "web1"})]) == ["host=web1,job=node"]
    assert csv.column_names([("A", {}), ("A", {}), ("A (2)", {})]) == ["A", "A (2)", "A (2) (2)"]


@pytest.mark.parametrize(
    ("cell", "want"),
    [("=1+1", "'=1+1"), ("\t=1+1", "'\t=1+1"), ("+x", "'+x"), ("-1+1", "'-1+1"), ("@x", "'@x"), ("-1.5", "-1.5"), ("+2", "+2"), ("1e3", "1e3"), ("a=b", "a=b"), (" =1", " =1"), ("\x01=1", "\x01=1"), ("\n=1", "'\n=1"), ("\tHello", "\tHello"), ("-5\n", "'-5\n"), (None, None), ("", "")],
)
def test_neutral_cells(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "a string").withColumnRenamed("a", "=h")
    out = csv.neutralize_cells(df)
    assert out.first()[0] == want and out.columns == ["'=h"]


def test_wide_csv(spark):
    rows = [("A", {"host": "a"}, "A|host=a", 0, 1.0), ("B", {"host": "b"}, "B|host=b", 60000, 2.5)]
    df = spark.createDataFrame(rows, "ref_id string, labels map<string,string>, series_key string, ms long, v double").withColumn("t", F.timestamp_millis("ms"))
    path = work_path(spark, "csv")
    csv.export_wide_csv(df, path)
    content = b"".join(r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).orderBy("path").collect())
    assert content.replace(b"timestamp,host=a,host=b\r\n", b"") == b"1970-01-01T00:00:00.000Z,1,\r\n1970-01-01T00:01:00.000Z,,2.5\r\n"


LOGS = [("frontend", "r1", 0), ("frontend", "r2", 1), ("backend", "r1", 2), ("db", "r1", 3), ("other", None, 4)]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(LOGS, "stream string, key string, ts long")
    return df.select("stream", "key", F.timestamp_seconds("ts").alias("ts"), F.lit("m").alias("message")).where("key is not null")


@pytest.mark.parametrize(
    ("names", "how", "want"),
    [
        (["frontend", "backend"], "and", {("r1", "complete", 2)}),
        (["frontend", "backend"], "unless", {("r2", "partial", 1)}),
        (["frontend", "backend"], "or", {("r1", "complete", 2), ("r2", "partial", 1)}),
        (["frontend", "backend", "db"], "and", {("r1", "complete", 3)}),
        (["backend", "frontend"], "unless", set()),
        (["frontend", "none"], "and", set()),
    ],
)
def test_log_joins(events, names, how, want):
    assert {(r.key, r.completeness, r.n_events) for r in logs.correlate_logs(events, names, how).collect()} == want


def test_truncated_streams(events):
    kept, stats = logs.cap_stream(events, 1)
    assert {(r.stream, r.fetched, r.total, r.truncated) for r in stats.collect()} == {("frontend", 1, 2, True), ("backend", 1, 1, False), ("db", 1, 1, False)}
    assert all(r.truncated for r in logs.correlate_logs(kept, ["frontend", "backend"], "or", stats).collect())
    with pytest.raises(Exception, match="truncated"):
        logs.correlate_logs(kept, ["backend", "frontend"], "unless", stats).collect()


@pytest.mark.parametrize("name", ["q_tool_correlate_logs", "q_tool_find_related"])
def test_whole_results_have_no_cap(spark, small, name):
    from tidewatch.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "10000000)" not in plan and "2000000000" not in plan


TARGET = "connection_id string, dashboard_uid string, dashboard_title string, panel_id long, panel_title string, target_pos int, ref_id string, datasource_uid string, expr string, query string, raw_query boolean, measurement string, tags array<struct<key:string,operator:string,value:string>>"


def target(expr=None, query=None, raw=None, measurement=None, tags=None, uid="d1", panel=1, source="prom1", title="Checkout overview"):
    return ("c", uid, title, panel, f"Panel {panel}", 0, "A", source, expr, query, raw, measurement, tags or [])


@pytest.mark.parametrize(
    ("given", "metrics", "pairs"),
    [
        (target('rate(http_requests_total{service="checkout"}[5m])'), {"http_requests_total"}, {("service", "checkout")}),
        (target('sum by (a, b) (rate(x{p=~"q.*"}[1m])) / sum(y)'), {"x", "y"}, {("p", "q.*")}),
        (target('{__name__="z", k!="v"}'), set(), {("k", "v")}),
        (target("up"), {"up"}, set()),
        (target('a{l="b{c}"} + 2'), {"a"}, {("l", "b{c}")}),
        (target('count{x="1"} + count (up) offset 5m'), {"count", "up"}, {("x", "1")}),
        (target('max without (a, b) (job:rate5m{}) and on (c) "not_this" == 3e5'), {"job:rate5m"}, set()),
        (target('label_replace(m, "dst", "$1", "src", "(.*)")'), {"m"}, set()),
        (target(query='SELECT x FROM "my metric" WHERE t > 1', raw=True), {"my metric"}, set()),
        (target(query="SELECT 1", raw=True), set(), set()),
        (target(query='SELECT x FROM "db"."rp"."cpu" WHERE "host" = \'h1\' AND t > 1 GROUP BY time(1m)', raw=True, measurement="stale"), {"cpu"}, {("host", "h1")}),
        (target(query="SELECT x FROM stale", raw=False, measurement="mem", tags=[("host", "=", "h2")]), {"mem"}, {("host", "h2")}),
        (target(query="select x from (disk)", raw=None, measurement="mem"), {"mem", "disk"}, set()),
        (target('a{x="1",y!~"2, z=\\"3\\"" , w = "4"} > on (x) b{x="1"} # "'), {"a", "b"}, {("x", "1"), ("y", '2, z=\\"3\\"'), ("w", "4")}),
        (target('a{p="c:\\\\", q="r"}'), {"a"}, {("p", "c:\\\\"), ("q", "r")}),
        (target(query="SELECT x FROM cpu WHERE (a='1' OR \"b\" = '2 and c = 3') AND d != '4' AND e >= '5'\n AND f='6' GROUP BY g='7'", raw=True), {"cpu"}, {("a", "1"), ("b", "2 and c = 3"), ("f", "6")}),
        (target(query='select x from ( "a.b"."c d" ) where k=\'v\' limit 1', raw=True), {"c d"}, {("k", "v")}),
        (target(query="", raw=True, measurement="m"), set(), set()),
    ],
)
def test_query_info(spark, given, metrics, pairs):
    row = catalog.extract_query_info(spark.createDataFrame([given], TARGET)).first()
    assert set(row.metrics) == metrics and {(p.key, p.value) for p in row.label_pairs} == pairs


def test_texts_are_read_once_each(spark, monkeypatch):
    """However often a text occurs and however its results are used; a hot text is dealt where the table is too large to broadcast."""
    rows = [target('rate(x{p="q"}[1m])', panel=i) for i in range(60)] + [target(f'y{i}{{p="{i}"}}', panel=i) for i in range(20)] + [target(query="SELECT v FROM z", panel=7)]
    df = spark.createDataFrame(rows, TARGET)
    table = catalog.query_texts(catalog.active_query_fields(df).withColumn("_text", F.struct(*catalog.TEXTS)).withColumn("_hash", F.xxhash64("_text")))
    assert sorted((r["_n"], *r["_info"].metrics) for r in table.collect()) == sorted([(60, "x"), *[(1, f"y{i}") for i in range(20)], (1, "z")])
    index = catalog.build_metric_index(df)
    assert "regexp" not in index._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(str, index.collect()))
    monkeypatch.setattr(catalog, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 8)
    assert sorted(map(str, catalog.build_metric_index(df).collect())) == want


def test_index_and_broken_sources(spark):
    rows = [target('rate(http_requests_total{service="checkout"}[5m])'), target('http_requests_total{service="payments"}', uid="d2", panel=5, title="Payments overview"), target("up", source="missing-ds", panel=2), target("up", source="$ds", panel=3), target("up", source="-- Dashboard --", panel=4)]
    df = spark.createDataFrame(rows, TARGET)
    index = catalog.build_metric_index(df)
    assert index.where("metric = 'http_requests_total'").count() == 2
    known = spark.createDataFrame([("c", "prom1", "Prom", "metrics")], "connection_id string, uid string, name string, type string")
    assert [(r.panel_id, r.datasource_uid) for r in catalog.broken_datasources(df, known).collect()] == [(2, "missing-ds")]
    found = catalog.search_index(index, {"service": "payments"}, text="CHECKOUT").collect()
    assert {(r.dashboard_uid, r.overlap) for r in found if r.metric == "http_requests_total"} == {("d1", 0), ("d2", 1)}


def test_variables(spark):
    schema = "name string, current array<string>, all_value string, options array<string>"
    df = spark.createDataFrame([("a", ["x"], None, None), ("b", ["$__all"], ".*", ["1"]), ("c", ["$__all"], None, ["$__all", "1", "2"]), ("d", ["$__all"], None, None), ("e", ["x"], None, None)], schema)
    rows = {r.name: (r["values"], r.unresolved) for r in catalog.resolve_variable_values(df, {"e": ["y", "z"]}).collect()}
    assert rows == {"a": (["x"], False), "b": ([".*"], False), "c": (["1", "2"], False), "d": ([], True), "e": (["y", "z"], False)}


def test_break_outs():
    assert catalog.breakout_filter({"a": "1"}, "a", "1") == {"a": "1"} and catalog.breakout_filter({}, "a", "") == {"a": ""}
    with pytest.raises(catalog.FilterConflict):
        catalog.breakout_filter({"a": "1"}, "a", "2")
    assert catalog.breakout_group(["a"], "b") == (["a", "b"], None) and catalog.breakout_group(["a"], "a") == (["a"], None)
    assert catalog.breakout_group(None, "a", without=["a", "b"]) == (None, ["b"])
    with pytest.raises(ValueError):
        catalog.breakout_group(None, "a")


ALERT = "id int, state string, labels map<string,string>, annotations map<string,string>, starts_at timestamp, ends_at timestamp, panel_url string, dashboard_url string, generator_url string"
NOW = dt.datetime(2024, 1, 1)


def normal(spark, annotations=None, panel_url=None, dashboard_url=None, generator_url=None, state="firing"):
    return alerts.normalize_alerts(spark.createDataFrame([(1, state, {"alertname": "A"}, annotations or {}, NOW, NOW, panel_url, dashboard_url, generator_url)], ALERT)).first()


def test_alerts(spark):
    r = normal(spark, {"__dashboardUid__": "u", "__panelId__": "4"}, panel_url="https://g/d/other?viewPanel=9")
    assert (r.dashboard_uid, r.panel_id, r.warnings, r.ends_at, r.alert_name) == ("u", 4, [], None, "A")
    r = normal(spark, {"__dashboardUid__": "u", "__panelId__": "abc"})
    assert r.panel_id is None and len(r.warnings) == 1
    r = normal(spark, panel_url="https://g/d/abc/name?viewPanel=panel-3&var-h=a&var-h=b%20c&var-bad=x%22y", state="resolved")
    assert (r.dashboard_uid, r.panel_id, [(v.name, v.value) for v in r.variables], r.ends_at) == ("abc", 3, [("h", "a"), ("h", "b c")], NOW) and "bad" in r.warnings[0]
    r = normal(spark, generator_url="https://g/alerting/grafana/x/view")
    assert r.dashboard_uid is None and r.warnings == ["no link to a dashboard"]
    r = normal(spark, panel_url="not a url at all %%%", dashboard_url="https://g/d-solo/k?panelId=7")
    assert (r.dashboard_uid, r.panel_id) == ("k", 7)


def test_link_kinds(spark):
    links = ["https://g/d/a", "https://g/dashboards/f/x/y", "https://g/goto/abc", "https://g/alerting/grafana/r/view", "https://g/else", "::", None]
    df = spark.createDataFrame([(x,) for x in links], "u string")
    assert [r[0] for r in df.select(alerts.link_kind(F.col("u"))).collect()] == ["dashboard", "folder", "short-link", "alert-rule", None, None, None]


def test_connections(spark):
    known = spark.createDataFrame([("a", "https://One.example.com:3000/x", ["alias.example.com"]), ("b", "https://two.example.com", ["ALIAS.example.com"])], "id string, url string, match_hosts array<string>")
    df = spark.createDataFrame([(f"https://{h}/d/x",) if h else (None,) for h in ("one.example.com", "TWO.example.com", "alias.example.com", "none", None)], "panel_url string").withColumns({"dashboard_url": F.lit(None).cast("string"), "generator_url": F.lit(None).cast("string")})
    rows = {(r.status, r.connection_id) for r in alerts.resolve_connections(df, known).collect()}
    assert rows == {("matched", "a"), ("matched", "b"), ("ambiguous", None), ("unmatched", None), ("no-host", None)}
    assert alerts.resolve_connections(df, known.limit(1)).where("panel_url is null").first().status == "only-connection"


def test_knowledge(spark):
    fence = "```json\n{}\n```"
    rows = [("c", "d", 1, 1, "Knowledge: Key", f"a {fence} b"), ("c", "d", 2, 2, "knowledge: key", "later"), ("c", "d", 3, 3, "knowledge: bad", "```json\n{oops\n```"), ("c", "d", 4, 4, "knowledge: none", " plain "), ("c", "d", 5, 5, "Title", "x"), ("c", "d", 6, 6, None, "x")]
    out = {r.product_key: (r.json, r.prose, r.parse_error) for r in knowledge.extract_knowledge(spark.createDataFrame(rows, "connection_id string, dashboard_uid string, panel_id int, at int, title string, content string")).collect()}
    assert out == {"key": ("{}", "a  b", False), "bad": (None, "```json\n{oops\n```", True), "none": (None, "plain", False)}


def test_knowledge_with_two_blocks(spark):
    text = 'A ```json\n{"a": 1}\n``` B ```json\n{"b": 2}\n``` C\n'
    rows = [("c", "d", 1, 1, "knowledge: k", text)]
    row = knowledge.extract_knowledge(spark.createDataFrame(rows, "connection_id string, dashboard_uid string, panel_id int, at int, title string, content string")).first()
    assert (row.json, row.prose) == ('{"a":1}', 'A  B ```json\n{"b": 2}\n``` C')


def test_knowledge_of_the_nearest_folder(spark):
    folders = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("far", None)], "uid string, parent_uid string")
    start = [(1, "b"), (2, "a"), (3, "far"), (4, "b"), (5, "b")]
    up = knowledge.folder_ancestors(spark, folders, folders.select("uid"), own=True)
    assert {(r.ancestor, r.depth) for r in up.where("uid = 'b'").collect()} == {("b", 0), ("a", 1), ("root", 2)}
    own = spark.createDataFrame(start, "alert_id int, at string")
    above = own.join(up, own["at"] == up["uid"]).select("alert_id", up["ancestor"].alias("folder"), "depth")
    homes = spark.createDataFrame([("kb", "b"), ("ka", "a"), ("kroot", "root"), ("kz", "elsewhere"), ("kc", "elsewhere")], "dashboard_uid string, home string")
    panels = spark.createDataFrame([("kb", 1, "x"), ("kb", 2, "y"), ("ka", 3, "x"), ("ka", 4, "w"), ("kroot", 5, "w"), ("kz", 6, "y"), ("kc", 7, "z"), ("kz", 8, "x")], "dashboard_uid string, panel_id int, product_key string")
    keys = [(1, 0, "Y"), (1, 1, "x"), (2, 0, "y"), (2, 1, "x"), (3, 0, "y"), (3, 1, "z"), (4, 0, "w"), (5, 0, "none")]
    found = knowledge.attach_knowledge(own, spark.createDataFrame(keys, "alert_id int, position int, key string"), above, panels, homes)
    # own folder first; the nearest dashboard before an earlier key elsewhere; of others the first dashboard; its parents' are no nearer
    assert {(r.alert_id, r.dashboard_uid, r.panel_id, r.depth) for r in found.collect()} == {(1, "kb", 2, 0), (2, "ka", 3, 0), (3, "kb", 2, None), (4, "ka", 4, None)}


def test_search_by_metric_shows_it(spark):
    index = spark.createDataFrame([("c", "m", "d1", "Board", 1, "P", {"svc": ["a"]}), ("c", "other", "d2", "Board", 2, "P", {"svc": ["a"]}), ("c", "m", "d3", "Board", 3, "P", {}), ("c", "other", "d1", "Board", 1, "P", {"svc": ["a", "b"], "env": ["x"]})], "connection_id string, metric string, dashboard_uid string, dashboard_title string, panel_id int, panel_title string, labels map<string,array<string>>")
    found = lambda **k: {(r.dashboard_uid, r.metric, r.overlap) for r in catalog.search_index(index, **k).collect()}
    assert found(labels={"svc": "a"}, metric="m", text="board") == {("d1", "m", 1), ("d3", "m", 0)}
    assert found(labels={"svc": "a", "env": "x"}) == {("d1", "other", 2), ("d2", "other", 1)}
    assert found(labels={}, text="BOARD", excluding="d1") == {("d2", "other", 0), ("d3", "m", 0)}


def test_folders(spark):
    df = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("x", "y"), ("y", "x"), ("lost", "gone")], "uid string, parent_uid string")
    up = {(r.uid, r.ancestor, r.depth) for r in knowledge.folder_ancestors(spark, df, df.select("uid")).collect()}
    assert up == {("a", "root", 1), ("b", "a", 1), ("b", "root", 2), ("x", "y", 1), ("y", "x", 1)}


def contents(spark, edges, boards, roots, **how):
    folders = spark.createDataFrame([(u, p, f"Folder {u}") for u, p in edges], "uid string, parent_uid string, title string")
    held = spark.createDataFrame([(f, u, u.upper()) for f, u in boards], "folder_uid string, uid string, title string")
    return knowledge.folder_contents(folders, held, spark.createDataFrame([(r,) for r in roots], "root string"), **how)


def summaries(found):
    return {r.root: (r.dashboards_total, r.subfolders_total, r.folders_scanned, r.truncated) for r in found.summary.collect()}


TREE = [("root", None), ("b", "root"), ("a", "root"), ("a2", "a"), ("b1", "b"), ("deep", "a2"), ("lost", "gone"), ("empty", None)]
BOARDS = [("root", "d1"), ("a", "d2"), ("a", "d0"), ("deep", "d3"), ("b1", "d4"), ("nowhere", "d5")]


def test_folder_listing(spark):
    one = contents(spark, TREE, BOARDS, ["root", "a", "empty", "gone"])
    assert summaries(one) == {"root": (1, 2, 1, False), "a": (2, 1, 1, False), "empty": (0, 0, 1, False)}
    assert [(r.root, r.uid, r.title) for r in one.dashboards.orderBy("root", "place").collect()] == [("a", "d0", "D0"), ("a", "d2", "D2"), ("root", "d1", "D1")]
    below = contents(spark, TREE, BOARDS, ["root", "a", "empty"], recursive=True)
    assert summaries(below) == {"root": (5, 2, 6, False), "a": (3, 1, 3, False), "empty": (0, 0, 1, False)}
    assert [r.uid for r in below.dashboards.where("root = 'root'").orderBy("place").collect()] == ["d1", "d0", "d2", "d4", "d3"]
    assert [r.uid for r in below.folders.where("root = 'root'").orderBy("at").collect()] == ["root", "a", "b", "a2", "b1", "deep"]
    assert {(r.root, r.uid, r.title, r.place) for r in below.subfolders.collect()} == {("root", "a", "Folder a", 1), ("root", "b", "Folder b", 2), ("a", "a2", "Folder a2", 1)}


def test_folder_listing_is_cut_breadth_first(spark):
    """The folder itself counts as one; what is left out shows, and nothing does where all fits."""
    for most, want in ((1, ["root"]), (2, ["root", "a"]), (4, ["root", "a", "b", "a2"]), (5, ["root", "a", "b", "a2", "b1"])):
        cut = contents(spark, TREE, BOARDS, ["root", "empty"], recursive=True, most=most)
        assert [r.uid for r in cut.folders.where("root = 'root'").orderBy("at").collect()] == want
        assert summaries(cut)["root"][2:] == (most, True) and summaries(cut)["empty"][3] is False
    for most in (6, None):
        assert summaries(contents(spark, TREE, BOARDS, ["root"], recursive=True, most=most))["root"] == (5, 2, 6, False)
    few = contents(spark, TREE, BOARDS, ["root"], recursive=True, limit=2)
    assert [r.uid for r in few.dashboards.orderBy("place").collect()] == ["d1", "d0"] and summaries(few)["root"][0] == 5


def test_folder_listing_of_chains_and_cycles(spark):
    chain = [("f00", None)] + [(f"f{i:02}", f"f{i - 1:02}") for i in range(1, 41)]
    found = contents(spark, chain, [("f40", "last")], ["f00", "f39"], recursive=True)
    assert summaries(found) == {"f00": (1, 1, 41, False), "f39": (1, 1, 2, False)}
    assert found.folders.where("root = 'f00'").agg(F.max("depth")).first()[0] == 40
    cycle = contents(spark, [("x", "y"), ("y", "x"), ("self", "self"), ("x", "y")], [("x", "dx"), ("y", "dy")], ["x", "self"], recursive=True)
    got = summaries(cycle)
    assert got["x"][0] == 2 and got["x"][2:] == (2, False) and got["self"] == (0, 1, 1, False)


def test_folder_listing_within_a_connection(spark):
    folders = spark.createDataFrame([("c1", "r", None, "R"), ("c1", "s", "r", "S"), ("c2", "r", None, "R"), ("c2", "t", "r", "T")], "connection_id string, uid string, parent_uid string, title string")
    boards = spark.createDataFrame([("c1", "s", "d", "D"), ("c2", "r", "d", "D"), ("c2", "t", "e", "E")], "connection_id string, folder_uid string, uid string, title string")
    found = knowledge.folder_contents(folders, boards, spark.createDataFrame([("c1", "r"), ("c2", "r")], "connection_id string, root string"), recursive=True, scope=["connection_id"])
    assert {(r.connection_id, r.uid) for r in found.dashboards.collect()} == {("c1", "d"), ("c2", "d"), ("c2", "e")}


def test_keys_of_knowledge_are_trimmed(spark):
    panels = spark.createDataFrame([("c", "d", 1, 1, "knowledge: Key4", None), ("c", "d", 2, 2, "knowledge: b", "x")], "connection_id string, dashboard_uid string, panel_id int, at int, title string, content string")
    known = knowledge.extract_knowledge(panels)
    assert {(r.product_key, r.json, r.prose, r.parse_error) for r in known.collect()} == {("key4", None, "", False), ("b", None, "x", False)}
    asked = spark.createDataFrame([(" KEY4 ",), ("\tkey4\n",)], "key string")
    assert [r.panel_id for r in knowledge.knowledge_matches(known, asked).collect()] == [1]
    nothing = spark.createDataFrame([], "alert_id int, folder string, depth int")
    hit = knowledge.attach_knowledge(spark.createDataFrame([(1,)], "alert_id int"), spark.createDataFrame([(1, 0, " Key4 ")], "alert_id int, position int, key string"), nothing, known, spark.createDataFrame([], "dashboard_uid string, home string"))
    assert [r.panel_id for r in hit.collect()] == [1]


def test_overview_of_knowledge(spark):
    boards = spark.createDataFrame([("c", "d", "Known", "f", ["knowledge", "x"]), ("c", "e", "Bare", None, ["knowledge"]), ("c", "g", "Other", "f", ["x"]), ("c", "h", "None", "f", None)], "connection_id string, uid string, title string, folder_uid string, tags array<string>")
    known = spark.createDataFrame([("c", "d", "b"), ("c", "d", "a"), ("c", "g", "z")], "connection_id string, dashboard_uid string, product_key string")
    assert {(r.dashboard_uid, r.title, r.folder_uid, *r.product_keys) for r in knowledge.knowledge_overview(boards, known).collect()} == {("d", "Known", "f", "a", "b"), ("e", "Bare", None)}


def test_masking(spark):
    df = spark.createDataFrame([(1, "call ACME-77 now", ({"x-api-key": "k", "note": "acme-1"}, [("p", "acme-2", "https://x/acme-3")]), 5)], "id int, text string, d struct<m:map<string,string>,l:array<struct<password:string,name:string,url:string>>>, token int")
    row = mask.redact(df, [r"acme-\d+"], exempt=("url", "password")).first()
    assert row.text == "call [REDACTED] now" and row.d.m == {"x-api-key": "[REDACTED]", "note": "[REDACTED]"}
    assert (row.d.l[0].password, row.d.l[0].name, row.d.l[0].url) == ("[REDACTED]", "[REDACTED]", "https://x/acme-3") and row.token is None


def test_masking_walks_values_of_any_type(spark):
    schema = "a map<string,array<string>>, b map<string,int>, c map<string,struct<password:string,note:string>>, d map<int,string>, e struct<url:struct<note:string>>, f array<map<string,array<string>>>"
    rows = [({"password": ["hunter2"], "x": ["acme-1"]}, {"token": 7, "n": 5}, {"k": ("p", "acme-2"), "secret": ("p", "q")}, {1: "acme-3"}, (("acme-4",),), [{"api_key": ["z"], "y": ["acme-5", None]}])]
    row = mask.redact(spark.createDataFrame(rows, schema), [r"acme-\d+"], exempt=("url",)).first()
    gone = "[REDACTED]"
    assert row.a == {"password": None, "x": [gone]} and row.b == {"token": None, "n": 5}
    assert row.c == {"k": (gone, gone), "secret": None} and row.d == {1: gone}
    assert row.e.url.note == "acme-4" and row.f == [{"api_key": None, "y": [gone, None]}]


def test_events_near_each_other(spark):
    rows = [(1, 0), (1, 1000), (1, 2500), (2, 0)]
    frame = spark.createDataFrame(rows, "k int, ms long").selectExpr("k", "timestamp_millis(ms) AS ts", "ms AS message")
    met = logs.join_pairs(frame, frame.withColumnRenamed("k", "j"), "k", "j", 1000)
    assert sorted((r.key, r.left_message, r.right_message) for r in met.collect()) == [("1", 0, 0), ("1", 0, 1000), ("1", 1000, 0), ("1", 1000, 1000), ("1", 2500, 2500), ("2", 0, 0)]
    assert logs.join_pairs(frame, frame.withColumnRenamed("k", "j"), "k", "j").count() == 10


def test_wide_tables_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(csv, "MOST_SERIES", 2)
    frame = spark.sql("SELECT timestamp'2024-01-01' AS t, 1.0D AS v, 'A' AS ref_id, map('k', string(id)) AS labels, string(id) AS series_key FROM range(3)")
    with pytest.raises(ValueError, match="more than 2"):
        csv.wide(frame)


def test_series_key_and_numbers(spark):
    df = spark.createDataFrame([("A", {"b": "1", "B": "2", "a": "3"}, 1.0, 1.5)], "ref string, labels map<string,string>, x double, y double")
    row = df.select(c.series_key(F.col("ref"), F.col("labels")), c.number_text(F.col("x")), c.number_text(F.col("y")), c.duration_text(F.lit(7_200_000))).first()
    assert list(row) == ["A|B=2,a=3,b=1", "1", "1.5", "2h"]


def test_nested_panels(spark):
    leaf = "struct<id:int,title:string,type:string,datasource:string,targets:array<struct<ref_id:string,datasource:string>>>"
    row = leaf.replace("ref_id:string,datasource:string>>>", f"ref_id:string,datasource:string>>,panels:array<{leaf}>>")
    t = [("A", None), ("B", "own")]
    data = [("c", "d", "D", [(1, "p", "g", "ds", t, []), (2, "row", "row", None, [], [(3, "q", "g", catalog.MIXED, t), (4, "text", "text", None, [])])])]
    df = spark.createDataFrame(data, f"connection_id string, uid string, title string, panels array<{row}>")
    out = {(r.panel_id, r.ref_id, r.datasource_uid) for r in catalog.panel_targets(catalog.flatten_panels(df)).collect()}
    assert out == {(1, "A", "ds"), (1, "B", "own"), (3, "A", None), (3, "B", "own")}
    with pytest.raises(Exception, match="too deep"):
        catalog.flatten_panels(df, depth=1).collect()


ENTRY = "connection_id string, metric string"


def saved(spark, path, rows, at="2024-01-01 10:00:00", **how):
    index_store.save_index(spark.createDataFrame(rows, ENTRY), path, built_at=F.lit(at).cast("timestamp"), **how)


def loaded(spark, path, now="2024-01-01 11:00:00", schema=ENTRY, **how):
    return sorted(tuple(r)[: len(schema.split(","))] for r in index_store.load_fresh_index(spark, path, schema, now=F.lit(now).cast("timestamp"), **how).collect())


def test_a_build_replaces_the_one_before(spark):
    path = work_path(spark, "index")
    assert loaded(spark, path) == []
    saved(spark, path, [("a", "old"), ("a", "gone"), ("b", "kept")])
    saved(spark, path, [("a", "new"), ("a", "new")])
    assert loaded(spark, path) == [("a", "new"), ("a", "new"), ("b", "kept")]
    saved(spark, path, [], connections=["b"])  # a build that found nothing
    assert loaded(spark, path) == [("a", "new"), ("a", "new")]


def test_an_old_or_foreign_build_hides_what_it_replaced(spark):
    path = work_path(spark, "index")
    saved(spark, path, [("a", "x"), ("b", "x"), ("c", "x")])
    saved(spark, path, [("a", "y")], version=0)
    saved(spark, path, [("b", "y")], at="2024-01-01 04:59:59")
    assert loaded(spark, path) == [("c", "x")]
    assert loaded(spark, path, now="2024-01-01 16:00:00") == [("c", "x")] and loaded(spark, path, now="2024-01-01 16:00:01") == []


def test_a_save_is_seen_whole_or_not_at_all(spark):
    """Entries of a save that isn't done, or never will be, are not seen; neither are those replaced under a reader."""
    path = work_path(spark, "index")
    saved(spark, path, [("a", "x")])
    reader = index_store.load_fresh_index(spark, path, ENTRY, now=F.lit("2024-01-01 11:00:00").cast("timestamp"))
    spark.createDataFrame([("a", "half")], ENTRY).write.partitionBy("connection_id").parquet(f"{path}/entries/build=unfinished")
    assert loaded(spark, path) == [("a", "x")]
    saved(spark, path, [("a", "y")])
    assert [r.metric for r in reader.collect()] == ["x"] and loaded(spark, path) == [("a", "y")]


def test_builds_may_be_saved_at_the_same_time(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = work_path(spark, "index")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: saved(spark, path, [(f"c{i}", "x"), ("all", str(i))]), range(8)))
    found = loaded(spark, path)
    assert [r for r in found if r[0] != "all"] == [(f"c{i}", "x") for i in range(8)] and len(found) == 9


def test_columns_that_a_build_lacks_have_defaults(spark):
    path = work_path(spark, "index")
    saved(spark, path, [("a", "x")])
    assert loaded(spark, path, schema=f"{ENTRY}, labels array<string>", defaults={"labels": F.array(F.lit("none"))}) == [("a", "x", ["none"])]


def keyed(spark, rows, key="k"):
    return spark.createDataFrame(rows, f"{key} int, ms long").selectExpr(key, "timestamp_millis(ms) AS ts", "ms AS message")


@pytest.mark.parametrize("least", [10_000, 5])
def test_pairs_of_a_hot_key(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_ROWS", least)
    left = [(1, i) for i in range(40)] + [(1, 3)] * 12 + [(2, 7), (3, 1), (None, 1)]
    right = [(1, i) for i in range(30)] + [(2, i) for i in range(15)] + [(4, 1), (None, 1)]
    a, b = keyed(spark, left).repartition(5), keyed(spark, right, "j").repartition(3)
    want = sorted((str(x), m, n) for x, m in left for y, n in right if x == y and x is not None)
    assert sorted((r.key, r.left_message, r.right_message) for r in logs.join_pairs(a, b, "k", "j").collect()) == want
    near = [(k, m, n) for k, m, n in want if abs(m - n) <= 4]
    assert sorted((r.key, r.left_message, r.right_message) for r in logs.join_pairs(a, b, "k", "j", 4).collect()) == near


def test_a_hot_key_is_dealt_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.range(100).selectExpr("1 AS k", "id AS x")
    right = spark.range(100).selectExpr("1 AS k", "id AS y")
    cells = skew.grid(left, right, ["k"]).groupBy("_line", "_column").count().collect()
    assert len(cells) == 100 and sum(r["count"] for r in cells) == 10_000 and max(r["count"] for r in cells) < 1_000


@pytest.mark.parametrize("least", [10_000, 5])
def test_many_events_to_one(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_ROWS", least)
    many, one = [(1, i) for i in range(40)] + [(2, 5), (3, 6), (None, 1)], [(1, 100), (2, 200), (9, 1), (None, 2)]
    a, b = keyed(spark, many), keyed(spark, one, "j")
    met = logs.join_to_one(a, b, "k", "j")
    assert sorted((r.key, r.many_message, r.one_message) for r in met.collect()) == sorted([("1", i, 100) for i in range(40)] + [("2", 5, 200)])
    assert {(r.key, r.one_message) for r in logs.join_to_one(a, b, "k", "j", keep=True).collect()} == {("1", 100), ("2", 200), ("3", None)}
    with pytest.raises(Exception, match="several events"):
        logs.join_to_one(a, keyed(spark, [(1, 1), (1, 2)], "j"), "k", "j").collect()
    assert logs.join_to_one(a, keyed(spark, [(1, 1), (9, 2), (9, 3)], "j"), "k", "j").count() == 40


@pytest.mark.parametrize(
    ("regex", "values", "want"),
    [
        (r"/web-(\d+)/", ["web-12", "db-1", "x web-7 y"], {"12", "7"}),
        (r"web-(?<n>\d+)", ["web-12"], {"12"}),
        ("[(w]eb-12", ["web-12", "(eb-12", "eb-12"], {"web-12", "(eb-12"}),
        (r"web-\d+", ["web-12", "no"], {"web-12"}),
        (r"\(a\)(b)?", ["(a)", "(a)b"], {"(a)", "b"}),
        ("/WEB-(.)/i", ["web-1"], {"1"}),
        ("/[a-z]+/g", ["one two", "one"], {"two", "one"}),
        ("/(?:a|b)(?=c)(c)/", ["ac", "bd"], {"c"}),
        (r"/(?<a>x)(?<b>y)\k<b>/", ["xyy", "xyx"], {"x"}),
        ("^a$", ["a", "a\n", "b"], {"a"}),
        ("[[&&]x{", ["[x{", "&x{", "x{"], {"[x{", "&x{"}),
        ("", ["a"], {"a"}),
    ],
)
def test_values_through_a_stored_pattern(spark, regex, values, want):
    T = dt.datetime(2024, 1, 1, 12)
    samples = spark.createDataFrame([(T, {"host": v}) for v in values] + [(T, {"other": "web-9"}), (dt.datetime(2024, 1, 3), {"host": "web-99"})], "t timestamp, labels map<string,string>")
    incident = spark.createDataFrame([("i", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "incident_id string, from_ts timestamp, to_ts timestamp")
    assert {r.value for r in catalog.materialize_values(samples, incident, "host", regex).collect()} == want


@pytest.mark.parametrize("regex", ["(", "a)", "[a", "*a", "a**", "(?x)", "/a/q", "/a/ii", "a\\", "a|+"])
def test_what_is_no_pattern(regex):
    with pytest.raises(BadPattern):
        stored_pattern(regex)


def test_live_variables(spark):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    samples = spark.createDataFrame([(day(1), {"host": "web-1"}), (day(1), {"host": "db-2"}), (day(2), {"host": "web-3"}), (day(3), {"host": "db-4"})], "t timestamp, labels map<string,string>")
    windows = spark.createDataFrame([("i", "incident", 1), ("j", "incident", 3), ("i", "control", 2)], "incident_id string, role string, day int").selectExpr("incident_id", "role", "make_timestamp(2024, 1, day, 0, 0, 0) AS from_ts", "make_timestamp(2024, 1, day, 23, 0, 0) AS to_ts")
    tags = 'show tag values with key = "host"'
    rows = [("web", "query", tags, r"/^web-(\d)/", "influxdb", ["$__all"], None), ("bad", "query", tags, "(", "influxdb", ["$__all"], None), ("fixed", "query", tags, None, "influxdb", ["web-1"], None), ("known", "query", tags, None, "influxdb", ["$__all"], ["x"]), ("const", "constant", None, None, None, ["$__all"], None), ("metric", "query", tags, None, "prometheus", ["$__all"], None)]
    variables = spark.createDataFrame([(*r, None) for r in rows], "name string, type string, query string, regex string, datasource_type string, current array<string>, options array<string>, all_value string")
    found, unresolved = catalog.live_values(variables, {}, samples, windows.where("role = 'incident'"))
    assert {tuple(r) for r in found.collect()} == {("i", "web", "1")}
    assert {tuple(r) for r in unresolved.collect()} == {(i, n) for i in "ij" for n in ("bad", "const", "metric")} | {("j", "web")}
    # the values of the incident's own window hold in its controls too
    from tidewatch.operators.windows import tag_windows

    values = spark.createDataFrame([("i", "host", "db-2"), ("i", "host", "web-3")], "incident_id string, name string, value string")
    kept = catalog.in_windows(tag_windows(samples, windows), values, "host", "host").select("incident_id", "role", F.col("labels")["host"].alias("h"))
    assert {tuple(r) for r in kept.collect()} == {("i", "incident", "db-2"), ("i", "control", "web-3"), ("j", "incident", "db-4")}


def batch(at, *alerts):
    import json

    return json.dumps({"receivedAt": at, "payload": {"alerts": [{"fingerprint": f, "status": s, "labels": {"alertname": "a"}} for f, s in alerts]}})


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_alerts_of_one_time_are_in_the_order_of_the_store(spark, split):
    at = "2024-01-02T00:00:00.000Z"
    lines = [batch("2024-01-01T00:00:00.000Z", ("old", "firing"), ("f", "old"))] + [batch(at, ("f", f"s{i}"), ("g", f"t{i}"), ("f", "second")) for i in range(40)] + [batch(at, ("h", "last"))]
    path = written(spark, *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        store = read_alert_store(spark, path)
        assert [(r.fingerprint, r.state) for r in alerts.latest_alert(store).collect()] == [("h", "last")]
        assert {r.fingerprint: r.state for r in alerts.alert_by_fingerprint(store).collect()} == {"old": "firing", "f": "s39", "g": "t39", "h": "last"}
        assert [(r.fingerprint, r.state) for r in alerts.recent_alerts(store, 5).collect()] == [("h", "last"), ("f", "s39"), ("g", "t39"), ("f", "second"), ("f", "s38")]
        assert {(r.fingerprint, r.state) for r in alerts.recent_batches(store, 2).collect()} == {("h", "last"), ("f", "s39"), ("g", "t39"), ("f", "second")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ties_without_places_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("f", "a", i) for i in range(50)], "fingerprint string, state string, n int").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    first = [alerts.alert_by_fingerprint(rows.repartition(k)).collect() for k in (1, 3, 7)]
    assert first[0] == first[1] == first[2] and alerts.recent_alerts(rows.repartition(5), 3).collect() == alerts.recent_alerts(rows.repartition(2), 3).collect()


def test_batches_delivered_again_give_nothing(spark):
    """In the same trigger, in a later one, and after a restart; lines without a time as well."""
    path, out, state = (work_path(spark, n) for n in ("feed", "out", "state"))
    lines = [batch("2024-01-01T00:00:00.000Z", ("f", "firing"), ("g", "firing")), batch("2024-01-01T01:00:00.000Z", ("f", "resolved")), batch(None, ("n", "firing"))]

    def deliver(*some):
        spark.createDataFrame([(x,) for x in some], "value string").coalesce(1).write.mode("append").text(path)
        feeds.store_alerts(feeds.alert_feed(spark, path), out, state)
        return sorted((r.fingerprint, r.state) for r in spark.read.parquet(out).collect())

    all_ = [("f", "firing"), ("f", "resolved"), ("g", "firing"), ("n", "firing")]
    assert deliver(*lines, *lines) == all_
    assert deliver(lines[0], lines[2]) == all_ and deliver(*lines, batch("2024-01-01T02:00:00.000Z", ("f", "firing"))) == sorted([*all_, ("f", "firing")])


def test_unknown_labels_are_an_error(spark):
    rows = spark.createDataFrame([("m", {"a": "1"}), ("m", {"a": "2"})], "metric string, labels map<string,string>")
    assert [r.value for r in catalog.label_values(rows, "m", "a").collect()] == ["1", "2"]
    for metric, label in (("m", "b"), ("x", "a")):
        with pytest.raises(catalog.UnknownLabel):
            catalog.label_values(rows, metric, label)


def test_values_that_are_no_numbers(spark):
    path = written(spark, '{"results": {"A": {"frames": [{"fields": [{"name": "t", "type": "time"}, {"name": "x", "type": "number"}], "values": [[0, "soon", 60000], ["n/a", 1, "2.5"]]}]}}}')
    rows = frames.frame_samples(frames.read_results(spark, path)).select(F.unix_millis("t").alias("ms"), "v").collect()
    assert sorted(tuple(r) for r in rows) == [(0, None), (60000, 2.5)]


def test_answers_of_several_sources(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2,)], "n int")
    assert {(r.connection_id, r.n, r.s) for r in catalog.union_sources({"a": a, "b": b}).collect()} == {("a", 1, "x"), ("b", 2, None)}


def test_batches_with_the_same_alerts_are_not_one(spark):
    import tempfile

    from tidewatch.plans.catalogue import QUERIES

    folder = tempfile.mkdtemp(dir="/tmp")
    orders = [(key, 7, "O", "1-URGENT") for key in (1, 20_001, 40_001)]
    orders = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit("1995-01-01").cast("date")).write.parquet(f"{folder}/orders.parquet")
    # of one day, fingerprint and customer, in batches of their own
    assert [tuple(r) for r in QUERIES["q_st1_alert_feed"](spark, folder).collect()] == [("fp1", "firing", 1, 3)]


@pytest.mark.parametrize("cell", [1, 2, 2000])
def test_paired_sources_are_not_grouped_as_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(catalog, "SOURCES", cell)
    a = [("m1", ["x", "y", "own1"]), ("m2", ["y", "y", None]), ("m3", ["z"]), ("m4", ["only"]), ("m5", None), ("m1", ["z"])]
    b = [("l1", ["y", "x"]), ("l2", ["z", "x", "own2"]), ("l3", ["y"]), ("l3", ["z", "x"]), ("l4", [])]
    found = catalog.pair_sources(*[spark.createDataFrame(rows, "id string, tags array<string>") for rows in (a, b)])
    known = lambda rows: {i: {t for j, tags in rows if j == i for t in tags or [] if t} for i, _ in rows}
    want = [(i, k, sorted(s & t)) for i, s in known(a).items() for k, t in known(b).items() if s & t]
    assert sorted((r.metric_id, r.log_id, r.shared) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_ancestors_are_joined_hop_by_hop(spark):
    df = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("c", "b"), ("self", "self"), ("two", "a"), ("two", "b")], "uid string, parent_uid string")
    up = knowledge.folder_ancestors(spark, df, df.select("uid").distinct(), hops=2, own=True)
    assert "Join" not in up._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.uid, r.ancestor, r.depth) for r in up.where("depth > 0").collect())
    assert got == sorted([("a", "root", 1), ("b", "a", 1), ("b", "root", 2), ("c", "b", 1), ("c", "a", 2), ("two", "a", 1), ("two", "b", 1), ("two", "root", 2), ("two", "a", 2)])
    assert up.where("depth = 0").count() == 6


def test_alerts_are_not_expanded_by_the_panels_of_a_key(spark):
    own = spark.createDataFrame([(1,), (2,)], "alert_id int")
    keys = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x")], "alert_id int, position int, key string")
    above = spark.createDataFrame([(1, "f", 2)], "alert_id int, folder string, depth int")
    homes = spark.createDataFrame([("k9", "f")], "dashboard_uid string, home string")
    panels = [(f"k{b}", p, key) for b in (1, 2, 9) for p, key in ((3, "x"), (4, "x"), (5, "y"), (6, "y")) if (b, key) != (9, "x")]
    panels = spark.createDataFrame(panels, "dashboard_uid string, panel_id int, product_key string")
    found = knowledge.attach_knowledge(own, keys, above, panels, homes)
    assert {(r.alert_id, r.dashboard_uid, r.panel_id, r.product_key, r.position, r.depth) for r in found.collect()} == {(1, "k9", 5, "y", 1, 2), (2, "k1", 5, "y", 0, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 3  # panels are cut to the first of a key before they meet alerts


@pytest.mark.parametrize("more", [False, True])
def test_what_is_told_of_single_shared_tags_is_made_before_the_pairs(spark, more):
    a = [("m1", ["x", "own1"]), ("m2", ["x", None]), ("m3", ["y"]), (None, ["x"]), *([("m4", ["y", "x"])] if more else [])]
    b = [("l1", ["x", "own2"]), ("l2", ["y", "x"]), ("l3", ["z"]), ("l4", None)]
    sides = [spark.createDataFrame(rows, "id string, tags array<string>") for rows in (a, b)]
    found = catalog.pair_sources(*sides, lambda tags: F.array_join(tags, "+"))
    want = [(i, k, "+".join(sorted(set(s) & set(t) - {None}))) for i, s in a for k, t in b if set(s) & set(t or []) - {None}]
    assert sorted(map(repr, found.collect())) == sorted(f"Row(metric_id={i!r}, log_id={k!r}, shared={s!r})" for i, k, s in want)
    pairs = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert ("array" in pairs) == more
