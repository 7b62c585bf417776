"""Dashboards, panels, query texts, the metric index and its search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import label_overlap_lists, match_text
from tidewatch.functions.patterns import BadPattern, stored_pattern
from tidewatch.operators.skew import grid, look_up
from tidewatch.session import stored

MIXED, MIRROR = "-- Mixed --", "-- Dashboard --"
#: Datasource names that stand for no datasource of their own.
PSEUDO = (MIXED, MIRROR, "-- Grafana --", "__expr__")
SURVEY, FOUND = 25, 20
#: Sources of a side in a cell of pairs.
SOURCES = 2_000
PANEL = ["connection_id", "dashboard_uid", "panel_id"]

#: Words of the query language that are not metrics, and those before a list of label names.
KEYWORDS = (
    "by", "without", "on", "ignoring", "group_left", "group_right", "offset", "bool", "and", "or", "unless", "sum", "min",
    "max", "avg", "stddev", "stdvar", "count", "count_values", "bottomk", "topk", "quantile", "rate", "irate", "increase",
    "delta", "idelta", "deriv", "predict_linear", "histogram_quantile", "label_replace", "label_join", "abs", "ceil",
    "floor", "round", "clamp", "clamp_max", "clamp_min", "sort", "sort_desc", "scalar", "vector", "time", "timestamp",
)
GROUPING = ("by", "without", "on", "ignoring", "group_left", "group_right")
#: What holds no metric's name, in an expression without strings: the insides of selectors, ranges, and lists of label names.
ASIDE = rf"(?<=\{{)[^{{}}]*|\[[^\]]*\]|(?i:\b(?:{'|'.join(GROUPING)})\s*\([^)]*\))"
#: A name with the bracket that follows it, if any; a label's name.
NAMED = r"(?<![\w:.])[A-Za-z_:][A-Za-z0-9_:]*+\s*+[({]?"
LABEL = "^[A-Za-z_][A-Za-z0-9_]*$"
BLANK = " \t\r\n"
#: What a target's query is read from, and bytes of texts up to which their table is broadcast.
TEXTS = ("expr", "query", "measurement", "tags")
BROADCAST_BYTES = 8 << 20


def flatten_panels(dashboards: DataFrame, depth: int = 5) -> DataFrame:
    """The leaves of nested panels that have targets: connection_id, dashboard_uid, dashboard_title, at, panel.

    `dashboards` has connection_id, uid, title and panels, whose rows may hold `panels`. `at` orders them as shown. Levels
    end where the schema does; rows that still nest at `depth` are an error.
    """
    keep = ["connection_id", F.col("uid").alias("dashboard_uid"), F.col("title").alias("dashboard_title")]
    level = dashboards.select(*keep, F.posexplode("panels").alias("_i", "panel"))
    level = level.withColumn("at", F.array("_i")).drop("_i")
    found = None
    for n in range(depth):
        nests = "panels" in level.schema["panel"].dataType.fieldNames()
        inner = F.size(F.coalesce(F.col("panel.panels"), F.array())) if nests else F.lit(0)
        last = n == depth - 1
        shallow = F.assert_true(inner == 0, "panels nest too deep").isNull() if last else inner == 0
        leaf = level.where(shallow & (F.size("panel.targets") > 0))
        panel = F.struct(*[F.col(f"panel.{c}").alias(c) for c in ("id", "title", "type", "datasource", "targets")])
        leaves = leaf.select("connection_id", "dashboard_uid", "dashboard_title", "at", panel.alias("panel"))
        found = leaves if found is None else found.unionByName(leaves)
        if last or not nests:
            return found
        level = level.where(inner > 0).select("connection_id", "dashboard_uid", "dashboard_title", "at", F.posexplode("panel.panels").alias("_i", "panel")).withColumn("at", F.concat("at", F.array("_i"))).drop("_i")
    return found


def panel_targets(panels: DataFrame) -> DataFrame:
    """One row for each target; its datasource is its own, else the panel's, and a mixed one is none."""
    rows = panels.select("connection_id", "dashboard_uid", "dashboard_title", "at", F.col("panel.id").alias("panel_id"), F.col("panel.title").alias("panel_title"), F.col("panel.type").alias("panel_type"), F.col("panel.datasource").alias("_own"), F.posexplode("panel.targets").alias("target_pos", "target"))
    source = F.coalesce("target.datasource", "_own")
    return rows.select("connection_id", "dashboard_uid", "dashboard_title", "at", "panel_id", "panel_title", "panel_type", "target_pos", F.when(source != MIXED, source).alias("datasource_uid"), *[F.col(f"target.{c}") for c in panels.schema["panel"].dataType["targets"].dataType.elementType.fieldNames() if c != "datasource"])


def active_query_fields(targets: DataFrame) -> DataFrame:
    """Of a target that is edited in two forms only the one that runs: raw text or builder fields; both if unknown."""
    raw = F.col("raw_query")
    return targets.withColumns({"query": F.when(raw.isNull() | raw, F.col("query")), "measurement": F.when(raw.isNull() | ~raw, F.col("measurement")), "tags": F.when(raw.isNull() | ~raw, F.col("tags"))})


def _quoted(text: Column, quote: str) -> tuple[Column, Column]:
    """`text` cut at its quotes: what stands outside of strings, and each string with what stands before it."""
    parts = F.split(text, quote)
    outside = F.filter(parts, lambda _, i: i % 2 == 0)
    # the last part has no quote after it
    at = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return outside, F.transform(at, lambda i: F.struct(F.get(parts, i - 1).alias("before"), F.get(parts, i).alias("value")))


def _pairs(strings: Column, key: Callable[[Column], Column]) -> Column:
    """Key and value of the strings whose `key`, from what stands before, is a label's name."""
    named = F.transform(strings, lambda s: F.struct(key(s["before"]).alias("key"), s["value"].alias("value")))
    return F.array_distinct(F.filter(named, lambda p: F.coalesce(p["key"].rlike(LABEL), F.lit(False))))


def _matched_label(before: Column) -> Column:
    """The label of a matcher whose value follows: what stands between the last comma or brace and the operator."""
    tail = F.rtrim(F.substring_index(F.substring_index(before, "{", -1), ",", -1), F.lit(BLANK))
    return F.when(F.right(tail, F.lit(1)).isin("=", "~"), F.btrim(tail, F.lit(BLANK + "=!~")))


def _compared_tag(before: Column) -> Column:
    """The tag of an equality whose value follows: the last word before the sign, without quotes."""
    tail = F.rtrim(F.translate(before, "\t\r\n", "   "))
    word = F.substring_index(F.substring_index(F.rtrim(F.rtrim(tail, F.lit("="))), " ", -1), "(", -1)
    return F.when(F.right(tail, F.lit(1)) == "=", F.btrim(word, F.lit('"')))


def _last_name(measurement: Column) -> Column:
    """What follows the last dot of a measurement, without quotes; none is empty."""
    return F.coalesce(F.btrim(F.substring_index(measurement, ".", -1), F.lit('"')), F.lit(""))


def _names(outside: Column) -> Column:
    """The metrics of an expression without its strings: every name before a selector, and others that no bracket follows."""
    words = F.regexp_extract_all(F.regexp_replace(F.array_join(outside, '""'), ASIDE, " "), F.lit(NAMED), 0)
    split = F.transform(words, lambda w: F.struct(F.rtrim(w, F.lit("({" + BLANK)).alias("name"), F.right(w, F.lit(1)).alias("then")))
    metric = lambda w: (w["then"] == "{") | ((w["then"] != "(") & ~F.lower(w["name"]).isin(*KEYWORDS))
    return F.array_distinct(F.transform(F.filter(split, metric), lambda w: w["name"]))


def _from_expression(expr: Column) -> Column:
    """metrics and pairs of an expression. Escaped quotes end no string; values keep their escapes."""
    escapes = (("\\\\", "\x01"), ('\\"', "\x02"))
    for sign, mark in escapes:
        expr = F.replace(expr, F.lit(sign), F.lit(mark))

    def restored(value: Column) -> Column:
        for sign, mark in escapes:
            value = F.replace(value, F.lit(mark), F.lit(sign))
        return value

    outside, strings = _quoted(expr, '"')
    pairs = F.filter(_pairs(strings, _matched_label), lambda p: p["key"] != "__name__")
    return F.struct(_names(outside).alias("metrics"), F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), restored(p["value"]).alias("value"))).alias("pairs"))


def _from_statement(query: Column, measurement: Column, tags: Column) -> Column:
    """metrics and pairs of a statement, or of the fields that one is built from.

    A statement has the last part of the name that follows its first `from`, and the tags that its condition, from `where`
    to the next clause, tests for equality.
    """
    after = lambda word: F.get(F.split(query, rf"(?i)\b{word}\b", 2), F.lit(1))
    source = F.regexp_substr(F.ltrim(F.regexp_replace(after("from"), r"^\s*\(", "")), F.lit(r'^(?:"[^"]+"|[\w.])+'))
    condition = F.get(F.split(after("where"), r"(?i)\b(?:(?:group|order)\s+by|limit)\b", 2), F.lit(0))
    _, strings = _quoted(F.coalesce(condition, F.lit("")), "'")
    named = F.filter(F.array(_last_name(measurement), _last_name(source)), lambda n: n != "")
    built = F.transform(F.coalesce(tags, F.array()), lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value")))
    return F.struct(F.array_distinct(named).alias("metrics"), F.array_distinct(F.concat(built, _pairs(strings, _compared_tag))).alias("pairs"))


def query_texts(rows: DataFrame) -> DataFrame:
    """The table of distinct query texts: `_hash`, `_text`, `_n` (targets that have it) and `_info` (metrics and pairs).

    It is written before anything reads it, so every expression is evaluated once a text, however it is used.
    """
    texts = rows.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"))
    text = F.col("_text")
    info = F.when(text["expr"].isNotNull(), _from_expression(text["expr"])).otherwise(_from_statement(F.coalesce(text["query"], F.lit("")), text["measurement"], text["tags"]))
    return stored(texts.withColumn("_info", info), "query-texts")


def extract_query_info(targets: DataFrame) -> DataFrame:
    """`targets` with `metrics` (distinct names) and `label_pairs` (distinct key and value) read from their query texts.

    Panels are copied far more often than written, so texts are read once each, in a table of their own, and joined back
    by hash and text; a text that many targets share is no hot key, as the table is broadcast where its size allows it
    and else the text's targets are dealt over tasks. An expression's names are read after strings, selectors, ranges and
    lists of labels are taken out, so that labels and their values do not pass for metrics.
    """
    rows = active_query_fields(targets if "tags" in targets.columns else targets.withColumn("tags", F.lit(None).cast("array<struct<key:string,operator:string,value:string>>")))
    text = F.struct(*TEXTS)
    rows = rows.withColumn("_text", text).withColumn("_hash", F.xxhash64("_text"))
    table = query_texts(rows)
    size = table.agg(F.sum(F.octet_length(F.to_json("_text")) + F.octet_length(F.to_json("_info")))).first()[0] or 0  # one row
    known = table.withColumnRenamed("_text", "_of")
    same = F.col("_text").eqNullSafe(F.col("_of"))
    if size <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(known.withColumnRenamed("_hash", "_h")), (F.col("_hash") == F.col("_h")) & same)
    else:
        found = look_up(rows, known, ["_hash"], "_n", same=same)
    return found.select(*[f"`{c}`" for c in targets.columns], F.col("_info.metrics").alias("metrics"), F.col("_info.pairs").alias("label_pairs"))


def labels_of(pairs: Column) -> Column:
    """Key and value pairs as a map from key to the list of its values."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]))
    return F.map_from_arrays(keys, values)


def build_metric_index(targets: DataFrame) -> DataFrame:
    """connection_id, metric, dashboard and panel columns, labels: of a panel's targets with a metric the first one."""
    entries = extract_query_info(targets).withColumn("metric", F.explode("metrics"))
    # a task keeps one target of each panel and metric before the shuffle
    first = F.min(F.struct("target_pos", "ref_id", "dashboard_title", "panel_title", "label_pairs")).alias("first")
    rows = entries.groupBy("metric", *PANEL).agg(first)
    return rows.select("connection_id", "metric", "dashboard_uid", "first.dashboard_title", "panel_id", "first.panel_title", labels_of(F.col("first.label_pairs")).alias("labels"))


def index_coverage(dashboards: DataFrame, index: DataFrame) -> DataFrame:
    """For each connection the dashboards discovered and those that the index holds."""
    known = dashboards.groupBy("connection_id").agg(F.countDistinct("uid").alias("discovered"))
    held = index.groupBy("connection_id").agg(F.countDistinct("dashboard_uid").alias("scanned"))
    return known.join(held, "connection_id", "left").fillna(0, ["scanned"])


def distinct_dashboards(pages: DataFrame, kind: str = "dash-db") -> DataFrame:
    """Dashboards of a listing that comes in overlapping pages, once each."""
    return pages.where(F.col("type") == kind).dropDuplicates(["connection_id", "uid"])


def mirror_panels(targets: DataFrame) -> DataFrame:
    """Panels all of whose targets show another panel of the dashboard: `mirrored`, the ids of these; they are not run."""
    by = targets.groupBy(*PANEL).agg(F.bool_and(F.coalesce(F.col("datasource_uid") == MIRROR, F.lit(False))).alias("_all"), F.array_sort(F.collect_set("mirrored_id")).alias("mirrored"))
    return by.where("_all").drop("_all")


def find_panel(panels: DataFrame, title: str | None = None) -> DataFrame:
    """`panels` with `problem`: ids that several panels of a dashboard share are picked by title, or listed as ambiguous."""
    same = Window.partitionBy(*PANEL)
    rows = panels.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_titles", F.array_join(F.array_sort(F.collect_set("panel_title").over(same)), ", "))
    if title is not None:
        rows = rows.withColumn("_hits", F.count_if(F.col("panel_title") == title).over(same))
        rows = rows.where((F.col("_n") == 1) | (F.col("_hits") != 1) | (F.col("panel_title") == title))
        clear = (F.col("_n") == 1) | (F.col("_hits") == 1)
    else:
        clear = F.col("_n") == 1
    return rows.withColumn("problem", F.when(~clear, F.concat(F.lit("several panels have this id: "), F.col("_titles")))).drop("_n", "_titles", "_hits")


def panel_links(panels: DataFrame) -> DataFrame:
    """Drill-down links: defaults hold for all fields, an override's for the field it names."""
    keys = ["connection_id", "dashboard_uid", "panel_id"]
    every = panels.select(*keys, F.lit(None).cast("string").alias("field"), F.explode("default_links").alias("link"))
    some = panels.select(*keys, F.explode(F.filter("overrides", lambda o: o["matcher"] == "byName")).alias("o")).select(*keys, F.col("o.field").alias("field"), F.explode("o.links").alias("link"))
    return every.unionByName(some).select(*keys, "field", "link.title", "link.url")


def survey_panels(panels: DataFrame, limit: int = SURVEY) -> DataFrame:
    """`coverage` of each panel (executable, beyond-limit, mirror, non-queryable) in the order shown; `total` of its kind."""
    ok = ~F.col("is_mirror") & F.col("has_targets")
    order = F.row_number().over(Window.partitionBy("connection_id", "dashboard_uid", ok).orderBy("at", "panel_id"))
    kind = F.when(~F.col("has_targets"), "non-queryable").when(F.col("is_mirror"), "mirror").when(order <= limit, "executable").otherwise("beyond-limit")
    rows = panels.withColumn("coverage", kind)
    return rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("connection_id", "dashboard_uid", "coverage")))


def dashboard_inventory(panels: DataFrame, variables: DataFrame) -> DataFrame:
    """For each dashboard its panels, those with targets and with links, and its variables."""
    keys = ["connection_id", "dashboard_uid"]
    shown = panels.groupBy(*keys).agg(F.count(F.lit(1)).alias("panels"), F.count_if("has_targets").alias("with_targets"), F.count_if("has_links").alias("with_links"))
    named = variables.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "type", "current", "multi"))).alias("variables"))
    return shown.join(named, keys, "left")


def broken_datasources(targets: DataFrame, datasources: DataFrame) -> DataFrame:
    """Panel references to datasources that do not exist; variables and pseudo sources are none."""
    real = targets.where(F.col("datasource_uid").isNotNull() & ~F.col("datasource_uid").startswith("$") & ~F.col("datasource_uid").isin(*PSEUDO))
    known = datasources.select("connection_id", F.col("uid").alias("datasource_uid"))
    return real.select(*PANEL, "datasource_uid").distinct().join(known, ["connection_id", "datasource_uid"], "left_anti")


def resolve_datasource(refs: DataFrame, datasources: DataFrame) -> DataFrame:
    """`resolved`: the datasource whose uid the reference is, else whose name, else the reference itself."""
    by_uid = datasources.select("connection_id", F.col("uid").alias("ref"), F.col("uid").alias("_u"))
    by_name = datasources.groupBy("connection_id", F.col("name").alias("ref")).agg(F.min("uid").alias("_n"))
    rows = refs.join(by_uid, ["connection_id", "ref"], "left").join(by_name, ["connection_id", "ref"], "left")
    return rows.withColumn("resolved", F.coalesce("_u", "_n", "ref")).drop("_u", "_n")


def alert_backed_panels(panels: DataFrame, rules: DataFrame) -> DataFrame:
    """Panels that alert rules point to, with the rules (uid, title, folder) in order; rules without a link count for none."""
    linked = rules.where("dashboard_uid is not null and panel_id is not null")
    own = linked.groupBy(*PANEL).agg(F.sort_array(F.collect_list(F.struct("uid", "title", "folder_uid"))).alias("rules"))
    return panels.select(*PANEL, "panel_title").distinct().join(own, PANEL)


def alert_overview(backed: DataFrame, limit: int = FOUND) -> DataFrame:
    """The panels with the most rules, with `total` of all."""
    backed = stored(backed, "backed")
    total = backed.agg(F.count(F.lit(1)).alias("total"))
    top = backed.withColumn("n_rules", F.size("rules")).orderBy(F.desc("n_rules"), *PANEL).limit(limit)
    return top.join(F.broadcast(total))


def search_index(index: DataFrame, labels: Mapping[str, str], metric: str | None = None, text: str | None = None, excluding: str | None = None) -> DataFrame:
    """Panels of the index that match, once each with the highest `overlap` of label values.

    With a metric, the panels that show it, whatever their labels; without, those with a label value or the text.
    """
    wanted = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    pool = index if metric is None else index.where(F.col("metric") == metric)
    rows = pool.withColumn("overlap", F.greatest(label_overlap_lists(wanted, F.col("labels")), F.lit(0)))
    if metric is None:
        hit = F.col("overlap") > 0
        if text is not None:
            hit = hit | match_text(text, F.col("metric"), F.col("dashboard_title"), F.col("panel_title"))
        rows = rows.where(hit)
    if excluding is not None:
        rows = rows.where(F.col("dashboard_uid") != excluding)
    # of a panel the highest overlap, then the first metric
    best = F.min(F.struct((-F.col("overlap")).alias("_o"), "metric", "overlap", "dashboard_title", "panel_title")).alias("_best")
    rows = rows.groupBy(*PANEL).agg(best)
    return rows.select(*PANEL, "_best.metric", "_best.overlap", "_best.dashboard_title", "_best.panel_title")


def related(found: DataFrame, backed: DataFrame, meta: DataFrame, author: str | None = None) -> DataFrame:
    """All panels found, whether an alert backs them and whether the dashboard is the author's own."""
    rows = found.join(backed.select(*PANEL, F.lit(True).alias("alert_backed")), PANEL, "left").join(meta, ["connection_id", "dashboard_uid"], "left")
    return rows.withColumns({"alert_backed": F.coalesce("alert_backed", F.lit(False)), "same_author": F.coalesce(F.col("updated_by") == author, F.lit(False)) if author else F.lit(False)})


def rank_related(found: DataFrame, backed: DataFrame, meta: DataFrame, author: str | None = None, limit: int = FOUND) -> DataFrame:
    """Alert-backed panels first, then by overlap, by the author's own dashboards, and by the latest update."""
    rows = stored(related(found, backed, meta, author), "related")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(F.desc("alert_backed"), F.desc("overlap"), F.desc("same_author"), F.desc_nulls_last("updated"), *PANEL).limit(limit)
    return top.join(F.broadcast(total))


def metric_catalog(samples: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Metric names that contain the term, sorted, the first `limit`, with `total`."""
    names = stored(samples.where(match_text(term, F.col("metric"))).select("metric").distinct(), "names")
    total = names.agg(F.count(F.lit(1)).alias("total"))
    return names.orderBy("metric").limit(limit).join(F.broadcast(total))


def label_keys(samples: DataFrame, metric: str) -> DataFrame:
    return samples.where(F.col("metric") == metric).select(F.explode(F.map_keys("labels")).alias("label")).distinct()


class UnknownLabel(ValueError):
    """A metric has no such label."""


def label_values(samples: DataFrame, metric: str, label: str, limit: int = 50) -> DataFrame:
    """The values of one label of one metric, sorted, the first `limit`, with `total`; a label that the metric lacks is an error."""
    values = samples.where((F.col("metric") == metric) & F.col("labels")[label].isNotNull()).groupBy(F.col("labels")[label].alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = stored(values, "values")
    if values.isEmpty():
        raise UnknownLabel(f"{metric!r} has no label {label!r}")
    total = values.agg(F.count(F.lit(1)).alias("total"))
    return values.orderBy("value").limit(limit).join(F.broadcast(total))


def panels_of_metrics(index: DataFrame, limit: int = 5) -> DataFrame:
    """Of each metric the first `limit` panels of the index, with `total` of all."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(*PANEL))
    first = index.withColumn("_i", place).where(F.col("_i") <= limit).drop("_i")
    return first.join(index.groupBy("metric").agg(F.count(F.lit(1)).alias("total")), "metric")


def union_sources(answers: Mapping[str, DataFrame]) -> DataFrame:
    """What several connections answer as one table with `connection_id`; a column that one lacks is null there."""
    parts = [df.withColumn("connection_id", F.lit(name)) for name, df in answers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def failed_sources(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Connections that gave no result, so that none is missing in silence."""
    return expected.select("connection_id").distinct().join(got.select("connection_id").distinct(), "connection_id", "left_anti")


def pair_sources(metrics: DataFrame, logs: DataFrame, told: Callable[[Column], Column] = lambda tags: tags) -> DataFrame:
    """Metric and log connections that share a tag, with the sorted tags that they share, or what `told` makes of these.

    Pairs are as many as there are, so they are never shuffled or grouped: tags that one side lacks are dropped first, a pair is
    made in a cell of a grid for each tag that it shares, and the first of these tags alone gives it out. Where a source has one
    such tag, no tags are compared, and what is told of it is made before the pairs; where a side's sources all have, no lists of tags
    are carried along either, and a pair is only to be written.
    """
    a = metrics.select(F.col("id").alias("metric_id"), F.explode("tags").alias("tag"))
    b = logs.select(F.col("id").alias("log_id"), F.explode("tags").alias("tag"))

    def shared(rows: DataFrame, other: DataFrame, name: str, tags: str, one: str) -> DataFrame:
        known = rows.join(other.select("tag").distinct(), "tag", "left_semi").groupBy(name).agg(F.array_sort(F.collect_set("tag")).alias(tags))
        return stored(known.select(name, tags, (F.size(tags) == 1).alias(one), F.explode(tags).alias("tag")), "tagged-sources")

    left, right = shared(a, b, "metric_id", "_a", "_a_one"), shared(b, a, "log_id", "_b", "_b_one")
    one, both = F.col("_a_one") | F.col("_b_one"), F.array_intersect("_a", "_b")
    known = left.withColumn("_told", told(F.array("tag")))
    if left.where("not _a_one").isEmpty() or right.where("not _b_one").isEmpty():
        return grid(known.select("metric_id", "_told", "tag"), right.select("log_id", "tag"), ["tag"], SOURCES).select("metric_id", "log_id", F.col("_told").alias("shared"))
    met = grid(known, right, ["tag"], SOURCES).where(one | (F.get(both, F.lit(0)) == F.col("tag")))
    return met.select("metric_id", "log_id", F.when(one, F.col("_told")).otherwise(told(both)).alias("shared"))


def resolve_variable_values(variables: DataFrame, overrides: Mapping[str, Sequence[str]]) -> DataFrame:
    """`values` of each variable: the override, else what is saved; all stands for allValue, else the cached options.

    An empty list with `unresolved` matches everything.
    """
    given = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))]) if overrides else F.create_map().cast("map<string,array<string>>")
    picked = F.coalesce(F.element_at(given, F.col("name")), F.col("current"))
    every = F.array_contains(picked, "$__all")
    options = F.filter(F.coalesce("options", F.array()), lambda x: x != "$__all")
    values = F.when(every & F.col("all_value").isNotNull(), F.array("all_value")).when(every, options).otherwise(picked)
    return variables.withColumn("values", values).withColumn("unresolved", F.coalesce(every & F.col("all_value").isNull() & (F.size(options) == 0), F.lit(False)))


def filter_by_values(samples: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """Rows whose label has one of the values; no value matches everything."""
    return samples.where(F.col("labels")[label].isin(list(values))) if values else samples


#: How a pattern's parts are named in a row.
PATTERN = T.StructType([T.StructField("text", T.StringType()), T.StructField("groups", T.IntegerType()), T.StructField("every", T.BooleanType())])


def _matched(value: Column, text: Column, groups: Column, every: Column) -> Column:
    """What a variable takes from a value: the first group, or the match where there is none or it took no part; null without a match.

    Where all matches are asked for, these are in the groups' place, so the second counts if there is one.
    """
    found = F.regexp_extract_all(value, text, F.lit(0))
    group = F.nullif(F.call_function("regexp_extract", value, text, F.least(groups, F.lit(1))), F.lit(""))
    return F.when(F.size(found) == 0, F.lit(None)).when(every, F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0)))).otherwise(F.coalesce(group, F.get(found, F.lit(0))))


def materialize_values(samples: DataFrame, incident: DataFrame, label: str, regex: str | None = None) -> DataFrame:
    """incident_id and `value`: what the label takes inside the incident's own window, through the regex's group or match.

    `regex` is in the form that dashboards store, `/body/flags` or a body alone; what is no pattern raises BadPattern.
    """
    from tidewatch.operators.windows import tag_windows

    raw = tag_windows(samples, incident).select("incident_id", F.col("labels")[label].alias("value")).where("value is not null").distinct()
    if not regex:
        return raw
    p = stored_pattern(regex)
    return raw.select("incident_id", _matched(F.col("value"), F.lit(p.text), F.lit(p.groups), F.lit(p.every)).alias("value")).where("value is not null").distinct()


@F.pandas_udf(PATTERN)
def _patterns(stored: pd.Series) -> pd.DataFrame:
    """The patterns of variables; nulls for what is none."""

    def parts(text: str | None) -> tuple:
        try:
            return tuple(stored_pattern(text)) if text else ("(?s).*", 0, False)
        except BadPattern:
            return (None, None, None)

    return pd.DataFrame([parts(t) for t in stored], columns=["text", "groups", "every"])


def live_values(variables: DataFrame, overrides: Mapping[str, Sequence[str]], samples: DataFrame, incident: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the variables that would match everything, from the samples inside each incident's own window.

    `variables` has name, type, query, regex and datasource_type besides what `resolve_variable_values` takes. Only those
    that stand for all and have no options are looked up, and of these the ones whose query lists the values of a tag of a
    store of tags. Gives (incident_id, name, value), to be used for every window of the incident (`in_windows`), and
    (incident_id, name) of the unresolved: other kinds, no pattern, or no value.
    """
    from tidewatch.operators.windows import tag_windows

    open_ = stored(resolve_variable_values(variables, overrides).where("unresolved").select("name", "type", "query", "regex", "datasource_type"), "open-variables")
    label = F.regexp_extract("query", r'(?is)\A\s*show\s+tag\s+values\b.*\bwith\s+key\s*=\s*"?([^"\s]+)', 1)
    asked = open_.withColumn("_label", label).where("type = 'query' and datasource_type = 'influxdb' and _label <> ''").withColumn("_p", _patterns("regex")).where("_p.text is not null")
    held = tag_windows(samples, incident).select("incident_id", F.explode("labels").alias("_label", "_value")).where("_value is not null").distinct()
    taken = _matched(F.col("_value"), F.col("_p.text"), F.col("_p.groups"), F.col("_p.every"))
    found = stored(held.join(asked, "_label").select("incident_id", "name", taken.alias("value")).where("value is not null").distinct(), "live-values")
    names = open_.agg(F.collect_list("name").alias("_names"))  # one row: the names that a dashboard declares
    every = incident.select("incident_id").distinct().join(F.broadcast(names)).select("incident_id", F.explode("_names").alias("name"))
    return found, every.join(found, ["incident_id", "name"], "left_anti")


def in_windows(tagged: DataFrame, values: DataFrame, name: str, label: str) -> DataFrame:
    """Samples of all windows whose label has a value that the variable took in the incident's own; an incident without any keeps all."""
    own = values.where(F.col("name") == name).select("incident_id", F.col("value").alias("_value"))
    some = own.select("incident_id").distinct().withColumn("_some", F.lit(True))
    rows = tagged.withColumn("_own", F.col("labels")[label])
    hit = rows.join(own, (rows["incident_id"] == own["incident_id"]) & (rows["_own"] == own["_value"]), "left_semi")
    return hit.unionByName(rows.join(some, "incident_id", "left_anti")).drop("_own")


class FilterConflict(ValueError):
    """A tag is already bound to something else."""


def breakout_filter(spec: Mapping[str, str], key: str, value: str) -> dict[str, str]:
    """The filters with key = value; the same again changes nothing, another value is an error."""
    if key in spec and spec[key] != value:
        raise FilterConflict(f"{key} is already {spec[key]!r}")
    return {**spec, key: value}


def apply_filters(samples: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    for key, value in spec.items():
        samples = samples.where(F.coalesce(F.col("labels")[key] == value, F.lit(False)))
    return samples


def breakout_group(groups: Sequence[str] | None, key: str, without: Sequence[str] | None = None) -> tuple[list[str] | None, list[str] | None]:
    """An aggregate's grouping, split by one more tag: `by` gains it, `without` loses it; no aggregate is an error."""
    if groups is None and without is None:
        raise ValueError("only an aggregate can be split")
    if without is not None:
        return None, [k for k in without if k != key]
    return [*groups, *([] if key in groups else [key])], None


def aggregate_by(samples: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sum and count of the values for each combination of label values."""
    keys = [F.col("labels")[g].alias(g) for g in groups]
    return samples.groupBy(*keys).agg(F.sum("v").alias("v"), F.count("v").alias("n"))
