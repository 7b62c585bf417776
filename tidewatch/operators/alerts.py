"""Alerts: one form for all, their rules, their connections, and lists of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import match_labels

#: Fixed value: characters that no value of a variable may hold.
UNSAFE = r"""[\x00-\x1f\x7f"'`\\;{}$]"""
RECENT, LISTED = 20, 50


def _path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def link_uid(url: Column) -> Column:
    """The dashboard of a link, null for other links."""
    return F.nullif(F.regexp_extract(F.coalesce(_path(url), F.lit("")), r"/d(?:-solo)?/([^/]+)", 1), F.lit(""))


def link_kind(url: Column) -> Column:
    """dashboard, alert-rule, folder or short link; null for what is none of them."""
    path = F.coalesce(_path(url), F.lit(""))
    return F.when(path.rlike(r"/d(?:-solo)?/[^/]+"), "dashboard").when(path.rlike(r"/alerting/grafana/[^/]+/view"), "alert-rule").when(path.rlike(r"/dashboards/f/[^/]+"), "folder").when(path.rlike(r"/goto/[^/?#]+"), "short-link")


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit(" ")))


def _parameters(url: Column) -> Column:
    """The decoded parameters of a link: an array of key and value."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), _decoded(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))


def link_panel(url: Column) -> Column:
    """The panel id of a link: digits, with or without `panel-` before them."""
    p = _parameters(url)
    first = lambda key: F.get(F.transform(F.filter(p, lambda x: x["key"] == key), lambda x: x["value"]), F.lit(0))
    raw = F.coalesce(first("viewPanel"), first("panelId"))
    return F.regexp_extract(raw, r"\A(?:panel-)?(\d+)\z", 1).try_cast("bigint")


def link_variables(url: Column) -> Column:
    """`var-` parameters: an array of name, value and whether the value is safe in a query."""
    own = F.filter(_parameters(url), lambda x: x["key"].startswith("var-"))
    return F.transform(own, lambda x: F.struct(F.substring(x["key"], F.lit(5), F.length(x["key"])).alias("name"), x["value"].alias("value"), (~x["value"].rlike(UNSAFE)).alias("safe")))


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """`alerts` with alert_name, dashboard_uid, panel_id, variables, ends_at (of resolved ones only) and warnings.

    The dashboard is the one annotated, else that of the first link to a dashboard among panel, dashboard and generator
    links. What can't be read becomes a warning.
    """
    note = F.col("annotations")
    annotated = F.nullif(note["__dashboardUid__"], F.lit(""))
    raw_panel = F.trim(note["__panelId__"])
    link = F.coalesce(*[F.when(link_uid(F.col(c)).isNotNull(), F.col(c)) for c in ("panel_url", "dashboard_url", "generator_url")])
    rows = alerts.withColumn("_link", F.when(annotated.isNull(), link))
    variables = F.coalesce(link_variables(F.col("_link")), F.array())
    rows = rows.withColumn("_vars", variables)
    unsafe = F.array_distinct(F.transform(F.filter("_vars", lambda v: ~v["safe"]), lambda v: v["name"]))
    bad_panel = annotated.isNotNull() & raw_panel.isNotNull() & (raw_panel != "") & ~raw_panel.rlike(r"\A\d+\z")
    warnings = F.array_compact(F.array(
        F.when(bad_panel, F.concat(F.lit("the annotated panel id is not a number: "), note["__panelId__"])),
        F.when(annotated.isNull() & F.col("_link").isNull(), "no link to a dashboard"),
        F.when(F.size(unsafe) > 0, F.concat(F.lit("unsafe values of variables were dropped: "), F.array_join(unsafe, ", "))),
    ))
    return rows.withColumns({
        "alert_name": F.col("labels")["alertname"],
        "dashboard_uid": F.coalesce(annotated, link_uid(F.col("_link"))),
        "panel_id": F.when(annotated.isNotNull(), F.when(~bad_panel, raw_panel).try_cast("bigint")).otherwise(link_panel(F.col("_link"))),
        "variables": F.transform(F.filter("_vars", lambda v: v["safe"]), lambda v: F.struct(v["name"].alias("name"), v["value"].alias("value"))),
        "ends_at": F.when(F.col("state") == "resolved", F.col("ends_at")),
        "warnings": warnings,
    }).drop("_link", "_vars")


def describe_threshold(rules: DataFrame) -> DataFrame:
    """`threshold` of a rule: the evaluator of the query that is its condition, as `type p1, p2`."""
    own = F.get(F.filter("data", lambda d: d["ref_id"] == F.col("condition")), F.lit(0))
    return rules.withColumn("threshold", F.when(own.isNotNull() & own["type"].isNotNull(), F.concat_ws(" ", own["type"], F.nullif(F.array_join(own["params"], ", "), F.lit("")))))


def resolve_connections(alerts: DataFrame, connections: DataFrame) -> DataFrame:
    """connection_id and `status` (matched, unmatched, ambiguous, only-connection, no-host) of each alert, by its link's host.

    A connection answers to the host of its url and to its aliases, whatever the case.
    """
    host = F.lower(F.try_parse_url(F.coalesce("panel_url", "dashboard_url", "generator_url"), F.lit("HOST")))
    names = F.array_distinct(F.array_compact(F.concat(F.array(F.lower(F.try_parse_url("url", F.lit("HOST")))), F.transform(F.coalesce("match_hosts", F.array().cast("array<string>")), lambda h: F.lower(h)))))
    hosts = connections.select(F.col("id").alias("_id"), F.explode(names).alias("_host")).groupBy("_host").agg(F.min("_id").alias("_id"), F.countDistinct("_id").alias("_n"))
    one = connections.agg(F.min("id").alias("_only"), F.count(F.lit(1)).alias("_count"))
    rows = alerts.withColumn("_of", host).join(hosts, F.col("_of") == F.col("_host"), "left").join(F.broadcast(one))
    status = (
        F.when(F.col("_of").isNull(), F.when(F.col("_count") == 1, "only-connection").otherwise("no-host"))
        .when(F.col("_n").isNull(), "unmatched")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("matched")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("connection_id", F.when(F.col("status") == "matched", F.col("_id")).when(F.col("status") == "only-connection", F.col("_only"))).drop("_of", "_host", "_id", "_n", "_only", "_count")


def _stored_at(alerts: DataFrame) -> Column:
    """When a batch came in and, of equal times, where it is in the store: what is stored later is newer."""
    return F.struct("received_at", *[c for c in ("place",) if c in alerts.columns])


def _within(alerts: DataFrame) -> list[Column]:
    """The order of alerts of one batch: by position, and by all they say where no position is known."""
    return [F.col("position")] if "position" in alerts.columns and "place" in alerts.columns else [F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns]))]


def latest_alert(alerts: DataFrame) -> DataFrame:
    """All alerts of the newest batch, by a comparison with one aggregated row; without places, of all that came in then."""
    newest = alerts.agg(F.max(_stored_at(alerts)).alias("_newest"))
    return alerts.join(F.broadcast(newest), _stored_at(alerts).eqNullSafe(F.col("_newest"))).drop("_newest")


def alert_by_fingerprint(alerts: DataFrame) -> DataFrame:
    """The newest state of each fingerprint: the first alert that has it in the newest batch that does.

    The order is total, so ties don't depend on how rows are dealt.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in alerts.columns])
    known = "position" in alerts.columns and "place" in alerts.columns
    last = F.struct(_stored_at(alerts), -F.col("position") if known else _within(alerts)[0])
    best = alerts.groupBy("fingerprint").agg(F.max_by(rest, last).alias("r"))
    return best.select("r.*")


def recent_alerts(alerts: DataFrame, n: int = RECENT) -> DataFrame:
    """The `n` newest alerts, the newest batch first and in each in its order."""
    return alerts.orderBy(_stored_at(alerts).desc(), *_within(alerts)).limit(n)


def recent_batches(alerts: DataFrame, n: int = RECENT) -> DataFrame:
    """All alerts of the `n` newest batches."""
    newest = alerts.select(_stored_at(alerts).alias("_at")).distinct().orderBy(F.desc("_at")).limit(n)
    return alerts.withColumn("_of", _stored_at(alerts)).join(F.broadcast(newest), F.col("_of").eqNullSafe(F.col("_at")), "left_semi").drop("_of")


def firing_alerts(alerts: DataFrame, wanted: Mapping[str, str], limit: int = LISTED) -> DataFrame:
    """Alerts with all wanted labels, the latest starts first, `limit` for each connection, with `total`."""
    found = alerts.where(match_labels(F.col("labels"), wanted))
    own = Window.partitionBy("connection_id")
    ranked = found.withColumn("_i", F.row_number().over(own.orderBy(F.desc("starts_at"), "fingerprint"))).where(F.col("_i") <= limit).drop("_i")
    totals = found.groupBy("connection_id").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, "connection_id").withColumn("link", F.coalesce("panel_url", "dashboard_url", "generator_url"))
