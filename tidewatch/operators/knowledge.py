"""Product knowledge in text panels, and the folders that lead to it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import stored, work_path

MARK = "knowledge"
FENCE = r"(?is)```json\s*\n(.*?)```"
SPACE = " \t\n\x0b\x0c\r"
#: Folders up, folders looked into, and rows listed of a folder.
HOPS, FOLDERS, LISTED = 10, 500, 200


def extract_knowledge(panels: DataFrame, mark: str = MARK) -> DataFrame:
    """product_key, json, prose and parse_error of text panels titled `<mark>: <key>`; of one key the first panel counts.

    `panels` has connection_id, dashboard_uid, panel_id, at, title and content. The first fenced block is parsed and the
    rest is prose; a block that can't be parsed leaves the whole text, with parse_error. Null content is empty.
    """
    key = F.trim(F.regexp_extract(F.coalesce("title", F.lit("")), rf"(?i)^{mark}:\s*(.+)$", 1))
    rows = panels.withColumn("product_key", F.lower(key)).where("product_key <> ''")
    first = Window.partitionBy("connection_id", "dashboard_uid", "product_key").orderBy("at", "panel_id")
    rows = rows.withColumn("_i", F.row_number().over(first)).where("_i = 1")
    rows = rows.withColumn("content", F.coalesce("content", F.lit("")))
    block = F.nullif(F.regexp_extract("content", FENCE, 1), F.lit(""))
    fenced = F.col("content").rlike(FENCE)
    parsed = F.try_parse_json(block)
    good = fenced & parsed.isNotNull()
    # the first block alone is cut out, by its place
    at, block_text = F.regexp_instr("content", F.lit(FENCE)), F.regexp_substr("content", F.lit(FENCE))
    rest = F.concat(F.substring("content", F.lit(1), at - 1), F.substring("content", at + F.length(block_text), F.length("content")))
    prose = F.btrim(F.when(good, rest).otherwise(F.col("content")), F.lit(SPACE))
    return rows.select("connection_id", "dashboard_uid", "panel_id", "product_key", F.when(good, F.to_json(parsed)).alias("json"), prose.alias("prose"), (fenced & parsed.isNull()).alias("parse_error"))


def related_uids(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """Every dashboard that is linked anywhere in a text (or a JSON document as text), once each."""
    links = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"/d/([A-Za-z0-9_-]+)"), 1)
    return texts.select(*keep, F.explode(links).alias("uid")).distinct()


def folder_ancestors(spark: SparkSession, folders: DataFrame, start: DataFrame, hops: int = HOPS, own: bool = False) -> DataFrame:
    """uid, ancestor and depth (from 1) for each `uid` of `start`, up to `hops`; ends at a root, a cycle or a gap.

    With `own` a folder is its own ancestor at depth 0. Each hop is one merge join whose result is a table, so no task holds
    the tree, and no plan more than one hop. Rows that have reached a root go into no further join, so a root that many
    folders share is no hot key.
    """
    edges = folders.select(F.col("uid").alias("_at"), "parent_uid").where("parent_uid is not null")
    known = folders.select(F.col("uid").alias("_there"))
    edges = stored(edges.join(known.hint("merge"), F.col("parent_uid") == F.col("_there"), "left_semi"), "folder-edges")
    further = edges.select(F.col("_at").alias("_there"), F.lit(True).alias("_more")).distinct()
    edges = stored(edges.join(further.hint("merge"), F.col("parent_uid") == F.col("_there"), "left").drop("_there"), "folder-edges")
    path = work_path(spark, "ancestors")
    level = start.select("uid", F.col("uid").alias("ancestor"), F.array("uid").alias("_path"), F.lit(0).alias("depth"), F.lit(True).alias("_more"))
    schema = level.schema
    for depth in range(hops + 1):
        level.write.parquet(f"{path}/level={depth}")
        last = spark.read.schema(schema).parquet(f"{path}/level={depth}").where("_more")
        if depth == hops or last.isEmpty():
            break
        up = last.drop("_more", "depth").join(edges.hint("merge"), F.col("ancestor") == F.col("_at")).where(~F.array_contains("_path", F.col("parent_uid")))
        level = up.select("uid", F.col("parent_uid").alias("ancestor"), F.concat("_path", F.array("parent_uid")).alias("_path"), F.lit(depth + 1).alias("depth"), "_more")
    found = spark.read.schema(schema).parquet(*[f"{path}/level={d}" for d in range(depth + 1)]).select("uid", "ancestor", "depth")
    return found if own else found.where("depth > 0")


class Contents(NamedTuple):
    """What folders hold. `scope` columns and `root` say of which folder each row is.

    `folders`: uid, depth (the folder itself at 0) and `at`, its place in breadth-first order, of each folder that was looked
    into. `dashboards` and `subfolders` (direct ones alone): uid, title and `place` (from 1). `summary`: dashboards_total,
    subfolders_total, folders_scanned and truncated, one row for each folder asked for.
    """

    folders: DataFrame
    dashboards: DataFrame
    subfolders: DataFrame
    summary: DataFrame


def _descend(roots: DataFrame, edges: DataFrame, own: list[str], scope: list[str], most: int | None) -> DataFrame:
    """`own`, uid, depth, at and `scanned` of the roots and all below them; a row that isn't scanned marks a root that was cut.

    One level after the other, for all roots at once, until a level is empty. Each level is a table, so a plan never holds
    more than one hop, and folders that were met before (on a cycle) are left out.
    """
    spark = roots.sparkSession
    path = work_path(spark, "folders")
    level = roots.withColumns({"depth": F.lit(0), "at": F.lit(0).cast("long"), "scanned": F.lit(True)})
    depth, schema = 0, None
    while True:
        level.write.parquet(f"{path}/level={depth}")
        schema = schema or level.schema
        known = spark.read.schema(schema).parquet(*[f"{path}/level={d}" for d in range(depth + 1)])
        last = spark.read.schema(schema).parquet(f"{path}/level={depth}")
        if last.where("scanned").isEmpty():
            return known
        ends = last.groupBy(*own).agg((F.max("at") + 1).alias("_next"), F.bool_and("scanned").alias("_whole"))
        front = last.join(ends.where("_whole"), own).select(*own, F.col("uid").alias("_up"), F.col("at").alias("_at"), "_next")
        met = front.join(edges, [*scope, "_up"]).select(*own, "uid", "_at", "_next")
        # a folder that is listed twice is looked into where it comes first
        new = met.join(known.select(*own, "uid"), [*own, "uid"], "left_anti").groupBy(*own, "uid").agg(F.min("_at").alias("_at"), F.first("_next").alias("_next"))
        rank = F.row_number().over(Window.partitionBy(*own).orderBy("_at", "uid"))
        placed = new.withColumn("_i", rank)
        if most is not None:
            placed = placed.where(F.col("_i") <= most)
        depth += 1
        at = F.col("_next") + F.col("_i") - 1
        inside = at < most if most is not None else F.lit(True)
        level = placed.select(*own, "uid", F.lit(depth).alias("depth"), at.alias("at"), inside.alias("scanned"))
        if most is not None:
            level = level.where(F.col("at") <= most)  # one row beyond tells that the root was cut


def folder_contents(folders: DataFrame, dashboards: DataFrame, roots: DataFrame, recursive: bool = False, most: int | None = FOLDERS, limit: int | None = LISTED, scope: Sequence[str] = ()) -> Contents:
    """Dashboards and subfolders of each folder in `roots` (column `root`), at once for all of them.

    `folders` has uid, parent_uid and title, `dashboards` folder_uid, uid and title; `scope` names columns (say, the
    connection) that all three tables have and within which uids hold. One level alone, or with `recursive` the dashboards
    of all folders below, of any depth; subfolders are the direct ones either way. Folders are looked into in breadth-first
    order, siblings by uid, at most `most` of them, the root among these; `truncated` is true where any was left out. At
    most `limit` dashboards and subfolders are listed, in that order and then by uid; the totals count all that was found.
    A root that isn't among the folders has no rows; cycles end where they meet a folder again. None lifts a bound.
    """
    scope = list(scope)
    own = [*scope, "root"]
    known = folders.select(*scope, F.col("uid").alias("root")).distinct()
    start = roots.select(*own).distinct().join(known, own, "left_semi").withColumn("uid", F.col("root"))
    named = folders.where("parent_uid is not null").select(*scope, F.col("parent_uid").alias("_up"), "uid", "title")
    if recursive:
        every = _descend(start, named.drop("title"), own, scope, most)
    else:
        every = stored(start.withColumns({"depth": F.lit(0), "at": F.lit(0).cast("long"), "scanned": F.lit(True)}), "folder-roots")
    scanned = every.where("scanned").select(*own, "uid", "depth", "at")

    held = dashboards.select(*scope, F.col("folder_uid").alias("_in"), F.col("uid").alias("_uid"), "title")
    found = stored(scanned.withColumnRenamed("uid", "_in").join(held, [*scope, "_in"]).select(*own, F.col("_uid").alias("uid"), "title", "at"), "folder-dashboards")
    direct = stored(start.select(*own, F.col("uid").alias("_up")).join(named, [*scope, "_up"]).select(*own, "uid", "title", F.lit(0).cast("long").alias("at")), "folder-subfolders")

    def listed(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy("at", "uid", "title")))
        return (placed if limit is None else placed.where(F.col("place") <= limit)).drop("at")

    count = lambda rows, name: rows.groupBy(*own).agg(F.count(F.lit(1)).alias(name))
    looked = every.groupBy(*own).agg(F.count_if("scanned").alias("folders_scanned"), (~F.bool_and("scanned")).alias("truncated"))
    totals = looked.join(count(found, "dashboards_total"), own, "left").join(count(direct, "subfolders_total"), own, "left")
    summary = totals.select(*own, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dashboards_total", "subfolders_total")], "folders_scanned", "truncated")
    return Contents(scanned, listed(found), listed(direct), summary)


def _product_key(key: Column) -> Column:
    return F.lower(F.btrim(key, F.lit(SPACE)))


def attach_knowledge(alerts: DataFrame, keys: DataFrame, ancestors: DataFrame, knowledge: DataFrame, homes: DataFrame) -> DataFrame:
    """The best knowledge panel of each alert; no row where there is none.

    `keys` has alert_id, position and key (dashboard tags, then label values); `ancestors` has alert_id, folder and depth,
    the alert's own folder at 0; `homes` has the folder (`home`) of each knowledge dashboard. Going up, the first folder
    with a knowledge dashboard gives the one that is tried first, with the keys in order; its first dashboard counts where
    it has several. Then all others are tried in order, each with the keys in order. `depth` is that of the first one's
    folder, and null for a panel of another dashboard.

    Of a key's panels only two can be the best: the first on the alert's nearest dashboard and the first of all. So an alert has
    a row for each of its keys, however many panels these have.
    """
    wanted = keys.select("alert_id", _product_key(F.col("key")).alias("product_key"), "position").groupBy("alert_id", "product_key").agg(F.min("position").alias("position"))
    met = ancestors.join(homes, F.col("folder") == F.col("home"))
    walked = met.groupBy("alert_id").agg(F.min(F.struct("depth", "dashboard_uid")).alias("walked"))
    place = F.row_number()
    boards = knowledge.withColumn("_i", place.over(Window.partitionBy("product_key", "dashboard_uid").orderBy("panel_id"))).where("_i = 1").drop("_i")
    firsts = boards.withColumn("_i", place.over(Window.partitionBy("product_key").orderBy("dashboard_uid", "panel_id"))).where("_i = 1")
    rest = [k for k in knowledge.columns if k != "product_key"]
    boards = boards.select("product_key", F.col("dashboard_uid").alias("_at"), F.struct(*rest).alias("_near"))
    firsts = firsts.select("product_key", F.struct(*rest).alias("_first"))
    rows = wanted.join(alerts.select("alert_id"), "alert_id", "left_semi").join(walked, "alert_id", "left").withColumn("_at", F.col("walked.dashboard_uid"))
    # a key with a panel has a first one
    rows = rows.join(firsts, "product_key").join(boards, ["product_key", "_at"], "left").withColumn("_k", F.coalesce("_near", "_first"))
    hits = rows.select("product_key", "alert_id", "position", "_k.*", F.when(F.col("_near").isNotNull(), F.col("walked.depth")).alias("depth"))
    best = Window.partitionBy("alert_id").orderBy(F.col("depth").isNull(), "dashboard_uid", "position", "panel_id")
    return hits.withColumn("_i", place.over(best)).where("_i = 1").drop("_i")


def knowledge_matches(knowledge: DataFrame, keys: DataFrame) -> DataFrame:
    """Every knowledge panel with one of the keys, whatever their case and the space around them."""
    return knowledge.join(keys.select(_product_key(F.col("key")).alias("product_key")).distinct(), "product_key", "left_semi")


def knowledge_overview(dashboards: DataFrame, knowledge: DataFrame, tag: str = MARK) -> DataFrame:
    """connection_id, dashboard_uid, title, folder_uid and the sorted product_keys of every dashboard with the tag.

    `dashboards` has connection_id, uid, title, folder_uid and tags. One without knowledge panels has no keys.
    """
    own = ["connection_id", "dashboard_uid"]
    keys = knowledge.groupBy(*own).agg(F.array_sort(F.collect_set("product_key")).alias("product_keys"))
    tagged = dashboards.where(F.array_contains("tags", tag)).select("connection_id", F.col("uid").alias("dashboard_uid"), "title", "folder_uid")
    return tagged.join(keys, own, "left").withColumn("product_keys", F.coalesce("product_keys", F.array().cast("array<string>")))
