"""What else moved: scores and ranks of candidate series around an incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import MINUTE, label_overlap
from tidewatch.operators.series import Z, classify_baseline
from tidewatch.operators.skew import pairs

LIMIT = 10


def score_candidates(joined: DataFrame, z: float = Z) -> DataFrame:
    """z, magnitude, overlap, lag_ms and score of candidates.

    Rows have the incident's mean, n, n_nonzero; pooled_mean and pooled_stddev of their own preceding window; onset,
    primary_onset, labels and primary_labels.
    """
    rows = classify_baseline(joined, z)
    share = z * F.col("n_nonzero") / F.greatest("n", F.lit(1))
    magnitude = F.when(F.col("class") == "baseline-all-zero", share).otherwise(F.coalesce("z", F.lit(0.0)))
    lag = F.unix_millis("onset") - F.unix_millis("primary_onset")
    timing = F.coalesce(1 / (1 + F.abs(F.col("lag_ms")) / MINUTE), F.lit(0.0))
    rows = rows.withColumns({"magnitude": magnitude, "overlap": label_overlap(F.col("primary_labels"), F.col("labels")), "lag_ms": lag})
    return rows.withColumn("score", F.abs("magnitude") * (1 + F.col("overlap")) * (1 + timing))


def top_candidates(scored: DataFrame, keys: Sequence[str], limit: int = LIMIT, ties: Sequence[str] = ("series_key",), total: bool = True) -> DataFrame:
    """The `limit` best of each of `keys`, with `rank` and, where it is asked for, `total`: all are scored again to be counted."""
    window = Window.partitionBy(*keys)
    ranks = scored.withColumn("rank", F.row_number().over(window.orderBy(F.desc("score"), *ties)))
    best = ranks.where(F.col("rank") <= limit)
    return best.join(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), list(keys)) if total else best


def candidate_panels(index: DataFrame, primary: DataFrame) -> DataFrame:
    """Panels that share a metric with a primary panel, once each, without the primary itself. A metric of many panels is dealt over tasks.

    `index` has connection_id, dashboard_uid, panel_id, metric; `primary` has incident_id and the same four columns.
    """
    wanted = primary.select("incident_id", "metric").distinct()
    panel = ["connection_id", "dashboard_uid", "panel_id"]
    found = pairs(index, wanted, ["metric"]).groupBy("incident_id", *panel).agg(F.min("metric").alias("metric"), F.count(F.lit(1)).alias("n_shared"))
    return found.join(primary.select("incident_id", *panel).distinct(), ["incident_id", *panel], "left_anti")


def tier_candidates(candidates: DataFrame, primary: DataFrame, product: DataFrame) -> DataFrame:
    """`tier` of each candidate: product (the same connection and a dashboard of the product), connection, or all.

    `primary` has incident_id and home (its connection); `product` has incident_id and dashboard_uid.
    """
    inside = product.select("incident_id", "dashboard_uid").distinct().withColumn("_in", F.lit(True))
    rows = candidates.join(primary.select("incident_id", "home").distinct(), "incident_id").join(inside, ["incident_id", "dashboard_uid"], "left")
    same = F.col("connection_id") == F.col("home")
    return rows.withColumn("tier", F.when(same & F.col("_in"), "product").when(same, "connection").otherwise("all")).drop("_in")


def containment(tiered: DataFrame) -> DataFrame:
    """For each incident the candidates of each tier, and whether the product's scope leaves any out on its connection."""
    by = tiered.groupBy("incident_id").agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("product", "connection", "all")])
    return by.withColumn("contained", F.col("n_connection") == 0)
