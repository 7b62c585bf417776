"""A verdict from the class of the baseline comparison, the alert's threshold and the confirmed candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE = 1.0
LISTED = 5


def scope_text(titles: Column) -> Column:
    """How far an incident reaches, from the titles of confirmed candidates in order of rank."""
    distinct = F.array_distinct(titles)
    listed = F.array_join(F.slice(distinct, 1, LISTED), ", ")
    more = F.when(F.size(distinct) > LISTED, F.concat(F.lit(" and "), (F.size(distinct) - LISTED).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(distinct) == 0, "isolated").otherwise(F.concat(F.size(distinct).cast("string"), F.lit(" dashboards: "), listed, more))


def summarize_findings(facts: DataFrame, score: float = SCORE) -> DataFrame:
    """verdict, confidence, reasons, scope and missing for rows with class, z, n_excursions, threshold_crossed (or null),
    candidates (array of title and score in order of rank), adhoc (whether any evidence is hand-written) and warnings.
    """
    rows = facts.withColumn("confirmed", F.filter("candidates", lambda c: c["score"] >= score))
    kind, crossed = F.col("class"), F.col("threshold_crossed")
    is_crossed, not_crossed = F.coalesce(crossed, F.lit(False)), F.coalesce(~crossed, F.lit(False))
    some, brief = F.size("confirmed") > 0, F.coalesce("n_excursions", F.lit(0)) > 0
    none, zero, unusual = kind == "insufficient-data", kind == "baseline-all-zero", kind == "statistically-unusual"
    verdict = (
        F.when(none, "inconclusive")
        .when(zero, F.when(is_crossed, "real-anomaly").otherwise("inconclusive"))
        .when(unusual, F.when(not_crossed, "inconclusive").otherwise("real-anomaly"))
        .when(brief, "inconclusive")
        .otherwise("likely-false-positive")
    )
    confidence = (
        F.when(none, "low")
        .when(zero, F.when(is_crossed | some, "medium").otherwise("low"))
        .when(unusual, F.when(is_crossed, "high").when(not_crossed, "low").otherwise("medium"))
        .when(brief, "low")
        .otherwise("medium")
    )
    scope = F.when(none, "unknown").when(~zero & ~unusual & ~brief, "none").otherwise(scope_text(F.transform("confirmed", lambda c: c["title"])))
    z = F.concat(F.lit("z is "), F.round(F.col("z"), 2).cast("string"))
    reasons = F.array_compact(F.array(
        F.when(none, "there is too little data to compare with"),
        F.when(zero, "the baseline is zero throughout, and the incident is not"),
        F.when(unusual, z),
        F.when(~none & ~zero & ~unusual, "the level is common during normal operations"),
        F.when(is_crossed, "the alert's threshold was crossed"),
        F.when(not_crossed, "the alert's threshold was not crossed"),
        F.when(brief, F.concat(F.col("n_excursions").cast("string"), F.lit(" brief excursions beyond the normal range"))),
        F.when(some, F.concat(F.size("confirmed").cast("string"), F.lit(" other panels moved as well"))),
        F.when(F.col("adhoc"), "some evidence comes from hand-written queries"),
    ))
    missing = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(crossed.isNull(), F.array(F.lit("whether the threshold was crossed"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumns({"verdict": verdict, "confidence": confidence, "scope": scope, "reasons": reasons, "missing": missing})
