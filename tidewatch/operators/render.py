"""Dashboards as one sees them: every panel's coverage, and statistics and thinned points of those that are run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.catalog import SURVEY, survey_panels
from tidewatch.operators.series import MAX_POINTS, downsample, series_stats
from tidewatch.operators.windows import tag_windows
from tidewatch.session import stored

BOARD = ["connection_id", "dashboard_uid"]
ASKED = ["from_ts", "to_ts", "series_key"]


def render_dashboards(panels: DataFrame, ranges: DataFrame, samples: DataFrame, limit: int = SURVEY, most: int = MAX_POINTS) -> tuple[DataFrame, DataFrame]:
    """The panels of every dashboard in its own time range, and the points of their series.

    `panels` has the columns of `survey_panels` and series_key; `ranges` has from_ts and to_ts of each dashboard. The first
    result has a row for each panel: coverage, and for an executable one the statistics of all its points. The second has
    at most `most` points for each range and series. Panels that ask for the same series in the same range are computed
    once, however many dashboards show them.
    """
    shown = stored(survey_panels(panels, limit).join(ranges, BOARD), "panels-shown")
    asked = stored(shown.where("coverage = 'executable'").select(*ASKED).distinct(), "panels-asked")
    tagged = tag_windows(samples, asked.select("from_ts", "to_ts").distinct()).join(asked, ASKED, "left_semi")
    stats = series_stats(tagged, ASKED).withColumn("coverage", F.lit("executable"))
    return shown.join(stats, [*ASKED, "coverage"], "left"), downsample(tagged, ASKED, most)
