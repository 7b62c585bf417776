"""Log messages with their extra fields as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that are columns of their own.
FIXED = ("_id", "message", "timestamp", "source")


def promote_labels(messages: DataFrame, source: str = "unknown") -> DataFrame:
    """id, ts, source, message and labels for rows with id, ts, source, message and `fields` (a JSON object).

    Every field but the fixed ones becomes a label; null is left out; what is not a string is its JSON.
    """
    fields = F.from_json("fields", "map<string,string>")
    labels = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*FIXED) & v.isNotNull())
    return messages.select("id", "ts", F.coalesce("source", F.lit(source)).alias("source"), "message", labels.alias("labels"))
