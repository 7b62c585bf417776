"""CSV in and out: wide series, tables of frames, and cells that no spreadsheet takes for a formula."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import iso, number_text

#: What a spreadsheet takes for a formula (white space that it skips, then a sign; a space is not skipped),
#: and what is a number as a whole.
SKIPPED = "\t\r\n\v\f"
SIGNS = "=+-@"
LEAD = r"\A[\t\r\n\x0B\f]*[=+\-@]"
NUMBER = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
#: Series that one wide table may have as columns.
MOST_SERIES = 10_000


def neutral(cell: Column) -> Column:
    """The cell with a leading ' where it could be read as a formula; numbers stay."""
    return F.when(cell.rlike(LEAD) & ~cell.rlike(NUMBER), F.concat(F.lit("'"), cell)).otherwise(cell)


def neutralize_cells(df: DataFrame) -> DataFrame:
    """All text columns, and their headers, neutralised."""
    out = []
    for name, kind in df.dtypes:
        head = f"'{name}" if name.lstrip(SKIPPED).startswith(tuple(SIGNS)) else name
        own = F.col(f"`{name}`")
        out.append((neutral(own) if kind == "string" else own).alias(head))
    return df.select(*out)


def column_names(series: list[tuple[str, dict]]) -> list[str]:
    """A header for each series, all distinct: its labels in order, or its ref; of equal ones the later are numbered."""
    heads: dict[str, None] = {}
    for ref, labels in series:
        plain = ",".join(f"{k}={v}" for k, v in sorted((labels or {}).items())) or ref
        numbered = (f"{plain} ({n})" for n in itertools.count(2))
        heads[next(h for h in itertools.chain([plain], numbered) if h not in heads)] = None
    return list(heads)


def wide(samples: DataFrame) -> DataFrame:
    """timestamp (ISO) and one text column for each series of `samples`, over the union of their times, in order.

    The series are collected to name the columns, as a table's columns are always known to the driver; more than
    `MOST_SERIES` are an error, and belong in one file for each (`export_frames`).
    """
    heads = samples.groupBy("series_key").agg(F.first("ref_id").alias("ref_id"), F.first("labels").alias("labels"))
    heads = heads.orderBy("series_key").limit(MOST_SERIES + 1).collect()
    if len(heads) > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series can't be columns of one table; export a file for each")
    names = column_names([(h.ref_id, h.labels) for h in heads])
    pivot = samples.groupBy("t").pivot("series_key", [h.series_key for h in heads]).agg(F.first("v"))
    columns = [number_text(F.col(f"`{h.series_key}`")).alias(n) for h, n in zip(heads, names, strict=True)]
    return pivot.orderBy("t").select(iso(F.col("t")).alias("timestamp"), *columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Neutralised cells, CRLF between lines, null as empty, a header in every file."""
    neutralize_cells(df).write.option("header", True).option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def export_wide_csv(samples: DataFrame, path: str) -> None:
    write_csv(wide(samples), path)


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """RFC 4180 documents, with line breaks in quotes."""
    return spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def frame_suffixes(frames: DataFrame, *keys: str) -> DataFrame:
    """`suffix` of each frame of each of `keys`: its ref_id, and a number where that repeats; one row for each frame."""
    one = frames.select(*keys, "ref_id", "frame").distinct()
    same = Window.partitionBy(*keys, "ref_id")
    n = F.row_number().over(same.orderBy("frame"))
    return one.withColumn("suffix", F.when(F.count(F.lit(1)).over(same) > 1, F.concat_ws("-", "ref_id", n.cast("string"))).otherwise(F.col("ref_id")))


def export_frames(rows: DataFrame, path: str, *keys: str) -> None:
    """One folder of CSV files for each frame, named by its suffix; cells are text in the order of the schema."""
    width = rows.agg(F.max(F.size("cells")).alias("w")).first().w or 0
    suffixed = rows.join(frame_suffixes(rows, *keys), [*keys, "ref_id", "frame"])
    cells = [neutral(F.get("cells", F.lit(i))).alias(f"c{i}") for i in range(width)]
    suffixed.sortWithinPartitions("suffix", "row").select("suffix", *cells).write.partitionBy("suffix").option("lineSep", "\r\n").csv(path)
