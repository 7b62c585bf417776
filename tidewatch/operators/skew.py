"""Joins whose hot keys are dealt over many tasks.

A key is hot when it has more than one in `HOT` of a side's rows, and over `HOT_ROWS`; so hot keys are few, and their list is
broadcast. Other keys are joined as ever.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys that a side can have at most, and rows that a key must exceed to be one.
HOT, HOT_ROWS = 20_000, 10_000
#: Tasks that the pairs of a join are dealt over at most.
MOST_TASKS = 4_000


def _parts(counts: DataFrame, n: str, most: int = HOT_ROWS) -> Column:
    """Into how many parts a key's rows are dealt, `most` of them to a part."""
    total = counts.agg(F.sum(n)).first()[0] or 0  # one row
    return F.greatest(F.ceil(F.col(n) / F.lit(max(most, total / HOT))).cast("int"), F.lit(1))


def _spread(rows: DataFrame) -> Column:
    """A number of the row that a task run again gives again; like rows differ where they lie in different partitions.

    Columns with maps, which have no hash, don't take part.
    """
    known = [F.col(f"`{f.name}`") for f in rows.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(F.spark_partition_id(), *known)


def _dealt(rows: DataFrame, hot: DataFrame, keys: Sequence[str], own: str, other: str) -> DataFrame:
    """Rows of hot keys with a part of their own side, once for each part of the other side."""
    found = rows.join(F.broadcast(hot), list(keys), "left")
    mine = F.coalesce(F.pmod(_spread(rows), F.col(own)), F.lit(0)).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return found.withColumn("_mine", mine).withColumn("_theirs", theirs).drop(own, other).withColumnsRenamed({"_mine": own, "_theirs": other})


def grid(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """The inner join of two sides that may both have many rows of a key, with each pair's cell: `_line` and `_column`.

    A hot key's rows are dealt over a grid: a row of the left goes to one line of it and a row of the right to one column,
    so each pair meets in one cell, and no task has more than a cell. Both sides are read twice. With `most`, for pairs that are
    far more than the rows, a cell has so many rows of a side, and there are tasks by the number of pairs and not of rows.
    """
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lines = a.withColumn("_line", _parts(a, "_n", most or HOT_ROWS)).where("_line > 1").drop("_n")
    columns = b.withColumn("_column", _parts(b, "_n", most or HOT_ROWS)).where("_column > 1").drop("_n")
    hot = lines.join(columns, keys, "full").select(*keys, F.coalesce("_line", F.lit(1)).alias("_line"), F.coalesce("_column", F.lit(1)).alias("_column"))
    cell = [*keys, "_line", "_column"]
    lined, columned = _dealt(left, hot, keys, "_line", "_column"), _dealt(right, hot, keys, "_column", "_line")
    if most is not None:
        met = a.join(b.withColumnRenamed("_n", "_m"), keys).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0  # one row
        tasks = int(min(max(met / most**2, 1), MOST_TASKS))
        lined, columned = lined.repartition(tasks, *cell).hint("merge"), columned.repartition(tasks, *cell)
    return lined.join(columned, cell)


def pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid(left, right, keys).drop("_line", "_column")


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str, how: str = "inner", same: Column | None = None) -> DataFrame:
    """`rows` joined to a table with few rows of each key (one, but for keys that stand for others) and their number in `rows`.

    `n` is the table's column with the rows of a key; it is dropped. `same` is a condition besides the keys. A hot key's rows are dealt over
    parts, and its row of the table is repeated for each. The table is read several times, so give a stored one.
    """
    keys = list(keys)
    sizes = table.groupBy(*keys).agg(F.sum(n).alias("_n"))
    hot = sizes.withColumn("_part", _parts(sizes, "_n")).where("_part > 1").drop("_n").withColumn("_one", F.lit(1))
    dealt = _dealt(rows, hot, keys, "_part", "_one").drop("_one")
    repeated = table.drop(n).join(F.broadcast(hot.drop("_one")), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_part", F.lit(1)) - 1)))
    if same is None:
        return dealt.join(repeated, [*keys, "_part"], how).drop("_part")
    on = same & (dealt["_part"] == repeated["_part"])
    for k in keys:
        on = on & (dealt[k] == repeated[k])
    joined = dealt.join(repeated, on, how)
    for k in [*keys, "_part"]:
        joined = joined.drop(repeated[k])
    return joined.drop("_part")
