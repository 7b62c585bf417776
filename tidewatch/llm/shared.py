"""Where the operators keep what one job writes and a later job reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary folder of our own only where that is unset and Spark runs locally."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of `df` as a table in the shared folder: the lineage ends here, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a bit for each (128 MB for all) is broadcast; of more rows, those that are picked are found by a shuffle.
MARKED = 1 << 30


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, with the columns `part` and `place`, by which `picked` tells its rows."""
    # Spark puts the partition above the lower 33 bits and counts a partition's rows in these
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(df.withColumns({"part": F.spark_partition_id(), "place": place}), name)


def picked(rows: DataFrame, chosen: DataFrame, part: str, place: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `rows` whose columns `part` and `place` are in `chosen`, and the others; no row is shuffled.

    A part's places are whole numbers from 0 without a gap, and `chosen` has places of `rows` only. A bit for each place, in one array for each
    part, is broadcast: a megabyte for 8 million rows. `rows` is read several times, so give a stored table.
    """
    at = [F.col(part).alias("_part"), F.col(place).alias("_place")]
    bits = rows.select(*at, F.lit(0).cast("long").alias("bit")).unionByName(chosen.select(*at).selectExpr("_part", "_place", "shiftleft(1L, int(_place % 64)) AS bit"))
    words = bits.groupBy("_part", F.expr("_place div 64").alias("word")).agg(F.bit_or("bit").alias("bits"))
    lists = words.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("list"), F.max("word").alias("last"))
    whole = F.assert_true(F.size("list") == F.col("last") + 1, "places of a part have gaps").isNull()
    marks = written(lists.where(whole).select("_part", F.col("list.bits").alias("_bits")), "marks")
    # one row
    if (marks.agg(F.sum(F.size("_bits").cast("long"))).first()[0] or 0) * 64 <= MARKED:
        here = (F.col(part) == F.col("_part")) & F.expr(f"getbit(get(_bits, int({place} div 64)), int({place} % 64)) = 1")
        return rows.join(F.broadcast(marks), here, "left_semi"), rows.join(F.broadcast(marks), here, "left_anti")
    here = (F.col(part) == F.col("_part")) & (F.col(place) == F.col("_place"))
    return rows.join(chosen.select(*at), here, "left_semi"), rows.join(chosen.select(*at), here, "left_anti")


def own_names(docs: DataFrame) -> list[str]:
    """Names for the columns of `docs` by their places, but for doc_id and text, so that no name of theirs matters."""
    return [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)]


def placed(docs: DataFrame, name: str, stored: bool) -> DataFrame:
    """`docs` with `own_names`, `part` and `place`: where it is a plain read of `stored` Parquet files by file and row, else as a copy by `numbered`."""
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own_names(docs), strict=True)]
    if stored:
        return docs.select(*own, F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("place"))
    return numbered(docs.select(*own), name)


#: Keys that may be called hot, and rows that a key must exceed to be.
HOT, HOT_ROWS = 50_000, 1_000


def spread_join(rows: DataFrame, table: DataFrame, on: str, n: str, *unique: str, how: str = "left") -> DataFrame:
    """`rows` joined to `table`, which has one row for each key, on the column `on`.

    `n` is the table's column with the number of rows of each key. A key with more than one in `HOT` of all rows is dealt
    over several partitions by the hash of the columns `unique`, and its row of the table is repeated for each; the list of
    these keys is broadcast, and there are fewer than `HOT` of them. `table` is read several times, so give a stored one.
    """
    total = table.agg(F.sum(n)).first()[0] or 0  # one row
    most = max(HOT_ROWS, total / HOT)
    parts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = table.where(F.col(n) > most).select(F.col(on).alias("_hot"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left").drop("_hot")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*unique), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated, [on, "_part"], how).drop("_part")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and the named columns; other columns of `docs` go, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
