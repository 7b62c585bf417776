"""Exact deduplication as a stream with keyed state on disk.

A streaming aggregation keyed by the digest of the text keeps, in a RocksDB state store and without expiry, the stable
identifier and the content locator (file and row) of the row that stays, and the size of the group. Map-side partial
aggregation shrinks a hot digest before the shuffle. Equal digests are only hits: a batch pass reads the keeper's text by
its locator and compares all bytes of every hit; texts that differ under one digest are regrouped by their bytes. Which rows
are copies, keepers or stay is a bit for each row of a file, so only the texts of copies are ever shuffled.

Results for odd inputs: null texts count as empty and equal each other; a null doc_id is smaller than any other; of rows
that repeat both doc_id and text one stays (the last by file and row); an empty table gives an empty result; columns
other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.shared import own_names, picked, scratch, spread_join, written

#: State on disk, as changes since the last snapshot; without files allocated ahead, which weigh more than small stores hold.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
STATE = "digest string, keeper struct<doc_id: bigint, file: string, row: bigint>, group_size bigint"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(reader, path: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Each row of the files with the digest of its text and its locator; `reader` is spark.read or spark.readStream."""
    rows = reader.schema("doc_id bigint, text string").parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def keeper_state(spark: SparkSession, path: str, state_dir: str, files_per_trigger: int = 10_000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream over all files of `path` that `state_dir` has not seen; one row per digest seen so far.

    A later call with the same `state_dir` takes new files only and updates their groups.
    """
    path = path.rstrip("/")
    # the settings of the stream are those of a session of its own
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in ROCKSDB.items():
        own.conf.set(k, v)
    # as a pattern, which names the same path: the stream source takes a single file only so
    stream = located(own.readStream.option("maxFilesPerTrigger", files_per_trigger), f"{path[:-1]}[{path[-1]}]", digest)
    groups = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    query = (
        groups.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{state_dir}/updates/batch={n}"))
        .option("checkpointLocation", f"{state_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], STATE)
    updates = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(f"{state_dir}/updates")
    # a group only grows, so its largest row is the latest
    last = updates.groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("last"))
    return last.select("digest", "last.keeper", "last.group_size")


def exact_groups(spark: SparkSession, path: str, state_dir: str | None = None, files_per_trigger: int = 10_000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of the parquet files at `path`: doc_id, file, row, digest, keep_id, group_size, kept."""
    state = keeper_state(spark, path, state_dir or scratch(spark, "dedup-state"), files_per_trigger, digest)
    state = written(state, "dedup-keepers")
    rows = located(spark.read, path, digest)
    found = written(spread_join(rows.drop("text"), state, "digest", "group_size", "file", "row", how="inner"), "dedup-found")
    hits = found.where("group_size > 1").select("file", "row", "keeper")
    stays = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    # texts that are alone in their group stay where they are; copies alone meet their keeper's text
    first = picked(rows, hits.where(stays), "file", "row")[0].select("digest", F.col("text").alias("keeper_text"))
    known = written(state.where("group_size > 1").select("digest", "group_size").join(first, "digest"), "dedup-known")
    copies = picked(rows, hits, "file", "row")[0]
    met = spread_join(copies, known, "digest", "group_size", "file", "row", how="inner")
    clash = written(met.where(F.col("text") != F.col("keeper_text")).select("digest").distinct(), "dedup-clashes")
    if not clash.isEmpty():
        found = _by_bytes(rows, found, clash)
    return found.select("doc_id", "file", "row", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size", stays.alias("kept"))


def _by_bytes(rows: DataFrame, found: DataFrame, clash: DataFrame) -> DataFrame:
    """Groups under digests that different texts share, by the texts themselves."""
    members = rows.join(clash, "digest", "left_semi")
    groups = members.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    apart = members.join(groups, ["digest", "text"]).select("doc_id", "file", "row", "digest", "keeper", "group_size")
    return found.join(clash, "digest", "left_anti").unionByName(apart)


def land(docs: DataFrame) -> str:
    """Write `docs` to the shared folder; the stream and the byte check both read that copy.

    Columns other than doc_id and text are named by their places, so that no name of theirs matters.
    """
    path = scratch(docs.sparkSession, "dedup-landed")
    docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own_names(docs), strict=True)]).write.option("compression", "zstd").parquet(path)
    return path


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    spark = docs.sparkSession
    path = land(docs)
    kept = exact_groups(spark, path).where("kept").select(F.col("file").alias("at_file"), F.col("row").alias("at_row"))
    fields = [T.StructField(n, f.dataType) for n, f in zip(own_names(docs), docs.schema.fields, strict=True)]
    back = spark.read.schema(T.StructType(fields)).parquet(path)
    rows = back.select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    stay = picked(rows, kept, "at_file", "at_row")[0]
    return stay.select(*[F.col(n).alias(c) for n, c in zip(own_names(docs), docs.columns, strict=True)])
