"""WARC archives: writing, normalising a monolithic gzip stream into one member for each record, and reading by index.

Spark's text sink writes each partition's records as gzip streams of at most `ARCHIVE_BYTES` of content each (or one record,
where that is larger), counted record by record, through whatever file system the path names and under its commit protocol. The normaliser inflates each such file once, piece by piece, cuts
the stream at the records' declared lengths, and rewrites every record as a gzip member of its own; each member's offset and
length, known as it is made, go to a sidecar index, so a record is later read alone. Of pages with equal payloads the one
with the largest page_id is a response and the others are revisits that refer to it; their records hold the HTTP header
(with the payload's length) and no payload. Payloads are equal if their SHA-256 and their lengths are.

The text sink ends each row with a fixed separator, which a gzip file can't hold between members. A member's last byte is
the high byte of its length and zero below 16 MiB; so the separator is a zero byte, and rows leave theirs to it. A larger
record is followed by an empty member, which ends in zero too.

Results for odd inputs: null html is an empty payload; payloads below `least` bytes are all responses; a null or empty url
becomes a urn of the page_id, and white space and control characters in a url are percent-coded; a null page_id is smaller
than any other, and pages equal in page_id and payload are responses both; an empty table gives no archive; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.shared import scratch, spread_join, written

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
#: Content of an archive at most, with headers, and repeated payloads up to which their table is broadcast.
ARCHIVE_BYTES = 32 << 20
BROADCAST_REPEATED = 50_000
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
INDEX = "archive string, record int, offset bigint, length bigint, record_id string"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def judged(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (never null), hex (SHA-1), record_type and refers_to for every row of `pages`."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = F.when(F.octet_length("html") >= least, F.concat_ws(":", F.sha2("html", 256), F.octet_length("html")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("own", own)
    # digests alone are grouped; a page that is the only one with its payload needs no row of the join
    first = rows.where("own is not null").groupBy("own").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = written(first.where("n > 1"), "warc-repeated")
    if repeated.count() <= BROADCAST_REPEATED:  # some 5 MB; pages stay where they are
        joined = rows.join(F.broadcast(repeated), "own", "left")
    else:
        joined = spread_join(rows, repeated, "own", "n", "page_id", "url")
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("hex"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One WARC record as text for each row of `pages`, without the empty lines that end it."""
    rows = judged(pages, least).withColumn("digest", base32_sha1_of_hex(F.col("hex")))
    coded = F.col("url")
    for c in ["%25", *(f"%{i:02X}" for i in (*range(33), 127))]:
        char = chr(int(c[1:], 16))
        coded = coded if char == "%" else F.replace(coded, F.lit(char), F.lit(c))
    uri = F.when(F.coalesce(F.length("url"), F.lit(0)) > 0, coded).otherwise(F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    again = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.octet_length("html").cast("string"), F.lit(CRLF * 2), F.when(again, "").otherwise(F.col("html")))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    # concat_ws leaves out what is null
    return rows.withColumn("block", block).select(F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), F.col("block")).alias("record"))


def base32_sha1_of_hex(hexes: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hex digits."""

    def five(i: int) -> Column:
        first, shift = divmod(5 * i, 4)
        pair = F.conv(F.substring(F.concat(hexes, F.lit("0")), first + 1, 2), 16, 10).cast("int")
        return F.substring(F.lit(_BASE32), F.shiftright(pair, 3 - shift).bitwiseAND(31) + 1, F.lit(1))

    return F.concat(*[five(i) for i in range(32)])


def numbered(archive_bytes: int) -> Column:
    """The archive of a record of `size` bytes within its task: the next one where the record would exceed the bound.

    Only sizes go through Python, in the order of the rows, with the count so far kept over a task's batches.
    """

    @F.pandas_udf(T.LongType())
    def number(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, held = 0, 0
        for batch in sizes:
            out = []
            for size in batch:
                if held and held + size > archive_bytes:
                    at, held = at + 1, 0
                held += size
                out.append(at)
            yield pd.Series(out, dtype="int64")

    return number(F.octet_length("record").cast("long") + 4)


def write_monolithic(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of `pages` under `path`, each file one gzip stream over all its records."""
    rows = records(pages, least).withColumn("n", numbered(archive_bytes))
    part = F.concat_ws("-", F.spark_partition_id(), "n")
    rows.select(F.col("record").alias("value"), part.alias("archive")).write.partitionBy("archive").option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


def split(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records, with the empty lines that end them, of an inflated stream that comes in pieces."""
    held = bytearray()
    for piece in stream:
        held += piece
        while True:
            head = held.find(b"\r\n\r\n")
            if head < 0:
                break
            size = next(int(x[15:]) for x in bytes(held[:head]).split(b"\r\n") if x[:15].lower() == b"content-length:")
            end = head + 4 + size + 4
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError(f"{len(held)} bytes follow the last whole record")


def inflate(data: bytes, step: int = 1 << 16, most: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in pieces of at most `most` bytes."""
    whole, at = memoryview(data), 0
    while at < len(whole):
        engine = zlib.decompressobj(31)
        while not engine.eof:
            if at == len(whole):
                raise ValueError("the stream ends within a member")
            held = whole[at : at + step]
            at += len(held)
            while held and not engine.eof:
                yield engine.decompress(held, most)
                held = engine.unconsumed_tail
        at -= len(engine.unused_data)


def header(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record by their names in lower case, and its block."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = (x.partition(":") for x in head.decode().split(CRLF)[1:])
    return {k.lower(): v.strip() for k, _, v in fields}, block[:-4]


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each gzip file under `source` as an archive with a member for each record, under `target`/archives.

    Returns the index, which is written to `target`/index. A file is inflated once, in one task, and stays one file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source)
    # a task writes one file of each of its archives
    files = files.select(F.regexp_extract("path", "archive=([^/]+)/", 1).alias("archive"), "content")
    names = ["archive", "record", "offset", "length", "record_id", "member"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, held, offset = [], 0, 0
                for n, record in enumerate(split(inflate(content.as_py()))):
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = press.compress(record) + press.flush()
                    row = member if member[-1] == 0 else member + EMPTY_MEMBER
                    rows.append((name, n, offset, len(member), header(record)[0]["warc-record-id"], row[:-1]))
                    offset += len(row)
                    held += len(row)
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    # members are kept while archives and index are written from them
    members = files.mapInArrow(run, f"{INDEX}, member binary").persist(StorageLevel.DISK_ONLY)
    try:
        bodies = members.sortWithinPartitions("archive", "record").select("archive", F.col("member").cast("string").alias("value"))
        bodies.write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", "\0").text(f"{target}/archives")
        members.drop("member").write.parquet(f"{target}/index")
    finally:
        members.unpersist()
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def archives(spark: SparkSession, target: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{target}/archives")
    return files.select(F.regexp_extract("path", "archive=([^/]+)/", 1).alias("archive"), "content")


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Every record of the archives under `target`, by its place in the index.

    page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to. The digest of a
    response is computed from what was read.
    """
    index = spark.read.schema(INDEX).parquet(f"{target}/index")
    # an archive's bytes, headers with them, are bounded, and so are its records, whose places are in one row
    places = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("record", "offset", "length"))).alias("places"))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page(name: str | None) -> int | None:
        number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
        return None if number in ("", "null") else int(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, spots in zip(batch.column("content"), batch.column("places").to_pylist(), strict=True):
                whole = memoryview(content.as_buffer())
                for i in range(0, len(spots), 200):
                    rows = []
                    for s in spots[i : i + 200]:
                        fields, block = header(zlib.decompress(whole[s["offset"] : s["offset"] + s["length"]], 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        again = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:") if again else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        rows.append((page(fields["warc-record-id"]), fields["warc-target-uri"], None if again else payload, size, digest, fields["warc-type"], page(fields.get("warc-refers-to"))))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return archives(spark, target).join(places, "archive").mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write `pages` as archives in the shared folder, normalise them, and read every record back."""
    spark = pages.sparkSession
    source, target = scratch(spark, "warc-monolithic"), scratch(spark, "warc")
    write_monolithic(pages, source, least)
    normalise(spark, source, target)
    return read_records(spark, target)
