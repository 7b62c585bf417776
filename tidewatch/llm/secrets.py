"""Secret scans over an incremental blob ledger.

The ledger is a table in the shared folder with one row for each blob (content address: SHA-256 of the text) and version of
the rules that has ever been scanned, with the spans found, or none. A run content-addresses every document version it is
given, keeps one copy of each blob, scans only pairs of blob and rule version that the ledger lacks, adds them in a folder of
its own, and joins the findings back to every document with that content. The version of the rules is a digest of the rules
themselves, so changed rules never meet old findings. Runs at the same time don't share a folder to write to; a pair that
both scan is there twice and counts once. A blob that the ledger should have and lacks is an error, never a clean text.

Give `ledger`, or set `LEDGER_CONF` in the session, to a folder that later runs use again; else each run has its own.

Every rule is tried at most a few times for each character: a run of characters that a rule may span is entered at its
beginning only, or is bounded in length.

Of a blob's copies one is picked by map-side partial aggregation, so a blob with very many copies is never gathered; rows of a
stored table are picked by their places, and their texts stay where they are. The
join back to documents moves identifiers and digests, not texts, and deals a blob with very many copies over tasks.

Results for odd inputs: null counts as empty and has no findings; texts of any length are scanned whole; documents that
repeat, or have a null doc_id, get their findings row by row; an empty table gives an empty result and leaves the ledger as
it is; columns other than doc_id and text are read only where the caller names them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.shared import own_names, picked, placed, scratch, spread_join, written

#: The base rules, in the order in which kinds are listed; pattern, group that holds the value, its least length.
BASE_RULES = (
    ("assign", r"(?ai:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds, with well-known prefixes or frames; white space and letters are those of ASCII.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 30),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 20),
    ("userinfo", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@", 0, 10),
)
RULES = BASE_RULES + MORE_RULES
KINDS = [r[0] for r in RULES]
SPANS = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
#: Setting of the session that names a folder for the ledger of all runs.
LEDGER_CONF = "spark.tidewatch.secrets.ledger"


def version_of(rules=RULES) -> str:
    """A digest of the rules: their kinds, patterns, groups, least lengths and order."""
    return hashlib.sha256(repr(tuple(tuple(r) for r in rules)).encode()).hexdigest()[:16]


def scan(text: str, rules=RULES) -> list[dict]:
    """Spans in code points by start, then by the order of the rules; leftmost and not overlapping within a kind."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blob() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame | None:
    """The rows of all runs that are done; None where there was none."""
    try:
        return docs.sparkSession.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def extend_ledger(docs: DataFrame, ledger: str, rules=RULES, stored: bool = False) -> None:
    """Scan the blobs of `docs` that the ledger at `ledger` lacks for this version of the rules, and add them as a run of their own.

    Where `docs` is `stored`, a table with the columns `part` and `place` (`placed`), texts are scanned where they lie; else the copies that are picked are shuffled.
    """
    rule_version = version_of(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    one = F.min(F.struct("part", "place")).alias("one") if stored else F.first(text).alias("text")
    blobs = docs.groupBy(blob().alias("blob")).agg(one)
    seen = read_ledger(docs, ledger)
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    if stored:
        blobs = picked(docs, blobs.select("one.part", "one.place"), "part", "place")[0].select(blob().alias("blob"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = pa.array([scan(t.as_py(), rules) for t in batch.column("text")], kind)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.repeat(rule_version, len(batch)), spans], names=["blob", "rule_version", "spans"])

    blobs.mapInArrow(run, LEDGER).write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")


def findings(docs: DataFrame, ledger: str | None = None, keep: Sequence[str] = (), rules=RULES, stored: bool = False) -> DataFrame:
    """doc_id, blob, spans and the columns in `keep` (as keep_0, keep_1 ...) for every row of `docs`, by way of the ledger.

    `stored` is that of `extend_ledger`.
    """
    ledger = ledger or docs.sparkSession.conf.get(LEDGER_CONF, None) or scratch(docs.sparkSession, "secret-ledger")
    extend_ledger(docs, ledger, rules, stored)
    known = read_ledger(docs, ledger).where(F.col("rule_version") == version_of(rules)).groupBy("blob").agg(F.first("spans").alias("spans"))
    copies = docs.groupBy(blob().alias("blob")).agg(F.count(F.lit(1)).alias("n"))
    # every blob has a row, with spans or none
    scanned = F.assert_true(F.col("spans").isNotNull(), "the ledger lacks a blob that was scanned").isNull()
    known = written(copies.join(known, "blob", "left").where(scanned), "secret-blobs")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob().alias("blob"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    # copies of one blob without ids are told apart by where they lie
    rows = rows.withColumn("lies", F.spark_partition_id())
    joined = spread_join(rows, known.where(F.size("spans") > 0), "blob", "n", "doc_id", "lies").drop("n", "lies")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def span_text(kinds: Sequence[str]) -> Column:
    """kind:start:end of the spans of `kinds`, joined by commas."""
    some = F.filter("spans", lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str, spans: str) -> str:
    """`text` with every span of `span_text`, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind.upper()}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with their spans replaced; null texts, of rows without a span, stay null."""
    return pd.Series([None if t is None else redact(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def without_secrets(docs: DataFrame, ledger: str | None = None, stored: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, with secrets in `text` replaced (and `n_chars` to match, where there is one).

    Where `docs` is a plain read of `stored` Parquet files, its rows are picked from these; else from a copy.
    """
    at = dict(zip(docs.columns, own_names(docs), strict=True))
    rows = placed(docs, "secret-rows", stored)
    found = findings(rows, ledger, ["part", "place"], stored=True).where(F.size("spans") > 0)
    found = written(found.select(F.col("keep_0").alias("part"), F.col("keep_1").alias("place"), "spans"), "secret-found")
    # only texts with secrets are shuffled, and go through Python
    dirty, clean = picked(rows, found, "part", "place")
    dirty = dirty.join(found, ["part", "place"]).withColumn("text", redacted("text", span_text(KINDS)))
    if "n_chars" in at:
        dirty = dirty.withColumn(at["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    both = clean.select(*at.values()).unionByName(dirty.select(*at.values()))
    return both.select(*[F.col(n).alias(c) for c, n in at.items()])
