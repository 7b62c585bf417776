"""Substring deduplication over content-defined chunks.

A gear rolling hash over the bytes of each text marks a cut wherever its top bits are zero, so cuts depend on the last 16
bytes alone and an insertion moves only the chunks it touches. Chunks have `LEAST` to `MOST` bytes, but for the last. The
unit that is deduplicated is a variable run of chunks: from each chunk's beginning to the first end of a chunk that is
`SPAN` bytes or more away, so equal content gives equal units wherever it lies, and short chunks that are equal by chance
make none. Digests of units are grouped with map-side aggregation; a digest that occurs twice or more, in other documents
or in the same one, is repeated, and its least occurrence by doc_id, row and place is the original. Overlapping units of a
text that continue each other in one original too form one span, so a span's bytes are equal to those of its original.

A digest is 96 bits of BLAKE2b, and is taken as proof of equality. Digests of boilerplate, which very many texts have, are
dealt over several partitions (`spread_join`). The bytes of a passage before its first cut and after its last are not in
its span: some 35 on each side.

Results for odd inputs: null and empty texts, and texts below `SPAN` bytes, have no units and no spans; rows that repeat are
repetitions of each other whatever their doc_id; a null doc_id is smaller than any other; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.shared import spread_join, texts, written

#: Mean distance of possible cuts is 2 ** CUT_BITS bytes.
CUT_BITS = 5
LEAST, MOST = 8, 256
#: Bytes that a unit, and so a span, has at least.
SPAN = 64
DIGEST_BYTES = 12
#: Texts that a task takes at once.
TEXTS = 500
#: A hash has as many bits as its window has bytes: each byte shifts the older ones out by one.
WINDOW = 16
GEAR = np.random.default_rng(11).integers(0, 1 << WINDOW, 256, dtype=np.uint16)


def cuts(data: np.ndarray, cut_bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of a text's bytes."""
    # h[i] = GEAR[b[i]] + 2 h[i - 1] in 16 bits, by doubling the part of the window that is summed
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            shifted = h[:-k] << np.uint16(k)
            h = np.concatenate([h[:k], h[k:] + shifted])
    marks = np.flatnonzero(h >> np.uint16(WINDOW - cut_bits) == 0) + 1
    ends, last = [], 0
    for m in marks.tolist():
        if m - last < least:
            continue
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least:
            ends.append(m)
            last = m
    while len(data) - last > most:
        last += most
        ends.append(last)
    if len(data) > last:
        ends.append(len(data))
    return np.array(ends, np.int64)


def units(data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a text's bytes."""
    ends = cuts(data)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.searchsorted(ends, starts + span)
    whole = at < len(ends)
    return starts[whole], ends[at[whole]]


def digests(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """row, doc_id, start and size in bytes, digest: one row for each unit of `rows` (row, doc_id, text)."""
    rows = rows.select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    names = ["row", "doc_id", "start", "size", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                part = batch.slice(i, TEXTS)
                columns: list[list] = [[] for _ in names]
                for row, doc_id, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    text = text.as_py()
                    starts, ends = units(np.frombuffer(text, np.uint8), span)
                    own = [hashlib.blake2b(text[a:b], digest_size=DIGEST_BYTES).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for column, values in zip(columns, ([row] * len(own), [doc_id] * len(own), starts.tolist(), (ends - starts).tolist(), own), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "row bigint, doc_id bigint, start int, size int, digest binary")


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Spans of bytes that occur elsewhere as well: doc_id, start, end, first_doc_id, first_start, n_places.

    first_doc_id and first_start are the original's (the span's own, where it is the original), and n_places the most
    occurrences of a unit of the span.
    """
    return spans(texts(docs).withColumn("row", F.monotonically_increasing_id()), span).drop("row", "original")


def spans(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """The spans of `repeated` for `rows` (row, doc_id, text), with row and whether the span is the original."""
    every = written(digests(rows, span), "substring-units")
    shared = every.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = spread_join(every.select("digest", "row", "start", "size", "doc_id"), written(shared, "substring-shared"), "digest", "n", "row", "start", how="inner")
    unit = F.struct("start", "size", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start"), "n")
    # a text's units are at most its bytes over LEAST
    lists = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(unit)).alias("units"))
    names = ["row", "doc_id", "start", "end", "first_doc_id", "first_start", "n_places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            original: list[bool] = []
            for row, doc_id, own in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("units").to_pylist(), strict=True):
                before = None
                for u in own:
                    origin = u["first_row"], u["start"] - u["first_start"]
                    if origin == before and u["start"] <= out[-1][3]:
                        out[-1][3] = u["start"] + u["size"]
                        out[-1][6] = max(out[-1][6], u["n"])
                    else:
                        out.append([row, doc_id, u["start"], u["start"] + u["size"], u["first_doc_id"], u["first_start"], u["n"]])
                        original.append(origin == (row, 0))
                        before = origin
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))), pa.array(original, pa.bool_())], names=[*names, "original"])

    return lists.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", original boolean")


def cut_out(text: str, spans: str) -> str:
    """`text` without the spans of bytes, given as start:end joined by commas, in order; a character cut in two goes."""
    data, out, at = text.encode(), [], 0
    for span in spans.split(","):
        start, end = map(int, span.split(":"))
        out.append(data[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode(errors="ignore")


@F.pandas_udf(T.StringType())
def without(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_out(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of `docs`, all columns, with every span that repeats an original cut out of `text` (`n_chars` to match)."""
    columns = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(docs.columns)]
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "substring-rows")
    at = {c: F.col(f"keep_{i}") for i, c in enumerate(docs.columns)}
    found = spans(keyed.select("row", at["doc_id"].cast("long").alias("doc_id"), F.coalesce(at["text"], F.lit("")).alias("text")), span)
    lists = found.where("not original").groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = keyed.join(lists, F.col("row") == F.col("of"), "left")
    text_spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    joined = joined.withColumn("cut", without(F.when(F.col("of").isNotNull(), at["text"]), text_spans))
    text = F.when(F.col("of").isNotNull(), F.col("cut")).otherwise(at["text"])
    out = at | {"text": text}
    if "n_chars" in at:
        out["n_chars"] = F.when(F.col("of").isNotNull(), F.length(text)).otherwise(at["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[v.alias(c) for c, v in out.items()])
