"""Best-fit packing planned over a histogram of lengths.

Each document becomes token ids with `END` at its end; only longer ones are cut, into pieces of `LENGTH` tokens, of which the
first may be shorter. Pieces are counted by length, and best fit in falling order of lengths is planned over these counts:
sequences of like contents are one group, a range of numbers with the room that is left, and all pieces of a length enter
groups by their number, so the plan takes time and space by the lengths there are, not by the documents. It comes out as one
document-wise best fit would have it, number of sequences included. A piece takes its slot by a join of its length and its
rank among the pieces of that length.

Ranks need no sort: a task numbers its pieces of each length as it makes them, and sums over tasks of the counts of a
length, one row a task, give what comes before. A length that most pieces have is ranked by all tasks that have it.

Results for odd inputs: null and empty texts are documents of the single id `END`; rows repeated or with a null doc_id are
packed row by row; texts of any length are packed whole; an empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.packing import encoder, id_type
from tidewatch.llm.shared import texts, written

LENGTH = 1024
END = 2
#: Tokens after which a task's pieces are passed on.
AT_ONCE = 1 << 20
PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, ids_crc32 bigint, part int, k bigint"


class Slots(NamedTuple):
    """Pieces of one length from a rank on: `each` of them in each of `bins` sequences in a row, from a place in these on."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], length: int = LENGTH) -> list[Slots]:
    """Best fit in falling order of lengths: a piece goes where the least room is left of what takes it."""
    out: list[Slots] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first sequence, number of sequences) by the room left
    opened = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        # what one length leaves is less than that length, so no group comes up twice
        for free in [r for r in sorted(room) if r >= size] + [length]:
            each = free // size
            while left and (free == length or room[free]):
                if room[free]:
                    first, n = room[free].pop()
                else:
                    first, n = opened, -(-left // each)
                    opened += n
                full = min(n, left // each)
                if full:
                    out.append(Slots(size, rank, full, each, first, length - free))
                    room[free - each * size].append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n and left:  # fewer than `each`
                    out.append(Slots(size, rank, 1, left, first + full, length - free))
                    room[free - left * size].append((first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    room[free].append((first + full, n - full))
    return out


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of documents, numbered by `k` among those of their length in the task `part`."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, part = encoder(path), id_type(path), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        rows: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py())
                ids.append(end)
                whole = np.array(ids, "<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                for at, (a, b) in enumerate(pairwise(cuts)):
                    rows.append((doc_id, at, a, b - a, whole[a:b].astype(kind).tobytes(), zlib.crc32(whole[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
                held += len(ids)
                if held >= AT_ONCE:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return texts(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (as `id_type` says), ids_crc32 (as 32-bit ids), sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, length, end), "bestfit-pieces")
    # one row for each task and length
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "bestfit-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `length` rows at most
    slots = spark.createDataFrame(plan(histogram, length), "length int, rank bigint, bins bigint, each bigint, sequence bigint, first bigint")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = cut.join(counts.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("own", F.col("before") + F.col("k")).drop("before", "k", "part")
    # the plan's size is bounded by `length`, whatever the input
    within = (F.col("own") >= F.col("rank")) & (F.col("own") < F.col("rank") + F.col("bins") * F.col("each"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & within)
    nth = F.col("own") - F.col("rank")
    sequence, offset = F.col("sequence") + F.expr("(own - rank) div each"), F.col("first") + nth % F.col("each") * F.col("length")
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
