"""Ranked lexical search by presence masks.

A first pass over the documents keeps, for blocks of them, only what items can meet: for each of the items' terms the
documents of the block that hold it and how often, and each document's number of terms. Document frequencies and corpus
sums come from these postings. A second pass ranks within a block: the bitmaps of an item's terms give each document its mask of
matched terms, documents are grouped by mask, and a mask's maximum is what its terms reach at best in the block. Masks are
evaluated by falling maximum until no mask that is left can reach the item's last place in the task's list; ties go on, as a
smaller id may win. Each task keeps a list of `k` rows an item, and these lists are ranked in two steps, over groups of
tasks first, so that no task gets a row of every task of the input.

Items are a stated set of queries. They are read one partition at a time and taken in blocks of bounded size, each of which
takes both passes; what goes to tasks is one block's terms.

Results for odd inputs: null and empty texts, of documents or items, have no terms; documents without terms are counted
nowhere; rows with the same id, of documents or items, are rows of their own; a null doc_id ranks after the others among equal
scores; texts of any length count whole; an empty table, of documents or items, gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import packed, unpacked
from tidewatch.llm.shared import texts, written

TOP = 20
#: Every byte as itself or, ASCII capitals, in lower case, and what isn't part of a term as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text in a block of documents; bytes of a text that are split at once; items and bytes of text in a block of items.
BLOCK_BYTES, PART_BYTES, ITEMS, ITEM_BYTES = 8 << 20, 4 << 20, 2_000, 4 << 20
#: Masks evaluated before the bound is looked at again, and tasks whose lists are ranked together first.
MASKS, TASKS = 64, 256
NO_ID = np.iinfo(np.int64).max
BLOCKS = "n_docs bigint, n_terms bigint, ids binary, lengths binary, terms binary, counts binary, docs binary, tfs binary"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PART_BYTES) if at + PART_BYTES < len(folded) else -1
        yield folded[at : end if end >= 0 else len(folded)].split()
        at = end if end >= 0 else len(folded)


def occurrences(text: bytes) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for terms in term_lists(text):
        found.update(terms)
    return found


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter[bytes]]]]:
    """Items with their terms, in blocks; the driver holds one block and one partition of the table."""
    block: list[tuple[int | None, Counter[bytes]]] = []
    size = 0
    for row in items.toLocalIterator():
        block.append((row.item_id, occurrences((row.text or "").encode())))
        size += len(row.text or "")
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int], block_bytes: int) -> DataFrame:
    """Blocks of documents as `BLOCKS` says: ids and numbers of terms of its documents, and of each term met the documents and counts."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def block(ids: list[int | None], lengths: list[int], terms: list[int], at: list[int], tfs: list[int]) -> pa.RecordBatch:
        term, doc = np.array(terms, np.int64), np.array(at, np.int64)
        order = np.argsort(term, kind="stable")
        met, counts = np.unique(term, return_counts=True)
        long = np.array(lengths, np.uint64)
        row = [
            int((long > 0).sum()), int(long.sum()), np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(), long.astype("<u8").tobytes(),
            packed(met), packed(counts), packed(doc[order]), packed(np.array(tfs, np.int64)[order]),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i > 1 else pa.int64()) for i, v in enumerate(row)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, lists = 0, ([], [], [], [], [])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                ids, lengths, terms, at, tfs = lists
                data = text.as_py()
                found = occurrences(data)
                for term, tf in found.items():
                    i = vocabulary.get(term)
                    if i is not None:
                        terms.append(i)
                        at.append(len(ids))
                        tfs.append(tf)
                ids.append(doc_id)
                lengths.append(sum(found.values()))
                size += len(data)
                if size >= block_bytes or len(ids) >= 1 << 16:
                    yield block(*lists)
                    size, lists = 0, ([], [], [], [], [])
        if lists[0]:
            yield block(*lists)

    return texts(docs).mapInArrow(run, BLOCKS)


def frequencies(blocks: DataFrame, n: int) -> np.ndarray:
    """The number of documents that hold each of `n` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                df[unpacked(terms.as_py())] += unpacked(counts.as_py())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], names=["term", "df"])

    out = np.zeros(n, np.int64)
    for r in blocks.select("terms", "counts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term
        out[r.term] = r.df
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tfs: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of that many terms, before the term's weight."""
    if len(lengths) and 25 * int(lengths.max()) * n >= 1 << 63:
        lengths = lengths.astype(object)
    m = (75 + 25 * lengths * n // max(total, 1)).astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * m)


class Best:
    """The `k` best (score, doc_id) rows of an item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The score that a row must reach to enter the list."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def rank_block(best: Best, terms: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray) -> int:
    """Enter a block's documents for one item; the number of masks evaluated.

    `terms` has for each of the item's terms in the block its documents (ascending), what they get for it, and the most of these.
    """
    masks = np.zeros((len(ids), -(-len(terms) // 64)), np.uint64)
    for j, (docs, _, _) in enumerate(terms):
        masks[docs, j >> 6] |= np.uint64(1 << (j & 63))
    held = np.flatnonzero(masks.any(axis=1))
    if masks.shape[1] == 1:
        distinct, of = np.unique(masks[held, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, of = np.unique(masks[held], axis=0, return_inverse=True)
        of = of.ravel()
    bits = np.unpackbits(distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(terms)]
    most = bits.astype(np.int64) @ np.array([t[2] for t in terms], np.int64)
    falling = np.argsort(-most, kind="stable")
    grouped = held[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of, minlength=len(distinct)))
    starts = np.concatenate([[0], ends[:-1]])
    for i in range(0, len(falling), MASKS):
        some = falling[i : i + MASKS]
        some = some[most[some] >= best.least()]
        if not len(some):
            return i
        docs = np.sort(np.concatenate([grouped[starts[m] : ends[m]] for m in some]))
        scores = np.zeros(len(docs), np.int64)
        for j in np.flatnonzero(bits[some].any(axis=0)):
            have, worth, _ = terms[j]
            at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
            scores += np.where(have[at] == docs, worth[at], 0)
        enough = scores >= best.least()
        best.add(scores[enough], ids[docs[enough]])
    return len(falling)


def ranked(blocks: DataFrame, items: list[list[tuple[int, int]]], n: int, total: int, k: int) -> DataFrame:
    """item (its place in the list), doc_id and score: the `k` best rows of each task.

    An item is its terms with their factors: weight times occurrences in the item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Best(k) for _ in items]
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "terms", "counts", "docs", "tfs")}
                ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<u8").astype(np.int64)
                met, docs = unpacked(row["terms"]), unpacked(row["docs"]).astype(np.int64)
                worth = impacts(unpacked(row["tfs"]).astype(np.int64), lengths[docs], n, total)
                ends = np.cumsum(unpacked(row["counts"]).astype(np.int64))
                of = {int(t): (docs[b - c : b], worth[b - c : b]) for t, b, c in zip(met, ends, np.diff(ends, prepend=0), strict=True)}
                peaks = {t: int(w.max()) for t, (_, w) in of.items()}
                for best, item in zip(lists, items, strict=True):
                    terms = [(of[t][0], of[t][1] * f, peaks[t] * f) for t, f in item if t in of and f]
                    if terms:
                        rank_block(best, terms, ids)
        sizes = [len(b.scores) for b in lists]
        ids = np.concatenate([b.ids for b in lists] or [np.zeros(0, np.int64)])
        columns = [
            pa.array(np.repeat(np.arange(len(lists)), sizes)), pa.array(ids, mask=ids == NO_ID),
            pa.array(np.concatenate([b.scores for b in lists] or [np.zeros(0, np.int64)])), pa.array(np.full(len(ids), TaskContext.get().partitionId() // TASKS)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score", "tasks"])

    found = blocks.select("ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, "item bigint, doc_id bigint, score bigint, tasks bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "tasks").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("tasks")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `k` best documents with a score above 0."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        blocks = written(postings(docs, vocabulary, block_bytes), "lexical-postings", "snappy")
        sums: Row = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
        weights = [weight(sums.n, int(df)) if df else 0 for df in frequencies(blocks, len(vocabulary))]
        known = [[(vocabulary[t], tf * weights[vocabulary[t]]) for t, tf in found.items()] for _, found in block]
        named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item bigint, item_id bigint")
        rows = ranked(blocks, known, sums.n, sums.total, k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        rows = written(rows, "lexical-ranks")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
