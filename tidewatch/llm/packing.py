"""Packing along a space-filling curve.

Each document becomes token ids with id 0 at its end. Its ids are hashed into a vector of bucket counts, which is
projected to a few dimensions; the cell of that point on a Hilbert curve is the document's key. Documents in the order of
their keys form one stream, which is cut every `LENGTH` tokens, so neighbours on the curve share sequences and only the
last sequence is not full.

The order needs no heavy shuffle: keys and lengths alone are range-sorted (ties by doc_id and row, so copies with one key
spread over partitions), running sums within partitions and over the few partition totals give each document's place in
the stream, and the ids meet their places in one join on a unique row number.

Results for odd inputs: null and empty texts are documents of the single id 0; long documents are cut over sequences; rows
repeated or with a null doc_id are packed row by row; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import texts, written

LENGTH = 1024
END = 0
BUCKETS = 1024
DIMENSIONS = 3
BITS = 16
#: White space, and other characters, in one run that are more than tiktoken should be given.
SPACES, LETTERS = 100, 400


def long_runs(text: str) -> bool:
    """Whether `text` may hold a run that is too long for tiktoken."""
    lengths = [*map(len, text.split())]
    # white space beyond one character between words
    return len(text) - sum(lengths) - len(lengths) >= SPACES - 1 or max(lengths, default=0) >= LETTERS


@lru_cache(maxsize=2)
def encoder(path: str):
    """ids of a text by the byte-level vocabulary at `path`, as the tokenizers library gives them.

    Most texts are encoded by tiktoken from the same vocabulary, whose merges are in the order of its ids: the same ids for
    a fifth of the time. Its pattern matcher can't take very long runs of white space, nor its merging very long words;
    a text that may hold such a run is given to the tokenizers library whole.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        if len(text) >= SPACES and long_runs(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)

    return ids


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    """How ids of the vocabulary at `path` are stored: little-endian, in two bytes where all fit."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


def point(ids: np.ndarray) -> np.ndarray:
    """A document's place in the unit cube, from its hashed vector of token counts."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    counts = np.bincount(hashed, minlength=BUCKETS)
    spread = counts @ projection() / max(1.0, np.sqrt((counts * counts).sum()))
    return 0.5 * (1 + np.tanh(0.8 * spread))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys on a Hilbert curve of points in the unit cube, by the transposed form of the curve's index."""
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        gray = np.where((x[-1] & q) != 0, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros_like(gray)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """row (unique), doc_id, key, n, ids (as `id_type` says, END last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path), id_type(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                coded = []
                for text in part.column("text"):
                    ids = encode(text.as_py())
                    ids.append(END)
                    coded.append(np.array(ids, kind))
                keys = hilbert(np.stack([point(c) for c in coded]))
                rows = np.arange(row, row + len(coded))
                row += len(coded)
                yield pa.RecordBatch.from_arrays([pa.array(rows), part.column("doc_id"), pa.array(keys), pa.array([len(c) for c in coded], pa.int64()), pa.array([c.tobytes() for c in coded], pa.binary())], names=["row", "doc_id", "key", "n", "ids"])

    return texts(docs).mapInArrow(run, "row bigint, doc_id bigint, key bigint, n bigint, ids binary")


def places(coded: DataFrame) -> DataFrame:
    """row and `at`: the tokens before the document in the stream along the curve."""
    along = ["key", "doc_id", "row"]
    ordered = coded.select(*along, "n").repartitionByRange(*along).withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "packing-order")
    # one row for each partition
    totals = ordered.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ordered.select("row", "part", within.alias("within")).join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("within")).alias("at"))


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Sequences have `length` tokens, but for the last, which is to be padded.
    """
    coded = written(tokenized(docs, path), "packing-tokens")
    placed = coded.select("row", "doc_id", "ids").join(places(coded), "row").select("doc_id", "ids", "at")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, ids, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("at").to_pylist(), strict=True):
                whole = np.frombuffer(ids.as_py(), kind).astype("<u4")
                start = 0
                while start < len(whole):
                    sequence, offset = divmod(at + start, length)
                    n = min(length - offset, len(whole) - start)
                    for column, value in zip(columns, (doc_id, start, n, whole[start : start + n].tobytes(), len(whole), sequence, offset), strict=True):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names=names)

    return placed.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
