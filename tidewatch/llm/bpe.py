"""Byte-pair encoding and decoding over a table of distinct words.

Spark splits each text into words: runs without ASCII white space. The vocabularies this is for never join across white
space, so the ids of a text are the ids of its words in order. Documents are taken in blocks of bounded size. A block lists
its distinct words, most frequent first, and for each of its documents the places of its words in that list. The lists are
dealt out by word, packed into a row for each of many buckets of words, and unpacked and sorted by word there: the table of
distinct words, each with a row for each block that has it. Every distinct word is encoded once, as its rows begin; its ids go
with its rows back to each block and place, and from there to the documents by position. Decoding joins ids to the id-to-piece
table. A word that is everywhere weighs one row for each block, never one for each occurrence; its rows pass one after the
other, no list grows with the input, and what a block gathers is bounded by its size.

Words and positions come from two passes over the same input, which give the same blocks as long as the input's partitions
and their order are the same; a checksum of its words is part of a block's number, so a difference is found and is an error.
Input that is not read from files should be written to a table first.

The id-to-piece table has one row for each id of the vocabulary, whatever the input, so every task holds a copy.

Results for odd inputs: null counts as empty; an empty text has no ids and decodes to an empty text; texts of any length are
encoded whole; repeated rows and null ids are encoded row by row; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality import word_array
from tidewatch.llm.shared import texts

#: Bytes of text in a block, beyond which the next block begins.
BLOCK_BYTES = 16 << 20
#: Documents in a packed row, and words of which a task packs ids at once.
PACKED_ROWS, PENDING = 256, 200_000
#: Buckets of words for each shuffle partition, and at least.
BUCKETS, LEAST_BUCKETS = 4, 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at row i."""
    own = tokenizer(path)
    return pa.array([own.id_to_token(i) for i in range(own.get_vocab_size(with_added_tokens=True))], pa.string())


def joined_pieces(ids: pa.Array, offsets: np.ndarray, table: pa.Array) -> pa.Array:
    """For each list of ids its pieces, joined by a space."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(ids))
    return pc.binary_join(lists, " ")


def packed(values: np.ndarray) -> bytes:
    """An array of unsigned 32-bit integers, compressed with like bytes together."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Block:
    """The distinct words of some documents, most frequent first, and each document's words by their places there."""

    def __init__(self, at: int, ids: list[int | None], lists: list[pa.Array]):
        self.ids = ids
        coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode().unify_dictionaries()
        words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        seen = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.zeros(0, np.int32)])
        order = np.argsort(-np.bincount(seen, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        self.words = words.take(pa.array(order))
        self.places = rank[seen]
        self.lengths = np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.uint32)
        sizes = pc.binary_length(self.words).to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.bytes = bytes(self.words.buffers()[2] or b"") if len(self.words) else b""
        self.number = at << 32 | zlib.crc32(self.bytes, zlib.crc32(sizes.tobytes()))

    def dealt(self, buckets: int) -> tuple[np.ndarray, pa.Array]:
        """The buckets that have words of the block, and the words of each, as lines of a place and a word."""
        own = np.fromiter((zlib.crc32(self.bytes[a:b]) % buckets for a, b in pairwise(self.ends.tolist())), np.int32, len(self.words))
        order = np.argsort(own, kind="stable")
        lines = pc.binary_join_element_wise(pa.array(order).cast(pa.string()), self.words.take(pa.array(order)), " ")
        full, starts = np.unique(own[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), lines)
        return full, pc.binary_join(lists, "\n")


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    """Blocks of a task's rows; where one ends depends on the rows alone, not on how they are batched."""
    at, size = TaskContext.get().partitionId() << 10, 0
    ids: list[int | None] = []
    lists: list[pa.Array] = []
    for batch in batches:
        begin = 0
        for i, n in enumerate(batch.column("size").to_pylist()):
            size += n
            if size >= block_bytes or i == len(batch) - 1:
                part = batch.slice(begin, i + 1 - begin)
                ids += part.column("doc_id").to_pylist()
                lists.append(part.column("words"))
                begin = i + 1
            if size >= block_bytes:
                yield Block(at, ids, lists)
                at, size, ids, lists = at + 1, 0, [], []
                if not at & 1023:
                    raise ValueError("more than 1,024 blocks in a task; give more partitions or larger blocks")
    if ids:
        yield Block(at, ids, lists)


def split(docs: DataFrame) -> DataFrame:
    """doc_id, words and size (in bytes of text)."""
    return texts(docs).select("doc_id", word_array(F.col("text")).alias("words"), F.octet_length("text").alias("size"))


def block_words(rows: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """bucket and packed: for each block and bucket its words there, as lines: the block, then a place and a word in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            full, lines = block.dealt(buckets)
            number = pa.array([str(block.number)] * len(full), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pc.binary_join_element_wise(number, lines, "\n")], names=["bucket", "packed"])

    return rows.mapInArrow(run, "bucket int, packed string")


def block_places(rows: DataFrame, block_bytes: int) -> DataFrame:
    """block, ids, `lengths` and `places`: rows for some documents each, with their words by place."""
    names = ["block", "ids", "lengths", "places"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            ends = np.concatenate([[0], np.cumsum(block.lengths, dtype=np.int64)])
            for i in range(0, len(block.ids), PACKED_ROWS):
                k = min(i + PACKED_ROWS, len(block.ids))
                row = (block.number, block.ids[i:k], packed(block.lengths[i:k]), packed(block.places[ends[i] : ends[k]]))
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "block bigint, ids array<bigint>, lengths binary, places binary")


def encoded(words: pa.Array, path: str) -> pa.Array:
    """The ids of words as little-endian unsigned 32-bit integers."""
    coded = [e.ids for e in tokenizer(path).encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in coded], dtype=np.int64)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(coded), "<u4", int(ends[-1]))
    return pa.Array.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer((ends * 4).tobytes()), pa.py_buffer(flat.tobytes())])


def sorted_words(packed: DataFrame) -> DataFrame:
    """word, block and place for every word of every block, the rows of a word one after the other."""
    # one shuffle of packed rows; the sort keeps their partitions
    head = F.substring_index("packed", "\n", 1)
    rest = F.substring("packed", F.length(head) + 2, F.length("packed"))
    lines = packed.repartition("bucket").select("bucket", head.cast("bigint").alias("block"), F.split(rest, "\n").alias("lines"))
    each = lines.select("bucket", "block", F.explode("lines").alias("line"))
    place, word = F.substring_index("line", " ", 1).cast("int"), F.substring("line", F.instr("line", " ") + 1, F.length("line"))
    return each.select("bucket", word.alias("word"), "block", place.alias("place")).sortWithinPartitions("bucket", "word").drop("bucket")


def word_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """block, place and ids of sorted words: a word is encoded where its rows begin, also where they go on in later batches."""
    last, kept = None, None
    for batch in batches:
        coded = batch.column("word").dictionary_encode()
        words = coded.dictionary
        if not len(words):
            continue
        if words[0].as_py() == last:
            ids = pa.concat_arrays([kept, encoded(words.slice(1), path)])
        else:
            ids = encoded(words, path)
        last, kept = words[-1].as_py(), ids.slice(len(ids) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), ids.take(coded.indices)], names=["block", "place", "ids"])


def packed_ids(rows: DataFrame, path: str) -> DataFrame:
    """block, places (as differences), lengths and ids of sorted words: what a task has of a block, `PENDING` rows at a time, in one row."""
    names = ["block", "places", "lengths", "ids"]

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        block, place = whole.column("block").to_numpy(), whole.column("place").to_numpy()
        order = np.lexsort((place, block))
        block, place, ids = block[order], place[order], whole.column("ids").take(pa.array(order)).combine_chunks()
        lengths = pc.binary_length(ids).to_numpy() // 4
        flat, ends = np.frombuffer(b"".join(ids.to_pylist()), "<u4"), np.concatenate([[0], np.cumsum(lengths)])
        cut = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
        out = [(int(block[i]), packed(np.diff(place[i:k], prepend=0)), packed(lengths[i:k]), packed(flat[ends[i] : ends[k]])) for i, k in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary() if i else pa.int64()) for i in range(4)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in word_ids(batches, path):
            parts.append(batch)
            if sum(map(len, parts)) >= PENDING:
                yield pack(parts)
                parts = []
        if parts:
            yield pack(parts)

    return rows.mapInArrow(run, "block bigint, places binary, lengths binary, ids binary")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slices of `flat` that begin at starts[i] with lengths[i], for each i of `at`, one after the other."""
    n = lengths[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(total)]


def restore(docs: pa.Table, words: pa.Table, path: str) -> pa.Table:
    """The ids and the decoded text of the documents of one block, by the places of their words."""
    empty = [np.zeros(0, np.uint32)]
    at = np.concatenate([np.cumsum(unpacked(x.as_py())) for x in words.column("places")] or empty).astype(np.int64)
    n = np.concatenate([unpacked(x.as_py()) for x in words.column("lengths")] or empty).astype(np.int64)
    flat = np.concatenate([unpacked(x.as_py()) for x in words.column("ids")] or empty)
    if len(at) and at.max() != len(at) - 1 or not len(at) and any(len(unpacked(x.as_py())) for x in docs.column("places")):
        raise ValueError("a block's words changed between two passes over the input; write the input to a table first")
    starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    starts[at], lengths[at] = np.cumsum(n) - n, n
    table, out = pieces(path), []
    for ids, counts, places in zip(docs.column("ids").to_pylist(), docs.column("lengths"), docs.column("places"), strict=True):
        place = unpacked(places.as_py())
        found = gathered(flat, starts, lengths, place)
        last = np.concatenate([[0], np.cumsum(unpacked(counts.as_py()).astype(np.int64))])
        stops = np.concatenate([[0], np.cumsum(lengths[place])])[last].astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((stops * 4).tobytes()), pa.py_buffer(found.astype("<u4").tobytes())])
        out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": binary, "decoded": joined_pieces(pa.array(found), stops, table)}))
    return pa.concat_tables(out)


def encode_decode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, `ids` (little-endian unsigned 32-bit integers) and `decoded` for every row of `docs`."""
    rows = split(docs)
    buckets = max(LEAST_BUCKETS, BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = packed_ids(sorted_words(block_words(rows, block_bytes, buckets)), path)
    placed = block_places(rows, block_bytes)
    return placed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(lambda a, b: restore(a, b, path), "doc_id bigint, ids binary, decoded string")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and `decoded` for rows with doc_id and `ids` as `encode_decode` gives them."""

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            lists = [np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column("ids")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), joined_pieces(flat, ends, table)], names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(speak, "doc_id bigint, decoded string")
