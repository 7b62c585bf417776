"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most one bit in one of their 32-bit halves. So for each
half every distinct fingerprint emits all variants of it within half the radius, rounded down (the 33 values within one
bit), the variants are shuffled against the unchanged halves, and colliding pairs are deduplicated and verified on all 64
bits. That is complete, and takes 68 rows for each fingerprint, where one ball over all 64 bits takes 2146.

A half that very many fingerprints share would collide in all pairs. Beyond `DENSE` fingerprints a half is left out of the
join, and all fingerprints near it meet in the ball over all 64 bits instead: each emits its variants within two bits, a
variant within one bit of some member links that member to all others at the same variant (their distance is at most
three), and a variant has at most 2081 fingerprints around it, so the rows stay in proportion to the fingerprints.

Links join distinct fingerprints only; copies share a fingerprint and are never expanded into pairs. Components are found
by alternating large-star and small-star steps, each written to the shared folder.

Results for odd inputs: null and empty texts have the fingerprint zero; a text of one or two words is one shingle; repeated
rows get one class; a null doc_id never is a class id unless the whole class has none; an empty table gives an empty
result; columns other than doc_id and text are read only where the caller names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import own_names, picked, placed, spread_join, texts, written

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints with one and the same half beyond which that half's members meet in the ball over all bits.
DENSE = 256
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text; A-Z count as a-z, other letters as they are."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(joined)]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[:last], stops, strict=True)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and `fp`: the fingerprint as a signed long."""
    rows = texts(docs, *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    rows = rows.select(F.struct("doc_id", *[f"keep_{i}" for i in range(len(keep))]).alias("row"), F.col("text").cast("binary").alias("bytes"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("bytes")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fps)], names=["row", "fp"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, fp bigint"
    return rows.mapInArrow(compute, schema)


def masks(bits: int, flips: int) -> list[int]:
    """All words of `bits` bits with exactly `flips` ones, as signed longs."""
    return [(m := sum(1 << b for b in at)) - (1 << 64 if m >> 63 else 0) for at in combinations(range(bits), flips)]


def half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of the fingerprints in column `fp` that connect all within three bits of each other; a < b."""
    one = F.array(*[F.lit(m).cast("long") for m in [0, *masks(32, 1)]])
    halves = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), half(F.col("fp"), i).alias("value")) for i in (0, 1)])).alias("h")
    centres = distinct.select("fp", halves).select("fp", "h.which", F.col("h.value").alias("key"))
    variants = centres.select("fp", "which", F.explode(F.transform(one, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    crowded = written(centres.groupBy("which", "key").count().where(F.col("count") > dense).select("which", "key"), "simhash-crowded")
    if crowded.isEmpty():
        sparse, far = centres, None
    else:
        sparse = centres.join(crowded, ["which", "key"], "left_anti")
        near = variants.join(crowded, ["which", "key"], "left_semi").select("fp").distinct()
        far = ball_links(written(near, "simhash-dense"))
    a, b = sparse.withColumnRenamed("fp", "a"), variants.withColumnRenamed("fp", "b")
    # a crowded half may be on one side only, so both orders of a pair are taken
    # Spark takes the size of the variants for that of the fingerprints they are made from, and would broadcast them
    pairs = a.join(b.hint("merge"), ["which", "key"]).where((F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= RADIUS))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (pairs if far is None else pairs.unionByName(far)).distinct()


def ball_links(distinct: DataFrame) -> DataFrame:
    """Links among fingerprints by their variants within two of all 64 bits; connects what `links` connects."""
    each = [F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks(64, r)]), lambda m: F.col("fp").bitwiseXOR(m))) for r in (0, 1, 2)]
    emitted = reduce(DataFrame.unionByName, [distinct.select("fp", F.lit(r).alias("flipped"), e.alias("variant")) for r, e in enumerate(each)])
    met = emitted.groupBy("variant").agg(F.min(F.when(F.col("flipped") < 2, F.col("fp"))).alias("a"), F.collect_list("fp").alias("members"))
    pairs = met.where("a is not null and size(members) > 1").select("a", F.explode("members").alias("b")).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "simhash-edges")
    seen = None
    while True:
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "simhash-large")
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u != v").distinct(), "simhash-small")
        # sums of hashes tell whether the edges changed
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def near_duplicates(docs: DataFrame, keep: Sequence[str] = (), dense: int = DENSE) -> DataFrame:
    """`row` (doc_id and the columns in `keep`), `fp`, `root` (the class, never null) and component_id for every row."""
    rows = written(fingerprints(docs, keep), "simhash-rows")
    return spread_join(rows, classes(rows, dense), "fp", "n", "row.doc_id").drop("n")


def classes(rows: DataFrame, dense: int = DENSE) -> DataFrame:
    """fp, root, component_id and n (rows) for every fingerprint of `rows` (row, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("row.doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), dense))
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", "n")
    classed = written(classed, "simhash-classed")
    least = classed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return written(classed.select("fp", "root", "n").join(least, "root"), "simhash-classes")


def one_of_each(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each class the row with the smallest doc_id.

    Where `docs` is a plain read of `stored` Parquet files, its rows are picked from these; else from a copy.
    """
    rows = placed(docs, "simhash-docs", stored)
    prints = written(fingerprints(rows, ["part", "place"]), "simhash-rows")
    # the rows that stay are picked without their texts, which are never shuffled
    light = prints.select(F.col("row.keep_0").alias("part"), F.col("row.keep_1").alias("place"), "row.doc_id", "fp")
    light = spread_join(light, classes(prints), "fp", "n", "part", "place")
    first = light.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "part", "place")).alias("first"))
    kept = picked(rows, first.select("first.part", "first.place"), "part", "place")[0]
    return kept.select(*[F.col(n).alias(c) for n, c in zip(own_names(docs), docs.columns, strict=True)])
