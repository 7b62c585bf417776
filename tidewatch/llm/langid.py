"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three letters, words framed by a space) in order of
frequency, over all training documents. A document's own most frequent n-grams are ranked the same way, and its distance to
a language is the sum over them of how far out of place each is there, an n-gram missing from the profile counting the
most. The nearest language is the prediction.

n-gram counts of all training documents are summed with map-side aggregation in the tasks and by Spark; only the profiles,
`PROFILE` rows for each language, reach the driver and every task.

Results for odd inputs: a null text, or one without a letter, is `und` with score zero; so is every text when nothing could
be learned; equal counts are ranked by the n-gram, equal distances by the language's name; documents without a language do
not train; repeated rows and null ids are handled row by row; other columns are read only where the caller names them.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: n-grams in a language's profile, and in a document's.
PROFILE = 1000
DOCUMENT = 300
UNKNOWN = "und"
#: Characters of a batch in memory before their n-grams are counted, and n-grams in a table of all of some letters.
PENDING = 500_000
TABLE = 4_000_000
#: A score below this is too close to call.
LEAST_SCORE = 0.02
_SHIFT = 21  # bits of a code point


@functools.cache
def alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], bool)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, each run of other characters as one space, with a space at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.concatenate([[32], np.where(alphabetic()[points], points, 32), [32]]).astype(np.int64)
    return kept[np.concatenate([[True], (kept[1:] != 32) | (kept[:-1] != 32)])]


def grams(points: np.ndarray) -> np.ndarray:
    """All n-grams of the orders as packed integers; a space only begins or ends one."""
    out = []
    gap = points == 32
    for n in ORDERS:
        m = len(points) - n + 1
        if m < 1:
            continue
        code = np.zeros(m, np.int64)
        for i in range(n):
            code = (code << _SHIFT) | points[i : i + m]
        good = ~gap if n == 1 else np.ones(m, bool)
        for i in range(1, n - 1):
            good &= ~gap[i : i + m]
        if n == 2:
            good &= ~(gap[:m] & gap[1 : m + 1])
        out.append(code[good])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def tally(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`counted(grams(points))`; n-grams of few different letters are counted in a table of all that there may be."""
    place = np.zeros(int(points.max()) + 1, np.int64)
    place[points] = 1
    known = np.flatnonzero(place)
    k = len(known)
    if k ** max(ORDERS) > TABLE:
        return counted(grams(points))
    place[known] = np.arange(k)
    at = place[points]
    gap = int(place[32])  # a space is at both ends
    out = []
    for n in ORDERS:
        m = len(at) - n + 1
        if m < 1:
            continue
        index = np.zeros(m, np.int64)
        for i in range(n):
            index = index * k + at[i : i + m]
        times = np.bincount(index, minlength=k**n).reshape((k,) * n)
        if n == 1:
            times[gap] = 0
        if n == 2:
            times[gap, gap] = 0
        for i in range(1, n - 1):
            times[(slice(None),) * i + (gap,)] = 0
        found = np.nonzero(times)
        code = np.zeros(len(found[0]), np.int64)
        for letter in found:
            code = (code << _SHIFT) | known[letter]
        out.append((code, times[found]))
    codes, n = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(codes)
    return codes[order], n[order]


class Counts:
    """Counts of n-grams for each language, with few texts in memory that are not yet counted."""

    def __init__(self):
        self.texts: dict[str, list[str]] = {}
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        self.texts.setdefault(lang, []).append(text)
        self.held += len(text)
        if self.held > PENDING:
            self.settle()

    def settle(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        for lang, parts in self.texts.items():
            codes, n = tally(letters("\n".join(parts)))  # as framed as each by itself
            if lang in self.sums:
                old, was = self.sums[lang]
                codes, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                n = np.bincount(back, np.concatenate([was, n]), len(codes)).astype(np.int64)
            self.sums[lang] = codes, n
        self.texts, self.held = {}, 0
        return self.sums


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of `docs` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = Counts()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by.add(lang, text.as_py())
            for lang, (codes, n) in by.settle().items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """For each language of the rows of `docs` its most frequent n-grams, in order."""
    ranked = gram_counts(docs).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list[int]] = {}
    # at most `size` rows for each language
    for row in ranked.where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(g, np.int64) for lang, g in out.items()}


class Ranks:
    """The profiles as one sorted table of n-grams with each language's rank."""

    def __init__(self, learned: dict[str, np.ndarray], document: int = DOCUMENT):
        self.langs = sorted(learned)
        self.document = document
        self.missing = max((len(g) for g in learned.values()), default=1)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *learned.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, learned[lang]), i] = np.arange(len(learned[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance, and its lead over the next as a share of that one's distance."""
        codes, n = counted(grams(letters(text or "")))
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = codes[np.lexsort((codes, -n))][: self.document]
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        place = self.ranks[at]
        apart = np.where(place < 0, self.missing, np.abs(place - np.arange(len(top))[:, None]))
        distance = apart.sum(axis=0)
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        rest = int(distance[order[1]]) if len(order) > 1 else self.missing * len(top)
        return self.langs[order[0]], (rest - best) / rest if rest else 0.0


def identify(docs: DataFrame, learned: dict[str, np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns in `keep` (as keep_0, keep_1 ...) for every row of `docs`."""
    table = docs.sparkSession.sparkContext.broadcast(Ranks(learned))  # bounded by languages and profile size
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    rows = docs.select(row.alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = table.value
        for batch in batches:
            found = [ranks.nearest(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose language is clear, with all their columns; learned from rows that are not held out."""
    learned = profiles(docs.where(~held_out()))
    rows = identify(docs, learned, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return rows.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
