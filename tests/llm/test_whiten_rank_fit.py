"""Whitening, ranked search and best-fit packing against plain versions, and over rows that are odd in every way."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidewatch.llm import bestfit, lexical, queries, whitening
from tidewatch.llm.packing import encoder

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one"), (5, "Two WORDS, two"), (6, "lorem ipsum dolor sit amet " * 12_000), (7, "ß é ñ 漢字 \U0001f600 token É"), (8, "12345 678-x_y")]


def table(spark, texts):
    """Rows of documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in texts], "doc_id long, text string, part string, length string, k string, rank string, item string, score string")


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")


def plain_whitening(rows, most=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = (apart / n).astype(float)
    _, sigma, axes = np.linalg.svd(centred, full_matrices=False)
    values = sigma**2 / n
    kept = min(most, int((sigma > 1e-11 * sigma[0]).sum()))
    return n, [int((row * row).sum()) for row in apart], centred @ axes[:kept].T / np.sqrt(values[:kept]), values[:kept] / values.sum()


def assert_whitened(got, rows, most=32):
    n, deviation, scores, shares = plain_whitening(rows, most)
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) and {r.n for r in got} == {n}
    assert [int(by[i].deviation) for i, _ in rows] == deviation
    own = np.array([by[i].whitened for i, _ in rows])
    assert own.shape == scores.shape
    sign = np.sign((own * scores).sum(axis=0))
    np.testing.assert_allclose(own * sign, scores, atol=1e-6)
    np.testing.assert_allclose(got[0].explained, shares, rtol=1e-9)
    np.testing.assert_allclose(np.cov(own.T, bias=True), np.eye(own.shape[1]), atol=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((400, 40)) @ rng.standard_normal((40, 40)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    assert_whitened(whitening.whitened(vectors(spark, rows)).collect(), rows)
    assert_whitened(whitening.whitened(vectors(spark, rows), components=5).collect(), rows, 5)


def test_whitening_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(2)
    scales = np.geomspace(1, 1e6, 12)
    rows = [(i, (v * scales).tolist()) for i, v in enumerate(rng.standard_normal((300, 12)))]
    assert_whitened(whitening.whitened(vectors(spark, rows)).collect(), rows)


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-200, 200, (6, 20)).astype(float)
    fewer = [(i, v.tolist()) for i, v in enumerate(base)]  # fewer rows than dimensions
    assert_whitened(whitening.whitened(vectors(spark, fewer)).collect(), fewer)
    v = rng.integers(-200, 200, (100, 5)).astype(float)
    twice = [(i, [*map(float, r), *map(float, r), 7.0]) for i, r in enumerate(v)]  # a constant and repeated dimensions
    assert_whitened(whitening.whitened(vectors(spark, twice)).collect(), twice)


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (9, [0.0, 0.0])]
    bad = [(3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0]), (10, [1.0, 1e30])]
    got = whitening.whitened(vectors(spark, good + bad)).collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in good)
    assert_whitened([r for r in whitening.whitened(vectors(spark, [(i, v) for i, (_, v) in enumerate(good)])).collect()], [(i, v) for i, (_, v) in enumerate(good)])
    same = whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained) for r in same] == [(5, 0, [], [])] * 5
    assert whitening.whitened(vectors(spark, [(1, [1.0])])).collect()[0].whitened == []
    assert whitening.whitened(vectors(spark, [])).collect() == whitening.whitened(vectors(spark, bad[:5])).collect() == []


def test_deviations_beyond_a_long_are_exact():
    x = np.array([[2**61, -(2**61)], [5, 7]])
    apart = whitening.deviations(x, 2, x.sum(axis=0))
    assert apart.tolist() == [[2**61 - 5, -(2**61) - 7], [5 - 2**61, 7 + 2**61]]
    assert [int(d) for d in whitening.squares(apart)] == [(2**61 - 5) ** 2 + (2**61 + 7) ** 2] * 2


def test_triangular_solves():
    rng = np.random.default_rng(4)
    r = np.triu(rng.standard_normal((7, 7))) + 5 * np.eye(7)
    rows = rng.standard_normal((20, 7))
    np.testing.assert_allclose(whitening.solved(rows, r) @ r, rows, atol=1e-12)


def test_whitening_query(spark, small):
    got = queries.op11_whitening(spark, small).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, deviation, scores, shares = plain_whitening(rows)
    assert len(got) == len(rows) * scores.shape[1]
    by = {(r.vec_id, r.component): r for r in got}
    own = np.array([[by[i, c + 1].whitened for c in range(scores.shape[1])] for i, _ in rows])
    np.testing.assert_allclose(own * np.sign((own * scores).sum(axis=0)), scores, atol=1e-6)
    assert all(by[i, 1].deviation == d and by[i, 1].n == n for (i, _), d in zip(rows, deviation, strict=True))
    np.testing.assert_allclose([by[rows[0][0], c + 1].explained for c in range(len(shares))], shares, rtol=1e-9)


# ranked search


TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        rows = []
        for i, c, own in held:
            m = 75 + 25 * own * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, at + 1, None if null else i, -s) for at, (s, null, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, score string")


@pytest.mark.parametrize("block_bytes", [1, 3_000, 8 << 20])
def test_search(spark, small, block_bytes):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical.search(docs, items, block_bytes=block_bytes)) == want


def test_search_of_odd_rows(spark):
    items = [(1, "one"), (1, "ONE two two"), (None, "words É token"), (3, None), (4, ""), (5, "absent"), (6, "678 x lorem"), (7, "é")]
    got = found(lexical.search(table(spark, ODD), benchmark(spark, items)))
    assert got == plain_search(ODD, items)
    empty = table(spark, [])
    assert not found(lexical.search(empty, benchmark(spark, items))) and not found(lexical.search(table(spark, ODD), benchmark(spark, [])))
    assert not found(lexical.search(table(spark, ODD[:3]), benchmark(spark, items)))


def test_search_with_ties_and_long_items(spark):
    """Many masks of more than 64 terms, copies that tie at the last place, tasks and blocks of items of one row."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)] + [(1000 - i, "w1 w2 w3") for i in range(60)] + [(i, "w1 w2 w3") for i in range(2000, 2040)]
    items = [(1, " ".join(words)), (2, "w1 w2 w3"), (3, "w1"), (4, " ".join(words[:70] * 2))]
    assert found(lexical.search(table(spark, docs).repartition(7), benchmark(spark, items), block_bytes=400)) == plain_search(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    items = [(i, t) for i, t in enumerate(["one", "two words", "lorem", "x", "token 12345"])]
    assert found(lexical.search(table(spark, ODD), benchmark(spark, items))) == plain_search(ODD, items)


def test_search_stops_early():
    ids = np.arange(2_000)
    rare, common = np.array([3, 5, 8]), np.arange(2_000)
    of = lambda docs, w: (docs, np.full(len(docs), w), w)
    best = lexical.Best(3)
    many = [of(np.flatnonzero(ids % (p + 2) == 0), 1) for p in range(12)]
    assert lexical.rank_block(best, [of(rare, 1_000), of(common, 1), *many], ids) < 200
    assert sorted(best.ids.tolist()) == [3, 5, 8]


def test_terms_of_long_texts(monkeypatch):
    text = "Añb c-D e_ F9 \x7f x" * 500
    want = Counter(t.encode() for t in plain_terms(text))
    for size in (1, 7, 1000):
        monkeypatch.setattr(lexical, "PART_BYTES", size)
        assert lexical.occurrences(text.encode()) == want


# best-fit packing


def document_wise(lengths, room):
    """Best fit in falling order, one piece after another; the number of sequences."""
    left = []
    for n in sorted(lengths, reverse=True):
        at = min((r for r in left if r >= n), default=None)
        if at is None:
            left.append(room - n)
        else:
            left[left.index(at)] -= n
    return len(left)


def test_plan_is_document_wise_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        room = rng.choice([10, 64, 200])
        lengths = [rng.randint(1, room) if rng.random() < 0.6 else rng.randint(1, 1 + room // 8) for _ in range(rng.randint(0, 400))]
        slots = bestfit.plan(Counter(lengths), room)
        used, ranks = defaultdict(list), defaultdict(list)
        for s in slots:
            for k in range(s.bins * s.each):
                ranks[s.length].append(s.rank + k)
                used[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= room
        assert sorted(used) == list(range(document_wise(lengths, room)))


def test_plan_grows_with_lengths_alone():
    rng = random.Random(7)
    counts = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    few, many = bestfit.plan(counts), bestfit.plan({n: c * 10_000_019 for n, c in counts.items()})
    assert len(few) < 60_000 and len(many) < 60_000
    assert max(s.sequence + s.bins for s in many) >= sum(n * c * 10_000_019 for n, c in counts.items()) / 1024


def assert_packed(rows, texts, encode, room=1024):
    want = Counter()
    for i, t in texts:
        ids = [*encode(t or ""), 2]
        cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    assert len(used) == document_wise([r.length for r in rows], room)


def test_packing(spark, small):
    encode = encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    known = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert_packed(queries.op13_bestfit(spark, small).collect(), known, encode)


def test_packing_of_odd_rows(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = bestfit.pack(table(spark, ODD).repartition(3), path).collect()
    assert_packed(rows, ODD, encoder(path))
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert bestfit.pack(table(spark, []), path).collect() == []


def test_a_length_of_most_pieces_is_ranked_by_all_tasks(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [(i, "one two") for i in range(500)] + [(i, "x " * (i % 90)) for i in range(500, 700)]
    rows = bestfit.pack(table(spark, texts).repartition(9), path, length=64).collect()
    assert_packed(rows, texts, encoder(path), 64)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
