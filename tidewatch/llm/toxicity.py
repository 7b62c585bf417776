"""Toxicity by a noisy-channel reading of obfuscated words.

Words that may be disguised (figures or signs for letters, letters or parts apart, letters repeated) become lattices: of the
letters that each character may stand for, and of white space that may part words or be dropped. Viterbi decoding picks the
reading that a character model of the corpus and the channel's costs make likeliest. Tokens, runs of single letters with
separators of any length between them, and stretches of any number of tokens that may be parts of a telling word are decoded
so. Where such stretches are, and which tokens can come to a telling word at all, is found by a walk of the telling words'
prefix tree through the lattice, with every reading of every sign; the decoding then says what was meant.

The score of a text is that of its most telling word, as it stands or as restored, where a word speaks
through itself and its beginnings, weighed by how often labelled texts with it are toxic. All labelled texts are read, but
a class of near copies counts once for each of its words, as it tells no more about other texts than one text. Near copies
share one of `BANDS` groups of least hashes of runs of words: nearly all pairs with half of their runs in common do. Words
that lean to toxic texts without telling grade the texts below the threshold.

The character model sums n-grams over all documents and keeps the `MODEL` most frequent; the word table sums documents for
each feature over the training labels (a bounded sample of them) and keeps those that tell; both reach every task and are bounded by their parameters.
Texts are read whole. A word without any disguise has one path through its lattice and is not decoded. Decoding is exact: as
it goes on, letters are settled that all paths share, so it takes time in proportion and little memory, however long a token
is. A worker remembers what each distinct token tells over all the tasks that it runs.

Results for odd inputs: a null or empty text has the lowest score; documents without a label do not train; a label of a
repeated doc_id counts for each row with that id; labels without a doc_id are left out; rows are scored one by one; where no label tells anything every score is
the lowest; columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import langid, simhash
from tidewatch.llm.shared import written

#: n-grams in the character model.
MODEL = 200_000
#: Features in the word table.
FEATURES = 20_000
PREFIXES = (4, 5)
#: Texts by which a feature's share is drawn to the share of all, however many are labelled.
WEIGHT = 4.0
#: Toxic texts that a feature must occur in, near copies counting as one.
SUPPORT = 4
#: Words in a run, groups of least hashes, and hashes in a group.
RUN, BANDS, ROWS = 3, 16, 3
_MIX = np.random.default_rng(8).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
#: A feature that tells less is dropped, so that chance words of a long text don't add up.
LEAST = 0.55
THRESHOLD = 0.3
#: A feature of fewer than LEAST that is toxic this many times as often as all texts grades the texts without a telling one.
LEANS = 2.0
LOWEST, GRADED = 0.01, 0.28
#: Labels that the words are learned from; of more, about so many are taken by the hash of their doc_id.
LABELS = 200_000

#: What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l",
}
SIGN, DROP_SIGN, DROP_OTHER, DROP_RUN, DROP_DOUBLE, DROP_SPACE = 1.0, 8.0, 0.5, 0.7, 4.0, 1.0
#: Characters after which it is looked for what all paths share.
SETTLED = 256
EDGES = ".,;:?\"'*#%&-_()[]<>"
#: Of these, those without a reading.
MARKS = "".join(c for c in EDGES if c not in STANDS_FOR)
#: Tokens of which a worker remembers what they tell; beyond, it starts afresh.
MEMORY = 500_000
#: Steps of walks that it remembers.
STEPS = 100_000
NOTHING = (), ()

WORD = re.compile(r"[^\W\d_]+")
_signs = re.escape("".join(STANDS_FOR))
#: A sign that has a reading, a mark before a letter, a figure after one, or two like letters.
DISGUISED = re.compile(rf"[{_signs}]|[*._-][^\W\d_]|[^\W\d_][0-9]|([^\W\d_])\1")
#: Three or more letters or signs, each alone between separators.
APART = re.compile(rf"(?<![^\W_])(?:[^\W\d_]|[{_signs}])(?:[\s._*-]++(?:[^\W\d_]|[{_signs}])(?![^\W_])){{2,}}")
#: Two of these with separators around, as in every such run; quicker to look for.
BEFORE = re.compile(rf"[\s._*-](?=.[\s._*-])(?:[^\W\d_]|[{_signs}])[\s._*-]+(?:[^\W\d_]|[{_signs}])(?![^\W_])")
#: What some token of such a run has, its second letter.
ALONE = re.compile(rf"(?:\A|[._*-])(?:[^\W\d_]|[{_signs}])(?:[._*-]|\Z)")


class CharacterModel:
    """Costs (negative logarithms) of a character after two others, from n-gram counts; a space frames words."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = max(1, sum(n for g, n in counts.items() if len(g) == 1))
        self.cache: dict[str, float] = {}
        self.kinds: dict[str, tuple[list[tuple[str, float]], float | None] | None] = {}

    def kind(self, c: str) -> tuple[list[tuple[str, float]], float | None] | None:
        """What a character may stand for and the cost of dropping one that isn't repeated; None for white space."""
        readings = [(c, 0.0)] if c.isalpha() else []
        readings += [(r, SIGN) for r in STANDS_FOR.get(c, "")]
        drop = None if c.isalpha() else DROP_SIGN if c in STANDS_FOR else DROP_OTHER
        known = self.kinds[c] = None if c.isspace() else (readings, drop)
        return known

    def cost(self, before: str, c: str) -> float:
        known = self.cache.get(before + c)
        if known is None:
            n = self.counts
            one, two = before[-1:], before[-2:]
            p = 0.01 / 64 + 0.04 * n.get(c, 0) / self.total
            p += 0.25 * n.get(one + c, 0) / max(1, self.after(one))
            p += 0.7 * n.get(two + c, 0) / max(1, n.get(two, 0)) if len(two) == 2 else 0.0
            known = self.cache[before + c] = -math.log(min(1.0, p))
        return known

    def after(self, c: str) -> int:
        if c != " ":
            return self.counts.get(c, 0)
        if "" not in self.cache:
            self.cache[""] = sum(n for g, n in self.counts.items() if len(g) == 2 and g[0] == " ")
        return int(self.cache[""])

    def restore(self, seen: str) -> str:
        """The likeliest words behind `seen`, by Viterbi decoding over the last two letters."""
        # where paths part: before the first there is one, and after the last they only join
        parting = [i for i, c in enumerate(seen) if not c.isalpha() or i and c == seen[i - 1]]
        if not parting:
            return seen
        begin, last = parting[0], parting[-1]
        settled = [seen[:begin]]
        # for each state its cost and its letters, linked from the last to the first
        paths: dict[str, tuple[float, list | None]] = {(" " + settled[0])[-2:]: (0.0, None)}
        look, cache, kinds = begin + SETTLED, self.cache, self.kinds
        for i in range(begin, len(seen)):
            if i > last and len(paths) == 1:
                [(_, path)] = paths.values()
                return "".join([*settled, spelled(path), seen[i:]]).strip()
            c = seen[i]
            if i == look:
                letters, left = settle([path for _, path in paths.values()])
                settled.append(letters)
                look = i + max(SETTLED, left)
            ahead: dict[str, tuple[float, list | None]] = {}
            kind = kinds[c] if c in kinds else self.kind(c)
            if kind is None:
                for state, (cost, path) in paths.items():
                    parted = (cost, path) if state == " " else (cost + self.cost(state, " "), [path, " "])
                    for to, reached in ((" ", parted), (state, (cost + DROP_SPACE, path))):
                        if to not in ahead or reached[0] < ahead[to][0]:
                            ahead[to] = reached
                paths = ahead
                continue
            readings, drop = kind
            if i and c == seen[i - 1]:
                drop = DROP_RUN if seen[max(0, i - 2) : i + 3].count(c) > 2 else DROP_DOUBLE
            for state, (cost, path) in paths.items():
                if drop is not None and (state not in ahead or cost + drop < ahead[state][0]):
                    ahead[state] = (cost + drop, path)
                for r, channel in readings:
                    after = state + r
                    letter = cache[after] if after in cache else self.cost(state, r)
                    to, total = after[-2:], cost + channel + letter
                    if to not in ahead or total < ahead[to][0]:
                        ahead[to] = (total, [path, r])
            paths = ahead
        state = min(paths, key=lambda state: (paths[state][0] + self.cost(state, " "), state))
        return "".join([*settled, spelled(paths[state][1])]).strip()


def spelled(path: list | None) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def settle(paths: list[list | None]) -> tuple[str, int]:
    """The letters up to the last that all paths share, which are cut off them, and how many the longest has left."""
    depth: dict[int, int] = {}
    path, shared = paths[0], None
    while path:
        depth[id(path)] = len(depth)
        path = path[0]
    at, longest = 0, len(depth)
    path = paths[0]
    for other in paths:
        n = 0
        while other and id(other) not in depth:
            other, n = other[0], n + 1
        longest = max(longest, n)
        if other is None:
            return "", longest
        if depth[id(other)] >= at:
            at, shared = depth[id(other)], other
    letters = spelled(shared)
    shared[:] = [None, ""]
    return letters, longest - len(letters)


class Reached(dict):
    """States that a walk from the root may come to, and, by character, what is reached next, found when first asked for."""

    def __init__(self, tree: Tree, states: frozenset[tuple[int, str]]):
        self.tree, self.states = tree, states
        self.told = any(node in tree.ends for node, _ in states)
        #: Whether it is known that the walk meets a word, or that it doesn't.
        self.settled = self.told or not states

    def __missing__(self, c: str) -> Reached:
        to = self[c] = self.tree.reached(frozenset(self.tree.walk(dict.fromkeys(self.states, 0), c)))
        return to


class Tree:
    """A prefix tree, walked through the lattice of what was written."""

    def __init__(self, words: set[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: set[int] = set()
        for word in words:
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            self.ends.add(node)
        self.forget()

    def forget(self) -> None:
        self.known: dict[frozenset, Reached] = {}
        self.steps = 0
        self.root = self.reached(frozenset([(0, "")]))

    def reached(self, states: frozenset[tuple[int, str]]) -> Reached:
        self.steps += 1
        known = self.known.get(states)
        if known is None:
            known = self.known[states] = Reached(self, states)
        return known

    def come(self, token: str) -> Reached:
        """Where it is known whether some path through `token`, or its beginning, meets a word; else where `token` ends."""
        at = self.start()
        for c in token:
            at = at[c]
            if at.settled:
                break
        return at

    def after(self, token: str) -> tuple[tuple[int, str], ...]:
        """The states after `token` where a word has begun."""
        at = self.start()
        for c in token:
            at = at[c]
            if not at.states:
                return ()
        return tuple(s for s in at.states if s[0])

    def start(self) -> Reached:
        if self.steps >= STEPS:
            self.forget()
        return self.root

    def walk(self, states: dict[tuple[int, str], int], token: str) -> dict[tuple[int, str], int]:
        """States (a node and the letter last read, with where the word began) after `token`.

        A sign stands for each of its letters or nothing, another mark for nothing, a letter for itself or, again, for nothing.
        """
        for c in token:
            letter = c.isalpha()
            ahead: dict[tuple[int, str], int] = {}
            for (node, last), start in states.items():
                if (not letter or c == last) and ahead.get((node, last), -1) < start:
                    ahead[node, last] = start
                for r in c if letter else STANDS_FOR.get(c, ""):
                    to = self.next[node].get(r)
                    if to is not None:
                        if ahead.get((to, r), -1) < start:
                            ahead[to, r] = start
            states = ahead
            if not states:
                break
        return states


def readings(token: str, model: CharacterModel) -> set[str]:
    """The words in a token of lower case, as they stand and, where it may be disguised, as restored."""
    bare = token.strip(EDGES)
    words = {bare} if bare.isalpha() else set(WORD.findall(token))
    # a bracket at an edge may be a letter or a bracket
    words.update(model.restore(seen) for seen in {bare, token.strip(MARKS)} if DISGUISED.search(seen))
    words.discard("")
    return words


def features(words: set[str]) -> set[str]:
    """The words and their beginnings."""
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n}


class Reader:
    """The features of texts, token by token; `only` says which are of use."""

    def __init__(self, model: CharacterModel, only: dict[str, float] | None = None):
        self.model, self.only = model, only
        self.memory: dict[str, tuple[tuple[str, ...], tuple[tuple[int, str], ...]]] = {}
        # nearly all tokens tell nothing; some are, or have, a letter alone
        self.nothing: set[str] = set()
        self.alone: set[str] = set()
        self.spans: dict[str, tuple[str, ...]] = {}
        # what a token must come to, and words that tell by themselves, which may stand in parts
        self.useful = Tree({f.rstrip("*") for f in only or {}})
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in only or {}}
        self.whole = {f for f, p in (only or {}).items() if p >= LEAST and len(f) > 3 and f.isalpha()}
        self.tree = Tree(self.whole)

    def tell(self, token: str) -> tuple[tuple[str, ...], tuple[tuple[int, str], ...]]:
        """The features in a token, and where in the tree a word may be after it as its first part."""
        only, told = self.only, True
        if only is not None:
            end = self.useful.come(token)
            if not end.states and (token.isalpha() or token.strip(EDGES).isalpha()):
                return NOTHING
            told = end.told
        if not DISGUISED.search(token):
            bare = token.strip(EDGES)
            words = (bare,) if bare.isalpha() else WORD.findall(token)
        else:
            # no path comes to a feature: the token as it stands
            words = readings(token, self.model) if told else WORD.findall(token)
        if only is None:
            return tuple(features(set(words))), ()
        # all features of a word begin as one of the heads
        found = {f for w in words if w[: PREFIXES[0]] in self.heads for f in (w, w[:4] + "*", w[:5] + "*") if f in only}
        return tuple(found), self.tree.after(token)

    def token(self, token: str) -> tuple[tuple[str, ...], tuple[tuple[int, str], ...]]:
        """What a token tells, which is remembered."""
        known = self.memory.get(token)
        if known is None:
            known = self.tell(token)
            if (len(token) == 1 or not token.isalpha()) and ALONE.search(token):
                self.alone.add(token)
            if known == NOTHING:
                self.nothing.add(token)
            else:
                self.memory[token] = known
        return known

    def restored(self, seen: str) -> tuple[str, ...]:
        """The words behind `seen`."""
        known = self.spans.get(seen)
        if known is None:
            if len(self.spans) >= MEMORY:
                self.spans.clear()
            known = self.spans[seen] = tuple(self.model.restore(seen).split())
        return known

    def parts(self, tokens: list[str], begins: dict[str, tuple[tuple[int, str], ...]]) -> Iterator[str]:
        """Stretches of tokens that one of the words may be spread over; `begins` has the tokens that may begin one."""
        states: dict[tuple[int, str], int] = {}
        at = [i for i, token in enumerate(tokens) if token in begins]
        for begin, after in zip(at, [*at[1:], len(tokens) - 1], strict=True):
            for s in begins[tokens[begin]]:
                states[s] = begin
            for i in range(begin + 1, after + 1):
                if not states:
                    break
                before = states
                states = self.tree.walk(before, tokens[i])
                for start in {start for s, start in states.items() if s[0] in self.tree.ends and s not in before}:
                    yield " ".join(t.strip(MARKS + "!") for t in tokens[start : i + 1])

    def text(self, text: str) -> set[str]:
        text = text.lower()
        tokens = text.split()
        own = set(tokens)
        if len(self.memory) + len(self.nothing) >= MEMORY:
            for known in (self.memory, self.nothing, self.alone):
                known.clear()
        found: set[str] = set()
        begins = {}
        for token in own - self.nothing:
            told, first = self.memory.get(token) or self.token(token)
            if told:
                found.update(told)
            if first:
                begins[token] = first
        if not self.alone.isdisjoint(own) and BEFORE.search(text):
            for m in APART.finditer(text):
                found.update(f for f in features(set(self.restored(m[0]))) if self.only is None or f in self.only)
        if begins:
            for stretch in self.parts(tokens, begins):
                # only whole words: beginnings of words that chance to stand together tell nothing
                words = self.whole.intersection(self.restored(stretch))
                found.update(f for f in features(words) if f in self.only)
        return found


_reader: list = []


def reader_of(value: tuple) -> Reader:
    """The worker's reader for a broadcast value, which later tasks find as earlier ones left it."""
    if not _reader or _reader[0] is not value:
        _reader[:] = [value, Reader(*value)]
    return _reader[1]


def held_out() -> Column:
    return langid.held_out(4, 2)


def character_model(docs: DataFrame, size: int = MODEL) -> CharacterModel:
    counts = langid.gram_counts(docs.select("text", F.lit("").alias("lang"))).orderBy(F.desc("n"), "gram").limit(size)

    def spelled(code: int) -> str:
        out = ""
        while code:
            out = chr(code & ((1 << langid._SHIFT) - 1)) + out
            code >>= langid._SHIFT
        return out

    return CharacterModel({spelled(r.gram): r.n for r in counts.collect()})  # at most `size` rows


def bands(text: str) -> list[int]:
    """`BANDS` hashes of a text's least hashes of runs of words; near copies are likely to have one in common."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in text.lower().split()] or [0], np.uint64)
    n = max(1, len(words) - RUN + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(RUN, len(words))):
        hashes = (hashes ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    # the upper half of a product depends on all bits of the hash
    least = np.concatenate([((hashes * m) >> np.uint64(32)).min(keepdims=True) for m in _MIX])
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def near_links(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of `of` that connect near copies among `rows` (of, text): in each band all with the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(found, pa.list_(pa.int64()))], names=["of", "bands"])

    hashed = rows.select(F.col("of").cast("long").alias("of"), "text").mapInArrow(run, "of bigint, bands array<bigint>")
    banded = written(hashed.select("of", F.explode("bands").alias("band")), "toxicity-bands")
    least = banded.groupBy("band").agg(F.min("of").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return banded.join(least, "band").where("of != a").select("a", F.col("of").alias("b")).distinct()


def labelled(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> DataFrame:
    """text, toxic and near of labelled documents that are not held out, of equal texts one.

    near is the class of a text that has near copies among the others, and null for other texts. The labels, about `bound`
    of them at most, are broadcast, so one scan finds their texts, which are written apart; all else reads only these.
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = written(marked.where("of is not null"), "toxicity-labels")
    n = marked.count()
    if n > bound:
        marked = marked.where(F.pmod(F.xxhash64("of"), F.lit(n)) < bound)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").alias("of"), text.alias("text")).join(F.broadcast(marked), "of").select("of", "toxic", "text", F.sha2("text", 256).alias("digest"))
    own = written(own, "toxicity-texts")
    chosen = written(own.groupBy("digest").agg(F.min("of").alias("of"), F.max("toxic").alias("toxic")), "toxicity-chosen")
    texts = written(own.drop("toxic").join(F.broadcast(chosen), ["digest", "of"]).dropDuplicates(["of", "digest"]).select("of", "toxic", "text"), "toxicity-distinct")
    near = simhash.components(near_links(texts.select("of", "text"))).select(F.col("node").alias("of"), F.col("root").alias("near"))
    return texts.join(near, "of", "left").select("text", "toxic", "near")


def word_table(docs: DataFrame, labels: DataFrame, model: CharacterModel, size: int = FEATURES) -> dict[str, float]:
    """The share of toxic texts among those with a feature, drawn to the share of all, for features that tell or lean.

    The toxic texts of a class of near copies count as one text for each feature, and so do its other texts.
    """
    train = labelled(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, None))  # bounded by `MODEL`
    names = ["feature", "near", "toxic", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.slice(i, 2000)
                seen: defaultdict[tuple[int | None, bool], Counter[str]] = defaultdict(Counter)
                for text, toxic, near in zip(part.column("text"), part.column("toxic").to_pylist(), part.column("near").to_pylist(), strict=True):
                    found = reader.text(text.as_py() or "")
                    found.add("")  # counts the texts
                    seen[near, bool(toxic)].update(found)
                sizes = [len(n) for n in seen.values()]
                of, bad = ([k[j] for k, size in zip(seen, sizes, strict=True) for _ in range(size)] for j in (0, 1))
                columns = [list(chain.from_iterable(seen.values())), of, bad, list(chain.from_iterable(n.values() for n in seen.values()))]
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = train.mapInArrow(run, "feature string, near bigint, toxic boolean, n bigint").groupBy("feature", "near", "toxic").agg(F.sum("n").alias("n"))
    once = F.when(F.col("near").isNull(), F.col("n")).otherwise(1)
    sums = rows.groupBy("feature").agg(F.sum(once).alias("n"), F.sum(F.when(F.col("toxic"), once).otherwise(0)).alias("bad"))
    # the sums that count are stored, as their total is asked for as well
    sums = written(sums.where((F.col("feature") == "") | (F.col("bad") >= SUPPORT)), "toxicity-features")
    total = sums.where("feature = ''").select(F.col("n").alias("of"), (F.col("bad") / F.col("n")).alias("prior"))  # one row
    share = (F.col("bad") + WEIGHT * F.col("prior")) / (F.col("n") + WEIGHT)
    shares = sums.where("feature <> ''").join(F.broadcast(total)).withColumn("share", share)
    told = shares.where((F.col("share") >= LEAST) | (F.col("share") >= LEANS * F.col("prior")))
    told = told.orderBy(F.col("share") < LEAST, F.desc("bad"), "feature").limit(size)
    return {r.feature: r.share for r in told.select("feature", "share").collect()}  # at most `size` rows


def weigh(shares: list[float]) -> float:
    """The score of a text from the shares of its features."""
    told = sorted((p for p in shares if p >= LEAST), reverse=True)
    if not told:
        return LOWEST + GRADED * max(shares, default=0.0)
    # further telling words close in on 1
    return 1 - (1 - told[0]) * math.prod(1 - 0.5 * p for p in told[1:])


def score(docs: DataFrame, model: CharacterModel, table: dict[str, float]) -> DataFrame:
    """doc_id and score for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast((model, table))  # bounded by `MODEL` and `FEATURES`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        table = reader.only
        for batch in batches:
            scores = [weigh([table[f] for f in reader.text(t.as_py() or "")]) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`, learned from labels that are not held out."""
    model = character_model(docs)
    scored = score(docs, model, word_table(docs, labels, model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
