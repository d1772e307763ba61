"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman to score what they join.

Seeds are the word trigrams and pairs of the test items that chance would hardly put in a document:
the product of their words' frequencies over all documents, times the mean length of a document,
is at most `CHANCE` (`PAIR_CHANCE` for pairs, which are there for items with every third word
changed).  A leaked passage that sits in very many documents stays a seed by that rule, which one
on document frequency would drop.  An item with fewer rare trigrams than `LEAST` keeps that many
of its rarest that do not overlap; an item of fewer words is one seed.  One Aho-Corasick pass over a document finds
its seeds; those of an item that lie near each other span a window, and the item's words are
aligned with the window's (match +2, mismatch -1, gap -1).  The score is the best alignment over
twice the item's length: 1 for a verbatim copy, about 0.63 with every fourth word replaced.

The test set crosses the network in blocks of at most `BLOCK` words, one at a time: a block's
results are written before the next one is read, so what is broadcast and held is bounded whatever
the size of the test set; each block is held against all documents.

Defined results: null or empty texts, and items without words, are in no pair.  Repeated rows
give a pair each.  Null identifiers are carried as they are.  Empty tables give no pairs.  Other
columns are carried by `decontaminate` and play no part.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 3
CHANCE = 1e-4
PAIR_CHANCE = 3e-6
LEAST = 3
#: Words of test items in one broadcast block.
BLOCK = 2_000_000
#: A pair at or above this score is a leak.
SCORE = 0.45
_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower-case words between single spaces, with one at either end."""
    return f" {_GAPS.sub(' ', text.lower()).strip()} " if text else "  "


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score and the end of its alignment in the window."""
    reach = np.arange(len(window))
    row, best, end = np.zeros(len(window), np.int64), 0, 0
    for x in item:
        t = np.where(window == x, 2, -1)
        t[1:] += row[:-1]
        t = np.maximum(np.maximum(t, row - 1), 0)
        row = np.maximum.accumulate(t + reach) - reach
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j + 1
    return best, end


class Seeds:
    """The items of one block and the automaton of their seeds."""

    def __init__(self, items: list[tuple[int | None, list[str]]], seeds: list[tuple[str, int, int]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.code: dict[str, int] = {}
        self.words = [np.array([self.code.setdefault(w, len(self.code)) for w in ws]) for _, ws in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for gram, item, at in seeds:
            places[gram].append((item, at))
        self.automaton = ahocorasick.Automaton()
        for gram, where in places.items():
            self.automaton.add_word(gram, where)
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def pairs(self, text: str | None, least: float) -> Iterator[tuple[int | None, float, int, int, int]]:
        """(item id, score, seeds, first word, words) of the document's items at or above least."""
        body = normalise(text)
        if not self.any or len(body) < 3:
            return
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, where in self.automaton.iter(body):
            for item, at in where:
                hits[item].append((end, at))
        if not hits:
            return
        words = body.split()
        ends = np.cumsum([1 + len(w) for w in words])  # the place of the space after each word
        coded = np.array([self.code.get(w, -1) for w in words])
        for item, found in hits.items():
            own, best = self.words[item], (0.0, 0, 0)
            size, spans = len(own), []
            for end, at in found:  # `at` is the place of the seed's last word in the item
                first = int(np.searchsorted(ends, end)) - at
                spans.append((first, first + size))
            spans.sort()
            slack, group = size // 2 + 2, []
            for low, high in spans:
                if group and low - slack <= group[-1][1]:
                    group[-1][1] = max(group[-1][1], high)
                else:
                    group.append([low, high])
            for low, high in group:
                # a long run of copies is cut into windows that overlap by more than an item
                step = 64 * size
                for cut in range(low, high, step):
                    a, b = max(0, cut - slack), min(len(coded), min(high, cut + step + size) + slack)
                    score, end = smith_waterman(own, coded[a:b])
                    if score > best[0]:
                        back, start = smith_waterman(own[::-1], coded[a : a + end][::-1])
                        best = (score, a + end - (start if back == score else size), a + end)
            value = best[0] / (2 * size)
            if value >= least:
                yield self.ids[item], round(value, 6), len(found), max(0, best[1]), best[2] - max(0, best[1])


_BUILT: dict[str, Seeds] = {}


def _seeds(key: str, shared) -> Seeds:
    """The automaton of a broadcast block, built once per worker."""
    if key not in _BUILT:
        if len(_BUILT) > 1:
            _BUILT.clear()
        _BUILT[key] = Seeds(*shared.value)
    return _BUILT[key]


def word_counts(docs: DataFrame, text: str, wanted: set[str]) -> tuple[Counter, int, int]:
    """Over all documents: counts of the wanted words, all words, documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, rows = Counter(), 0, 0
        for whole in batches:
            rows += whole.num_rows
            for at in range(0, whole.num_rows, 500):
                own = Counter()
                for t in whole.column(0).slice(at, 500):
                    own.update(normalise(t.as_py()).split())
                total += own.total()
                found.update({w: own[w] for w in own.keys() & shared.value})
        words = [*found, None, ""]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([*found.values(), total, rows], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r.word: r.n for r in rows})
    return counts, counts.pop(None, 0), counts.pop("", 0)


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    held, size = [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        words = normalise(r.t).split()
        if words:
            held.append((r.i, words))
            size += len(words)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def choose_seeds(items: list[tuple[int | None, list[str]]], counts: Counter, total: int, n_docs: int, chance: float) -> list[tuple[str, int, int]]:
    """(seed, item, place of its last word) for the rare n-grams of each item."""
    mean = total / max(1, n_docs)
    out = []
    for i, (_, words) in enumerate(items):

        def grams(n: int, words: list[str] = words) -> list[tuple[float, int, str]]:
            found = []
            for at in range(max(1, len(words) - n + 1)):
                own = words[at : at + n]
                p = mean
                for w in own:
                    p *= (counts[w] + 1) / (total + 1)
                found.append((p, at, f" {' '.join(own)} "))
            return sorted(found)

        ranked = grams(N)
        chosen = {at: g for p, at, g in ranked if p <= chance}
        for _, at, g in ranked:  # the rarest of the others, apart from each other
            if len(chosen) >= LEAST:
                break
            if all(abs(at - x) >= N for x in chosen):
                chosen[at] = g
        out += [(g, i, min(at + N, len(words)) - 1) for at, g in chosen.items()]
        if len(words) > 2:
            out += [(g, i, at + 1) for p, at, g in grams(2) if p <= chance * PAIR_CHANCE / CHANCE]
    return out


def _prepared(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, chance: float, most: int) -> Iterator[tuple[str, Broadcast, bool]]:
    """A broadcast for one block of the test set after another, and whether it is the only one."""
    common.ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    found = blocks(benchmark, item, item_text, most)
    ahead, only = next(found, None), True
    while ahead is not None:
        items, ahead = ahead, next(found, None)
        only = only and ahead is None
        counts, total, n_docs = word_counts(docs, text, {w for _, ws in items for w in ws})
        yield uuid.uuid4().hex, sc.broadcast((items, choose_seeds(items, counts, total, n_docs, chance))), only


def _done(df: DataFrame, shared: Broadcast, only: bool) -> DataFrame:
    """The results of one of several blocks, written, so that its broadcast can go."""
    if only:
        return df
    out = common.written(df, "test-block")
    shared.destroy()
    return out


def pairs(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = SCORE, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, seeds, first_word, n_words of every document and item that align at `least` or better."""
    slim = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    schema = "doc_id long, item_id long, score double, seeds long, first_word long, n_words long"
    out = None
    for key, shared, only in _prepared(docs, benchmark, text, item, item_text, chance, block):

        def work(batches: Iterable[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(key, shared)
            for b in batches:
                rows = [(d.as_py(), *p) for d, t in zip(b.column(0), b.column(1), strict=True) for p in seeds.pairs(t.as_py(), least)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "seeds", "first_word", "n_words"])

        found = _done(slim.mapInArrow(work, schema), shared, only)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = SCORE, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item aligns at `least` or better."""
    at, names = docs.columns.index(text), docs.columns
    left = docs
    # words are counted over all documents for every block
    for key, shared, only in _prepared(docs, benchmark, text, item, item_text, chance, block):

        def work(batches: Iterable[pa.RecordBatch], shared=shared, key=key, at=at) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(key, shared)
            for b in batches:
                b = pa.RecordBatch.from_arrays(b.columns, names=names)
                yield b.filter(pa.array([next(seeds.pairs(t.as_py(), least), None) is None for t in b.column(at)], pa.bool_()))

        left = _done(common.plain(left).mapInArrow(work, docs.schema), shared, only)
    return left
