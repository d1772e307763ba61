"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to `ORDER`, learnt from all training documents.  A byte
is looked for in the longest context that was seen; where it was not met there, the model pays an
escape (method D: each different byte met in the context gives half a count to it) and looks in
the next shorter context, in which the bytes of the longer one are excluded.
Below order 0 all bytes not met at all share what is left.  Texts are lower-cased (A-Z), words
joined by single spaces, and closed by an end symbol that is predicted like a byte.

Nothing of corpus size is broadcast or held in one task.  Documents are dealt into blocks of a
bounded number of bytes.  A block sends the different context-and-byte grams it holds, with their
training counts, to the buckets of all their context bytes but the first, and its different words
to the buckets of their hashes.  What the blocks hold of one context is at most 258 symbols a
block, so a frequent pair of letters fills no bucket.  The lower orders are tables of different
grams, which grow with the language and not with its use: a bucket adds up its grams of one order
less and sends them on, once, to low buckets by their last two context bytes.  A low bucket holds
all contexts down to order 2 that escapes reach from there (orders 1 and 0 are a table of 258 x 258
counts, broadcast) and returns for each gram what an escape to it costs.  With that the upper
bucket works out the probability of each of its grams once, and answers every block for the grams
that block asked about.  The block then adds up its documents.  Words give the unigram baseline in
the same way.

Probabilities travel as 32-bit floats, counts as 64-bit numbers.

Defined results: a null or empty text is one end symbol.  Rows with null or repeated identifiers
are scored each; a null identifier hashes like the empty text.  With no training rows the model
is uniform and N = V = 0.  An empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import Words

ORDER = 5
BITS = 9
START, END, SYMBOLS = 0, 257, 258
#: Bytes of text in a block.
BLOCK = 8 << 20
#: The fold of identifiers, of FOLDS, that is held out of training.
FOLDS, HELD_OUT = 7, 2
_END_WORD = np.uint64(0)
_WORDS = Words(100_000)


def normalised(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


# ---- packed, sorted arrays ----------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, byte by byte."""
    d = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(b.T).view(np.uint64).ravel(), dtype=np.uint64)


def numbers(values: np.ndarray) -> bytes:
    """32-bit floats, or counts in as many bytes as the largest needs, byte by byte; a first byte says which."""
    if values.dtype == np.float32:
        kind, raw = 0, values.astype("<f4").view(np.uint8).reshape(-1, 4)
    else:
        kind = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
        raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :kind]
    return bytes([kind]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unnumbers(blob: bytes) -> np.ndarray:
    kind = blob[0]
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(kind or 4, -1)
    if not kind:
        return np.ascontiguousarray(b.T).view("<f4").ravel()
    out = np.zeros((b.shape[1], 8), np.uint8)
    out[:, :kind] = b.T
    return out.view("<u8").ravel().astype(np.int64)


# ---- a block of documents -----------------------------------------------------------------


def grams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all symbols of all texts, and where each text's grams begin."""
    sizes = np.array([sum(map(len, t)) + max(0, len(t) - 1) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # order starts before each text, so no context reaches over a boundary
    line = np.zeros(int(begin[-1]) + order * len(texts), np.int64)
    keep = np.zeros(len(line), bool)
    for k, t in enumerate(texts):
        at = int(begin[k]) + order * (k + 1)
        n = int(sizes[k])
        line[at : at + n - 1] = np.frombuffer(b" ".join(t), np.uint8)
        line[at : at + n - 1] += 1
        line[at + n - 1] = END
        keep[at : at + n] = True
    packed = line.copy()
    for k in range(1, order + 1):
        packed[k:] |= line[:-k] << (BITS * k)
    return packed[keep], begin[:-1]


def counted(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs where train is set.  Sorting values is far quicker than ordering them."""
    learnt, n = np.unique(values[train], return_counts=True)
    rest = np.unique(values[~train], return_counts=True)[0]  # with counts it sorts, which is quicker here
    keys = np.unique(np.concatenate([rest, learnt]), return_counts=True)[0]
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, learnt)] = n
    return keys, counts


class Lookup:
    """An open hash table from sorted keys to numbers; absent keys are not asked for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, values.dtype)
        self.steps = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != wanted)
        for _ in range(self.steps):
            if not len(left):
                break
            at = (slot[left] + 1) & self.mask
            slot[left] = at
            out[left] = self.values[at]
            left = left[self.keys[at] != wanted[left]]
        return out


def tokens(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end word closing each text, and where each text begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(begin[-1]), np.uint64)
    keep = np.ones(len(out), bool)
    keep[begin[1:] - 1] = False
    # Arrow numbers the different words, so that only those are hashed
    coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    if len(coded):
        out[keep] = _WORDS.hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    out[~keep] = _END_WORD
    return out, begin[:-1]


def _deal(kind: str, block: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield kind, int(bucket[a]), block, squeeze(keys[a:b]), numbers(counts[a:b])


def _bucket(contexts: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """By the last `size` symbols of packed contexts."""
    own = (contexts & ((1 << BITS * size) - 1)).view(np.uint64)
    return (((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _ask(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """What a block sends: grams, words, and its order-1 counts."""
    block = table.column("block")[0].as_py()
    texts = [normalised(t.as_py()) for t in table.column("t")]
    train = np.array(table.column("train").to_pylist(), bool)
    g, at = grams(texts, order)
    sizes = np.diff(np.concatenate([at, [len(g)]]))
    keys, counts = counted(g, np.repeat(train, sizes))
    del g
    rows = list(_deal("gram", block, keys, counts, _bucket(keys >> BITS, order - 1, buckets)))
    pair = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    np.add.at(pair, ((keys >> BITS) & 511, keys & 511), counts)
    where = np.flatnonzero(pair)
    rows.append(("pair", -1, block, squeeze(where.astype(np.uint64)), numbers(pair.ravel()[where])))
    w, at = tokens(texts)
    keys, counts = counted(w, np.repeat(train, np.diff(np.concatenate([at, [len(w)]]))))
    rows += _deal("word", block, keys, counts, (keys % np.uint64(buckets)).astype(np.int64))
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "bucket", "block", "keys", "counts"])


# ---- the model ----------------------------------------------------------------------------


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """The contexts of one order, from the sorted grams met in training and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        ctx = keys >> BITS
        heads = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts, self.heads = ctx[heads], heads
        self.total = self.sums(counts)
        self.distinct = np.diff(np.concatenate([heads, [len(keys)]]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of the values of each context's grams."""
        return np.add.reduceat(values, self.heads) if len(self.heads) else np.zeros(0, np.int64)

    def of(self, wanted: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """For grams: whether their context was met, its total and distinct symbols, further values of it, and the gram's count."""
        at, seen = _find(self.contexts, wanted >> BITS)
        spot, has = _find(self.keys, wanted)
        return seen, *(np.where(seen, v[at] if len(v) else 0, 0) for v in (self.total, self.distinct, *values)), np.where(has, self.counts[spot] if len(self.counts) else 0, 0)


class Coder:
    """The state of an escape down the orders, for many grams at a time."""

    def __init__(self, n: int):
        self.p, self.open = np.zeros(n), np.ones(n, bool)
        self.seen, self.taken, self.distinct = np.zeros(n, bool), np.zeros(n), np.zeros(n)

    def enter(self, seen: np.ndarray, taken: np.ndarray, distinct: np.ndarray) -> None:
        """What the context just left excludes in the next: the weight its symbols have there, and their number."""
        self.seen, self.taken, self.distinct = seen, taken, distinct

    def step(self, seen: np.ndarray, total: np.ndarray, distinct: np.ndarray, count: np.ndarray) -> None:
        left = total - np.where(self.seen, self.taken, 0)
        new = distinct - np.where(self.seen, self.distinct, 0)
        live = self.open & seen & (new > 0)
        hit, miss = live & (count > 0), live & (count == 0)
        self.p[hit] += np.log10((2 * count[hit] - 1) / (2 * left[hit]))
        self.p[miss] += np.log10(new[miss] / (2 * left[miss]))
        self.open &= ~hit


def _met(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys[counts > 0], counts[counts > 0]


def tails(keys: np.ndarray, counts: np.ndarray, pair: np.ndarray, size: int) -> np.ndarray:
    """For grams of `size` context symbols: what the orders below cost, once their own context is escaped from or was not met."""
    own_keys, own_counts = _met(keys, counts)
    single = pair.sum(axis=0)
    coder, above = Coder(len(keys)), Level(own_keys, own_counts)
    for k in range(size - 1, -1, -1):
        # leave the context above, then look into the one of order k
        mask = (1 << BITS * (k + 1)) - 1
        if k >= 2:
            level = Level(*_totals(own_keys & mask, own_counts))
            at, _ = _find(level.keys, above.keys & mask)
            share = above.sums(level.counts[at] if len(level.counts) else np.zeros(0, np.int64))
        elif k == 1:
            level, share = None, above.sums(pair[(above.keys >> BITS) & 511, above.keys & 511])
        else:
            level, share = None, ((pair > 0) * single).sum(axis=1)
        if above is not None:
            seen, _, distinct, taken, _ = above.of(keys & ((1 << BITS * (k + 2)) - 1), share)
        else:
            c1 = (keys >> BITS) & 511
            distinct, taken = (pair > 0).sum(axis=1)[c1], share[c1]
            seen = distinct > 0
        coder.enter(seen, taken, distinct)
        if k >= 2:
            seen, total, distinct, count = level.of(keys & mask)
        elif k == 1:
            c1 = (keys >> BITS) & 511
            total, distinct, count = pair.sum(axis=1)[c1], (pair > 0).sum(axis=1)[c1], pair[c1, keys & 511]
            seen = total > 0
        else:
            total, distinct, count = np.full(len(keys), single.sum()), np.full(len(keys), (single > 0).sum()), single[keys & 511]
            seen = total > 0
        coder.step(seen, total, distinct, count)
        above = level
    if (single > 0).sum() < 257:
        coder.p[coder.open] -= math.log10(257 - (single > 0).sum())
    return coder.p


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray, tail: np.ndarray, order: int) -> np.ndarray:
    """Of grams of `order` context symbols, given all grams of their contexts of one symbol less and what an escape to those costs."""
    mask = (1 << BITS * order) - 1
    top, low = Level(*_met(keys, counts)), Level(*_met(low_keys, low_counts))
    coder = Coder(len(keys))
    at, _ = _find(low.keys, top.keys & mask)
    share = top.sums(low.counts[at] if len(low.counts) else np.zeros(0, np.int64))
    seen, total, distinct, taken, count = top.of(keys, share)
    coder.step(seen, total, distinct, count)
    coder.enter(seen, taken, distinct)
    seen, total, distinct, count = low.of(keys & mask)
    coder.step(seen, total, distinct, count)
    at, _ = _find(low_keys, keys & mask)
    coder.p[coder.open] += tail[at[coder.open]]
    return coder.p


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row, and all keys with their counts added up."""
    parts = [unsqueeze(k.as_py()) for k in table.column("keys")]
    keys, counts = _totals(np.concatenate(parts), np.concatenate([unnumbers(c.as_py()) for c in table.column("counts")]))
    return parts, keys, counts


def _down(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """A bucket's different grams of one order less, for the low buckets of their last two context symbols."""
    _, keys, counts = _summed(table)
    keys, counts = _totals(keys.astype(np.int64) & ((1 << BITS * order) - 1), counts)
    own = table.column("bucket")[0].as_py()
    rows = [(b, own, k, c) for _, b, _, k, c in _deal("", 0, keys.view(np.uint64), counts, _bucket(keys >> BITS, 2, buckets))]
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["low", "bucket", "keys", "counts"])


def _low(table: pa.Table, pair: np.ndarray, order: int) -> pa.Table:
    """A low bucket's replies to upper buckets: their grams, counts, and what an escape costs."""
    parts, keys, counts = _summed(table)
    tail = tails(keys.astype(np.int64), counts, pair, order - 1).astype(np.float32)
    rows = []
    for b, own, c in zip(table.column("bucket").to_pylist(), parts, table.column("counts").to_pylist(), strict=True):
        rows.append((b, squeeze(own), c, numbers(tail[np.searchsorted(keys, own)])))
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "keys", "counts", "tail"])


def _answer(asked: pa.Table, low: pa.Table, order: int) -> pa.Table:
    """An upper bucket's replies: per block, its grams with log10 probabilities."""
    parts, keys, counts = _summed(asked)
    low_keys = np.concatenate([unsqueeze(k.as_py()) for k in low.column("keys")]).astype(np.int64)
    by = np.argsort(low_keys, kind="stable")
    low_counts, tail = (np.concatenate([unnumbers(c.as_py()) for c in low.column(name)])[by] for name in ("counts", "tail"))
    value = log10_probabilities(keys.astype(np.int64), counts, low_keys[by], low_counts, tail, order).astype(np.float32)
    rows = [("gram", b, squeeze(own), numbers(value[np.searchsorted(keys, own)])) for b, own in zip(asked.column("block").to_pylist(), parts, strict=True)]
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "block", "keys", "value"])


def _answer_words(table: pa.Table) -> pa.Table:
    """A word bucket's replies: per block, its words with their counts."""
    parts, keys, counts = _summed(table)
    rows = [("word", b, squeeze(own), numbers(counts[np.searchsorted(keys, own)])) for b, own in zip(table.column("block").to_pylist(), parts, strict=True)]
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "block", "keys", "value"])


def _gather(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [(unsqueeze(k.as_py()), unnumbers(v.as_py())) for t, k, v in zip(table.column("kind"), table.column("keys"), table.column("value"), strict=True) if t.as_py() == kind]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32 if kind == "gram" else np.int64)
    keys, values = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _add_up(docs: pa.Table, replies: pa.Table, order: int) -> pa.Table:
    """Scores of a block's documents from the replies to it."""
    gram_keys, gram_values = _gather(replies, "gram")
    gram_keys = gram_keys.astype(np.int64)
    word_keys, word_counts = _gather(replies, "word")
    of_gram, of_word = Lookup(gram_keys, gram_values), Lookup(word_keys.view(np.int64), word_counts)
    out: list[list] = [[] for _ in range(5)]
    n, at = docs.num_rows, 0
    column = docs.column("t")
    while at < n:  # some megabytes at a time
        texts, size = [], 0
        while at + len(texts) < n and size < 1 << 20:
            texts.append(normalised(column[at + len(texts)].as_py()))
            size += sum(map(len, texts[-1])) + 64
        g, begin = grams(texts, order)
        out[4] += np.add.reduceat(of_gram[g].astype(np.float64), begin).tolist()
        w, begin = tokens(texts)
        c = of_word[w.view(np.int64)]
        out[1] += np.diff(np.concatenate([begin, [len(w)]])).tolist()
        out[2] += np.add.reduceat((c > 0).astype(np.int64), begin).tolist()
        out[3] += np.add.reduceat(np.log10(c + 1), begin).tolist()
        at += len(texts)
    return pa.table([docs.column("doc_id"), docs.column("held_out"), *(pa.array(x) for x in out[1:])], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    common.ship(spark)
    if order < 3:
        raise ValueError("the order is 3 at least")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes), min(spark.sparkContext.defaultParallelism, int(size) >> 20))
    # a block sends a row to each bucket, so buckets grow more slowly than blocks where there are thousands
    buckets = min(blocks, 64 * math.isqrt(blocks) + 64)
    base = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    base = base.withColumn("held_out", common.fold_of(F.col("doc_id"), folds) == held_out)
    base = base.select("doc_id", "t", "held_out", (~F.col("held_out")).alias("train"), F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)).alias("block"))
    # as many partitions as blocks and buckets, so that a task's share does not grow with the corpus
    asked_path = common.scratch_path(spark, "grams")
    asked = "kind string, bucket long, block long, keys binary, counts binary"
    with common.tidy(spark):
        base.repartition(blocks, "block").groupBy("block").applyInArrow(lambda t: _ask(t, order, buckets), asked).write.partitionBy("kind").parquet(asked_path)
    sent = spark.read.schema(asked).parquet(asked_path)

    def totals(t: pa.Table) -> pa.Table:
        _, keys, counts = _summed(t)
        return pa.table({"v": [int((counts > 0).sum())], "n": [int(counts.sum())]})

    known = sent.where("kind = 'word'").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(totals, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    def pairs(t: pa.Table) -> pa.Table:
        _, keys, counts = _summed(t)
        return pa.table({"k": keys.astype(np.int64), "n": counts})

    # at most 258 x 258 rows come to the driver and go out again
    few = sent.where("kind = 'pair'").withColumn("part", F.pmod("block", F.lit(64))).groupBy("part").applyInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    table[few["k"].to_numpy(np.int64)] = few["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table.reshape(SYMBOLS, SYMBOLS))
    asked_grams = sent.where("kind = 'gram'").select("bucket", "block", "keys", "counts")
    # grams of different contexts only, once each, so few bytes for a low bucket; a fixed number of those keeps rows in step with upper buckets
    lows = min(buckets, 256)
    down = asked_grams.select("bucket", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _down(t, order, lows), "low long, bucket long, keys binary, counts binary")
    low = down.repartition(lows, "low").groupBy("low").applyInArrow(lambda t: _low(t, shared.value, order), "bucket long, keys binary, counts binary, tail binary")
    reply = "kind string, block long, keys binary, value binary"
    replies = asked_grams.repartition(buckets, "bucket").groupBy("bucket").cogroup(low.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(lambda a, b: _answer(a, b, order), reply)
    replies = replies.unionByName(sent.where("kind = 'word'").select("kind", "bucket", "block", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer_words, reply))
    added = base.repartition(blocks, "block").groupBy("block").cogroup(replies.repartition(blocks, "block").groupBy("block")).applyInArrow(lambda a, b: _add_up(a, b, order), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return added.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(known.n)).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(known.n + known.v + 1))).alias("base_score"), "score")


class Trie:
    """The same model, symbol by symbol: for adaptive coding of one text, and to test against."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], dict[int, int]] = defaultdict(lambda: defaultdict(int))

    @staticmethod
    def symbols(raw: bytes | None) -> list[int]:
        return [b + 1 for b in b" ".join(normalised(raw))] + [END]

    def _context(self, past: list[int]) -> tuple[int, ...]:
        return tuple(([START] * self.order + past)[len(past) :]) if self.order else ()

    def learn(self, past: list[int], symbol: int) -> None:
        context = self._context(past)
        for k in range(self.order + 1):
            self.counts[context[self.order - k :]][symbol] += 1

    def log10(self, past: list[int], symbol: int) -> float:
        context, out, excluded = self._context(past), 0.0, set()
        for k in range(self.order, -1, -1):
            found = self.counts.get(context[self.order - k :])
            if not found:
                continue
            rest = {s: n for s, n in found.items() if s not in excluded}
            if not rest:
                continue
            whole = 2 * sum(rest.values())
            if symbol in rest:
                return out + math.log10((2 * rest[symbol] - 1) / whole)
            out += math.log10(len(rest) / whole)
            excluded = set(found)
        return out - math.log10(257 - len(excluded))

    def text(self, raw: bytes | None, adapt: bool = False) -> float:
        """log10 probability of a text; with `adapt`, the model learns as it goes."""
        past, total = [], 0.0
        for s in self.symbols(raw):
            total += self.log10(past, s)
            if adapt:
                self.learn(past, s)
            past.append(s)
        return total


def adaptive(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """docs with adaptive_log10: each text coded by a model that starts empty and learns from it."""
    common.ship(docs.sparkSession)
    carried = [c for c in docs.columns if c != "adaptive_log10"]
    slim = docs.select(*[F.col(common.quoted(c)) for c in carried], F.col(text).cast("binary").alias(common.fresh(carried, "raw")))

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([Trie(order).text(t.as_py(), True) for t in b.column(b.num_columns - 1)], pa.float64())], names=[*carried, "adaptive_log10"])

    return common.plain(slim).mapInArrow(work, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "adaptive_log10 double"]))
