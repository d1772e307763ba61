"""Repeated substrings by suffix arrays.

Bytes covered by a string of `LENGTH` bytes that also starts elsewhere are removed.  A suffix array
over all text would cross the network many times over; this one covers what can matter:

1. Every window of LENGTH bytes is owned by the anchor in it whose k-gram hash is least (leftmost
   of equals), so equal windows are owned by equal anchors, and an anchor owns a run of windows.
   One pass gives an anchor per 85 bytes or so: hash, place, run, and a digest of the run's bytes.
2. An anchor hash that occurs once owns nothing repeated.  Of those that recur, runs whose digest
   recurs are repeated as a whole.  What is left is at the edges of repeated passages.
3. The bytes of one run per digest of such hashes are dealt by hash and cut into shards.  Each shard
   gets a suffix array (Larsson-Sadakane refinement: only groups not yet in order are sorted, by
   the ranks found so far, doubling the depth) and the common prefixes of neighbours (Kasai,
   all runs in step).  A hash whose runs fill several shards is merged across them by binary
   search of its windows in the earlier shards' arrays.
4. A hash with more than `HOT` different runs would fill one task; its windows are counted by
   128-bit digests instead, which spreads them over all tasks.

Defined results: a null text is empty.  Texts below LENGTH bytes lose nothing.  Rows are known by
identifier and text hash; a row that repeats both is another place of the same strings, so both
lose them.  Null identifiers are a value like others.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 32
SHARD = 1 << 20
HOT = 20_000
_U = np.uint64
_RNG = np.random.default_rng(20240411)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams; k is a power of two."""
    h, step = _BYTE[text], 1
    base = _BASE
    while step < k:
        h = h[:-step] * base + h[step:]
        base = base * base
        step *= 2
    return _mix(h)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def anchors(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, hash, first window, windows, digest of each anchor's run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    if len(text) < length:
        return none
    with np.errstate(over="ignore"):
        h = gram_hashes(text, k)
        key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span, least = length - k + 1, key
        step = 1
        while 2 * step <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        rest = span - step
        least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & _U(0xFFFFFFFF)).astype(np.int64)  # of the owner of each window
        whole = np.zeros(len(place), bool)
        owner = np.zeros(len(place), np.int64)
        for d, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            whole[a : max(a, b - length + 1)] = True
            owner[a:b] = d
        at = np.flatnonzero(whole)
        if not len(at):
            return none
        p, d = place[at], owner[at]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
        low, n = at[first], np.diff(np.concatenate([first, [len(at)]]))
        high = low + n - 1 + length
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[text] * _powers(_BASE, len(text) - 1)[: len(text)], dtype=np.uint64)])
        digest = _mix((sums[high] - sums[low]) * _powers(_INVERSE, len(text))[low] + n.astype(np.uint64))
        return d[first], h[p[first]], low - begin[d[first]], n, digest


def _slabs(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    at, texts, held = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        raw = t.as_py() or b""
        texts.append(raw)
        held += len(raw)
        if held >= size:
            yield at, texts
            at, texts, held = i + 1, [], 0
    if texts:
        yield at, texts


def _find_anchors(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at, texts in _slabs(b, 2):
            ends = np.cumsum([len(t) for t in texts])
            d, h, low, n, digest = anchors(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, length)
            yield pa.record_batch([pa.array(x) for x in (h.view(np.int64), k1[d + at], k2[d + at], low.astype(np.int32), n.astype(np.int32), digest.view(np.int64))], names=["h", "k1", "k2", "low", "n", "digest"])


# ---- suffix arrays ------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `depth` bytes at least, and the rank of each."""
    n = len(text)
    wide = _words(text)
    order = np.argsort(wide, kind="stable")
    ranks = np.zeros(n + 2 * depth + 16, np.int64)  # beyond the end: rank 0, the least
    s = wide[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    # a suffix that ends within the eight bytes differs from one padded alike by a zero byte
    tail = order > n - 8
    head |= tail
    head[1:] |= tail[:-1]
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks[order] = starts + 1
    step = 8
    while step < depth:
        same = np.concatenate([~head, [False]])
        open_ = same[:-1] | same[1:]  # members of groups of more than one
        where = np.flatnonzero(open_)
        if not len(where):
            break
        members = order[where]
        group, key = ranks[members], ranks[members + step]
        by = np.lexsort((key, group))
        members, group, key = members[by], group[by], key[by]
        order[where] = members
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        head[where] |= new
        starts = np.maximum.accumulate(np.where(new, where, 0))
        ranks[members] = starts + 1
        step *= 2
    return order, ranks[:n]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a big-endian number; zero beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(text)].astype(np.uint64)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for the first `count` places of each run, which are those in `order`, the longer common prefix
    with the two neighbours, up to `most`.

    The prefix shared with the neighbour before shrinks by one at most from a place to the next, if the
    place after that neighbour is in the order too and on the same side; else nothing is carried over
    (a neighbour can be the last window of its run, and places alike to the full depth stand in any order).
    All runs advance together, eight bytes a comparison.
    """
    n, m = len(text), len(order)
    at_rank = np.full(n + 1, -1, np.int64)
    at_rank[order] = np.arange(m)
    wide = np.concatenate([_words(text), np.zeros(most + 16, np.uint64)])
    out = np.zeros(n, np.int64)
    for side in (-1, 1):
        held, met = np.zeros(len(begin), np.int64), np.full(len(begin), n - 1)
        for t in range(int(count.max()) if len(count) else 0):
            runs = np.flatnonzero(count > t)
            i = begin[runs] + t
            r = at_rank[i] + side
            fine = (r >= 0) & (r < m)
            j = order[np.clip(r, 0, m - 1)]
            after = at_rank[met[runs] + 1]
            h = np.maximum(held[runs] - 1, 0)
            h[~fine | (after < 0) | ((after - at_rank[i]) * side <= 0)] = 0
            room = np.minimum(most, n - np.maximum(i, j))
            live = np.flatnonzero(fine & (h < room))
            while len(live):
                x = wide[i[live] + h[live]] ^ wide[j[live] + h[live]]
                zero = x == 0
                # leading equal bytes of words that differ
                lead = np.where(zero, 8, (7 - (np.frexp(np.maximum(x, _U(1)).astype(np.float64))[1] - 1) // 8))
                # rounding up to a power of two can hide one byte; look again at that byte
                over = ~zero & (x >> (_U(8) * np.maximum(7 - lead, 0).astype(np.uint64)) == 0)
                lead = np.where(over, lead + 1, lead)
                h[live] = np.minimum(h[live] + lead, room[live])
                live = live[zero & (h[live] < room[live])]
            held[runs], met[runs] = h, j
            out[i] = np.maximum(out[i], h)
    return out


class Shard:
    """Runs of bytes with their owned windows, and which windows are found elsewhere."""

    def __init__(self, rows: list[tuple], length: int):
        self.rows, self.length = rows, length
        sizes = np.array([len(r[5]) for r in rows])
        self.begin = np.cumsum(sizes) - sizes
        self.count = np.array([r[4] for r in rows])
        self.text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        own = np.zeros(len(self.text), bool)
        for b, c in zip(self.begin.tolist(), self.count.tolist(), strict=True):
            own[b : b + c] = True
        # other suffixes reach over the end of their run, so only owned windows are neighbours
        order, _ = suffix_array(self.text, length)
        self.order = order[own[order]]
        self.shared = common_prefixes(self.text, self.order, self.begin, self.count, length) >= length

    def merge(self, other: Shard, hashes: set[int]) -> None:
        """Mark windows of `hashes` found in both: binary search in the other's suffix array."""
        mine = self._places(hashes)
        theirs = other.order[np.isin(other.order, other._places(hashes))]
        if not len(mine) or not len(theirs):
            return
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        own = np.lib.stride_tricks.sliding_window_view(self.text, self.length)
        far = np.lib.stride_tricks.sliding_window_view(other.text, other.length)
        for at in range(0, len(mine), 20_000):
            part = slice(at, at + 20_000)
            a, b, w = low[part], high[part], own[mine[part]]
            while (live := np.flatnonzero(a < b)).size:
                mid = (a[live] + b[live]) // 2
                x, y = w[live], far[theirs[mid]]
                differ = x != y
                first = differ.argmax(axis=1)
                rows = np.arange(len(live))
                less = differ[rows, first] & (y[rows, first] < x[rows, first])
                a[live] = np.where(less, mid + 1, a[live])
                b[live] = np.where(less, b[live], mid)
            low[part] = a
        # equal windows lie side by side from low on; marking the first marks the class, as neighbours share
        hit = low < len(theirs)
        same = np.zeros(len(mine), bool)
        for at in range(0, len(mine), 20_000):
            part = np.flatnonzero(hit[at : at + 20_000]) + at
            same[part] = (own[mine[part]] == far[theirs[low[part]]]).all(axis=1)
        self.shared[mine[same]] = True
        other.shared[theirs[low[same]]] = True

    def _places(self, hashes: set[int]) -> np.ndarray:
        runs = [k for k, r in enumerate(self.rows) if r[0] in hashes]
        return np.concatenate([np.arange(self.begin[k], self.begin[k] + self.count[k]) for k in runs] or [np.zeros(0, np.int64)])

    def spans(self) -> Iterator[tuple]:
        """(k1, k2, first byte, byte after) of repeated windows."""
        for k, (_, k1, k2, low, n, _) in enumerate(self.rows):
            got = np.flatnonzero(self.shared[self.begin[k] : self.begin[k] + n])
            if len(got):
                cut = np.flatnonzero(np.diff(got) > 1)
                for a, b in zip(got[np.concatenate([[0], cut + 1])].tolist(), got[np.concatenate([cut, [len(got) - 1]])].tolist(), strict=True):
                    yield k1, k2, low + a, low + b + self.length


_SPAN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _shards(batches: Iterable[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash.  A hash that fills more than a shard is merged over its shards."""
    waiting: list[Shard] = []  # earlier shards of the hash now being read
    rows: list[tuple] = []
    held = 0

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, held, waiting
        if rows:
            s = Shard(rows, length)
            first = rows[0][0]
            for w in waiting:
                s.merge(w, {first})
            waiting.append(s)
        if last:
            found = [x for w in waiting for x in w.spans()]
            waiting = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _SPAN, strict=True)], schema=_SPAN)
        rows, held = [], 0

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if held >= size:
                # the shard ends here; if the hash goes on, its shards wait for each other
                yield from close(row[0] != rows[-1][0])
            elif rows and waiting and row[0] != rows[-1][0]:
                yield from close(True)
            rows.append(row)
            held += len(row[5])
    yield from close(True)


def _cut(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    for b in batches:
        rows = []
        for k1, k2, t, wanted in zip(*(b.column(i) for i in range(4)), strict=True):
            if wanted.is_valid and len(wanted):
                raw = t.as_py()
                for w in wanted.as_py():
                    rows.append((w["h"], k1.as_py(), k2.as_py(), w["low"], w["n"], raw[w["low"] : w["low"] + w["n"] - 1 + length], w["hot"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["h", "k1", "k2", "low", "n", "body", "hot"])


def _windows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of a hot hash by a 128-bit digest, in two numbers."""
    raw: list[bytes] = []
    owners: list[tuple[int, int, int, int]] = []

    def flush() -> pa.RecordBatch:
        x = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        k1, k2, low, n = (np.array(c, np.int64) for c in zip(*owners, strict=True))
        first = np.cumsum(n) - n
        places = np.arange(len(x)) - np.repeat(first, n) + np.repeat(low, n)
        out = pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.repeat(k1, n)), pa.array(np.repeat(k2, n)), pa.array(places.astype(np.int32))], names=["w1", "w2", "k1", "k2", "low"])
        raw.clear()
        owners.clear()
        return out

    for b in batches:
        for k1, k2, low, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            n = len(body) - length + 1
            raw.extend(hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n))
            owners.append((k1, k2, low, n))
            if len(raw) > 50_000:
                yield flush()
    if raw:
        yield flush()


def _finish(batches: Iterable[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for ident, t, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
            raw, removed, runs, kept, at = t.as_py() or b"", 0, 0, [], 0
            if spans.is_valid and len(spans):
                a, e = (spans.values.field(i).to_numpy() for i in (0, 1))
                by = np.argsort(a, kind="stable")
                a, e = a[by], np.maximum.accumulate(e[by])
                new = np.concatenate([[True], a[1:] > e[:-1]])
                for lo, hi in zip(a[new].tolist(), e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])].tolist(), strict=True):
                    kept.append(raw[at:lo])
                    removed, runs, at = removed + hi - lo, runs + 1, hi
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((ident.as_py(), len(raw), removed, runs, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else [])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every document."""
    spark = docs.sparkSession
    common.ship(spark)
    raw = docs.select(F.coalesce(F.col(ident).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.col(ident).cast("long").alias("doc_id"), common.text_of(text).cast("binary").alias("t")).withColumn("k2", F.xxhash64("t")).select("k1", "k2", "doc_id", "t")
    schema = "h long, k1 long, k2 long, low int, n int, digest long"
    found = common.written(raw.select("k1", "k2", "t").mapInArrow(lambda it: _find_anchors(it, length), schema), "anchors")
    # hashes that recur; those with one digest need no bytes
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("rows > 1").select("h", (F.col("d0") != F.col("d1")).alias("mixed"))
    rep = common.written(found.join(again, "h"), "repeated")
    by_run = rep.where("mixed").groupBy("h", "digest").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "low", "n")).alias("one"))
    # few hashes are hot, so their table is small and no task gets all runs of one by a join
    many = by_run.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > hot).select("h", F.lit(True).alias("hot"))
    several = by_run.where("m > 1").select("h", "digest")
    whole = rep.where("not mixed").select("k1", "k2", "low", "n").unionByName(rep.where("mixed").join(several, ["h", "digest"], "left_semi").select("k1", "k2", "low", "n"))
    whole = whole.select("k1", "k2", F.col("low").alias("a"), (F.col("low") + F.col("n") - 1 + length).cast("int").alias("b"))
    wanted = by_run.join(many, "h", "left").select("h", F.coalesce("hot", F.lit(False)).alias("hot"), "one.*").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "low", "n", "hot")).alias("wanted"))
    # both joins with the texts deal them alike, so their shuffle is made once
    cut = raw.join(wanted, ["k1", "k2"], "left").select("k1", "k2", "t", "wanted").mapInArrow(lambda it: _cut(it, length), "h long, k1 long, k2 long, low int, n int, body binary, hot boolean")
    cold = cut.where("not hot").select("h", "k1", "k2", "low", "n", "body").repartition("h").sortWithinPartitions("h", "k1", "k2", "low")
    edges = cold.mapInArrow(lambda it: _shards(it, length, shard), "k1 long, k2 long, a int, b int")
    each = cut.where("hot").select("k1", "k2", "low", "body").mapInArrow(lambda it: _windows(it, length), "w1 long, w2 long, k1 long, k2 long, low int")
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    warm = each.join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", F.col("low").alias("a"), (F.col("low") + length).cast("int").alias("b"))
    # rows that repeat as a whole tell the same spans, which are kept once
    spans = whole.unionByName(edges).unionByName(warm).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return raw.join(spans, ["k1", "k2"], "left").select("doc_id", "t", "spans").mapInArrow(lambda it: _finish(it, keep_text), out)
