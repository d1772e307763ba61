"""Fuzzy line de-duplication by SimHash.

Lines are normalised (lower case, digits as 0, all else but letters as single spaces).  Equal lines
become one row by a 128-bit digest before anything else.  Each different line has a SimHash of
eight blocks of 32 bits.  A word votes in one block only, which its last two letters pick, so that
an edit moves the block of its word and leaves the others as they are; votes weigh the square of a
word's letters (up to twelve), so long words decide and short ones take part.  Letters of scripts
without blanks are words of their own; words of more than `LONG` letters are cut where a hash of
two letters says so.

Lines are joined on blocks that are equal (pigeonhole: fewer edited words than blocks leave one
whole).  Long lines are joined on each block, lines of some words on each of four pairs of blocks,
lines of few words on the six pairs of those pairs, so that a key holds enough words at every
length; the ranges overlap, as an edit can change the number of words.  A key whose blocks hold too
few letters beyond the second of their words says nothing and is left out.  Lines below `FEW` words and up to `SHORT`
letters are joined on what is left without any one letter, or none.

A bucket is not paired up.  Its least line leads and is held against the others; the links found
make components; lines of a bucket that are in different components then meet in blocks of rows,
spread over tasks, where their hashes are compared.  Pairs at most `BITS` bits apart and close
enough in length go to the edit distance: a link has 1 - Levenshtein / longer length >= `SIMILARITY`.
Pairs of the second kind never leave a task: lines that are near another bring their texts to the blocks of their
buckets, a pair is tried in the first bucket it shares and while no link has joined its components, and links come out.
Of each component the occurrence with the least (identifier, line number) stays.

Style: the pass that reads all text is numpy in an Arrow function, the edit distance bit vectors in
another; joins, bucket by bucket, and components are DataFrame functions.  In DataFrame functions alone
the pass over texts took twice to four times its limit (README).

Defined results: a null text has no lines, an empty one has one blank line.  Blank lines, and
lines without letters or digits, belong to no group and stay.  Null identifiers sort before
others, and repeated rows are further occurrences; rows that repeat an identifier with another text
are documents of their own, ordered by the hash of the text.  Very long lines are worked on whole.
Empty tables give empty results; other columns play no part, and `rewrite` carries them whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, led

SIMILARITY = 0.85
BLOCKS, BLOCK_BITS = 8, 32
#: Most differing bits of 256: unrelated lines that share a block differ in 100 or so; of pairs beyond 60 one in fifteen is a link, and of those with a tenth of their words edited one in a hundred lies there.
BITS = 60
#: Words of lines joined on single blocks, on pairs, and on pairs of pairs; fewest letters in a key, where two of each word do not count (and a letter that is a word does, twice).
LEVELS = ((40, 1 << 30, 8), (6, 56, 7), (1, 32, 8))
#: Lines of fewer words, and at most so many letters, are joined on all they leave without one letter.
FEW, SHORT = 8, 64
LONG = 24
#: Rows of a bucket that meet in a task: a block against a block.
ROWS = 4_096
#: The same where their texts meet.
TEXT_ROWS = 512
#: Characters worked on at a time, where no text is longer.
SLAB = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BLANK, _END = 32, 10


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """What each code point becomes: a lower-case letter, 0 for the ten digits, the line end, or a blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if (t := chr(c)).isalpha():
            out[c] = ord(t.lower()[0])
    out[48:58] = 48
    out[_END] = _END
    return out


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full((1 << bits) - 1, base, np.uint64)]), dtype=np.uint64)


def _power(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(16, int(n).bit_length()))[:n]


def _alone(x: np.ndarray) -> np.ndarray:
    """South-East Asian, Chinese and Japanese letters, which stand for words; Korean words have blanks."""
    return ((x >= 0x2E80) & ((x < 0xAC00) | (x > 0xD7A3))) | ((x >= 0x0E00) & (x < 0x0F00)) | ((x >= 0x1000) & (x < 0x10A0)) | ((x >= 0x1780) & (x < 0x1800))


def _words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and which characters are letters."""
    letter = (x != _BLANK) & (x != _END)
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    if len(x) and x.max() >= 0x0E00:
        alone = _alone(x) & letter
        start |= alone
        start[1:] |= letter[1:] & alone[:-1]

    def ends() -> np.ndarray:
        return np.flatnonzero(letter & ~np.concatenate([letter[1:] & ~start[1:], [False]])) + 1

    s, e = np.flatnonzero(start), ends()
    long = np.flatnonzero(e - s > LONG)
    if len(long):
        for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True):
            y = x[a:b].astype(np.uint64)
            start[a + 1 + np.flatnonzero(_mix(y[1:] * _U(0x10001) + y[:-1]) % _U(6) == 0)] = True
        s, e = np.flatnonzero(start), ends()
    return s, e, letter


def _codes(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _normal(x: np.ndarray, letter: np.ndarray) -> list[str]:
    """The normalised lines: letters, and a blank after each run of them."""
    keep = letter | (x == _END)
    keep[1:] |= letter[:-1]
    return [t.rstrip(" ") for t in x[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\n")]


def normalised(line: str) -> str:
    x = _codes(line.replace("\n", " "))
    return _normal(x, (x != _BLANK) & (x != _END))[0]


def signatures(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of a text: normalised line, words, SimHash (a row of blocks), letters beyond the second of words by block."""
    x = _codes(text)
    s, e, letter = _words(x)
    n = int((x == _END).sum()) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum((x.astype(np.uint64) + _U(0x9E37)) * _power(_BASE, len(x)), dtype=np.uint64)])
        h = _mix((sums[e] - sums[s]) * _power(_INVERSE, len(x) + 1)[s])
        size = e - s
        last = x[e - 1].astype(np.uint64) + np.where(size > 1, x[np.maximum(e - 2, 0)], 0).astype(np.uint64) * _U(0x10001)
        block = (_mix(last * _BASE) >> _U(61)).astype(np.int64)
    line = np.searchsorted(np.flatnonzero(x == _END), s)
    cell, cells = line * BLOCKS + block, n * BLOCKS
    weight = np.minimum(size, 12).astype(np.float64) ** 2
    total = np.bincount(cell, weight, cells)
    out = np.zeros(cells, np.uint32)
    # two bits to a sum: both fit a double's 53 bits while a block's weight is below 2^26
    two = 2 if not len(total) or total.max() < 1 << 26 else 1
    for k in range(0, BLOCK_BITS, two):
        vote = ((h >> _U(k + 20)) & _U(1)).astype(np.float64)
        if two == 2:
            vote += ((h >> _U(k + 21)) & _U(1)).astype(np.float64) * (1 << 26)
        low = np.bincount(cell, weight * vote, cells).astype(np.float64)
        if two == 2:
            high = np.floor(low / (1 << 26))
            low -= high * (1 << 26)
            out |= (2 * high > total).astype(np.uint32) << np.uint32(k + 1)
        out |= (2 * low > total).astype(np.uint32) << np.uint32(k)
    mass = np.bincount(cell, np.where(_alone(x[s]), 2, np.maximum(size - 2, 0)), cells)
    return _normal(x, letter), np.bincount(line, minlength=n), out.reshape(n, BLOCKS), np.minimum(mass, 255).astype(np.uint8).reshape(n, BLOCKS)


_LINES = "doc_id long, tie long, line_no int, key binary, chars int, words int, s0 long, s1 long, s2 long, s3 long, mass long, short string"
_SIG = ["s0", "s1", "s2", "s3"]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LINES for (doc_id, tie, text)."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        norm, words, sig, mass = signatures("\n".join(texts))
        counts = np.array([t.count("\n") + 1 for t in texts])
        number = np.arange(len(norm)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, ties = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
        own = pa.array(np.repeat(np.arange(len(rows)), counts))
        key = [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() if t else None for t in norm]
        short = [t if 0 < w < FEW and len(t) <= SHORT else None for t, w in zip(norm, words.tolist(), strict=True)]
        cols = [ids.take(own), ties.take(own), pa.array(number, pa.int32()), pa.array(key, pa.binary()), pa.array(list(map(len, norm)), pa.int32()), pa.array(words, pa.int32()), *(pa.array(c) for c in sig.view(np.int64).T), pa.array(mass.view(np.int64).ravel()), pa.array(short, pa.string())]
        return pa.record_batch(cols, names=["doc_id", "tie", "line_no", "key", "chars", "words", *_SIG, "mass", "short"])

    for b in batches:
        rows, held = [], 0
        for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if not t.is_valid:
                continue
            rows.append((i, k, t.as_py()))
            held += len(rows[-1][2]) + 1
            if held > SLAB:
                yield work(rows)
                rows, held = [], 0
        if rows:
            yield work(rows)


def bucket_keys(words: np.ndarray, sig: np.ndarray, mass: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, whether they count) of each kind of key, for rows of lines."""
    sig, mass = sig.astype(np.uint64), mass.astype(np.int64)
    singles = [(k,) for k in range(BLOCKS)]
    pairs = [(k, k + BLOCKS // 2) for k in range(BLOCKS // 2)]
    out = []
    for (low, high, least), kinds in zip(LEVELS, (singles, pairs, [a + b for a, b in combinations(pairs, 2)]), strict=True):
        for blocks in kinds:
            key = np.full(len(sig), 1 + sum(1 << b for b in blocks), np.uint64)
            for b in blocks:
                key = _mix(key * _BASE + sig[:, b])
            out.append((key, (words >= low) & (words <= high) & (mass[:, list(blocks)].sum(axis=1) >= least)))
    return out


def _without(text: str, similarity: float) -> set[int]:
    """Hashes of a short line and of all it leaves without one letter; only itself where an edit is too much."""
    out = {text}
    if (len(text) + 1) * (1 - similarity) + 1e-9 >= 1:
        out |= {text[:i] + text[i + 1 :] for i in range(len(text))}
    return {int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in out}


def _seats(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(bucket, id) for (id, words, s0, s1, s2, s3, mass, short)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 5000):
            b = whole.slice(at, 5000)
            n, ids = b.num_rows, b.column(0).to_numpy()
            sig = np.column_stack([b.column(k).to_numpy() for k in range(2, 6)]).view(np.uint32)
            mass = np.ascontiguousarray(b.column(6).to_numpy()).view(np.uint8).reshape(n, BLOCKS)
            buckets, seated = [], []
            for key, counts in bucket_keys(b.column(1).to_numpy(), sig, mass):
                buckets.append(key[counts].view(np.int64))
                seated.append(ids[counts])
            for i, t in zip(ids.tolist(), b.column(7).to_pylist(), strict=True):
                if t is not None and (own := _without(t, similarity)):
                    buckets.append(np.fromiter(own, np.int64, len(own)))
                    seated.append(np.full(len(own), i))
            yield pa.record_batch([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(seated))], names=["bucket", "id"])


def _room(longer: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor(longer * (1 - similarity) + 1e-9)


#: Rows of a group up to which all groups of a batch are compared together, a distance in the table at a time.
_FEW_ROWS = 64


def _met(batches: Iterable[pa.RecordBatch], similarity: float, each: Callable[[pa.Table], tuple[Callable[[np.ndarray, np.ndarray], None], Callable[[], pa.Table]]]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, block, id, component, chars, s0, s1, s2, s3, ...) come sorted by (bucket, i, j): `each` takes pairs across components that hashes and lengths allow, and then tells its rows."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j, block, chars = (t.column(k).to_numpy() for k in (0, 1, 2, 3, 6))
        sig = np.column_stack([t.column(k).to_numpy() for k in range(7, 11)]).view(np.uint64)
        own = t.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
        head = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group, starts = np.cumsum(head) - 1, np.flatnonzero(head)
        size = np.diff(np.concatenate([starts, [len(head)]]))
        take, told = each(t)

        def pairs(p: np.ndarray, q: np.ndarray) -> None:
            fit = (own[p] != own[q]) & ((i[p] == j[p]) | (block[p] != block[q])) & (np.abs(chars[p] - chars[q]) <= _room(np.maximum(chars[p], chars[q]), similarity))
            p, q = p[fit], q[fit]
            near = np.bitwise_count(sig[p] ^ sig[q]).sum(axis=1) <= BITS
            if near.any():
                take(p[near], q[near])

        few = np.flatnonzero(size[group] <= _FEW_ROWS)
        for d in range(1, int(size[size <= _FEW_ROWS].max(initial=1))):
            p = few[few + d < len(group)]
            p = p[group[p] == group[p + d]]
            if len(p):
                pairs(p, p + d)
        for g in np.flatnonzero(size > _FEW_ROWS).tolist():
            last = starts[g] + size[g]
            for r in range(starts[g], last - 1):
                q = np.arange(r + 1, last)
                pairs(np.full(len(q), r), q)
        yield from told().to_batches()

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        keys = [t.column(k).to_numpy() for k in range(3)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(change):  # the last group can go on in the next batch
            cut = int(change[-1]) + 1
            yield from compare(t.slice(0, cut))
            t = t.slice(cut)
        held = t
    if held is not None:
        yield from compare(held)


def _apart(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of ids themselves."""

    def each(t: pa.Table) -> tuple[Callable, Callable]:
        ids, found = t.column(4).to_numpy(), [np.empty((0, 2), np.int64)]

        def told() -> pa.Table:
            both = np.concatenate(found)
            return pa.table({"a": both.min(axis=1), "b": both.max(axis=1)})

        return lambda p, q: found.append(np.column_stack([ids[p], ids[q]])), told

    return _met(batches, similarity, each)


def _near(t: pa.Table) -> tuple[Callable, Callable]:
    """Of the rows those with another one near: as many as there are rows at most, however many pairs."""
    mark = np.zeros(t.num_rows, bool)

    def take(p: np.ndarray, q: np.ndarray) -> None:
        mark[p] = mark[q] = True

    return take, lambda: t.select(["bucket", "id"]).filter(pa.array(mark))


def _confirmed(t: pa.Table, similarity: float) -> tuple[Callable, Callable]:
    """Links (a, b) by the texts of rows (..., words, mass, key, norm): a pair is tried in the first bucket it shares, and only while nothing has linked its components."""
    bucket, chars, words = (t.column(k).to_numpy() for k in ("bucket", "chars", "words"))
    sig = np.column_stack([t.column(c).to_numpy() for c in _SIG]).view(np.uint32)
    mass = np.ascontiguousarray(t.column("mass").to_numpy()).view(np.uint8).reshape(-1, BLOCKS)
    keys, counts = (np.column_stack(x) for x in zip(*bucket_keys(words, sig, mass), strict=True))
    keys = keys.view(np.int64)
    own = t.column("c").combine_chunks().dictionary_encode().indices.to_pylist()
    key, norm = t.column("key"), t.column("norm")
    up: dict[int, int] = {}
    found: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def take(p: np.ndarray, q: np.ndarray) -> None:
        shared = (keys[p] == keys[q]) & counts[p] & counts[q]
        # buckets of short lines are no such keys
        first = ~shared.any(axis=1) | (keys[p, shared.argmax(axis=1)] == bucket[p])
        p, q = p[first], q[first]
        room = _room(np.maximum(chars[p], chars[q]), similarity).astype(int)
        for x, y, r in zip(p.tolist(), q.tolist(), room.tolist(), strict=True):
            if (a := top(own[x])) != (b := top(own[y])) and within(norm[x].as_py(), norm[y].as_py(), r):
                up[a] = b
                found.append((x, y))

    def told() -> pa.Table:
        a, b = ([x[k] for x in found] for k in (0, 1))
        return pa.table({"a": key.take(pa.array(a, pa.int64())), "b": key.take(pa.array(b, pa.int64()))})

    return take, told


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way over the network."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([pack(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(2)], pa.binary())], names=["doc_id", "tie", "t"])


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, norm) of the lines wanted of each text (doc_id, tie, t, wanted); rows that repeat a document come one after another."""
    unpack, before = zstandard.ZstdDecompressor().decompress, None
    for b in batches:
        for ident, tie, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if (ident, tie) == before:
                continue
            before = ident, tie
            lines = unpack(t.as_py()).decode("utf-8", "surrogatepass").split("\n")
            rows = [(w["key"], normalised(lines[w["line_no"]])) for w in wanted.as_py()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "norm"])


def within(a: str, b: str, room: int) -> bool:
    """Whether the edit distance is at most `room`: what both begin and end with is taken off, the rest goes through Myers' bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > room:
        return False

    def same(x: str, y: str, most: int) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
        return low

    n = same(a, b, len(a))
    a, b = a[n:], b[n:]
    n = same(a[::-1], b[::-1], len(a))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or len(b) <= room:
        return len(b) <= room  # b alone can be written over what is left of a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for k, x in enumerate(b, 1):
        m = places.get(x, 0)
        across = (((m & up) + up) ^ up) | m | down
        rise, fall = (down | ~(across | up)) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - (len(b) - k) > room:
            return False
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(m | down | rise)) & full, rise & (m | down) & full
    return score <= room


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (ka, kb, room, na, nb) the keys of pairs within room."""
    for b in batches:
        room, one, two = (b.column(k).to_pylist() for k in (2, 3, 4))
        keep = pa.array([within(x, y, r) for r, x, y in zip(room, one, two, strict=True)], pa.bool_())
        yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)


class LineGroups:
    """The steps of one run; tables between them lie in the shared folder."""

    def __init__(self, docs: DataFrame, ident: str, text: str, similarity: float):
        common.ship(docs.sparkSession)
        self.docs = docs.select(docs[ident].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("tie"), docs[text].cast("string").alias("t"))
        self.similarity, self.spark = similarity, docs.sparkSession

    def kept_table(self, df: DataFrame, name: str) -> DataFrame:
        return common.written(df, name)

    def texts(self, places: DataFrame) -> DataFrame:
        """key, norm of the lines at places (key, first)."""
        each = self.docs.where("t is not null").mapInArrow(_packed, "doc_id long, tie long, t binary")
        wanted = places.groupBy("first.doc_id", "first.tie").agg(F.collect_list(F.struct("key", "first.line_no")).alias("wanted"))
        # sorted by the join, so that repeated rows meet
        found = each.hint("merge").join(wanted, each.doc_id.eqNullSafe(wanted.doc_id) & (each.tie == wanted.tie)).select(each.doc_id, each.tie, "t", "wanted")
        return self.kept_table(found.mapInArrow(_texts, "key binary, norm string"), "line-texts")

    def linked(self, pairs: DataFrame, seated: DataFrame) -> DataFrame:
        """Of pairs of ids (a, b) the links, as keys (a, b): first by hashes and lengths, then by the texts of those left."""
        near = pairs
        for x in "ab":
            near = near.join(seated.select(F.col("id").alias(x), F.struct("key", "first", "chars", *_SIG).alias(f"l{x}")), x)
        room = F.floor(F.greatest("la.chars", "lb.chars") * (1 - self.similarity) + 1e-9).cast("int")
        apart = [F.bit_count(F.col(f"la.{c}").bitwiseXOR(F.col(f"lb.{c}"))) for c in _SIG]
        near = near.where((F.abs(F.col("la.chars") - F.col("lb.chars")) <= room) & (F.col("la.key") != F.col("lb.key"))).where(sum(apart[1:], apart[0]) <= BITS)
        near = near.select(F.col("la.key").alias("ka"), F.col("la.first").alias("fa"), F.col("lb.key").alias("kb"), F.col("lb.first").alias("fb"), room.alias("room"))
        # dealt by both lines, as a bucket's pairs come from a few tasks and the edit distance is dear
        near = self.kept_table(near.repartition("ka", "kb"), "line-pairs")
        places = near.select(F.col("ka").alias("key"), F.col("fa").alias("first")).unionByName(near.select(F.col("kb").alias("key"), F.col("fb").alias("first"))).distinct()
        texts, near = self.texts(places), near.select("ka", "kb", "room")
        for x in "ab":
            near = near.join(texts.select(F.col("key").alias(f"k{x}"), F.col("norm").alias(f"n{x}")), f"k{x}")
        links = near.select("ka", "kb", "room", "na", "nb").mapInArrow(_verified, "a binary, b binary")
        return self.kept_table(links.distinct(), "line-links")

    def across(self, seats: DataFrame, seated: DataFrame, groups: DataFrame) -> DataFrame:
        """Links, as keys (a, b), between lines of a bucket whose components differ, the leader apart: rows that are near others by hash first, then those rows by their texts."""
        similarity = self.similarity
        label = seated.select("id", "key", "first", "chars", "words", *_SIG, "mass").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
        sat = seats.select("bucket", "id").join(label.select("id", "c"), "id")
        open_ = sat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket", "n")

        def dealt(rows: DataFrame, most: int, *more: str) -> DataFrame:
            """Rows with the number n of their bucket, in blocks that each meet each other."""
            blocks = F.ceil(F.col("n") / most).cast("int")
            rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
            rows = rows.select("bucket", F.least("block", "y").alias("i"), F.greatest("block", "y").alias("j"), "block", "id", "c", "chars", *_SIG, *more)
            return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

        rows = dealt(sat.select("bucket", "id").join(open_, "bucket").join(label.select("id", "c", "chars", *_SIG), "id"), ROWS)
        near = self.kept_table(rows.mapInArrow(lambda it: _met(it, similarity, _near), "bucket long, id long").distinct(), "line-rest")
        if not near.limit(1).count():
            return self.spark.createDataFrame([], "a binary, b binary")
        left = label.join(near.select("id").distinct(), "id", "left_semi")
        texts = self.texts(left.select("key", "first"))
        told = self.kept_table(left.join(texts, "key").select("id", "c", "chars", "words", *_SIG, "mass", "key", "norm"), "line-near")
        rows = near.join(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").join(told, "id")
        links = dealt(rows, TEXT_ROWS, "words", "mass", "key", "norm").mapInArrow(lambda it: _met(it, similarity, lambda t: _confirmed(t, similarity)), "a binary, b binary")
        return self.kept_table(links.distinct(), "line-links")

    def run(self) -> DataFrame:
        similarity = self.similarity
        every = self.kept_table(self.docs.mapInArrow(_read, _LINES), "lines")
        one = F.min(F.struct("doc_id", "tie", "line_no", "chars", "words", *_SIG, "mass", "short")).alias("one")
        different = every.where("key is not null").groupBy("key").agg(one, F.count(F.lit(1)).alias("rows"))
        different = different.select(F.xxhash64("key").alias("id"), "key", F.struct("one.doc_id", "one.tie", "one.line_no").alias("first"), "rows", "one.chars", "one.words", *[f"one.{c}" for c in _SIG], "one.mass", "one.short")
        different = self.kept_table(different, "different-lines")
        seats = different.select("id", "words", *_SIG, "mass", "short").mapInArrow(lambda it: _seats(it, similarity), "bucket long, id long")
        seats = self.kept_table(seats.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(led, "bucket long, leader long, id long"), "seats")
        pairs = seats.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        ids = seats.select("id").unionByName(seats.select(F.col("leader").alias("id"))).distinct()
        seated = self.kept_table(different.join(ids, "id", "left_semi").select("id", "key", "first", "chars", "words", *_SIG, "mass"), "seated")
        links = self.linked(pairs, seated)
        groups = components(links)
        rest = self.across(seats, seated, groups)
        if rest.limit(1).count():
            links = links.unionByName(rest)
            groups = components(links)
        names = different.select("key", "first", "rows").join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "first", "rows", F.coalesce("component", "key").alias("c"))
        heads = names.groupBy("c").agg(F.min("first").alias("head"), F.sum("rows").alias("group_lines")).where("group_lines > 1")
        marks = names.join(heads, "c").select("key", "head", "group_lines")
        out = every.select("doc_id", "tie", "line_no", "key").join(marks, "key", "left")
        place = F.struct("doc_id", "tie", "line_no")
        head = F.coalesce("head", place)
        return out.select("doc_id", "tie", "line_no", head["doc_id"].alias("group_doc_id"), head["line_no"].alias("group_line_no"), F.coalesce("group_lines", F.lit(1)).cast("long").alias("group_lines"), head.eqNullSafe(place).alias("kept"))


def occurrences(docs: DataFrame, ident: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every line: doc_id, line_no, the occurrence that stays for its group, the group's lines, kept."""
    return LineGroups(docs, ident, text, similarity).run().drop("tie")


def rewrite(docs: DataFrame, ident: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the text made of the lines that stay."""
    gone = LineGroups(docs, ident, text, similarity).run().where("not kept").groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("lines"))
    row, drop = common.fresh(docs.columns, "row"), common.fresh(docs.columns, "lines")
    gone = gone.select(F.col("doc_id").alias("a"), F.col("tie").alias("b"), F.col("lines").alias(drop))
    own = F.xxhash64(docs[text].cast("string"))
    both = docs.join(gone, docs[ident].cast("long").eqNullSafe(gone["a"]) & (own == gone["b"]), "left").select(F.struct(*[docs[common.quoted(c)] for c in docs.columns]).alias(row), gone[drop])
    whole = F.col(row)[text]
    left = F.array_join(F.filter(F.split(whole.cast("string"), "\n", -1), lambda x, i: ~F.array_contains(drop, i)), "\n")
    return both.select(*[(F.when(F.col(drop).isNull(), whole).otherwise(left) if c == text else F.col(row)[c]).alias(c) for c in docs.columns])
