"""Near-duplicate groups by HyperMinHash registers.

One pass gives each document the set of its distinct word shingles as 64-bit hashes, and of that
set `REGISTERS` registers: a bucket keeps its least hash, stored as the number of leading zeros and
four mantissa bits, in one byte; an empty bucket takes the register of the first bucket of a fixed
random sequence that is not empty.  A set of few shingles fills few buckets, so its registers would
say little: sets below `SMALL` (and those up to a third larger, which can be linked with them) get
registers of another kind, one hash function each, with 26 mantissa bits.  Equal sets become one
class before anything else, so copies cost one row each.  Registers are banded, 72 bands of six
rows; a band holds the classes that agree in it.

Links are looked for in two sweeps, both inside bands and both on full sets:

1. Each class is held against the least member of its bands.  The members of a leader are dealt
   over tasks with a copy of the leader's set, and a task reads them one after another.
2. The links found make components.  Of bands whose members (the leader apart) are in several
   components still, all pairs across components are tested; of bands with the same members one is: a block of members against a block, spread over tasks, by
   sizes, then (where both sets have `ESTIMATED` shingles) by the similarity that the registers
   estimate less what equal registers owe to chance, then by the two full sets.  A pair joined by
   other links is not tested again, and only links leave the task.

What can be missed: a pair at similarity 0.75 that meets in none of 72 bands, (1 - 0.75^6)^72 or
7e-7 with registers of one hash each, a little more with buckets; and a pair of large sets whose
estimate is 0.12 low, more than five deviations.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing.  Null identifiers take part in no link and keep their row (component null, kept true).
Rows that repeat an identifier are nodes of their own where their sets differ; a component has the
least identifier of all its rows.  An empty table gives an empty result.  `deduplicate` carries all
columns, whatever their names; of kept rows that repeat an identifier within a component one stays,
that of the least text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components, led

WORDS = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS = 432
ROWS = 6
#: Bits of a register: leading zeros, up to fifteen, and mantissa.
MANTISSA = 4
#: Sets below this have registers of one hash function each.
SMALL = 64
#: Classes, and bytes of their sets, in one of the blocks that meet in a task.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Members of a leader in one task.
STAR = 2_048
#: Registers refute a pair of sets that both have so many shingles, when their estimate is so far below the threshold.
ESTIMATED, MARGIN = 1_000, 0.12
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Words:
    """64-bit hashes of words, kept for the frequent ones."""

    def __init__(self, most: int = 100_000):
        self.most, self.kept = most, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.kept.get, words))
        if None in found:
            if len(self.kept) > self.most:
                self.kept.clear()
            of, kept = xxhash.xxh3_64_intdigest, self.kept
            for i, x in enumerate(found):
                if x is None:
                    found[i] = h = of(words[i])
                    if len(words[i]) < 40:
                        kept[words[i]] = h
        return np.array(found, np.uint64)


_WORDS = Words()


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; bytes A-Z count as lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = _WORDS.hashes(words)
    n = len(w) - size + 1
    if n < 1:
        n, size = 1, len(w)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


_SEEDS = np.random.default_rng(20240301).integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
_PROBES = np.random.default_rng(20240229).integers(0, REGISTERS, (400, REGISTERS))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash of each bucket."""
    high = hashes >> np.uint64(32)
    scaled = high * np.uint64(REGISTERS)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(bucket, np.arange(REGISTERS))
    full = np.zeros(REGISTERS, bool)
    full[bucket] = True
    # place of the least hash within its bucket, as 52 bits; exact in a double
    own = first[full]
    rest = ((scaled[own] & np.uint64(0xFFFFFFFF)) << np.uint64(20)) | ((hashes[own] & np.uint64(0xFFFFFFFF)) >> np.uint64(12))
    mantissa, exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))
    zeros = 52 - exponent
    value = (np.minimum(zeros, 15).astype(np.uint8) << np.uint8(MANTISSA)) | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.uint8)
    out = np.zeros(REGISTERS, np.uint8)
    out[full] = value
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_PROBES[:, empty]]
        source = _PROBES[hit.argmax(axis=0), empty]
        lost = ~hit.any(axis=0)
        if lost.any():
            there = np.flatnonzero(full)
            source[lost] = there[_PROBES[0, empty[lost]] % len(there)]
        out[empty] = out[source]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less the share that chance makes equal.

    Two registers of unrelated sets agree when leading zeros and mantissa do: about
    sum_z 4^-(z+1) / 2^MANTISSA = 2^-MANTISSA / 3 for sets of equal size.
    """
    chance = 1 / 3 / (1 << MANTISSA)
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def narrow_registers(hashes: np.ndarray) -> np.ndarray:
    """Of a small set: the least of each of REGISTERS hash functions, as leading zeros and 26 mantissa bits."""
    least = _mix(hashes[:, None] ^ _SEEDS[None, :]).min(axis=0)
    mantissa, exponent = np.frexp(np.maximum(least >> np.uint64(12), np.uint64(1)).astype(np.float64))
    return ((52 - exponent).astype(np.uint64) << np.uint64(26)) | ((mantissa * 2 - 1) * (1 << 26)).astype(np.uint64)


def band_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of the bands that a set sits in; sets near `SMALL` have both kinds."""
    kinds = []
    if len(hashes) * percent < SMALL * 100:
        kinds.append((1, narrow_registers(hashes)))
    if len(hashes) >= SMALL:
        kinds.append((2, registers(hashes).astype(np.uint64)))
    out = []
    for kind, r in kinds:
        cells = r.reshape(-1, ROWS)
        key = _mix(np.arange(1, len(cells) + 1, dtype=np.uint64) + np.uint64(kind << 32))
        for k in range(ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, k])
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterable[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            rows = []
            for t in b.column(2):
                s = shingles(t.as_py(), size)
                rows.append((len(s), _digest(s), band_keys(s, percent).tobytes()) if len(s) else (0, None, None))
            n, digests, keys = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())], names=["id", "hash", "n", "digest", "keys"])


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            raw = b.column(1).to_pylist()
            keys = np.frombuffer(b"".join(raw), np.int64)
            yield pa.record_batch([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw]))], names=["band", "id"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [(), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _stars(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (leader, part, id, set) come sorted, the leader's own first in each part; its set alone is held."""
    key, own = None, None
    for b in batches:
        found = []
        for leader, part, ident, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            if ident == leader:
                key, own = (leader, part), s.copy()
            elif key == (leader, part) and _linked(own, s, percent):
                found.append((leader, ident))
        yield _pairs(found)


def _compare(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links of one group of rows (band, i, j, block, id, component, set), but for those that follow from others."""
    i, j = rows[0][1:3]
    block, ids = (np.array([r[k] for r in rows]) for k in (3, 4))
    joined = np.unique([r[5] for r in rows], return_inverse=True)[1]
    sets = [np.frombuffer(r[6], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    large = np.flatnonzero(size >= ESTIMATED)
    regs = {k: registers(sets[k]) for k in large.tolist()}
    for a in range(len(rows)):
        # groups of two blocks hold pairs across them only
        near = (joined != joined[a]) & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])) & (block > block[a] if i != j else np.arange(len(rows)) > a)
        for c in np.flatnonzero(near).tolist():
            if joined[c] == joined[a] or (a in regs and c in regs and estimate(regs[a], regs[c]) < percent / 100 - MARGIN):
                continue
            if _linked(sets[a], sets[c], percent):
                joined[joined == joined[c]] = joined[a]
                yield int(ids[a]), int(ids[c])


def _groups(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, i, j); a group has at most two blocks."""
    rows: list[tuple] = []
    out: list[tuple[int, int]] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    out.extend(_compare(rows, percent))
                    rows = []
                    if len(out) > 10_000:
                        yield _pairs(out)
                        out = []
                rows.append(row)
    if rows:
        out.extend(_compare(rows, percent))
    yield _pairs(out)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way over the network."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([pack(t.as_py()) for t in b.column(1)], pa.binary())], names=["id", "t"])


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of the classes asked for, from packed texts; a text of another class under the same identifier gives none."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            rows = [(node, s.tobytes()) for node, digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) if len(s := shingles(unpack(t.as_py()), size)) and _digest(s) == digest]
            nodes, sets = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])


class NearDuplicates:
    """The steps of one run; tables between them lie in the shared folder."""

    def __init__(self, docs: DataFrame, ident: str, text: str, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        common.ship(self.spark)
        self.docs = docs.select(F.col(ident).cast("long").alias("id"), text_hash(docs, text).alias("hash"), F.col(text).cast("binary").alias("t"))

    def kept_table(self, df: DataFrame, name: str) -> DataFrame:
        return common.written(df, name)

    def signatures(self) -> DataFrame:
        size, percent = self.size, self.percent
        return self.kept_table(self.docs.mapInArrow(lambda it: _signatures(it, size, percent), "id long, hash long, n long, digest binary, keys binary"), "signatures")

    def classes(self, sigs: DataFrame) -> DataFrame:
        """digest, rep (least identifier), n, node: the rep, or a hash of the digest where classes share a rep."""
        found = sigs.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n"))
        found = self.kept_table(found, "classes")
        several = found.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep", F.lit(True).alias("several"))
        return found.join(several, "rep", "left").select("digest", "rep", "n", F.when(F.col("several"), F.xxhash64("digest")).otherwise(F.col("rep")).alias("node"))

    def first_links(self, seats: DataFrame, sets: DataFrame) -> DataFrame:
        percent = self.percent
        stars = seats.where("id <> leader").select("leader", "id").distinct()
        parts = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
        rows = stars.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
        rows = rows.unionByName(parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("id")))
        dealt = rows.join(sets, "id").select("leader", "part", (F.col("id") != F.col("leader")).alias("later"), "id", "set")
        dealt = dealt.repartition("leader", "part").sortWithinPartitions("leader", "part", "later")
        return self.kept_table(dealt.mapInArrow(lambda it: _stars(it, percent), "a long, b long"), "first-links")

    def second_links(self, seats: DataFrame, sets: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
        percent = self.percent
        label = classes.select(F.col("node").alias("id"), "n").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"))
        seated = seats.where("id <> leader").select("band", "id").join(label, "id")
        # a band whose members are one component has nothing left to find
        members = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
        open_ = seated.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.min("c").alias("c0"), F.max("c").alias("c1"), *members).where("c0 <> c1")
        open_ = open_.groupBy("rows", "total", "x", "y").agg(F.min("band").alias("band"))
        open_ = open_.select("band", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
        rows = seated.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("band", F.least("block", "y").alias("i"), F.greatest("block", "y").alias("j"), "block", "id", "c").join(sets, "id")
        dealt = rows.select("band", "i", "j", "block", "id", "c", "set").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        return self.kept_table(dealt.mapInArrow(lambda it: _groups(it, percent), "a long, b long"), "second-links")

    def run(self) -> DataFrame:
        """One row per row of docs: id, hash (of the text), n, grp (the component's node), label (its least identifier)."""
        sigs = self.signatures()
        classes = self.kept_table(self.classes(sigs), "nodes")
        # rows that repeat identifier and set bring equal seats, which `led` takes once
        nodes = sigs.select("digest", "id", "keys").join(classes.select("digest", F.col("rep").alias("id"), "node"), ["digest", "id"]).select("node", "keys")
        members = nodes.mapInArrow(_bands, "band long, id long")
        dealt = members.repartition("band").sortWithinPartitions("band", "id")
        seats = self.kept_table(dealt.mapInArrow(lambda it: led(it, True), "band long, leader long, id long"), "seats")
        wanted = self.kept_table(classes.join(seats.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "digest", F.col("rep").alias("id")), "seated")
        size = self.size
        texts = self.docs.where("id is not null and t is not null").select("id", "t").mapInArrow(_packed, "id long, t binary").hint("merge")
        found = texts.join(wanted, "id").select("node", "digest", "t")
        sets = self.kept_table(found.mapInArrow(lambda it: _sets(it, size), "id long, set binary"), "sets")
        links = self.first_links(seats, sets)
        groups = components(links)
        more = self.second_links(seats, sets, classes, groups)
        if more.limit(1).count():
            groups = components(links.unionByName(more))
        names = classes.join(groups, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("grp"))
        least = names.groupBy("grp").agg(F.min("rep").alias("label"))
        names = names.join(least, "grp").select("digest", "grp", "label")
        return sigs.select("id", "hash", "n", "digest").join(names, "digest", "left").select("id", "hash", "n", "grp", F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("label"))


def text_hash(docs: DataFrame, text: str) -> Column:
    return F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least identifier reachable by links), kept."""
    found = NearDuplicates(docs, ident, text, size, percent).run()
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.coalesce(F.col("id") == F.col("label"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the least identifier; rows with a null identifier stay."""
    run = NearDuplicates(docs, ident, text, size, percent)
    found = run.kept_table(run.run(), "near-groups")
    whole, own, given = docs[ident].cast("long"), text_hash(docs, text), docs.columns
    gone = found.where("id <> label").select(F.col("id").alias("a"), F.col("hash").alias("b")).distinct()
    left = docs.join(gone, (whole == gone["a"]) & (own == gone["b"]), "left_anti")
    # identifiers that several kept rows of one component share
    stay = found.where("id = label")
    several = stay.groupBy("id", F.coalesce("grp", "hash").alias("g")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias("a")).distinct()
    single = left.join(several, whole == several["a"], "left_anti")
    row, key, h, g, k = (common.fresh(given, x) for x in ("row", "key", "hash", "group", "place"))
    marks = stay.select(F.col("id").alias(key), F.col("hash").alias(h), F.coalesce("grp", "hash").alias(g)).distinct()
    more = left.join(several, whole == several["a"], "left_semi").select(F.struct(*[left[common.quoted(c)] for c in given]).alias(row), whole.alias(key), own.alias(h)).join(marks, [key, h])
    more = more.withColumn(k, F.row_number().over(Window.partitionBy(key, g).orderBy(h))).where(F.col(k) == 1)
    return single.unionByName(more.select(*[F.col(row)[c].alias(c) for c in given]))
