"""Exact de-duplication with Patricia tries as owners of the texts.

A text belongs to the partition of its length and content hash.  Before the shuffle each
input partition puts its own texts in a trie, so a text that fills a third of all rows
crosses the network once per input partition.  The owner of a partition inserts the full
byte strings in another trie; a terminal node holds the smallest identifier and the number
of rows.  A trie over its memory budget writes its largest subtree to a file of the task and
sends later strings of that subtree straight there; such files are read back as tries of
their own, under the same budget.

Defined results: a null text counts as empty and equals other empty texts.  A null
identifier sorts after all others.  Rows that repeat an identifier and its text are one
group; `deduplicate` returns one of them.  An empty table gives an empty result.  Columns
besides the two named are carried through `deduplicate` untouched.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that a trie holds before it spills a subtree.
TRIE_BYTES = 48 << 20
_HEAD = struct.Struct("<qq??I")


class _Node:
    __slots__ = ("src", "start", "end", "kids", "best", "rows", "at_best", "file")

    def __init__(self, src: bytes, start: int, end: int):
        self.src, self.start, self.end = src, start, end
        self.kids: dict[int, _Node] = {}
        self.best: int | None = None
        self.rows = 0
        self.at_best = 0
        self.file = None


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], at most `most`; slices compare in C."""
    low, step = 0, 16
    while low < most:
        n = min(step, most - low)
        if a[i + low : i + low + n] == b[j + low : j + low + n]:
            low += n
            step *= 4
        elif n == 1:
            break
        else:
            step = max(1, n // 4)
    return low


class PatriciaTrie:
    """Byte strings with the smallest identifier, the rows, and the rows of that identifier."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root = _Node(b"", 0, 0)
        self.budget = budget
        self.held = 0
        self.spilled: list[_Node] = []

    def add(self, key: bytes, ident: int | None, rows: int = 1, at_best: int = 1) -> None:
        node, pos, n = self.root, 0, len(key)
        while True:
            if node.file is not None:
                node.file.write(_HEAD.pack(ident or 0, rows, ident is None, False, n))
                node.file.write(struct.pack("<q", at_best) + key)
                return
            if pos == n:
                break
            kid = node.kids.get(key[pos])
            if kid is None:
                kid = node.kids[key[pos]] = _Node(key, pos, n)
                self.held += n + 200  # a node keeps its whole string alive
                node = kid
                break
            size = kid.end - kid.start
            same = _common(key, pos, kid.src, kid.start, min(size, n - pos))
            if same < size:  # split the edge
                upper = _Node(kid.src, kid.start, kid.start + same)
                node.kids[key[pos]] = upper
                kid.start += same
                upper.kids[kid.src[kid.start]] = kid
                self.held += 200
                kid = upper
            node, pos = kid, pos + same
        if node.rows == 0 or (ident is not None and (node.best is None or ident < node.best)):
            node.best, node.at_best = ident, at_best
        elif ident == node.best:
            node.at_best += at_best
        node.rows += rows
        if self.held > self.budget:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            full = prefix + node.src[node.start : node.end]
            if node.rows:
                yield full, node
            stack.extend((k, full) for k in node.kids.values())

    def _spill(self) -> None:
        """Move the largest subtree below the first branch to a file of this task."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.file is None:
            node = next(iter(node.kids.values()))
            prefix += node.src[node.start : node.end]
        live = [k for k in node.kids.values() if k.file is None]
        if not live:
            self.budget *= 2  # what is left is one string, or subtrees that are spilled already
            return
        sizes = {id(k): sum(len(full) + 200 for full, _ in self._walk(k, prefix)) for k in live}
        top = max(live, key=lambda k: sizes[id(k)])
        out = tempfile.TemporaryFile()
        for full, x in self._walk(top, prefix):
            out.write(_HEAD.pack(x.best or 0, x.rows, x.best is None, False, len(full)))
            out.write(struct.pack("<q", x.at_best) + full)
        # what was spilled below it before moves to its file, so that a string is in one place
        stack = list(top.kids.values())
        while stack:
            x = stack.pop()
            stack.extend(x.kids.values())
            if x.file is not None:
                x.file.seek(0)
                shutil.copyfileobj(x.file, out)
                x.file.close()
                self.spilled.remove(x)
        top.kids, top.rows, top.best, top.file = {}, 0, None, out
        self.spilled.append(top)
        self.held = max(0, self.held - sizes[id(top)])

    def items(self) -> Iterator[tuple[bytes, int | None, int, int]]:
        """(string, smallest identifier, rows, rows of that identifier), spilled subtrees last."""
        for full, x in self._walk(self.root, b""):
            yield full, x.best, x.rows, x.at_best
        self.root = _Node(b"", 0, 0)
        for stub in self.spilled:
            own, size = PatriciaTrie(self.budget), stub.file.seek(0, os.SEEK_END)
            stub.file.seek(0)
            while stub.file.tell() < size:
                ident, rows, none, _, n = _HEAD.unpack(stub.file.read(_HEAD.size))
                (ties,) = struct.unpack("<q", stub.file.read(8))
                own.add(stub.file.read(n), None if none else ident, rows, ties)
            stub.file.close()
            yield from own.items()


_LOCAL = "n_bytes long, content_hash long, body binary, ident long, n long, ties long"
_OWNED = "sha string, keep_id long, group_size long, ties long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _local(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: one row per different text of this input partition."""
    trie = PatriciaTrie(budget)
    for b in batches:
        for ident, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            trie.add(body, ident)
    schema = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("ident", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())])
    yield from _batches(((len(k), xxhash.xxh3_64_intdigest(k) - (1 << 63), k, i, n, t) for k, i, n, t in trie.items()), schema)


def _own(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(budget)
    for b in batches:
        for body, ident, n, ties in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            trie.add(body, ident, n, ties)
    schema = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])
    yield from _batches(((hashlib.sha256(k).hexdigest(), i, n, t) for k, i, n, t in trie.items()), schema)


def normalised(text: str = "text"):
    return F.regexp_replace(common.text_of(text), common.SPACE, " ")


def owners(docs: DataFrame, ident: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per different normalised text: sha, keep_id, group_size, ties (rows of keep_id)."""
    common.ship(docs.sparkSession)
    body = docs.select(F.col(ident).cast("long").alias("ident"), normalised(text).alias("t"))
    body = body.select("ident", F.col("t").cast("binary").alias("body"))
    local = body.mapInArrow(lambda it: _local(it, budget), _LOCAL)
    dealt = local.repartition("n_bytes", "content_hash").select("body", "ident", "n", "ties")
    return dealt.mapInArrow(lambda it: _own(it, budget), _OWNED)


def _grouped(docs: DataFrame, ident: str, text: str, budget: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with the results under names of their own, and those names.

    Texts that occur once need no partner, so only repeated ones take part in the join; their
    side has one row per text, and adaptive execution splits a hot text on the other side.
    """
    name = {c: common.fresh(docs.columns, c) for c in ("text_sha256", "sha", "keep", "size", "rows_of_keep", "kept")}
    many = owners(docs, ident, text, budget).where("group_size > 1")
    many = many.select(F.col("sha").alias(name["sha"]), F.col("keep_id").alias(name["keep"]), F.col("group_size").alias(name["size"]), F.col("ties").alias(name["rows_of_keep"]))
    base = docs.select(*[docs[common.quoted(c)] for c in docs.columns], F.sha2(normalised(text).cast("binary"), 256).alias(name["text_sha256"]))
    both = base.join(many, F.col(name["text_sha256"]) == F.col(name["sha"]), "left")
    own, alone = F.col(ident).cast("long"), F.col(name["sha"]).isNull()
    return both.withColumns(
        {
            name["kept"]: F.when(alone, F.lit(True)).otherwise(own.eqNullSafe(F.col(name["keep"]))),
            name["keep"]: F.when(alone, own).otherwise(F.col(name["keep"])),
            name["size"]: F.coalesce(name["size"], F.lit(1)).cast("long"),
            name["rows_of_keep"]: F.coalesce(name["rows_of_keep"], F.lit(1)).cast("long"),
        }
    ), name


def groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """All columns of docs, and keep_id, group_size, kept, text_sha256, and ties, which replace columns of those names."""
    found, name = _grouped(docs, ident, text, budget)
    made = {"keep_id": "keep", "group_size": "size", "kept": "kept", "text_sha256": "text_sha256", "ties": "rows_of_keep"}
    carried = [c for c in docs.columns if c.lower() not in made]
    return found.select(*[F.col(common.quoted(c)) for c in carried], *[F.col(name[x]).alias(c) for c, x in made.items()])


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, with the columns of docs.

    Of rows that share identifier and normalised text the one stays whose raw text hashes least, then whose
    columns as JSON do: the same however the rows are dealt.
    """
    found, name = _grouped(docs, ident, text, budget)
    kept, carried = found.where(F.col(name["kept"])), [F.col(common.quoted(c)) for c in docs.columns]
    once = kept.where(F.col(name["rows_of_keep"]) == 1).select(*carried)
    row = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(carried)])
    rank = F.struct(F.xxhash64(common.text_of(common.quoted(text))).alias("text"), F.xxhash64(F.to_json(row)).alias("row"))
    again = kept.where(F.col(name["rows_of_keep"]) > 1).groupBy(name["text_sha256"]).agg(F.min_by(row, rank).alias("one"))
    return once.unionByName(again.select(*[F.col(f"one.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
