"""Two tokenizers over the same bytes: which tokens of A share bytes with which tokens of B.

`np.repeat` writes each token's index once per byte it owns, for A and for B.  Where consecutive
bytes differ in the pair of owners a new overlap begins; where both owners change at once is a
cut, and the tokens between two cuts are a group.  The tokens of a group are linked, each of A with
each of B, and an id pair's count is the number of documents that hold it linked.

A is a byte-level file of the tokenizers library, which gets a space before the text; B is a
sentencepiece model that adds one itself.  Neither has a token that holds a space after anything
else, so a space that follows no white space is always a cut: a text falls into chunks there, each
different chunk is encoded and aligned once per worker (in a bounded store), and a document is the
run of its chunks.  Vocabularies of another make get whole texts.

Counts go by blocks of documents.  A task reads its partition once and writes, per document, its
id pairs with their numbers, and per block the different pairs with the documents that hold them.
Pairs are counted over blocks, the counts go back to the blocks that asked, and a block's documents
meet them in one task.  So what is shuffled row by row is a block's different pairs, not each
document's; a pair that every document holds is one row a block.

Defined results: null and empty texts, and texts whose tokens of A or of B do not spell a space
and the text, have no tokens: zeros and ''.  Repeated rows count as documents of their own and get
equal results; null identifiers are carried.  An empty table gives no rows.  Other columns are not
carried.  Memory holds a block, or a document where that is longer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import bpe, common

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Characters of text in a block, and in a step over texts or over chunks not seen before.
BLOCK = 24 << 20
STEP = 2 << 20
#: Chunks that a worker keeps, and the length up to which one is worth keeping.
STORE, STORE_CHARS = 400_000, 64
#: Groups of up to so many links are written out at once; larger ones by their different ids.
SMALL = 256
#: Pairs in one row of a block's list.
ROW = 1 << 16

#: A space that follows something that nobody takes for white space.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]) ")
#: A chunk that may stand in a row of others: characters on which all tables of letters agree, no white space at its end.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*[\x21-\x7e\xa1-\u024f]")
_HEX = re.compile("<0x([0-9A-Fa-f]{2})>")


class Pool:
    """Ragged arrays in a row: list k of each column is values[starts[k] : starts[k + 1]]."""

    def __init__(self, columns: int):
        self.values = [np.zeros(1 << 12, np.int64) for _ in range(columns)]
        self.starts = np.zeros(1 << 12, np.int64)
        self.n = 0

    def extend(self, lengths: np.ndarray, *columns: np.ndarray) -> None:
        at, more = int(self.starts[self.n]), int(lengths.sum())
        for k, c in enumerate(columns):
            while at + more > len(self.values[k]):
                self.values[k] = np.concatenate([self.values[k], np.zeros_like(self.values[k])])
            self.values[k][at : at + more] = c
        while self.n + len(lengths) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.starts[self.n + 1 : self.n + 1 + len(lengths)] = at + np.cumsum(lengths)
        self.n += len(lengths)

    def lengths(self, which: np.ndarray) -> np.ndarray:
        return self.starts[which + 1] - self.starts[which]

    def places(self, which: np.ndarray) -> np.ndarray:
        return spread(self.starts[which], self.lengths(which))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


class Aligner:
    """The two vocabularies, and what is known of the chunks seen."""

    def __init__(self, path_a: str = A_FILE, path_b: str = B_FILE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe.resolve(path_a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=bpe.resolve(path_b))
        letters, added = {c: b for b, c in enumerate(bpe.byte_alphabet())}, {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [added[i].encode() if i in added else bytes(map(letters.__getitem__, entries.get(i, ""))) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _HEX.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.n_b = len(pieces)
        self.space = self.b.piece_to_id("▁")
        kind = type(self.a.pre_tokenizer).__name__
        self.whole = kind != "ByteLevel" or not self.a.pre_tokenizer.use_regex or self.a.normalizer is not None or any(re.search("[^▁]▁", p) for p in pieces)
        self.rank = None if self.whole else self._ranked()
        # a token's number with what follows it: within its tokenizer, at A's end, at B's end
        self.written = [[b"%d%c" % (i, c) for i in range(n)] for n, c in ((len(self.bytes_a), 44), (len(self.bytes_a), 124), (self.n_b, 44), (self.n_b, 59))]
        self.written_len = [np.array(list(map(len, t)), np.int64) for t in self.written]
        self.forget()

    def _ranked(self):
        """A's merges by rank, which a faster library applies, if ids follow the order of merges."""
        import tiktoken
        from public_tokenizers import PATTERN

        model = json.loads(self.a.to_str())["model"]
        made = [model["vocab"].get("".join(m)) for m in model["merges"]]
        plain = {self.bytes_a[i]: i for i in model["vocab"].values()}
        if None in made or made != sorted(set(made)) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or len(plain) != len(made) + 256:
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []  # groups as written, without the last semicolon
        self.pairs = Pool(2)  # keys a * n_b + b, numbers
        self.ids_a, self.ids_b = Pool(1), Pool(1)
        self.groups = Pool(3)  # last byte's end, tokens of A, tokens of B
        self.chunk = Pool(2)  # links (-1: the bytes differ), bytes: one of each a chunk

    def chunks(self, text: str) -> list[str]:
        """A text's chunks, each without the space it starts with."""
        return [text] if self.whole else _CUT.split(text)

    def look_up(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts by number, and how many each text has."""
        if len(self.known) > STORE or self.ids_a.starts[self.ids_a.n] > 10 * STORE:
            self.forget()
        parts = [self.chunks(t) for t in texts]
        known = self.known
        flat = [c for p in parts for c in p]
        fresh = [c for c in dict.fromkeys(flat) if c not in known]
        self._learn(fresh)
        numbers = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        for c in fresh:
            if len(c) > STORE_CHARS:
                del known[c]
        return numbers, np.array(list(map(len, parts)), np.int64)

    def _learn(self, fresh: list[str]) -> None:
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (end == at or size + len(fresh[end]) <= STEP):
                size += len(fresh[end])
                end += 1
            self._learn_step(fresh[at:end])
            at = end

    def _in_a_row(self, plain: list[str]) -> list[np.ndarray]:
        """Ids and their numbers per chunk, A's and B's, of chunks that stand in one text behind each other."""
        row = " ".join(plain)
        raw = f" {row}".encode()
        ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in plain), np.int64, len(plain)))
        out = []
        for x, names, lengths in ((self.rank.encode_ordinary(f" {row}"), self.bytes_a, self.len_a), (list(chain.from_iterable(self.b.encode(plain, num_threads=1))), self.bytes_b, self.len_b)):
            ids = np.array(x, np.int64)
            at = np.cumsum(lengths[ids])
            place = np.searchsorted(at, ends)
            if b"".join(map(names.__getitem__, x)) != raw or (at[place] != ends).any():
                raise ValueError("chunks are not apart")
            out += [ids, np.diff(place, prepend=-1)]
        return out

    def _one_by_one(self, odd: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        ids_a = [e.ids for e in self.a.encode_batch([f" {c}" for c in odd], add_special_tokens=False)]
        # the library takes no text for nothing, not for the space it adds
        ids_b = [ids if c else [self.space] for c, ids in zip(odd, self.b.encode(odd, num_threads=1), strict=True)]
        sound = np.zeros(len(odd), bool)
        for k, c in enumerate(odd):
            raw = b" " + c.encode()
            sound[k] = b"".join(map(self.bytes_a.__getitem__, ids_a[k])) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b[k]))
            if not sound[k]:
                ids_a[k], ids_b[k] = [], []
        out = []
        for ids in (ids_a, ids_b):
            n = np.array(list(map(len, ids)), np.int64)
            out += [np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n]
        return out, sound

    def _learn_step(self, fresh: list[str]) -> None:
        plain = [c for c in fresh if len(c) <= STORE_CHARS and _PLAIN.fullmatch(c)] if self.rank else []
        known = set(plain)
        odd = [c for c in fresh if c not in known]
        fresh = plain + odd
        row, (single, sound) = self._in_a_row(plain) if plain else [np.zeros(0, np.int64)] * 4, self._one_by_one(odd)
        a, n_a, b, n_b = (np.concatenate(x) for x in zip(row, single, strict=True))
        sound = np.concatenate([np.ones(len(plain), bool), sound])
        of_a = np.repeat(np.arange(len(fresh)), n_a)
        # the owners of every byte
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.len_a[a]), np.repeat(np.arange(len(b)), self.len_b[b])
        turn_a, turn_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        cut = np.concatenate([np.zeros(min(1, len(owner_a)), bool), turn_a & turn_b])
        group = np.cumsum(cut)
        first_a, first_b = (np.concatenate([np.zeros(min(1, len(x)), np.int64), np.flatnonzero(t) + 1]) for x, t in ((a, turn_a), (b, turn_b)))
        n_groups = int(group[-1]) + 1 if len(group) else 0
        in_a, in_b = group[first_a], group[first_b]
        p, q = np.bincount(in_a, minlength=n_groups), np.bincount(in_b, minlength=n_groups)
        start_a, start_b = np.cumsum(p) - p, np.cumsum(q) - q
        chunk_of = of_a[start_a] if n_groups else np.zeros(0, np.int64)
        ends = np.concatenate([np.flatnonzero(cut), np.full(min(1, n_groups), len(group))])
        from_byte = np.cumsum(bytes_in := np.bincount(of_a, self.len_a[a], len(fresh)).astype(np.int64)) - bytes_in
        self.groups.extend(np.bincount(chunk_of, minlength=len(fresh)), ends - from_byte[chunk_of], p, q)
        self.ids_a.extend(n_a, a)
        self.ids_b.extend(n_b, b)
        links = np.zeros(len(fresh), np.int64)
        np.add.at(links, chunk_of, p * q)
        self.known.update((c, self.chunk.n + k) for k, c in enumerate(fresh))
        self.chunk.extend(np.ones(len(fresh), np.int64), np.where(sound, links, -1), bytes_in)
        self._pairs(fresh, a, b, p, q, start_a, start_b, chunk_of)
        self._texts(n_a, n_b, a, b, in_a, in_b, start_a + p - 1, start_b + q - 1)

    def _pairs(self, fresh, a, b, p, q, start_a, start_b, chunk_of) -> None:
        small = np.flatnonzero(p * q <= SMALL)
        size = (p * q)[small]
        which, k = np.repeat(small, size), spread(np.zeros(len(small), np.int64), size)
        keys = a[start_a[which] + k // q[which]] * self.n_b + b[start_b[which] + k % q[which]]
        chunk, found, numbers = [chunk_of[which]], [keys], [np.ones(len(keys), np.int64)]
        for g in np.flatnonzero(p * q > SMALL).tolist():
            ua, ca = np.unique(a[start_a[g] : start_a[g] + p[g]], return_counts=True)
            ub, cb = np.unique(b[start_b[g] : start_b[g] + q[g]], return_counts=True)
            found.append((ua[:, None] * self.n_b + ub).ravel())
            numbers.append((ca[:, None] * cb).ravel())
            chunk.append(np.full(len(found[-1]), chunk_of[g]))
        space = len(self.bytes_a) * self.n_b
        keys, numbers = counted(np.concatenate(chunk) * space + np.concatenate(found), np.concatenate(numbers))
        self.pairs.extend(np.bincount(keys // space, minlength=len(fresh)), keys % space, numbers)

    def _texts(self, n_a, n_b, a, b, in_a, in_b, last_a, last_b) -> None:
        """Chunks as written: A's ids of a group, a bar, B's ids, a semicolon."""
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[last_a] = ends_b[last_b] = True
        from_b = np.cumsum(np.bincount(in_b)) if len(b) else np.zeros(0, np.int64)
        from_a = np.cumsum(np.bincount(in_a)) if len(a) else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(a)) + np.concatenate([[0], from_b])[in_a], np.arange(len(b)) + from_a[in_b]]).astype(np.int64)
        order = np.argsort(place, kind="stable")
        kind = np.concatenate([ends_a, 2 + ends_b])[order]
        ids = np.concatenate([a, b])[order]
        parts, length = self.written, np.zeros(len(ids), np.int64)
        for k, x in enumerate(self.written_len):
            length[kind == k] = x[ids[kind == k]]
        whole = b"".join([parts[k][i] for k, i in zip(kind.tolist(), ids.tolist(), strict=True)])
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.texts += [whole[i : j - 1] if j > i else b"" for i, j in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], int]]:
    """Identifiers and texts, so many characters at a time."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            yield batch.column(0).slice(at, end - at), texts[at:end], size
            at = end


def sound_runs(own: Aligner, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of texts by number, the text of each, and the number of each text's chunks: none where bytes differ or there is no text."""
    numbers, n = own.look_up(texts)
    of = np.repeat(np.arange(len(texts)), n)
    bad = np.bincount(of[own.chunk.values[0][numbers] < 0], minlength=len(texts)) > 0
    bad |= np.array([not t for t in texts], bool)
    keep = ~bad[of]
    return numbers[keep], of[keep], np.where(bad, 0, n)


def _aligned(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    own = aligner(path_a, path_b)
    for idents, texts, _ in steps(batches):
        numbers, of, n = sound_runs(own, texts)
        cols = [idents]
        for pool in (own.ids_a, own.ids_b):
            per = np.bincount(of, pool.lengths(numbers), len(texts)).astype(np.int64)
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(pool.values[0][pool.places(numbers)], pa.int32())))
        per = own.groups.lengths(numbers)
        places, chunk = own.groups.places(numbers), np.repeat(np.arange(len(numbers)), per)
        length = own.chunk.values[1][numbers]
        # a group's end counts from its chunk's first byte; chunks follow each other in their document
        before = np.cumsum(length) - length
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        before -= np.repeat(np.concatenate([before, [0]])[np.minimum(first, len(before))], n)
        end = own.groups.values[0][places] + before[chunk]
        groups = pa.StructArray.from_arrays([pa.array(end), *(pa.array(own.groups.values[k][places]) for k in (1, 2))], names=["end", "n_a", "n_b"])
        many = np.bincount(of, per, len(texts)).astype(np.int64)
        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), groups))
        yield pa.record_batch(cols, names=["ident", "a_ids", "b_ids", "groups"])


def _slim(docs: DataFrame, ident: str, text: str) -> DataFrame:
    common.ship(docs.sparkSession)
    return docs.select(F.col(common.quoted(ident)).alias("ident"), common.text_of(common.quoted(text)).alias("body"))


def align(docs: DataFrame, ident: str = "doc_id", text: str = "text", path_a: str = A_FILE, path_b: str = B_FILE) -> DataFrame:
    """Per document: ident, a_ids, b_ids, and groups in order, each with the byte of space+text it ends before and its tokens of A and of B."""
    slim = _slim(docs, ident, text)
    kind = slim.schema["ident"].dataType.simpleString()
    out = slim.mapInArrow(lambda it: _aligned(it, path_a, path_b), f"ident {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<end:bigint,n_a:bigint,n_b:bigint>>")
    return out.withColumnRenamed("ident", ident)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = aligner(path_a, path_b)
    space = len(own.bytes_a) * own.n_b
    block, size = TaskContext.get().partitionId() << 24, 0
    held: list[np.ndarray] = []

    def close() -> Iterator[pa.RecordBatch]:
        pairs, docs = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        for at in range(0, len(pairs), ROW):
            row = {"block": [block], "pairs": [pairs[at : at + ROW]], "holders": [docs[at : at + ROW]]}
            yield pa.record_batch([pa.array(row.get(f.name, [None]), f.type) for f in schema], schema=schema)

    for idents, texts, more in steps(batches):
        numbers, of, _ = sound_runs(own, texts)
        d = len(texts)
        n = {c: np.bincount(of, x, d).astype(np.int64) for c, x in zip(_NUMBERS, (own.ids_a.lengths(numbers), own.ids_b.lengths(numbers), own.groups.lengths(numbers), own.chunk.values[0][numbers]), strict=True)}
        edge = np.searchsorted(of, np.arange(d + 1)).tolist()
        shown = [own.texts[k] for k in numbers.tolist()]
        digest = [hashlib.sha256(b";".join(shown[i:j])).hexdigest() if j > i else "" for i, j in zip(edge, edge[1:], strict=False)]
        # different chunks of each document first, then their pairs
        seen, times = counted(of * own.chunk.n + numbers, np.ones(len(numbers), np.int64))
        of, numbers = seen // max(1, own.chunk.n), seen % max(1, own.chunk.n)
        places, per = own.pairs.places(numbers), own.pairs.lengths(numbers)
        keys, numbers = counted(np.repeat(of, per) * space + own.pairs.values[0][places], own.pairs.values[1][places] * np.repeat(times, per))
        starts = pa.array(np.searchsorted(keys, np.arange(d + 1) * space), pa.int32())
        keys %= space
        held.append(keys)
        cols = {"block": pa.array(np.full(d, block)), "ident": idents, **{c: pa.array(x) for c, x in n.items()}, "groups_sha256": pa.array(digest)}
        cols |= {"keys": pa.ListArray.from_arrays(starts, pa.array(keys)), "numbers": pa.ListArray.from_arrays(starts, pa.array(numbers))}
        yield pa.record_batch([cols[f.name] if f.name in cols else pa.nulls(d, f.type) for f in schema], schema=schema)
        size += more
        if size >= BLOCK:
            yield from close()
            block, size = block + 1, 0
            held = []
    yield from close()


def _meet(docs: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    """A block's documents with the counts it asked for."""
    pair, count, best = (answers.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pair)
    pair, count, best = pair[order], count[order], best[order]
    out = []
    for b in docs.to_batches():
        keys, numbers = b.column("keys"), b.column("numbers").flatten().to_numpy()
        at = np.searchsorted(pair, keys.flatten().to_numpy())
        sums = [np.concatenate([[0], np.cumsum(numbers * x)]) for x in (count[at], best[at].astype(np.int64))]
        ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
        of = {c: s[ends[1:]] - s[ends[:-1]] for c, s in zip(("count_sum", "n_best"), sums, strict=True)}
        out.append(pa.record_batch([pa.array(of[f.name]) if f.name in of else b.column(f.name) for f in schema], schema=schema))
    return pa.Table.from_batches(out, schema)


def _schema(docs: DataFrame, *columns: str) -> StructType:
    """The identifier with the named columns behind it, arrays where a name ends in []."""
    out = StructType().add("ident", docs.schema["ident"].dataType)
    for c in columns:
        kind = StringType() if c == "groups_sha256" else ArrayType(LongType()) if c.endswith("[]") else LongType()
        out = out.add(c.removesuffix("[]"), kind)
    return out


def _task_table(docs: DataFrame, ident: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """A row a document (block, its numbers, its pairs) and rows of each block's pairs, written."""
    slim = _slim(docs, ident, text)
    schema = _schema(slim, "block", *_NUMBERS, "groups_sha256", "keys[]", "numbers[]", "pairs[]", "holders[]")
    arrow = to_arrow_schema(schema)
    return common.written(slim.mapInArrow(lambda it: _blocks(it, path_a, path_b, arrow), schema), "aligned")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, docs: how many documents hold the pair linked."""
    return _asked(table).groupBy("pair").agg(F.sum("holders").alias("docs"))


def _asked(table: DataFrame) -> DataFrame:
    rows = table.where("pairs IS NOT NULL").select("block", F.inline(F.arrays_zip("pairs", "holders")))
    return rows.withColumnRenamed("pairs", "pair")


def links(docs: DataFrame, ident: str = "doc_id", text: str = "text", path_a: str = A_FILE, path_b: str = B_FILE) -> DataFrame:
    """a_id, b_id, docs: every id pair that is linked somewhere, and the number of documents that hold it."""
    table = _task_table(docs, ident, text, path_a, path_b)
    n_b = aligner(path_a, path_b).n_b
    return pair_counts(table).select(F.expr(f"pair div {n_b}").alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "docs")


def scores(docs: DataFrame, ident: str = "doc_id", text: str = "text", path_a: str = A_FILE, path_b: str = B_FILE) -> DataFrame:
    """Per document: ident, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = _task_table(docs, ident, text, path_a, path_b)
    n_b = aligner(path_a, path_b).n_b
    counts = common.written(pair_counts(table), "pairs")
    # one row an entry of A's vocabulary at most
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("docs").alias("most"))
    answers = _asked(table).select("block", "pair").join(counts, "pair").join(F.broadcast(best), F.expr(f"pair div {n_b} = a"))
    answers = answers.select(F.col("block").alias("asker"), "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    rows = table.where("n_a IS NOT NULL").drop("pairs", "holders")
    schema = _schema(rows, *_NUMBERS, "n_best", "count_sum", "groups_sha256")
    arrow = to_arrow_schema(schema)
    out = rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(lambda x, y: _meet(x, y, arrow), schema)
    return out.withColumnRenamed("ident", ident)
