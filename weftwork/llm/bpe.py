"""Byte-pair encoding as a bounded-lookahead transducer, and its inverse as a state machine.

The merge list fixes how far to the right a token can depend on symbols not yet read.  A rule
(u, v) is undone only by an earlier rule that takes the right end of v, or v itself, for its
right neighbour, and that rule by a still earlier one; ranks fall along such a chain, so the
reach of every token follows from one pass over the list (`MergeTable.lookahead`).  A word is
fed symbol by symbol; tokens that end further than the lookahead from the end of what was read
are final, leave the buffer and are emitted.  The buffer stays within a constant, whatever the
length of the word; every word goes this way, and the short ones end before anything is final.
Results of short words are kept in two generations of bounded size.  What is held besides is a
slice of text, which ends at white space: a text without any is one slice.

Text goes to words as the tokenizer's file says: special tokens are cut out of the raw text,
then composed form, single spaces, lower case, and the split pattern.  White space always
separates words, so chunks between white space are independent.  Chunks below U+0250 take
rules written here; others take the normaliser and splitter of the tokenizers library, which
alone know the Unicode tables that the vocabulary was made with.  Arrow cuts the chunks of some
texts at a time and numbers the different ones, so that only those meet Python.

Decoding feeds token ids to a machine that turns bytes into text as soon as a character is
whole; broken bytes become U+FFFD.  Where the tokenizer's file names no decoder, the library
joins token strings by single spaces; `pieces=True` gives that form.

Defined results: a null text counts as empty and gives no ids and the empty text.  Columns
besides the text are carried through, but for those named like a result, which are replaced.
An empty table gives an empty result; ids may be null or repeated.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The vocabulary file, by its name in the public_tokenizers package; a path does as well.
TOKENIZER = "word_bpe_49k.json"
#: Chunks, and words, that a worker keeps in the younger of two generations.
CACHE, WORD_CACHE = 80_000, 200_000
#: Chunks and words above this length are not kept.
CACHE_CHARS = 64
#: Characters of a text, and of all texts, worked on at a time.
SLICE, GROUP = 1 << 16, 3 << 20
_NONE = 1 << 30
_BLANKS = " \t\n\x0b\x0c\r"
#: Characters beyond the plain rules: blanks on which Unicode tables differ, and U+0250 on.
_ODD = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: Letters below U+0100 in lower case, for a class of a pattern; those beyond come in turns with capitals.
LOWER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
#: Texts with these are left as they are: beyond the plain rules, the start of a special token, and a letter that is two in lower case.
_LEFT = f"{_ODD.pattern}|[<\u0130]"
#: A stop between a letter and white space or the end is a word of its own wherever it stands.
_STOP = f"([{LOWER}])([.,;:!?])([{_BLANKS}]|$)"


def resolve(path: str) -> str:
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MergeTable:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        marks = byte_alphabet()
        self.start = [vocab[m] for m in marks]
        self.last = [vocab[m + suffix] for m in marks]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        size = [1] * (max(vocab.values()) + 1)
        taken, within = [0] * len(size), [0] * len(size)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a.removesuffix(suffix) + b if suffix else a + b]
            self.rank.setdefault(x << 20 | y, r)
            self.made.append(z)
            reach = max(within[y], taken[y])
            size[z] = size[x] + size[y]
            within[z] = max(within[z], reach)
            taken[x] = max(taken[x], size[y] + reach)
        self.size = size
        #: Symbols right of a token's end that settle it.
        self.lookahead = max(map(max, taken, within))

    def settle(self, ids: list[int]) -> list[int]:
        """The merges of one buffer: lowest rank first, leftmost first."""
        rank, made = self.rank, self.made
        pairs = [rank.get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            r = min(pairs)
            if r == _NONE:
                break
            i = pairs.index(r)
            ids[i : i + 2] = [made[r]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(pairs):
                pairs[i] = rank.get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of one word that arrives in blocks; the last symbol waits for the word's end."""
        hold: list[int] = []
        last, room, start = None, 2 * self.lookahead + 64, self.start
        for block in blocks:
            for b in block:
                if last is not None:
                    hold.append(start[last])
                last = b
                if len(hold) >= room:
                    done, at, stable = self.settle(hold[:]), 0, []
                    for t in done:
                        if at + self.size[t] > room - self.lookahead:
                            break
                        at += self.size[t]
                        stable.append(t)
                    del hold[:at]
                    if stable:
                        yield stable
                    else:
                        room *= 2
        if last is not None:
            yield self.settle([*hold, self.last[last]])

    def word(self, raw: bytes) -> list[int]:
        """The transducer over one word; most end before their first token could be settled."""
        return list(chain.from_iterable(self.stream([raw])))


class Chunks:
    """Texts to packed ids, through bounded maps from chunks and from words to ids.

    `words_to_ids` gets words not met lately, a group of texts at a time; a subclass says how.
    Maps have two generations: when the younger is full it becomes the older, and what is
    asked for again moves back.
    """

    def __init__(self, path: str = TOKENIZER, cache: int = CACHE, word_cache: int = WORD_CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(resolve(path))
        self.library.no_truncation()
        self.library.no_padding()
        with open(resolve(path), encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        # stops are cut off where the pattern takes runs of letters, and of marks, each for itself
        self.lowers = "Lowercase" in json.dumps(self.spec["normalizer"]) and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(self.split.pattern.split("|"))
        vocab = self.spec["model"]["vocab"]
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in chain(vocab.items(), self.special.items()):
            self.names[i] = name
        self.code = "H" if len(self.names) <= 1 << 16 else "I"
        self.cache, self.word_cache = cache, word_cache
        self.chunks: list[dict[str, bytes]] = [{}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]

    def pack(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def unpack(self, raw: bytes) -> list[int]:
        return memoryview(raw).cast(self.code).tolist()

    def words_to_ids(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def odd(self, text: str) -> bytes:
        """Ids of a text or chunk outside the plain rules."""
        raise NotImplementedError

    def _resolve(self, missing: Iterable[str]) -> dict[str, bytes]:
        old = self.chunks[1]
        now = {c: old.get(c) for c in missing}
        parts: dict[str, list[str | bytes]] = {}
        for c in [c for c, x in now.items() if x is None]:
            got: list[str | bytes] = []
            for piece in self.cut.split(c) if self.cut and "<" in c else (c,):
                if piece in self.special:
                    got.append(self.pack([self.special[piece]]))
                elif _ODD.search(piece):
                    got.append(self.odd(piece))
                elif piece:
                    got.extend(self.split.findall(piece.lower()))
            parts[c] = got
        young, old = self.words
        wanted = {w: old.get(w) for got in parts.values() for w in got if isinstance(w, str) and w not in young}
        fresh = [w for w, x in wanted.items() if x is None]
        wanted.update(zip(fresh, self.words_to_ids(fresh), strict=True))
        for c, got in parts.items():
            now[c] = b"".join(x if isinstance(x, bytes) else wanted[x] if x in wanted else young[x] for x in got)
        young.update((w, x) for w, x in wanted.items() if len(w) <= CACHE_CHARS)
        self.chunks[0].update((c, x) for c, x in now.items() if len(c) <= CACHE_CHARS)
        for maps, most in ((self.words, self.word_cache), (self.chunks, self.cache)):
            if len(maps[0]) > most:
                maps[:] = [{}, maps[0]]
        return now

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Lower case, with a blank before single stops, so that far fewer chunks differ; texts outside the plain rules stay."""
        if not self.lowers:
            return texts
        lower = pc.replace_substring_regex(pc.utf8_lower(texts), _STOP, r"\1 \2\3")
        return pc.if_else(pc.match_substring_regex(texts, _LEFT), texts, lower)

    def _group(self, units: list[tuple[int, str]]) -> Iterator[tuple[int, bytes]]:
        """Arrow cuts the chunks and numbers the different ones; only those are looked up."""
        if not units:
            return
        lists = pc.ascii_split_whitespace(self.prepared(pa.array([t for _, t in units], pa.string())))
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        found = list(map(self.chunks[0].get, keys))
        if None in found:
            now = self._resolve([c for c, x in zip(keys, found, strict=True) if x is None])
            found = [now[c] if x is None else x for c, x in zip(keys, found, strict=True)]
        ids = np.frombuffer(b"".join(found), f"<u{array(self.code).itemsize}")
        size = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        at = coded.indices.to_numpy()
        sizes = size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # a group's ids are few enough for 32 bits
        places = np.repeat(((np.cumsum(size) - size)[at] - ends[:-1]).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        out = ids[places]
        cuts = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        for (i, _), low, high in zip(units, cuts, cuts[1:], strict=False):
            yield i, out[low:high].tobytes()

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(index of the text, packed ids), in order; a long text comes in slices that end at white space."""
        group, size = [], 0
        for i, text in enumerate(texts):
            at, n = 0, len(text or "")
            while at < n:
                end = min(n, at + SLICE)
                while end < n and text[end] not in _BLANKS:
                    end += 1
                group.append((i, text[at:end]))
                size += end - at
                at = end
                if size > GROUP:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def encode(self, text: str | None) -> list[int]:
        return self.unpack(b"".join(x for _, x in self.stream([text])))


class Encoder(Chunks):
    """The transducer behind the maps."""

    def __init__(self, path: str = TOKENIZER, cache: int = CACHE, word_cache: int = WORD_CACHE):
        super().__init__(path, cache, word_cache)
        model = self.spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.byte_of = {m: b for b, m in enumerate(byte_alphabet())}

    def words_to_ids(self, words: list[str]) -> list[bytes]:
        return [self.pack(self.table.word(w.encode())) for w in words]

    def odd(self, text: str) -> bytes:
        out = []
        for piece in self.cut.split(text) if self.cut else (text,):
            if piece in self.special:
                out.append(self.pack([self.special[piece]]))
            elif piece:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)):
                    out.append(self.pack(self.table.word(bytes(map(self.byte_of.__getitem__, word)))))
        return b"".join(out)


class Decoder:
    """Ids to text, block by block.  The state is an unfinished character and, for pieces, whether a token came before."""

    def __init__(self, encoder: Encoder, pieces: bool = False):
        marks, suffix = encoder.byte_of, encoder.table.suffix
        special = set(encoder.special)

        def raw(name: str) -> bytes:
            if pieces or name in special:
                return name.encode()
            body = name.removesuffix(suffix) if suffix else name
            return bytes(map(marks.__getitem__, body)) + b" " * (bool(suffix) and body != name)

        self.bytes, self.pieces = [raw(n) for n in encoder.names], pieces
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = (b" " if self.pieces else b"").join(map(self.bytes.__getitem__, ids))
        if self.pieces and self.begun:
            raw = b" " + raw
        self.begun = True
        return self.state.decode(raw)

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        self.begun = False
        return rest


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def decoder(path: str, pieces: bool) -> Decoder:
    return Decoder(encoder(path), pieces)


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _mapped(df: DataFrame, used: str, new: list[tuple[str, str, pa.DataType]], rows: Callable[[list], list[tuple]], drop: bool = False) -> DataFrame:
    """Add columns that a worker computes from one column, some rows of an Arrow batch at a time."""
    common.ship(df.sparkSession)
    carried = [c for c in df.columns if c not in {n for n, _, _ in new} and not (drop and c == used)]
    slim = df.select(*[F.col(common.quoted(c)) for c in carried], F.col(used).alias(common.fresh(carried, "in")))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried), *(f"{n} {kind}" for n, kind, _ in new)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                made = list(map(list, zip(*rows(b.column(b.num_columns - 1).to_pylist()), strict=True))) or [[] for _ in new]
                cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(v, t) for v, (_, _, t) in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*carried, *(n for n, _, _ in new)])

    return common.plain(slim).mapInArrow(work, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """docs with the column `ids`, array<int>."""

    def rows(texts: list[str | None]) -> list[tuple]:
        enc, out = encoder(path), [[] for _ in texts]
        for i, raw in enc.stream(texts):
            out[i] += enc.unpack(raw)
        return [(x,) for x in out]

    return _mapped(docs, text, [(ids, "array<int>", pa.list_(pa.int32()))], rows)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str = TOKENIZER, pieces: bool = False) -> DataFrame:
    """df with the text of its ids."""

    def rows(all_ids: list[list[int] | None]) -> list[tuple]:
        d = decoder(path, pieces)
        return [(d.feed(x or []) + d.end(),) for x in all_ids]

    return _mapped(df, ids, [(text, "string", pa.string())], rows)


def _digests(texts: list[str | None], path: str) -> list[tuple[int, str, str]]:
    enc, dec = encoder(path), decoder(path, True)
    names = _decimals(len(enc.names))
    out = []

    def end() -> None:
        text_sha.update(dec.end().encode())
        out.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))

    n, ids_sha, text_sha, at = 0, hashlib.sha256(), hashlib.sha256(), 0
    for i, raw in enc.stream(texts):
        while at < i:
            end()
            n, ids_sha, text_sha, at = 0, hashlib.sha256(), hashlib.sha256(), at + 1
        ids = enc.unpack(raw)
        if ids:
            ids_sha.update((" " if n else "").encode() + " ".join(map(names.__getitem__, ids)).encode())
            text_sha.update(dec.feed(ids).encode())
            n += len(ids)
    while at < len(texts):
        end()
        n, ids_sha, text_sha, at = 0, hashlib.sha256(), hashlib.sha256(), at + 1
    return out


def digests(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256, encoded and decoded slice by slice."""
    new = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, text, new, lambda t: _digests(t, path), drop=True)
