"""Token ids in Arrow files of equal-length sequences.

A range partition of documents in ascending identifier order becomes one or more pairs of
files.  NAME.arrow is an Arrow file whose record batches hold two fixed-size-list columns: the
ids, and a mask of the places that hold an id (the end of a file is padded).  A batch's values
are one contiguous buffer, so a memory-mapped file gives any sequence, and any span over
sequences of a batch, without a copy.  NAME.docs.arrow lists the documents of the file with
their place and length.  Documents never cross files.

Files are written under a name of the attempt and renamed when whole, so a task that runs twice
leaves one file.  The manifest (a small Parquet table beside them) has one row per file; its
running sum gives each file's place in the whole stream.  Ids take 16 bits where the vocabulary
allows, else 32.

Chunks between white space are independent under the vocabulary's rules, so each different
chunk (words, as stops at their ends stand apart) goes to the tokenizers library once per worker
(in bounded caches); texts with white space on which Python and the tokenizer disagree go there whole.

Defined results: a null text counts as empty and holds the end id alone.  Null identifiers come
first; equal identifiers are in the order of their texts' hashes.  An empty table gives an empty
manifest.  Other columns are not written.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

SEQUENCE = 2048
#: Sequences in a record batch, and ids in a file before the next one begins.
BATCH = 128
FILE_IDS = 64 << 20
END_ID = 1


#: A chunk that is one word: letters below U+0100 in lower case.
_PLAIN = f"^[{bpe.LOWER}]{{1,40}}$"


class LibraryEncoder(bpe.Chunks):
    """The tokenizers library behind the bounded maps of chunks and words.

    Plain words go to the library's model without its normaliser and splitter, which would leave
    them as they are in lower case; as only a word's last token has the suffix, the ids of many
    words come in one call.  Vocabularies without such a suffix take the whole library throughout.
    """

    def __init__(self, path: str, cache: int = bpe.CACHE):
        super().__init__(path, cache)
        from tokenizers import Tokenizer

        suffix = self.spec["model"].get("end_of_word_suffix")
        self.last = np.array([bool(suffix) and n.endswith(suffix) for n in self.names])
        cut = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        plain = self.spec | {"normalizer": None, "pre_tokenizer": cut, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
        self.model = Tokenizer.from_str(json.dumps(plain)) if suffix else None

    def words_to_ids(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        [e] = self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, f"<u{array(self.code).itemsize}")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) != len(words):
            raise ValueError("a word has not one last token")
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _resolve(self, missing: list[str]) -> dict[str, bytes]:
        """All new plain words in one call; other chunks in one call with a special token, which always stands alone, between them."""
        if not self.special or self.model is None:
            return {c: self.odd(c) for c in missing}
        old = self.chunks[1]
        now = {c: old.get(c) for c in missing}
        fresh = [c for c, x in now.items() if x is None]
        plain = pc.match_substring_regex(pa.array(fresh, pa.string()), _PLAIN).to_pylist()
        words = list(compress(fresh, plain))
        now.update(zip(words, self.words_to_ids(words), strict=True))
        self._whole([c for c, x in zip(fresh, plain, strict=True) if not x], now)
        self.chunks[0].update((c, x) for c, x in now.items() if len(c) <= bpe.CACHE_CHARS)
        if len(self.chunks[0]) > self.cache:
            self.chunks = [{}, self.chunks[0]]
        return now

    def _whole(self, fresh: list[str], now: dict[str, bytes | None]) -> None:
        mark, code = next(iter(self.special.items()))
        sound = [c for c in fresh if "<" not in c or not self.cut.search(c)]
        if sound:
            [e] = self.library.encode_batch_fast([mark.join(sound)], add_special_tokens=False)
            ids = np.array(e.ids, f"<u{array(self.code).itemsize}")
            cuts = np.flatnonzero(ids == code)
            if len(cuts) != len(sound) - 1:
                raise ValueError("the separator is not a token of its own")
            raw, wide = ids.tobytes(), ids.itemsize
            now.update(zip(sound, [raw[i:j] for i, j in zip([0, *(wide * (cuts + 1)).tolist()], [*(wide * cuts).tolist(), len(raw)], strict=True)], strict=True))
        now.update((c, self.odd(c)) for c in fresh if now[c] is None)

    def odd(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path, 5 * bpe.CACHE)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """One pair of files; documents are begun one by one and extended by blocks of ids."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, batch: int):
        self.fs, root = filesystem(folder)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.temp}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.buffer, self.used = np.zeros(length * batch, dtype), 0
        self.length, self.n_ids = length, 0
        self.docs: list[list[int | None]] = []

    def begin(self, ident: int | None) -> None:
        self.docs.append([ident, self.n_ids, 0])

    def extend(self, block: np.ndarray) -> None:
        """More ids of the document begun last."""
        at = 0
        while at < len(block):
            n = min(len(block) - at, len(self.buffer) - self.used)
            self.buffer[self.used : self.used + n] = block[at : at + n]
            self.used += n
            at += n
            if self.used == len(self.buffer):
                self._flush()
        self.n_ids += len(block)
        self.docs[-1][2] += len(block)

    def _flush(self) -> None:
        n = -(-self.used // self.length)
        if not n:
            return
        self.buffer[self.used :] = 0
        values = self.buffer[: n * self.length].copy()
        mask = np.arange(len(values)) < self.used
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)], schema=self.schema))
        self.used = 0

    def close(self) -> tuple[str, int, int]:
        self._flush()
        self.out.close()
        self.sink.close()
        cols = [pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)]
        docs = pa.record_batch(cols, names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.temp}.docs.arrow") as sink, pa.ipc.new_file(sink, docs.schema) as out:
            out.write_batch(docs)
        for end in (".docs.arrow", ".arrow"):
            self.fs.move(f"{self.temp}{end}", f"{self.final}{end}")
        return self.final, len(self.docs), self.n_ids


class Reader:
    """Random access to one pair of files."""

    def __init__(self, folder: str, name: str):
        system, root = filesystem(folder)
        path = f"{root}/{name}"
        local = isinstance(system, pafs.LocalFileSystem)
        get = pa.memory_map if local else system.open_input_file
        self.file = pa.ipc.open_file(get(f"{path}.arrow"))
        self.documents = pa.ipc.open_file(get(f"{path}.docs.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._values = -1, None
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._values = i, self.file.get_batch(i).column("ids").flatten().to_numpy()
        return self._values

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence; the ids are a view of the file where it is mapped."""
        batch, row = divmod(i, self.rows)
        mask = self.file.get_batch(batch).column("mask")[row].values.to_numpy(zero_copy_only=False)
        return self._batch(batch)[row * self.length : (row + 1) * self.length], mask

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from a place on, in views of the batches that hold them."""
        step = self.rows * self.length
        while n > 0:
            i, at = divmod(start, step)
            part = self._batch(i)[at : at + n]
            yield part
            start += len(part)
            n -= len(part)


def _write(batches: Iterable[pa.RecordBatch], folder: str, path: str, length: int, batch: int, file_ids: int, end: int) -> Iterator[pa.RecordBatch]:
    enc = library_encoder(path)
    dtype = np.dtype(f"<u{array(enc.code).itemsize}")
    part, k, out = TaskContext.get().partitionId(), 0, None
    last = np.asarray([end], dtype)
    done: list[tuple] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            idents, texts = (b.column(i).to_pylist() for i in (0, 1))
            found = enc.stream(texts)
            ahead = next(found, None)
            for i, ident in enumerate(idents):
                if out is None:
                    out = Writer(folder, f"part-{part:07d}-{k:05d}", dtype, length, batch)
                out.begin(ident)
                while ahead and ahead[0] == i:
                    out.extend(np.frombuffer(ahead[1], dtype))
                    ahead = next(found, None)
                out.extend(last)
                if out.n_ids >= file_ids:
                    done.append((part, k, *out.close()))
                    k, out = k + 1, None
    if out is not None:
        done.append((part, k, *out.close()))
    if done:
        p, ks, names, docs, ids = zip(*done, strict=True)
        yield pa.record_batch([pa.array(p, pa.int64()), pa.array(ks, pa.int64()), pa.array([n.rsplit("/", 1)[1] for n in names]), pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], names=["part", "k", "name", "n_docs", "n_ids"])


def write(docs: DataFrame, folder: str, ident: str = "doc_id", text: str = "text", path: str = bpe.TOKENIZER, end: int = END_ID, length: int = SEQUENCE, batch: int = BATCH, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files under folder, which all machines share; returns the manifest with `first`."""
    spark = docs.sparkSession
    common.ship(spark)
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    slim = docs.select(F.col(ident).cast("long").alias("ident"), common.text_of(text).alias("body"))
    # the sort's second key settles ties; it is read from the shuffled rows
    dealt = slim.repartitionByRange(F.col("ident")).sortWithinPartitions("ident", F.xxhash64("body"))
    rows = dealt.mapInArrow(lambda it: _write(it, folder, path, length, batch, file_ids, end), "part long, k long, name string, n_docs long, n_ids long")
    rows.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file; `first` is the number of ids in the files before it."""
    rows = spark.read.schema("part long, k long, name string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's files, dealt one by one: a stated number of partitions is not made fewer at run time."""
    files = manifest(spark, folder).select("name", "first")
    return files.repartition(max(1, min(files.count(), 20_000)), "name")


def _crc(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            r, crcs = Reader(folder, name), []
            starts, counts = (r.documents.column(c).to_numpy() for c in ("start", "n_tokens"))
            for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
                crc = 0
                for part in r.span(s, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            yield pa.record_batch([r.documents.column("doc_id").combine_chunks(), pa.array(starts + first), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    return files_of(spark, folder).mapInArrow(lambda it: _crc(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All sequences: place of the first id, ids, mask."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, at = Reader(folder, name), first
                for i in range(r.file.num_record_batches):
                    x = r.file.get_batch(i)
                    places = pa.array(at + np.arange(x.num_rows) * r.length, pa.int64())
                    at += x.num_rows * r.length
                    yield pa.record_batch([places, x.column("ids").cast(pa.list_(pa.int32())), x.column("mask").cast(pa.list_(pa.bool_()))], names=["start", "ids", "mask"])

    return files_of(spark, folder).mapInArrow(work, "start long, ids array<int>, mask array<boolean>")
