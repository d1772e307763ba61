"""Exports that are one file: CSV, JSON and XLSX, as a data source that tasks write side by side.

Each task turns its rows into finished bytes of the format in a file of its own beside the target and
reports how many (`Fragment`).  The commit puts a head, the fragments in the order of partitions and a
tail behind each other, under another name, and renames that when whole; what tasks wrote goes with it, also
when the job fails.  Rows never pass the driver.  Bytes are joined by the file system where it can (the
kernel copies them between local files) and in blocks of `BLOCK` bytes elsewhere.

A workbook is a ZIP archive of deflated sheets.  Tasks deflate their rows in fragments that end on a byte and
refer to nothing before them, so the commit can lay them behind each other as one member, whose check
sum follows from those of the fragments.  Sheets are filled fragment by fragment up to the
format's limit of rows; rows beyond it go on in a further sheet, under the same header.

    df.write.format("single_file").option("kind", "xlsx").mode("append").save("/exports/items.xlsx")

`workbook` reads the cells of a workbook back as text, a partition a sheet.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import places

#: Rows of a sheet, by its format, header included; rows of a fragment of it.
SHEET_ROWS = 1_048_576
FRAGMENT_ROWS = 65_536
#: Characters of texts from which on a fragment is full before that; bytes of a CSV file that a task reads.
FRAGMENT_CHARS, RANGE = 8 << 20, 32 << 20
BLOCK = 8 << 20
#: Rows by which a task sets column widths; rows of a batch that are held as Python values at once.
MEASURED, SLICE = 200, 512


@dataclass
class Piece:
    """Bytes at a place of a task's file; for sheets also the text's length and check sum."""

    start: int
    size: int
    rows: int
    raw: int = 0
    crc: int = 0


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    file: str
    pieces: list[Piece] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.pieces)


# ---- check sums and archives --------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, bits reversed as zlib has them."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The check sum of two texts behind each other, from theirs and the second's length."""
    power, base, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = _times(power, base)
        base, n = _times(base, base), n >> 1
    return _times(power, first) ^ second


def deflated(text: bytes, last: bool = False) -> bytes:
    """A stretch of a raw deflate stream that refers to nothing before it."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(text) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


class Archive:
    """A ZIP archive whose members' compressed bytes and sums are known; large ones by its 64-bit records."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str, size: int, raw: int, crc: int) -> None:
        self.entries.append((name.encode(), size, raw, crc, self.at))
        # sizes stand in the 64-bit extra field throughout, so that a header's length does not hang on them
        extra = struct.pack("<HHQQ", 1, 16, raw, size)
        self.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), len(extra)) + name.encode() + extra)

    def add(self, name: str, text: str) -> None:
        raw = text.encode()
        data = deflated(raw, last=True)
        self.begin(name, len(data), len(raw), zlib.crc32(raw))
        self.write(data)

    def close(self) -> None:
        start = self.at
        for name, size, raw, crc, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, raw, size, at)
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, end, n = self.at - start, self.at, len(self.entries)
        self.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


# ---- formats ------------------------------------------------------------------------------


class Csv:
    """RFC 4180 with a byte-order mark and a header; nulls are empty, empty texts are quoted."""

    def __init__(self, columns: Sequence[str], options: dict):
        self.columns = columns

    def _lines(self, rows) -> bytes:
        out = io.StringIO()
        plain, told = csv.writer(out), csv.writer(out, quoting=csv.QUOTE_NOTNULL)
        for r in rows:
            (told if "" in r else plain).writerow(r)
        return out.getvalue().encode()

    def pieces(self, rows: Iterator[list]) -> Iterator[tuple[bytes, Piece]]:
        for some in _some(rows, 4096):
            data = self._lines(some)
            yield data, Piece(0, len(data), len(some))

    def join(self, out, fragments: list[Fragment], copy: Callable) -> None:
        out.write(b"\xef\xbb\xbf" + self._lines([self.columns]))
        for f in fragments:
            for p in f.pieces:
                copy(f, p)


class Json:
    """An indented array; rows are objects as JSON text in the one column `value`."""

    def __init__(self, columns: Sequence[str], options: dict):
        if list(columns) != ["value"]:
            raise ValueError("rows of a JSON file are objects as text in the column `value`")

    def pieces(self, rows: Iterator[list]) -> Iterator[tuple[bytes, Piece]]:
        for some in _some(rows, 4096):
            shown = [json.dumps(json.loads(r[0]), ensure_ascii=False, indent=2).replace("\n", "\n  ") for r in some]
            data = ",\n".join(f"  {x}" for x in shown).encode()
            yield data, Piece(0, len(data), len(some))

    def join(self, out, fragments: list[Fragment], copy: Callable) -> None:
        lead = b"[\n"
        for f in fragments:
            for p in f.pieces:
                out.write(lead)
                copy(f, p)
                lead = b",\n"
        out.write(b"[]\n" if lead == b"[\n" else b"\n]\n")


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: A carriage return that stands as it is would be read as a line feed.
_RETURN = {"\r": "&#13;"}


def letters(i: int) -> str:
    """The name of a column by its place from 0."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(v, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"{s}><v>{int(v)}</v></c>'
    if isinstance(v, int | float) and v == v and abs(v) != float("inf"):
        return f"<c{s}><v>{v!r}</v></c>"
    text = "".join(c for c in str(v) if c in "\t\n\r" or ord(c) >= 32 and c not in "￾￿")
    return f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape(text, _RETURN)}</t></is></c>'


class Xlsx:
    """Sheets with a bold header that stays in view, widths by the first rows, and a filter over all."""

    def __init__(self, columns: Sequence[str], options: dict):
        self.columns, self.sheet = columns, options.get("sheet", "Items")

    def pieces(self, rows: Iterator[list]) -> Iterator[tuple[bytes, Piece]]:
        for some in _some(rows, FRAGMENT_ROWS, FRAGMENT_CHARS):
            raw = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in some).encode()
            data = deflated(raw)
            yield data, Piece(0, len(data), len(some), len(raw), zlib.crc32(raw))

    def _sheets(self, fragments: list[Fragment]) -> list[list[tuple[Fragment, Piece]]]:
        sheets: list[list[tuple[Fragment, Piece]]] = [[]]
        rows = 0
        for f in fragments:
            for p in f.pieces:
                if rows + p.rows >= SHEET_ROWS:
                    sheets.append([])
                    rows = 0
                sheets[-1].append((f, p))
                rows += p.rows
        return sheets

    def join(self, out, fragments: list[Fragment], copy: Callable) -> None:
        sheets, z = self._sheets(fragments), Archive(out)
        names = [self.sheet[:31]] + [f"{self.sheet[: 31 - len(f' ({k})')]} ({k})" for k in range(2, len(sheets) + 1)]
        part = lambda k: f"worksheets/sheet{k + 1}.xml"
        kinds = "".join(f'<Override PartName="/xl/{p}" ContentType="{_KIND}.{c}+xml"/>' for p, c in [("workbook.xml", "sheet.main"), ("styles.xml", "styles"), *((part(k), "worksheet") for k in range(len(sheets)))])
        z.add("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        rel = lambda i, kind, to: f'<Relationship Id="r{i}" Type="{_REL}/{kind}" Target="{to}"/>'
        rels = lambda inner: f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
        z.add("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        z.add("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{"".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))}</sheets></workbook>')
        z.add("xl/_rels/workbook.xml.rels", rels("".join(rel(k + 1, "worksheet", part(k)) for k in range(len(sheets))) + rel(len(sheets) + 1, "styles", "styles.xml")))
        z.add("xl/styles.xml", f'{_HEAD}<styleSheet {_MAIN}><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9D9D9"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>')
        widths = [max(len(c), *(f.widths[i] for f in fragments if f.widths), 0) for i, c in enumerate(self.columns)]
        cols = "".join(f'<col min="{i}" max="{i}" width="{min(max(10, w + 2), 60)}" customWidth="1"/>' for i, w in enumerate(widths, 1))
        head = f'{_HEAD}<worksheet {_MAIN}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData><row>{"".join(_cell(c, 1) for c in self.columns)}</row>'.encode()
        for k, held in enumerate(sheets):
            tail = f'</sheetData><autoFilter ref="A1:{letters(max(0, len(self.columns) - 1))}{sum(p.rows for _, p in held) + 1}"/></worksheet>'.encode()
            first, last = deflated(head), deflated(tail, last=True)
            crc, raw = zlib.crc32(head), len(head)
            for _, p in held:
                crc, raw = joined_crc(crc, p.crc, p.raw), raw + p.raw
            crc, raw = joined_crc(crc, zlib.crc32(tail), len(tail)), raw + len(tail)
            z.begin(f"xl/{part(k)}", len(first) + sum(p.size for _, p in held) + len(last), raw, crc)
            z.write(first)
            for f, p in held:
                copy(f, p)
                z.at += p.size
            z.write(last)
        z.close()


KINDS = {"csv": Csv, "json": Json, "xlsx": Xlsx}


def _some(rows: Iterator[list], n: int, chars: int | None = None) -> Iterator[list[list]]:
    """Up to n rows, or as many as have some characters of text."""
    held: list[list] = []
    size = 0
    for r in rows:
        held.append(r)
        if chars is not None:
            size += sum(len(v) for v in r if isinstance(v, str))
        if len(held) == n or chars is not None and size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---- the data source ----------------------------------------------------------------------


class SingleFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.kind, self.options, self.columns = options.get("kind", "csv").lower(), dict(options), schema.names
        if self.kind not in KINDS:
            raise ValueError(f"no format {self.kind!r}")
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragment:
        context = TaskContext.get()
        name = f"{context.partitionId():07d}-{context.taskAttemptId()}"
        fs, root = places.filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        out = Fragment(context.partitionId(), name, widths=[0] * len(self.columns))
        at = 0

        def rows() -> Iterator[list]:
            n = 0
            for b in iterator:
                # some rows of a batch at a time, as texts may be long
                for at in range(0, b.num_rows, SLICE):
                    for r in zip(*(c.slice(at, SLICE).to_pylist() for c in b.columns), strict=True):
                        if n < MEASURED:
                            out.widths = [max(w, len(str(v)) if v is not None else 0) for w, v in zip(out.widths, r, strict=True)]
                            n += 1
                        yield r

        with fs.open_output_stream(f"{root}/{name}") as f:
            for data, piece in KINDS[self.kind](self.columns, self.options).pieces(rows()):
                piece.start = at
                f.write(data)
                at += len(data)
                out.pieces.append(piece)
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, target = places.filesystem(self.path)
        root = places.filesystem(self.folder)[1]
        if fs.get_file_info(target).type != pafs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is there; overwrite it or take another name")
        fragments = sorted((m for m in messages if m and m.pieces), key=lambda m: m.partition)
        fs.create_dir(root, recursive=True)
        whole = f"{root}/whole"
        local = isinstance(fs, pafs.LocalFileSystem)
        with open(whole, "wb") if local else fs.open_output_stream(whole) as out:
            KINDS[self.kind](self.columns, self.options).join(out, fragments, lambda f, p: (_copy_local if local else _copy)(fs, f"{root}/{f.file}", p, out))
        fs.move(whole, target)
        fs.delete_dir(root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = places.filesystem(self.folder)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)


def _copy_local(fs: pafs.FileSystem, path: str, piece: Piece, out) -> None:
    """From file to file within the kernel."""
    out.flush()
    with open(path, "rb") as f:
        at, left = piece.start, piece.size
        while left:
            n = os.sendfile(out.fileno(), f.fileno(), at, min(left, 1 << 30))
            at, left = at + n, left - n
    out.seek(0, os.SEEK_END)


def _copy(fs: pafs.FileSystem, path: str, piece: Piece, out) -> None:
    with fs.open_input_file(path) as f:
        f.seek(piece.start)
        left = piece.size
        while left:
            data = f.read(min(left, BLOCK))
            out.write(data)
            left -= len(data)


class SingleFile(DataSource):
    """Options: path, kind (csv, json, xlsx), sheet (a workbook's first sheet)."""

    @classmethod
    def name(cls) -> str:
        return "single_file"

    def writer(self, schema: T.StructType, overwrite: bool) -> SingleFileWriter:
        return SingleFileWriter(self.options, schema, overwrite)


def write(df: DataFrame, path: str, kind: str, **options: str) -> None:
    """df's rows in the order of its partitions; columns as they are, for JSON one column `value` of objects as text."""
    df.sparkSession.dataSource.register(SingleFile)
    # a Python source knows no file to replace but its own target
    df.write.format("single_file").options(kind=kind, **options).mode("overwrite").save(path)


# ---- CSV read back ------------------------------------------------------------------------


def _records(path: str, start: int, end: int, quoted: bool) -> bytes:
    """The records behind the line ends outside quotes in a range of bytes, the last one whole."""
    fs, p = places.filesystem(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        data, at, inside = [], start, int(quoted)
        while chunk := f.read(min(BLOCK, end - at) if at < end else 1 << 16):
            a = np.frombuffer(chunk, np.uint8)
            odd = (np.cumsum(a == 34, dtype=np.uint8) + np.uint8(inside)) & 1
            inside = int(odd[-1])
            ends = np.flatnonzero((a == 10) & (odd == 0))
            if at < end:
                if data or len(ends):
                    data.append(chunk if data else chunk[int(ends[0]) + 1 :])
            elif not data:
                break  # no record begins behind a line end of this range
            else:
                data.append(chunk[: int(ends[0]) + 1] if len(ends) else chunk)
                if len(ends):
                    break
            at += len(chunk)
        return b"".join(data)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below the header of one CSV file, read by many tasks; empty cells are null, quoted ones empty texts.

    Tasks count the quotes of their bytes; the sums before each range, one number a range, tell whether it begins
    inside a text.  A record is read where the line end before it stands.
    """
    fs, p = places.filesystem(path)
    size = fs.get_file_info(p).size
    n = max(1, -(-size // RANGE))
    width = RANGE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, p = places.filesystem(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                with fs.open_input_file(p) as f:
                    f.seek(k * width)
                    found, left = 0, width
                    while left and (chunk := f.read(min(left, BLOCK))):
                        found, left = found + chunk.count(b'"'), left - len(chunk)
                yield pa.record_batch([pa.array([k]), pa.array([found])], names=["k", "quotes"])

    ranges = spark.range(0, n, 1, n)
    quotes = {r.k: r.quotes for r in ranges.mapInArrow(count, "k long, quotes long").collect()}
    inside, before = [], 0
    for k in range(n):
        inside.append(before % 2 == 1)
        before += quotes[k]
    kinds = T._parse_datatype_string(schema)
    names, alone = kinds.names, len(kinds) == 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for b in batches:
            for k in b.column(0).to_pylist():
                text = io.TextIOWrapper(io.BytesIO(_records(path, k * width, min(size, (k + 1) * width), inside[k])), "utf-8", newline="")
                for some in _some((r for r in csv.reader(text, quoting=csv.QUOTE_NOTNULL) if r), 4096, FRAGMENT_CHARS):
                    # the only cell of a row is quoted when it is empty, a null too
                    yield pa.record_batch([pa.array([v or None for v in c] if alone else c, pa.string()) for c in zip(*some, strict=True)], names=names)

    cells = ranges.mapInArrow(read, ", ".join(f"`{c}` string" for c in names))
    told = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.nullif(F.col(f"`{f.name}`"), F.lit(""))
    return cells.select(*[told(f).cast(f.dataType).alias(f.name) for f in kinds])


# ---- workbooks read back ------------------------------------------------------------------


@dataclass
class Sheet(InputPartition):
    number: int
    member: str


def _open(path: str) -> zipfile.ZipFile:
    fs, p = places.filesystem(path)
    return zipfile.ZipFile(fs.open_input_file(p))


def _place(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _rows(z: zipfile.ZipFile, member: str) -> Iterator[list[str | None]]:
    """A sheet's rows as text, parsed as they come."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    with z.open(member) as f:
        above = []
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if not e.tag.endswith("}row"):
                continue
            row: list[str | None] = []
            for c in e:
                at = _place(c.get("r")) if c.get("r") else len(row)
                row += [None] * (at - len(row))
                text = [t.text or "" for t in c.iter() if t.tag.endswith("}t")] if c.get("t") == "inlineStr" else [t.text or "" for t in c if t.tag.endswith("}v")]
                value = "".join(text) if text else None
                row.append(shared[int(value)] if c.get("t") == "s" and value else value)
            yield row
            above[-1].remove(e)


def _members(z: zipfile.ZipFile) -> list[str]:
    """Sheets in the workbook's order."""
    own = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
    return ["xl/" + own[e.get(f"{{{_REL}}}id")].removeprefix("/xl/") for e in sheets]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.width, self.names = path, len(schema), schema.names

    def partitions(self) -> Sequence[Sheet]:
        with _open(self.path) as z:
            return [Sheet(k, m) for k, m in enumerate(_members(z))]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as z:
            rows = _rows(z, partition.member)
            next(rows, None)  # the header
            cells = self.width - 2
            kinds = [pa.int32(), pa.int64(), *[pa.string()] * cells]
            n = 0
            for some in _some(rows, 10_000, FRAGMENT_CHARS):
                shown = [(partition.number, n + k, *(r + [None] * (cells - len(r)))[:cells]) for k, r in enumerate(some)]
                n += len(some)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*shown, strict=True), kinds, strict=True)], names=self.names)


class Workbook(DataSource):
    """sheet, row and the cells of all sheets as text, named by the first sheet's header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as z:
            header = next(_rows(z, _members(z)[0]), [])
        out = T.StructType().add("_sheet", T.IntegerType()).add("_row", T.LongType())
        for k, c in enumerate(header):
            out = out.add(c or letters(k), T.StringType())
        return out

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], schema)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").load(path)
