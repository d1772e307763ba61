"""Data sources of stored files: logs by byte ranges, batch and stream, and sitemaps parsed as they are read.

`log_lines` reads the lines of a file or of all files below a folder: file, offset (the byte a line
starts at) and line.  A batch is cut into ranges of bytes, and a line belongs to the range it starts in,
so a large file is read by many tasks.  With `last`, only the bytes of the last lines are read at all.
A stream's offset is the number of whole bytes of each file: lines come once, a line that is still being
written waits for its end, and a query that goes on from its checkpoint goes on at the byte it had reached.
A file that was cut short is read again from its start; one that is gone is forgotten.

`sitemap_files` reads stored sitemaps, packed or not, entry by entry: file, kind, pos, loc, lastmod.
A broken document gives the entries before its fault.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import places

#: Bytes of a task's range, and of one read; tasks from which on ranges grow with what is read, up to RANGE.
RANGE, BLOCK, TASKS = 64 << 20, 4 << 20, 200


@dataclass
class Range(InputPartition):
    """Bytes of one file; `aligned` where a line is known to start at the first of them."""

    file: str
    start: int
    end: int
    aligned: bool = False


@dataclass
class Files(InputPartition):
    names: list[str] = field(default_factory=list)


# ---- logs ---------------------------------------------------------------------------------


def _lines(path: str, part: Range | None) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range, some blocks at a time; Spark reads no partition where there is none."""
    if part is None or part.start >= part.end:
        return
    fs, _ = places.filesystem(path)
    with fs.open_input_file(part.file) as f:
        at = part.start
        if at and not part.aligned:
            # the byte before tells whether a line starts here
            at -= 1
            f.seek(at)
            n = 1 << 11
            while chunk := f.read(n := min(BLOCK, 2 * n)):
                k = chunk.find(b"\n")
                if k >= 0:
                    at += k + 1
                    break
                at += len(chunk)
        f.seek(at)
        held = b""
        while at < part.end:
            # a small range is no reason to read a whole block; past its end stands only the rest of its last line
            chunk = f.read(min(BLOCK, max(part.end - at - len(held), len(held), 1 << 12)))
            data = held + chunk
            cut = data.rfind(b"\n") + 1 if chunk else len(data)
            if not data:
                return
            whole, held = data[:cut], data[cut:]
            ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
            if not chunk and len(whole) and not whole.endswith(b"\n"):
                ends = np.append(ends, len(whole))  # the last line has no end
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
            n = int(np.searchsorted(starts + at, part.end))
            texts = [whole[s:e].removesuffix(b"\r").decode("utf-8", "replace") for s, e in zip(starts[:n].tolist(), ends[:n].tolist(), strict=True)]
            if texts:
                yield pa.record_batch([pa.array([part.file] * n), pa.array(starts[:n] + at, pa.int64()), pa.array(texts)], names=["file", "offset", "line"])
            at += len(whole)
            if not chunk:
                return


def _width(least: int, total: int) -> int:
    """Bytes of a range: as asked for while there are few, more where they would be more than TASKS, so that tasks do not grow with the files."""
    return max(least, min(RANGE, total // TASKS + 1))


def _ranges(file: str, start: int, end: int, size: int, aligned: bool = False) -> list[Range]:
    cuts = [*range(start, end, size), end]
    return [Range(file, a, b, aligned and a == start) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole_bytes(path: str, file: str, size: int, least: int = 0) -> int:
    """Bytes up to the end of the last whole line, looked for from the end."""
    fs, _ = places.filesystem(path)
    with fs.open_input_file(file) as f:
        end = size
        while end > least:
            start = max(least, end - BLOCK)
            f.seek(start)
            k = f.read(end - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            end = start
    return least


def _tail(path: str, files: list[tuple[str, int]], last: int) -> list[Range]:
    """Ranges that hold just the last lines, found from the end of the last file backwards."""
    fs, _ = places.filesystem(path)
    out: list[Range] = []
    for file, size in reversed(files):
        if last <= 0:
            break
        with fs.open_input_file(file) as f:
            end, found, start = size, 0, 0
            while end > 0 and found <= last:
                block = max(0, end - BLOCK)
                f.seek(block)
                data = np.frombuffer(f.read(end - block), np.uint8)
                ends = np.flatnonzero(data == 10)
                # an end of line closes the file's last line, it begins none
                ends = ends[ends + block < size - 1]
                if found + len(ends) >= last:
                    start, found = block + int(ends[len(ends) - (last - found)]) + 1, last
                    break
                found, end = found + len(ends), block
            else:
                start, found = 0, found + (size > 0)
        out.append(Range(file, start, size, True))
        last -= found
    return out[::-1]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))
        self.last = int(options["last"]) if "last" in options else None

    def partitions(self) -> Sequence[Range]:
        files = places.files_under(self.path)
        if self.last is not None:
            return _tail(self.path, files, self.last)
        width = _width(self.size, sum(size for _, size in files))
        return [r for file, size in files for r in _ranges(file, 0, size, width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)


class LogStream(DataSourceStreamReader):
    """Offsets map files to whole bytes."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))
        self.known: dict[str, tuple[int, int]] = {}  # size at the last look, whole bytes then

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = {}
        for file, size in places.files_under(self.path):
            before, whole = self.known.get(file, (0, 0))
            if size != before:
                whole = _whole_bytes(self.path, file, size, whole if size > before else 0)
            now[file] = (size, whole)
        self.known = now
        return {file: whole for file, (_, whole) in now.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        new = [(file, at if (at := start.get(file, 0)) <= to else 0, to) for file, to in sorted(end.items())]
        width = _width(self.size, sum(to - at for _, at, to in new))
        return [r for file, at, to in new for r in _ranges(file, at, to, width, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)


class LogLines(DataSource):
    """Options: path; bytes of a task's range; last, of a batch: how many lines from the end."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:  # noqa: N802
        return LogStream(self.options)


def log_lines(spark: SparkSession, path: str, last: int | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(LogLines)
    return spark.read.format("log_lines").options(**options, **({} if last is None else {"last": str(last)})).load(path)


def log_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").options(**options).load(path)


def events_of(lines: DataFrame, schema: str, kinds: Sequence[str] = (), kind: str = "t") -> DataFrame:
    """file, offset and the columns of lines that are JSON objects; of the kinds asked for, if any.  Broken lines are left out."""
    parsed = lines.select("file", "offset", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e IS NOT NULL").select("file", "offset", "e.*")
    rows = parsed.where(F.col(kind).isNotNull())
    return rows.where(F.col(kind).isin(*kinds)) if kinds else rows


# ---- sitemaps -----------------------------------------------------------------------------


def _entries(path: str, file: str) -> Iterator[tuple]:
    fs, _ = places.filesystem(path)
    with fs.open_input_file(file) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        pos, kind, above = 0, None, []
        try:
            for event, e in ElementTree.iterparse(gzip.open(raw) if packed else raw, events=("start", "end")):
                name = e.tag.rsplit("}", 1)[-1]
                if event == "start":
                    kind = kind or name
                    above.append(e)
                    continue
                above.pop()
                if name in ("url", "sitemap") and len(above) == 1:
                    own = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in e}
                    if own.get("loc"):
                        yield file, kind, pos, own["loc"], own.get("lastmod")
                    pos += 1
                    above[-1].remove(e)
        except (ElementTree.ParseError, OSError, EOFError):
            return


class SitemapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))

    def partitions(self) -> Sequence[Files]:
        out, held = [Files()], 0
        for name, size in places.files_under(self.path):
            if held and held + size > self.size:
                out.append(Files())
                held = 0
            out[-1].names.append(name)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            yield from _entries(self.path, name)


class SitemapFiles(DataSource):
    """Options: path; bytes of files that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "sitemap_files"

    def schema(self) -> str:
        return "file string, kind string, pos int, loc string, lastmod string"

    def reader(self, schema) -> SitemapReader:
        return SitemapReader(self.options)


def sitemap_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SitemapFiles)
    return spark.read.format("sitemap_files").options(**options).load(path)


def store_files(df: DataFrame, folder: str) -> int:
    """A file per row of (name, content binary), each written by its task; returns their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = places.filesystem(folder)
        fs.create_dir(root, recursive=True)
        n = 0
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(content or b"")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return df.select("name", "content").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
