"""Logs by ranges, tails and streams, and sitemaps, on files written by hand."""

from __future__ import annotations

import gzip
import random
from pathlib import Path

import pytest

from weftwork.sources import formats, places, readers
from weftwork.streaming import ingest


def logs(tmp_path):
    rng = random.Random(6)
    files = {"a.log": "", "b.log": "one\n", "c.log": "\n\n\ntwo\r\nthree", "d/e.log": "".join(f"{'é' * rng.randrange(90)}{k}\n" for k in range(300)), "z.log": "x" * 5000 + "\n" + "last"}
    for n, t in {**files, "_hidden/x": "no\n", ".y": "no\n"}.items():
        Path(tmp_path, n).parent.mkdir(exist_ok=True)
        Path(tmp_path, n).write_bytes(t.encode())
    return files


def plain(files):
    out = []
    for n in sorted(files):
        at = 0
        for line in files[n].encode().split(b"\n"):
            out.append((n, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        if not files[n] or files[n].endswith("\n"):
            out.pop()  # what follows the last end of line is no line
    return out


@pytest.mark.parametrize(("size", "block"), [(7, 5), (64, 16), (1000, 100), (1 << 20, 1 << 20)])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, size, block):
    files = logs(tmp_path)
    monkeypatch.setattr(formats, "BLOCK", block)
    r = formats.LogReader({"path": str(tmp_path), "bytes": str(size)})
    got = [(f.removeprefix(f"{tmp_path}/"), o, t) for p in r.partitions() for b in r.read(p) for f, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == plain(files)


@pytest.mark.parametrize("block", [6, 50, 1 << 20])
def test_tails(tmp_path, monkeypatch, block):
    files = logs(tmp_path)
    monkeypatch.setattr(formats, "BLOCK", block)
    want = plain(files)
    for last in (0, 1, 2, 3, 5, 200, 301, 302, 303, 308, 9999):
        r = formats.LogReader({"path": f"file://{tmp_path}", "last": str(last)})
        got = [t for p in r.partitions() for b in r.read(p) for t in b.column(2).to_pylist()]
        assert got == [t for _, _, t in want[len(want) - min(last, len(want)) :]]


def test_log_source(spark, tmp_path):
    files = logs(tmp_path)
    got = formats.log_lines(spark, str(tmp_path), bytes="500")
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r.file.removeprefix(f"{tmp_path}/"), r.offset, r.line) for r in got.collect()) == sorted(plain(files))
    assert formats.log_lines(spark, f"{tmp_path}/nothing").count() == 0
    assert [r.line for r in formats.log_lines(spark, f"{tmp_path}/c.log", last=2).collect()] == ["two", "three"]


def test_ranges_do_not_grow_with_the_files(tmp_path):
    line = b"x" * 99 + b"\n"
    Path(tmp_path, "a.log").write_bytes(line * 40_000)
    r = formats.LogReader({"path": str(tmp_path), "bytes": "400"})
    parts = r.partitions()
    assert len(parts) <= formats.TASKS + 1
    assert sum(b.num_rows for p in parts[::20] for b in r.read(p)) == sum(-(-p.end // 100) - -(-p.start // 100) for p in parts[::20])
    s = formats.LogStream({"path": str(tmp_path), "bytes": "400"})
    assert len(s.partitions({}, s.latestOffset())) <= formats.TASKS + 1


def test_stream_goes_on_at_its_byte(spark, tmp_path):
    log, out, state = tmp_path / "in/a.log", f"{tmp_path}/out", f"{tmp_path}/state"
    log.parent.mkdir()

    def told():
        s = formats.log_stream(spark, str(tmp_path / "in")).select("line")
        return sorted(r.line for r in ingest.drained(s, out, state).collect())

    log.write_text("a\nb\nunfin")
    assert told() == ["a", "b"]
    assert told() == ["a", "b"]
    with log.open("a") as f:
        f.write("ished\nc\n")
    Path(tmp_path, "in/b.log").write_text("other\n")
    assert told() == ["a", "b", "c", "other", "unfinished"]
    log.write_text("new\n")  # cut short: a new log under the old name
    Path(tmp_path, "in/b.log").unlink()
    assert told() == ["a", "b", "c", "new", "other", "unfinished"]


def test_stream_offsets(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "BLOCK", 3)
    log = tmp_path / "a.log"
    s = formats.LogStream({"path": str(tmp_path)})
    assert s.latestOffset() == s.initialOffset() == {}
    for text, whole in (("no end yet", 0), ("no end yet\nx", 11), ("no end yet\nxyz\n", 15), ("q\n", 2)):
        log.write_text(text)
        assert s.latestOffset() == {str(log): whole}
    assert s.partitions({str(log): 2}, {str(log): 2}) == [] and s.partitions({str(log): 9}, {str(log): 2})[0].start == 0


def test_sitemap_source(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    body = lambda *locs: f"<urlset {ns}>" + "".join(f"<url><loc> {u} </loc><image><loc>no</loc></image><lastmod>{k}</lastmod></url>" for k, u in enumerate(locs)) + "</urlset>"
    Path(tmp_path, "a.xml").write_text(f"<sitemapindex {ns}><sitemap><loc>https://x/b.xml.gz</loc></sitemap><sitemap><loc>https://x/c.xml</loc></sitemap><sitemap><loc>https://x/a.xml</loc></sitemap></sitemapindex>")
    Path(tmp_path, "b.xml.gz").write_bytes(gzip.compress(body("https://x/1", "https://x/2&amp;q").encode()))
    Path(tmp_path, "c.xml").write_text(body("https://x/3", "https://x/1", "") + "<broken")
    Path(tmp_path, "d.xml").write_text(body("https://x/4").replace("</urlset>", "<url><loc>cut"))
    Path(tmp_path, "e.xml").write_bytes(gzip.compress(body("https://x/5").encode())[:-9])
    Path(tmp_path, "f.xml").write_text("")
    e = formats.sitemap_files(spark, str(tmp_path), bytes="100")
    got = [(r.file.rsplit("/", 1)[1], r.kind, r.pos, r.loc, r.lastmod) for r in e.orderBy("file", "pos").collect()]
    assert got[:3] == [("a.xml", "sitemapindex", k, f"https://x/{n}", None) for k, n in enumerate(["b.xml.gz", "c.xml", "a.xml"])]
    assert [g[3] for g in got[3:]][:5] == ["https://x/1", "https://x/2&q", "https://x/3", "https://x/1", "https://x/4"]
    entries = e.selectExpr("'https://x/' || substring_index(file, '/', -1) base", "kind", "pos", "loc", "lastmod")
    walked = readers.sitemap_walk(entries, spark.createDataFrame([("https://x/a.xml",)], "url string"))
    assert sorted((r.loc, r.lastmod) for r in walked.collect()) == [("https://x/1", "0"), ("https://x/2&q", "1"), ("https://x/3", "0")]


def test_stored_files(spark, tmp_path):
    df = spark.createDataFrame([("a", b"x"), ("b", None), ("c", bytes(range(256)))], "name string, content binary").repartition(3)
    assert formats.store_files(df, f"file://{tmp_path}/s") == 3
    assert [(Path(n).name, s) for n, s in places.files_under(f"{tmp_path}/s")] == [("a", 1), ("b", 0), ("c", 256)]
    assert formats.store_files(df.limit(0), f"{tmp_path}/t") == 0
