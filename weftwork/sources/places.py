"""Folders that all machines share, and files in them, wherever they live."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str = "files") -> str:
    """A new place: below the folder all machines share where it is named, of our own where there is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix=f'weftwork-{name}-')}/f"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


def files_under(path: str) -> list[tuple[str, int]]:
    """(URI-free path, bytes) of the file, or of the files below the folder, without hidden ones, by name."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")))
