"""The dataset as stored tables: a base in buckets of the id, and the rows that runs have touched since.

Base and touched rows are bucketed and sorted by id alike, one file a bucket, so reading the dataset
as it is now (touched rows before those of the base) and folding a run into it are joins in which only the run is
shuffled.  A run that saw part of the site writes the touched rows anew and leaves the base alone; when
these come to more than `SHARE` of the base, both are written as a new base.  A run that saw all of it
says something of each of its recipe's rows, and writes a new base at once.

A version is a small file that names its tables and is put in place whole, after them; what is not named by
the newest version counts for nothing, so a run that broke off changes nothing, and old versions can be
read until they are dropped.  One writer at a time.

Buckets should be no fewer than the session's shuffle partitions: with fewer, Spark would rather deal both sides anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import places
from . import changes

SHARE = 0.1
_ROW = f"{changes._DATASET}, action string, version int"


class DatasetStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 200):
        """buckets holds for a new store; one that is there keeps its own."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.root = places.filesystem(self.folder)
        self._own = f"weftwork_{hashlib.md5(self.folder.encode(), usedforsecurity=False).hexdigest()[:12]}"
        self.buckets = self._version()["buckets"] if self.versions() else buckets

    # ---- versions

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(places.pafs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def _version(self, number: int | None = None) -> dict:
        number = self.versions()[-1] if number is None else number
        with self.fs.open_input_stream(f"{self.root}/versions/{number}.json") as f:
            return json.loads(f.read())

    def _publish(self, number: int, **tables) -> None:
        self.fs.create_dir(f"{self.root}/versions", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/versions/_{number}") as f:
            f.write(json.dumps({"buckets": self.buckets, **tables}).encode())
        self.fs.move(f"{self.root}/versions/_{number}", f"{self.root}/versions/{number}.json")

    def drop_before(self, number: int) -> None:
        """Forget versions below a number, and the tables that no other names."""
        kept = [v for v in self.versions() if v >= number]
        named = {t for v in kept for t in (self._version(v)["base"], self._version(v)["touched"])}
        for v in self.versions():
            if v < number:
                gone = self._version(v)
                self.fs.delete_file(f"{self.root}/versions/{v}.json")
                for t in {gone["base"], gone["touched"]} - named - {None}:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._known(t)}")
                    if self.fs.get_file_info(f"{self.root}/{t}").type != places.pafs.FileType.NotFound:
                        self.fs.delete_dir(f"{self.root}/{t}")

    # ---- tables

    def _known(self, name: str) -> str:
        return f"{self._own}_{name.replace('-', '_')}"

    def _table(self, name: str) -> DataFrame:
        """A stored table with its buckets, which the catalogue of this session is told of once."""
        known = self._known(name)
        if not self.spark.catalog.tableExists(known):
            columns = self.spark.createDataFrame([], _ROW).schema.toDDL()
            self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(known)

    def _write(self, rows: DataFrame, name: str) -> None:
        """rows in buckets; dealt by id first, so that a bucket is one file."""
        known = self._known(name)
        columns = [f.name for f in self.spark.createDataFrame([], _ROW).schema]
        dealt = rows.select(columns).repartition(self.buckets, "id")
        self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        dealt.write.format("parquet").bucketBy(self.buckets, "id").sortBy("id").option("path", f"{self.folder}/{name}").mode("overwrite").saveAsTable(known)
        # the files stay, as the table is an external one; the next reader's will know the new ones
        self.spark.sql(f"DROP TABLE {known}")

    def _rows(self, number: int | None = None) -> DataFrame:
        if not self.versions():
            return self.spark.createDataFrame([], _ROW)
        v = self._version(number)
        base = self._table(v["base"])
        if v["touched"] is None:
            return base
        new = self._table(v["touched"])
        return base.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)

    def rows(self, version: int | None = None) -> DataFrame:
        """The dataset now, or as a version had it."""
        return self._rows(version).drop("action", "version")

    def actions(self, version: int | None = None) -> DataFrame:
        """id, key, action of the rows that a run said something of."""
        number = self.versions()[-1] if version is None else version
        return self._rows(number).where((F.col("version") == number) & F.col("action").isNotNull()).select("id", "key", "action")

    def touched_share(self) -> float:
        v = self._version()
        return v["touched_rows"] / max(1, v["base_rows"])

    # ---- runs

    def folded(self, rows: DataFrame, recipe_id: str, keys: Sequence[str], order: Sequence[str], now: Column, partial: bool = False, history: int = changes.HISTORY) -> DataFrame:
        """What a run makes of the rows it says something of, with `action`."""
        mine = self._rows().drop("action", "version").where(F.col("recipe_id") == recipe_id)
        if partial:
            mine = mine.join(changes.run_ids(rows, recipe_id, keys), "id", "left_semi")
        return changes.fold_own(mine, rows, recipe_id, keys, order, now, partial, history)

    def fold(self, rows: DataFrame, recipe_id: str, keys: Sequence[str], order: Sequence[str], now: Column, partial: bool = False, history: int = changes.HISTORY) -> int:
        """Fold a run in; returns the new version."""
        there = self.versions()
        number = (there[-1] if there else 0) + 1
        out = self.folded(rows, recipe_id, keys, order, now, partial, history).withColumn("version", F.lit(number))
        if not there or not partial:
            rest = self._rows().where(F.col("recipe_id") != recipe_id)
            self._base(out.unionByName(rest), number)
            return number
        v, name = self._version(), f"touched-{number}"
        if v["touched"] is not None:
            before = self._table(v["touched"])
            out = before.join(out.select("id"), "id", "left_anti").unionByName(out)
        self._write(out, name)
        n = self._table(name).count()
        self._publish(number, base=v["base"], touched=name, base_rows=v["base_rows"], touched_rows=n)
        if n > SHARE * v["base_rows"]:
            self.compact()
        return number

    def _base(self, rows: DataFrame, number: int) -> None:
        name = f"base-{number}"
        self._write(rows, name)
        self._publish(number, base=name, touched=None, base_rows=self._table(name).count(), touched_rows=0)

    def compact(self) -> None:
        """The newest version as one base, under the same number: its rows are the same."""
        number = self.versions()[-1]
        if self._version(number)["touched"] is not None:
            self._base(self._rows(), number)
