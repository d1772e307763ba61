"""Walks over links, breadth first: a frontier, and a written table of what was visited.

Every round joins the frontier with the links, keeps each address once, takes away what a round
before has visited, and writes what is left as a round of its own: `round=k` below the walk's folder.
The walk ends on an empty frontier, after `most` rounds, or when the budget of pages is used.
Rounds are read back from storage, so a lost executor costs one round's work at most, and a walk that was
broken off goes on from its last whole round.

With items, a page that brings no key that is new does not lead on (pages of the first round do).
A key is new on the least address of the first round that shows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import places

_VISITED = "url string, page_no int"


def _rounds(folder: str, name: str) -> list[int]:
    """The rounds of a table that were written whole."""
    fs, root = places.filesystem(f"{folder}/{name}")
    found = fs.get_file_info(places.pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(int(f.path.rsplit("round=", 1)[1].split("/")[0]) for f in found if f.path.endswith("/_SUCCESS"))


def _read(spark: SparkSession, folder: str, name: str, rounds: Sequence[int], schema: str = "url string") -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/{name}/round={k}" for k in rounds])


def _unvisited(candidates: DataFrame, visited: DataFrame, on: str = "url") -> DataFrame:
    """Candidates that are in no table before; those are met by a semi-join first, which sends them nowhere while the candidates are few."""
    known = visited.select(on).join(candidates.select(on), on, "left_semi").distinct()
    return candidates.join(known, on, "left_anti")


def walk(links: DataFrame, start: DataFrame, most: int | None = None, budget: int | None = None, items: DataFrame | None = None, keys: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """url, page_no of every page reached; start and links hold `url`, links also `next_url`, items `url` and the keys.

    most: rounds at most, the starting pages being the first; budget: pages at most, of the round that would
    go beyond it those with the least addresses.  folder: where rounds are written; an earlier walk's folder resumes it.
    Null addresses are no links; repeated starts and links count once.
    """
    spark = links.sparkSession
    folder = folder or places.shared_folder(spark, "walk")
    # every round asks the links again, so what they were made of is worked out once
    worked = places.shared_folder(spark, "links")
    links.where("next_url IS NOT NULL").select("url", "next_url").write.parquet(worked)
    links = spark.read.schema("url string, next_url string").parquet(worked)
    k, more, left = max(_rounds(folder, "visited"), default=0), True, budget
    if k and left is not None:
        left -= _read(spark, folder, "visited", range(1, k + 1)).count()
    if k and items is not None and k not in _rounds(folder, "leading"):
        _new_keys(items, keys, folder, k)
    while more and (most is None or k < most) and (left is None or left > 0):
        if k == 0:
            fresh = start.where("url IS NOT NULL").select("url").distinct()
        else:
            # pages of the first round lead on in any case
            frontier = _read(spark, folder, "visited" if items is None or k == 1 else "leading", [k])
            found = links.join(frontier, "url").select(F.col("next_url").alias("url")).distinct()
            fresh = _unvisited(found, _read(spark, folder, "visited", range(1, k + 1)))
        k += 1
        if left is not None:
            fresh = fresh.orderBy("url").limit(left)
        fresh.select("url", F.lit(k).alias("page_no")).write.mode("overwrite").parquet(f"{folder}/visited/round={k}")
        n = _read(spark, folder, "visited", [k]).count()
        left, more = None if left is None else left - n, n > 0
        if items is not None and more:
            _new_keys(items, keys, folder, k)
    if k == 0:
        return spark.createDataFrame([], _VISITED)
    return _read(spark, folder, "visited", range(1, k + 1), _VISITED)


def _new_keys(items: DataFrame, keys: Sequence[str], folder: str, k: int) -> None:
    """Write the keys first seen in round k, and which of its pages lead on."""
    spark = items.sparkSession
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")
    shown = items.join(_read(spark, folder, "visited", [k]), "url", "left_semi").groupBy(key).agg(F.min("url").alias("url"))
    if k > 1:
        shown = _unvisited(shown, _read(spark, folder, "keys", range(1, k), "key string, url string"), "key")
    shown.select("key", "url").write.mode("overwrite").parquet(f"{folder}/keys/round={k}")
    _read(spark, folder, "keys", [k]).distinct().write.mode("overwrite").parquet(f"{folder}/leading/round={k}")


def reached(pages: DataFrame, links: DataFrame, start: DataFrame, **limits) -> DataFrame:
    """The stored pages that a walk reaches, with page_no."""
    return pages.join(walk(links, start, **limits), "url")
