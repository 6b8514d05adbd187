"""A paged search feed as a Python data source: one partition a query, pages fetched in order by an injected client.

    spark.dataSource.register(SearchFeed)
    spark.read.format("search_feed").option("client", "package.module:function").option("queries", json).load()

The client takes (query, page) and returns (status, body): 200 with {"data": [...]}, 429, or another status. Further options:
`pages` (most pages a query), `known` (ids as JSON) or `known_path` (a Parquet table of ids, see stored_ids), and `quota_path`, a
folder that driver and executors share: a query that meets the quota leaves a file there, and every query looks for one ahead of
each page. fetched() puts these together for a refresh.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas, storage
from ..functions.extract import is_cs_title
from ..operators import ingest

# Which queries each source runs is the caller's; how they are asked isn't.
FACADES = {"indeed": ("FULLTIME", "INTERN"), "glassdoor": ("FULLTIME", "INTERN"), "handshake": ("FULLTIME", "INTERN")}
PAGE_ROWS = 10
# End of fixed values.


def pages(client: Callable[[str, int], tuple[int, dict]], query: str, known, most: int, wait: Callable[[float], None] = lambda s: None, stopped: Callable[[], bool] = lambda: False):
    """(postings, quota exceeded). A rate-limited page is lost and the next one tried; a page with a known id is the last; none is
    asked for once `stopped`. `known` is a set, or anything else with its intersection()."""
    found: list[dict] = []
    for page in range(1, most + 1):
        if stopped():
            break
        status, body = client(query, page)
        if status == 429:
            if "quota" in str(body.get("message", "")).lower():
                return found, True
            wait(15)
            continue
        rows = body.get("data") or [] if status == 200 else []
        if not rows:
            break
        old = known.intersection([r.get("job_id") for r in rows])
        found += [r for r in rows if r.get("job_id") not in old]
        if old:
            break
    return found, False


class StoredIds:
    """A table of ids of which each question reads the row groups that may hold its ids."""

    def __init__(self, path: str) -> None:
        self.rows = ds.dataset(path if "://" in path else f"file://{path}", format="parquet", exclude_invalid_files=True)

    def intersection(self, ids: list[str | None]) -> set[str]:
        asked = [i for i in ids if i is not None]
        return set(self.rows.to_table(["id"], filter=pc.field("id").isin(asked)).column(0).to_pylist()) if asked else set()


def stored_ids(known: DataFrame, id_col: str = "source_job_id") -> str:
    """Writes the ids in order, so that statistics tell where one lies, and returns the folder."""
    path = storage.new_path(known.sparkSession, "known")
    known.select(F.col(id_col).cast("string").alias("id")).where("id IS NOT NULL").repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return path


class Quota:
    """Whether any query of a run has met the quota: a file in a shared folder. Each leaves its own, so none waits for another."""

    def __init__(self, path: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def met(self) -> bool:
        return bool(self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True)))

    def note(self) -> None:
        self.files.create_dir(self.path, recursive=True)
        self.files.open_output_stream(f"{self.path}/{uuid.uuid4().hex}").close()


class _Query(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.client, self.queries = options["client"], json.loads(options["queries"])
        self.known, self.most = json.loads(options.get("known", "[]")), int(options.get("pages", "5"))
        self.known_path, self.quota_path = options.get("known_path"), options.get("quota_path")

    def partitions(self):
        return [_Query(q) for q in self.queries]

    def read(self, partition):
        module, name = self.client.split(":")
        client = getattr(importlib.import_module(module), name)
        known = StoredIds(self.known_path) if self.known_path else set(self.known)
        quota = Quota(self.quota_path) if self.quota_path else None
        names = [c.split(" ", 1)[0] for c in schemas.RAW.split(", ")]
        rows, exceeded = pages(client, partition.value, known, self.most, stopped=quota.met if quota else lambda: False)
        if exceeded and quota:
            quota.note()
        for row in rows:
            yield tuple(row.get(n) for n in names)


class SearchFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_feed"

    def schema(self) -> str:
        return schemas.RAW

    def reader(self, schema):
        return _Reader(self.options)


def wanted(raw: DataFrame) -> DataFrame:
    """Postings with a fitting title and a link."""
    return raw.where(is_cs_title(F.col("job_title")) & (F.coalesce("job_apply_link", F.lit("")) != ""))


def fetched(spark: SparkSession, client: str, queries: list[str], source: str, most: int = 5) -> Callable[[DataFrame], tuple[DataFrame, bool]]:
    """A source of a refresh: takes the stored ids, gives staged postings and whether the quota was met.

    The pages are asked for once and written; the quota is looked up after that. A query that runs again because its executor was
    lost stops if the quota was met meanwhile: what it had is left to the next run, which finds it not stored.
    """

    def fetch(known: DataFrame) -> tuple[DataFrame, bool]:
        spark.dataSource.register(SearchFeed)
        quota = storage.new_path(spark, "quota")
        options = {"client": client, "queries": json.dumps(queries), "pages": str(most), "known_path": stored_ids(known), "quota_path": quota}
        rows = storage.written(spark.read.format("search_feed").options(**options).load(), "pages")
        return ingest.staged(wanted(rows), source), Quota(quota).met()

    return fetch


def catalogue(searches: dict[str, list[tuple[str, str]]], boards: dict[str, list[str]]) -> list[tuple[str, str, dict]]:
    """(name, kind, arguments) of every source to run: searches by facade, then boards by kind."""
    out = [(f"{facade}: {query}", facade, {"query": query, "location": place, "employment_types": ",".join(FACADES[facade])}) for facade, some in searches.items() for query, place in some]
    return out + [(f"{kind}: {board}", kind, {"board": board}) for kind, some in boards.items() for board in some]
