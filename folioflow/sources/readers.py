"""Readers of landed records: library and collections JSON, Atom feeds, preprint API pages."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)

# Library item types that are read.
ITEM_TYPES = ("conferencePaper", "journalArticle", "preprint")


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """collection_key, collection_name, parent_collection (null at the root) of collections JSON."""
    rows = spark.read.schema("key string, data struct<name:string,parentCollection:string>").option("multiLine", True).json(path)
    return rows.select(F.col("key").alias("collection_key"), F.col("data.name").alias("collection_name"), F.nullif(F.col("data.parentCollection"), F.lit("false")).alias("parent_collection"))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """title, abstract, added_date, collections of library JSON, of the item types above."""
    kind = "data struct<itemType:string,title:string,abstractNote:string,dateAdded:string,collections:array<string>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).where(F.coalesce("data.itemType", F.lit(ITEM_TYPES[0])).isin(*ITEM_TYPES))
    added = F.try_to_timestamp("data.dateAdded", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.select(F.col("data.title").alias("title"), F.col("data.abstractNote").alias("abstract"), added.alias("added_date"), F.coalesce("data.collections", F.array().cast("array<string>")).alias("collections"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, title, abstract, announce_type, authors, url, pdf_url, categories of an Atom feed; a feed that says it is in error is refused.

    Authors are those of the entry, else the names of its dc:creator, which commas
    part. Without a link to a PDF the address of the page is rewritten to one.
    """
    schema = (
        "title string, entry array<struct<id:string,title:string,summary:string,`arxiv:announce_type`:string,author:array<struct<name:string>>,`dc:creator`:string,"
        "link:array<struct<_VALUE:string,_href:string,_rel:string,_title:string,_type:string>>,category:array<struct<_VALUE:string,_term:string>>>>"
    )
    feed = spark.read.format("xml").option("rowTag", "feed").schema(schema).load(path)
    if not feed.where(F.contains(F.coalesce("title", F.lit("")), F.lit("Feed error for query"))).isEmpty():
        raise ValueError("the feed tells of an error in the query")
    rows = feed.select(F.posexplode("entry").alias("ord", "e"))
    none = F.array().cast("array<string>")
    named, creator = F.col("e.author.name"), F.col("e.`dc:creator`")
    authors = F.when(F.size(F.coalesce(named, none)) > 0, named).otherwise(F.filter(F.transform(F.split(F.coalesce(creator, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    links = F.coalesce(F.col("e.link"), F.array().cast("array<struct<_VALUE:string,_href:string,_rel:string,_title:string,_type:string>>"))
    page = F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    pdf = F.get(F.filter(links, lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(0))["_href"]
    return rows.select(
        "ord", F.col("e.id").alias("id"), F.col("e.title").alias("title"), F.col("e.summary").alias("abstract"), F.col("e.`arxiv:announce_type`").alias("announce_type"), authors.alias("authors"), page.alias("url"),
        F.coalesce(pdf, F.replace(page, F.lit("/abs/"), F.lit("/pdf/"))).alias("pdf_url"), F.coalesce(F.col("e.category._term"), none).alias("categories"),
    )


def feed_query(categories: list[str]) -> str:
    """The part of a feed's address that asks for several categories at once."""
    if not categories:
        raise ValueError("a feed needs a category")
    return "+".join(categories)


def in_batches(ids: list[str], size: int = 20) -> list[str]:
    """Ids as lists for a metadata API, of so many each, in order."""
    return [",".join(ids[at : at + size]) for at in range(0, len(ids), size)]


def too_many(error: Exception) -> bool:
    """Whether a server said that it was asked too often (status 429): the only failure the feed's API is asked again after."""
    return getattr(error, "code", getattr(error, "status", None)) == 429


def growing(n: int, step: float = 30.0) -> float:
    """Pauses before another try that grow by `step` seconds each."""
    return step * (n + 1)


def converted(rows: DataFrame, convert: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """What convert() makes of each row: rows it fails for are left out with a warning in the worker's log, as are those it gives None for.

    Rows keep their order within a partition. A source's raw records become
    papers this way where columns alone can't say how.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    made = convert(row)
                except Exception:
                    log.warning("a record was left out: %.200r", row, exc_info=True)
                    continue
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def gathered(names: list[str], readers: dict[str, Callable[[], DataFrame]]) -> list[tuple[str, DataFrame]]:
    """The rows of each named source; a name without a reader is skipped with a warning."""
    out = []
    for name in names:
        if name in readers:
            out.append((name, readers[name]()))
        else:
            log.warning("no reader for the source %s; it is skipped", name)
    return out


def read_preprints(spark: SparkSession, path: str, server: str) -> DataFrame:
    """Records of landed preprint API pages, with their ordinal in the page."""
    kind = "collection array<struct<doi:string,title:string,authors:string,abstract:string,date:string,category:string,version:string>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("collection").alias("item_id", "c"))
    named = ["doi", "title", "authors", "abstract", F.col("c.date").alias("item_date"), "category", F.col("c.version").alias("item_version")]
    return rows.select(F.col("item_id").cast("long"), F.lit(server).alias("server"), *[F.col(f"c.{n}") if isinstance(n, str) else n for n in named])


def retried(call: Callable[[], object], tries: int = 10, pause: Callable[[int], float] = lambda n: 10.0, may_retry: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after a pause while it fails in a way that may be retried."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n + 1 == tries or not may_retry(e):
                raise
            sleep(pause(n))
    raise ValueError("no tries")


class PreprintSource(DataSource):
    """`spark.read.format("preprints")`: live pages of a preprint API, one partition a page address.

    Options: pages (addresses, by white space), server. The reader retries a page
    itself, as a task's retry would ask for everything again.
    """

    @classmethod
    def name(cls) -> str:
        return "preprints"

    def schema(self) -> str:
        return "server string, doi string, title string, authors string, abstract string, item_date string, category string, item_version string"

    def reader(self, schema: object) -> DataSourceReader:
        return _PreprintReader(self.options)


class _PreprintReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.server = options.get("pages", "").split(), options.get("server", "")
        if not self.pages:
            raise ValueError("the option pages is needed")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def load() -> dict:
            with urllib.request.urlopen(partition.value, timeout=60) as page:
                return json.load(page)

        for r in retried(load).get("collection", []):
            yield (self.server, *[r.get(k) for k in ("doi", "title", "authors", "abstract", "date", "category", "version")])


class LibrarySource(DataSource):
    """`spark.read.format("library")`: a reader's live library or its collections, one partition a page.

    Options: url (of the list), key (sent as a bearer token), page (rows of a
    page), total (how many rows there are; asked of the server where it is not
    given, which tells it in the header Total-Results). Each row is the JSON of an
    item; read_library() and read_collections() say what is in it.
    """

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema: object) -> DataSourceReader:
        return _LibraryReader(self.options)


class _LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key, self.page, self.total = options.get("url", ""), options.get("key"), int(options.get("page", 100)), options.get("total")
        if not self.url:
            raise ValueError("the option url is needed")

    def _open(self, start: int, limit: int):
        joint = "&" if "?" in self.url else "?"
        asked = urllib.request.Request(f"{self.url}{joint}start={start}&limit={limit}&format=json", headers={"Authorization": f"Bearer {self.key}"} if self.key else {})
        return urllib.request.urlopen(asked, timeout=60)

    def partitions(self) -> list[InputPartition]:
        total = self.total
        if total is None:
            with retried(lambda: self._open(0, 1)) as answer:
                total = answer.headers.get("Total-Results", 0)
        return [InputPartition(at) for at in range(0, int(total), self.page)] or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def load() -> list:
            with self._open(partition.value, self.page) as answer:
                return json.load(answer)

        for item in retried(load):
            yield (json.dumps(item),)


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str) -> Callable:
    """Make a reader known by a name."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SOURCES[name] = f
        return f

    return keep


def source(name: str) -> Callable[..., DataFrame]:
    if name not in _SOURCES:
        raise ValueError(f"source {name} not found; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


register_source("feed")(read_feed)
register_source("preprints")(read_preprints)
