"""Search results as Python data sources: queries against a fixed table or a folder of stored results, by exact text.

`spark.dataSource.register(FixtureSearch)`, then
`spark.read.format("fixture_search").option("results", json).option("limit", 5).load()`,
with `results` a JSON object of query to a list of {title, url, snippet}. A live
connector has the same schema; none is built in.

`published(results, folder)` stores results of any number of queries, and
`spark.read.format("stored_search").option("path", folder).load()` reads them. The
queries of a filter (`query = ..`, `query in (..)`) are pushed down: only the files
of their buckets are planned and opened, and of these only their rows leave the
reader. Pushdown into Python sources is a setting of the session: `pushing(spark)`.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MOST_RESULTS = 20
#: Folders that stored results lie in, by their query's hash.
BUCKETS = 64


class FixtureSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixture_search"

    def schema(self) -> str:
        return "query string, rank int, title string, url string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.results = json.loads(options.get("results", "{}"))
        self.limit = min(MOST_RESULTS, int(options.get("limit", MOST_RESULTS)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.results]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rank, r in enumerate(self.results[partition.value][: self.limit], 1):
            yield partition.value, rank, r.get("title"), r.get("url"), r.get("snippet")


def published(results: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Stores results (query, rank, title, url, snippet) as JSON lines, the first MOST_RESULTS ranks of each query; null queries have none."""
    rows = results.where(F.col("query").isNotNull() & F.col("rank").between(1, MOST_RESULTS))
    bucketed = rows.select("query", F.col("rank").cast("int").alias("rank"), "title", "url", "snippet", F.pmod(F.crc32(F.col("query").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))
    bucketed.repartition("bucket").sortWithinPartitions("bucket", "query", "rank").write.partitionBy("bucket").option("maxRecordsPerFile", 1_000_000).json(f"{folder.rstrip('/')}/of={buckets}")


def pushing(spark: SparkSession) -> None:
    """Lets filters reach Python data sources, and registers these."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FixtureSearch, StoredSearch):
        spark.dataSource.register(source)


class StoredSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_search"

    def schema(self) -> str:
        return "query string, rank int, title string, url string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return StoredReader(self.options["path"], int(self.options.get("limit", MOST_RESULTS)))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    return fs.FileSystem.from_uri(path)


class StoredReader(DataSourceReader):
    """queries: those asked for, null for all. A partition is a file."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit, self.queries = path, min(MOST_RESULTS, limit), None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("query",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = asked if self.queries is None else self.queries & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        layouts = [x for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("of=")]
        files = []
        for layout in layouts:
            buckets = int(layout.base_name[3:])
            wanted = range(buckets) if self.queries is None else sorted({zlib.crc32(q.encode()) % buckets for q in self.queries})
            for bucket in wanted:
                found = system.get_file_info(fs.FileSelector(f"{layout.path}/bucket={bucket}", allow_not_found=True))
                files += [x.path for x in found if x.base_name.endswith(".json")]
        return [InputPartition(f) for f in sorted(files)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:  # Spark wants a partition even of nothing
            return
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.value) as stream:
            for line in _lines(stream):
                r = json.loads(line)
                if r["rank"] <= self.limit and (self.queries is None or r["query"] in self.queries):
                    yield r["query"], r["rank"], r.get("title"), r.get("url"), r.get("snippet")


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest
