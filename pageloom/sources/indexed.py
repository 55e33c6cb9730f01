"""Indexed page snapshots: pages sorted by host and URL, read by URL or host without touching others.

``write_snapshot`` packs the markup of pages into files of a bounded size, each page one range, and
notes ``key, file, offset, length`` and what is known of the page besides in index files. A page's
key is its host and its URL, so pages of a host lie together, and the manifest, which holds the
first and last key of every index file, tells which of them a URL or a host can be in.

``pageloom_snapshot`` is a data source over such a folder. Filters on ``url`` and ``host`` (equality
and IN) reach it: it plans only the index files that can hold them, a task reads only the
index rows that do, and of the data files only those rows' ranges. Filters Spark keeps are
applied again, so they only ever save reading.

``IndexedSnapshot`` gives pages of URLs or hosts that are a table themselves, of any size, by a join
with the index. ``crawl_site`` takes one in place of a page table: it then reads the seeds'
pages alone for depth 0, else the pages of the hosts the crawls stay on.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition

from pageloom.functions import urls
from pageloom.sources.packed import INDEX, PackedWriter, TaskFiles, Written, newest, opened

# The source travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READER, WRITER = "pageloom_snapshot", "pageloom_snapshot_writer"
FILE_BYTES = 256 << 20
MORE = [pa.field("page_id", pa.int64()), pa.field("status", pa.int32()), pa.field("timed_out", pa.bool_())]
PAGE_INDEX = pa.schema([*[f.with_name("key") if f.name == "crawl_id" else f for f in INDEX], *MORE])
PAGES_DDL = "page_id bigint, url string, html string, status int, timed_out boolean, host string"
INDEX_DDL = "key string, part int, nr int, file string, offset bigint, length bigint, page_id bigint, status int, timed_out boolean"
URL = re.compile(urls.URL_PATTERN)
BEFORE_URL = "".join(map(chr, range(33)))
ROWS_AT_ONCE = 64  # pages sent back together
MARK = "\n"  # between host and URL: sorts before all that a host may hold


def key_of(host: str | None, url: str | None) -> str | None:
    return None if url is None else f"{host or ''}{MARK}{url}"


class SnapshotWriter(PackedWriter):
    """Writes rows ``key, html, page_id, status, timed_out`` that are sorted by key, a range each."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = TaskFiles(self.folder, self.run, TaskContext.get().partitionId(), self.file_bytes, 0, PAGE_INDEX, ".html")
        for batch in iterator:
            more = zip(*(batch.column(n).to_pylist() for n in ("page_id", "status", "timed_out")))
            for key, html, own in zip(batch.column("key").to_pylist(), batch.column("html"), more):
                files.end_range()
                if html.is_valid:
                    files.add(key, html.as_py().encode("utf-8", "surrogatepass"), own)
                else:  # a page without markup
                    files.note(key, None, -1, 0, own)
        return files.close()


class SnapshotSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITER

    def schema(self) -> str:
        return "key string, html string, page_id bigint, status int, timed_out boolean"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SnapshotWriter(self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)), 0)


@dataclass
class IndexFile(InputPartition):
    """An index file and the keys that are wanted of it: exact ones, beginnings, or all (None)."""

    name: str
    keys: list[str] | None = None
    starts: list[str] | None = None


class SnapshotReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.urls: set[str] | None = None
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("url",), ("host",)):
                wanted = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                if f.attribute == ("url",):
                    self.urls = wanted if self.urls is None else self.urls & wanted
                else:
                    self.hosts = wanted if self.hosts is None else self.hosts & wanted
            yield f  # Spark applies every filter once more

    def partitions(self) -> list[IndexFile]:
        """Index files that can hold wanted keys, by the spans in the manifest."""
        _, runs = newest(*opened(self.folder))
        keys, starts = None, None
        if self.urls is not None:
            keys = sorted(key_of(netloc(u), u) for u in self.urls)
        elif self.hosts is not None:
            starts = sorted(f"{h}{MARK}" for h in self.hosts)
        planned = []
        for run in runs:
            for name, (first, last) in zip(run["indexes"], run["spans"]):
                if keys is not None:
                    own = [k for k in keys if last is not None and (first or "") <= k <= last]
                    if own:
                        planned.append(IndexFile(name, keys=own))
                elif starts is not None:
                    own = [s for s in starts if last is not None and s <= last and (first or "") < s + "\U0010ffff"]
                    if own:
                        planned.append(IndexFile(name, starts=own))
                else:
                    planned.append(IndexFile(name))
        return planned or [IndexFile("", keys=[])]

    def read(self, partition: IndexFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.folder)
        file = pq.ParquetFile(f"{root}/{partition.name}", filesystem=store)
        for rows in file.iter_batches(batch_size=8192):
            if partition.keys is not None:
                rows = rows.filter(pc.is_in(rows.column("key"), pa.array(partition.keys)))
            elif partition.starts is not None:
                host = pc.list_element(pc.split_pattern(rows.column("key"), MARK, max_splits=1), 0)
                rows = rows.filter(pc.is_in(pc.binary_join_element_wise(host, "", MARK), pa.array(partition.starts)))
            yield from fetched(store, root, rows)


def netloc(url: str) -> str:
    """Host of a URL as the column function ``urls.netloc`` has it."""
    tidy = url.lstrip(BEFORE_URL).translate({9: None, 10: None, 13: None})
    return URL.match(tidy)[2] or ""


def fetched(store: fs.FileSystem, root: str, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pages of index rows; only their ranges are read."""
    name, file = None, None
    for at in range(0, rows.num_rows, ROWS_AT_ONCE):
        part = rows.slice(at, ROWS_AT_ONCE)
        html = []
        for own, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if offset < 0:
                html.append(None)
                continue
            if own != name:
                name, file = own, store.open_input_file(f"{root}/{own}")
            html.append(file.read_at(length, offset).decode("utf-8", "replace"))
        keys = [k.split(MARK, 1) if k is not None else (None, None) for k in part.column("key").to_pylist()]
        columns = [
            part.column("page_id"), pa.array([u for _, u in keys], pa.string()), pa.array(html, pa.string()),
            part.column("status"), part.column("timed_out"), pa.array([h for h, _ in keys], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "html", "status", "timed_out", "host"])


class SnapshotSource(DataSource):
    """``spark.read.format("pageloom_snapshot").load(folder)``: ``page_id, url, html, status, timed_out, host``."""

    @classmethod
    def name(cls) -> str:
        return READER

    def schema(self) -> str:
        return PAGES_DDL

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"])


def write_snapshot(pages: DataFrame, folder: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (``url, html`` and, where present, ``page_id, status, timed_out``) as an indexed snapshot.

    Pages are range-partitioned by host and URL; copies of a URL each keep their row.
    """
    pages.sparkSession.dataSource.register(SnapshotSink)

    def own(name: str, kind: str):
        return (F.col(name) if name in pages.columns else F.lit(None)).cast(kind).alias(name)

    key = F.when(F.col("url").isNotNull(), F.concat(F.coalesce(urls.netloc(F.col("url")), F.lit("")), F.lit(MARK), "url"))
    rows = pages.select(key.alias("key"), "html", own("page_id", "bigint"), own("status", "int"), own("timed_out", "boolean"))
    ordered = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.write.format(WRITER).mode(mode).option("path", folder).option("file_bytes", str(file_bytes)).save()


class IndexedSnapshot:
    """A snapshot that ``write_snapshot`` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.sparkSession, self.folder = spark, folder.rstrip("/")
        number, self.runs = newest(*opened(self.folder))
        if not number:
            raise FileNotFoundError(f"{folder} holds no snapshot")
        spark.dataSource.register(SnapshotSource)

    @property
    def bytes(self) -> int:
        """Size of all markup."""
        return sum(run["bytes"] for run in self.runs)

    @property
    def fingerprint(self) -> str:
        """What a journal knows it by: the files of its newest manifest."""
        return json.dumps([[run["run"], run["bytes"]] for run in self.runs])

    def all(self) -> DataFrame:
        """Every page. Filters on ``url`` and ``host`` are pushed into the source, which Spark does where
        ``spark.sql.python.filterPushdown.enabled`` is set, as it is here."""
        self.sparkSession.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        return self.sparkSession.read.format(READER).load(self.folder)

    def index(self) -> DataFrame:
        """``host, url`` and the place of every page's markup."""
        paths = [f"{self.folder}/{name}" for run in self.runs for name in run["indexes"]]
        if not paths:
            return self.sparkSession.createDataFrame([], f"host string, url string, {INDEX_DDL}")
        rows = self.sparkSession.read.schema(INDEX_DDL).parquet(*paths)
        return rows.select(F.substring_index("key", MARK, 1).alias("host"), F.expr("substring(key, instr(key, '\\n') + 1)").alias("url"), "*")

    def of_urls(self, wanted: DataFrame) -> DataFrame:
        """Pages whose ``url`` is in ``wanted``; the index meets it by key, and only their ranges are read."""
        key = F.concat(F.coalesce(urls.netloc(F.col("url")), F.lit("")), F.lit(MARK), "url")
        return self._of(self.index().join(wanted.select(key.alias("key")).distinct(), "key", "left_semi"))

    def of_hosts(self, wanted: DataFrame) -> DataFrame:
        """Pages whose host is in ``wanted(host)``."""
        return self._of(self.index().join(wanted.select("host").distinct(), "host", "left_semi"))

    def _of(self, rows: DataFrame) -> DataFrame:
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = opened(folder)
            for batch in batches:
                yield from fetched(store, root, batch)

        return rows.select("key", "file", "offset", "length", "page_id", "status", "timed_out").mapInArrow(run, PAGES_DDL)
