"""Report store: the documents of many crawls packed into few files, with an index of ranges.

``PackedReports`` is a data source whose writer takes rows ``crawl_id, text`` that are sorted by
crawl and by place in its document. Each task appends them to files of a bounded size and notes
where every crawl's bytes lie: ``crawl_id, part, nr, file, offset, length``, in the order of the
document, at most ``block_bytes`` each. The notes are Parquet files of the task's own; a commit
message carries file names and totals alone, so neither the driver nor a message grows with the
number of crawls.

A task's files become visible when the driver lists them in a manifest, after all tasks have
succeeded: what failed, repeated or stopped tasks wrote is in no manifest. A manifest appears
under a new name by one rename, and readers take the newest. Overwriting and appending both
write one; the files of a run no manifest lists any more are removed.

A crawl is read by range: the index is filtered (Parquet's own statistics skip most of it, as
it is sorted by crawl) and only its bytes are fetched. Null crawls form a document of their
own; null texts are left out.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# The writer travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "pageloom_reports"
FILE_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
INDEX_ROWS = 100_000  # index rows a task holds before it writes them
INDEX = pa.schema(
    [("crawl_id", pa.string()), ("part", pa.int32()), ("nr", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
INDEX_DDL = "crawl_id string, part int, nr int, file string, offset bigint, length bigint"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, in any store that pyarrow can open."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def manifests(store: fs.FileSystem, root: str) -> list[tuple[int, str]]:
    """Number and path of the published manifests, oldest first."""
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    named = [(f.base_name, f.path) for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json")]
    return sorted((int(name[len("manifest-") : -len(".json")]), path) for name, path in named)


def newest(store: fs.FileSystem, root: str) -> tuple[int, list[dict]]:
    """Number of the newest manifest and the runs it lists."""
    known = manifests(store, root)
    if not known:
        return 0, []
    with store.open_input_file(known[-1][1]) as file:
        return known[-1][0], json.loads(file.read())["runs"]


@dataclass
class Written(WriterCommitMessage):
    """What a task has finished."""

    indexes: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    spans: list[list[str | None]] = field(default_factory=list)  # first and last key of each index file
    rows: int = 0
    bytes: int = 0


class TaskFiles:
    """Data and index files of one task attempt."""

    def __init__(self, folder: str, run: str, part: int, file_bytes: int, block_bytes: int, index: pa.Schema = INDEX, ending: str = ".txt"):
        self.schema, self.ending = index, ending
        self.store, root = opened(folder)
        self.root, self.run, self.part = root, run, part
        self.name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        self.file_bytes, self.block_bytes = file_bytes, block_bytes
        self.store.create_dir(f"{root}/{run}", recursive=True)
        self.message = Written()
        self.data, self.size, self.index, self.rows = None, 0, None, []
        self.crawl, self.start, self.nr, self.more = None, None, 0, ()

    def add(self, crawl: str | None, text: bytes, more: tuple = ()) -> None:
        """Append a text; ranges end where the crawl, the block or the file does. ``more`` goes into the
        index's further columns."""
        if self.start is not None and (crawl != self.crawl or self.size - self.start >= self.block_bytes):
            self.end_range()
        if self.data is not None and self.size >= self.file_bytes:
            self.end_file()
        if self.data is None:
            name = f"{self.run}/{self.name}-{len(self.message.files):04d}{self.ending}"
            self.data, self.size = self.store.open_output_stream(f"{self.root}/{name}"), 0
            self.message.files.append(name)
        if self.start is None:
            self.crawl, self.start, self.more = crawl, self.size, more
        self.data.write(text)
        self.size += len(text)
        self.message.bytes += len(text)

    def end_range(self) -> None:
        if self.start is not None:
            self.note(self.crawl, self.message.files[-1], self.start, self.size - self.start, self.more)
            self.start = None

    def note(self, crawl: str | None, file: str | None, offset: int, length: int, more: tuple = ()) -> None:
        """Add an index row."""
        self.rows.append((crawl, self.part, self.nr, file, offset, length, *more))
        self.nr += 1
        if len(self.rows) >= INDEX_ROWS:
            self.write_index()

    def end_file(self) -> None:
        """A data file and the index of what it holds end together."""
        self.end_range()
        if self.data is not None:
            self.data.close()
            self.data = None
        self.write_index()
        if self.index is not None:
            self.index.close()
            self.index = None

    def write_index(self) -> None:
        if not self.rows:
            return
        if self.index is None:
            name = f"{self.run}/{self.name}-{len(self.message.indexes):04d}.parquet"
            self.index = pq.ParquetWriter(f"{self.root}/{name}", self.schema, filesystem=self.store)
            self.message.indexes.append(name)
            self.message.spans.append([self.rows[0][0], None])
        columns = [pa.array(c, t.type) for c, t in zip(zip(*self.rows), self.schema)]
        self.index.write_table(pa.Table.from_arrays(columns, schema=self.schema))
        self.message.spans[-1][1] = self.rows[-1][0]
        self.message.rows += len(self.rows)
        self.rows = []

    def close(self) -> Written:
        self.end_file()
        return self.message


class PackedReports(DataSource):
    """``df.write.format("pageloom_reports").option("path", …)`` for rows ``crawl_id, text`` in the
    order of their documents. Options: ``file_bytes``, ``block_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "crawl_id string, text string"

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        if [f.name for f in schema] != ["crawl_id", "text"]:
            raise ValueError("packed reports have the columns crawl_id, text")
        return PackedWriter(
            self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)), int(self.options.get("block_bytes", BLOCK_BYTES))
        )


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, file_bytes: int, block_bytes: int):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.run = f"run-{uuid.uuid4().hex[:16]}"
        self.file_bytes, self.block_bytes = file_bytes, block_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = TaskFiles(self.folder, self.run, TaskContext.get().partitionId(), self.file_bytes, self.block_bytes)
        for batch in iterator:
            for crawl, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    files.add(crawl, text.as_py().encode("utf-8", "surrogatepass"))
        return files.close()

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        number, runs = newest(store, root)
        done = [m for m in messages if m is not None]
        run = {
            "run": self.run,
            "indexes": [x for m in done for x in m.indexes],
            "files": [x for m in done for x in m.files],
            "spans": [x for m in done for x in m.spans],
            "ranges": sum(m.rows for m in done),
            "bytes": sum(m.bytes for m in done),
        }
        runs = [run] if self.overwrite else [*runs, run]
        text = json.dumps({"runs": runs}, indent=1).encode()
        with store.open_output_stream(f"{root}/{self.run}.new") as out:
            out.write(text)
        store.move(f"{root}/{self.run}.new", f"{root}/manifest-{number + 1}.json")
        kept = {r["run"] for r in runs}
        for old, path in manifests(store, root):
            if old <= number:
                store.delete_file(path)
        for found in store.get_file_info(fs.FileSelector(root)):
            if found.type == fs.FileType.Directory and found.base_name.startswith("run-") and found.base_name not in kept:
                store.delete_dir(found.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.folder)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


def write_packed(blocks: DataFrame, order: list[str], folder: str, mode: str = "overwrite", **options: int) -> None:
    """Pack ``blocks`` (``crawl_id``, the columns of ``order``, ``lines``) in the order of their documents.

    ``blocks`` are range-partitioned, so a large crawl spreads over tasks, and small ones share files.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(PackedReports)
    ordered = blocks.repartitionByRange("crawl_id", *order).sortWithinPartitions("crawl_id", *order)
    text = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    writer = ordered.select("crawl_id", text.alias("text")).write.format(FORMAT).mode(mode).option("path", folder)
    writer.options(**{name: str(value) for name, value in options.items()}).save()


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each crawl's bytes lie: ``crawl_id, run, part, nr, file, offset, length``; in the order of
    ``run, part, nr`` they are its document."""
    folder = folder.rstrip("/")
    number, runs = newest(*opened(folder))
    if not number:
        raise FileNotFoundError(f"{folder} holds no packed reports")
    paths = [f"{folder}/{name}" for run in runs for name in run["indexes"]]
    if not paths:
        return spark.createDataFrame([], f"crawl_id string, run int, {INDEX_DDL.removeprefix('crawl_id string, ')}")
    names = F.array(*[F.lit(run["run"]) for run in runs])
    rows = spark.read.schema(INDEX_DDL).parquet(*paths)
    return rows.select("crawl_id", F.array_position(names, F.substring_index("file", "/", 1)).cast("int").alias("run"), "part", "nr", "file", "offset", "length")


def read_packed(spark: SparkSession, folder: str, crawls: DataFrame | None = None) -> DataFrame:
    """``crawl_id, run, part, nr, text`` of all documents or of those in ``crawls(crawl_id)``; only
    their ranges are read."""
    folder = folder.rstrip("/")
    index = read_index(spark, folder)
    if crawls is not None:
        index = index.join(crawls.select("crawl_id").distinct(), "crawl_id", "left_semi")
    keys = ["crawl_id", "run", "part", "nr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name, file = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.slice(at, 1)
                if own.column("file")[0].as_py() != name:
                    name = own.column("file")[0].as_py()
                    file = store.open_input_file(f"{root}/{name}")
                data = file.read_at(own.column("length")[0].as_py(), own.column("offset")[0].as_py())
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), pa.array([data.decode("utf-8", "replace")])], names=[*keys, "text"])

    return index.mapInArrow(run, "crawl_id string, run int, part int, nr int, text string")
