"""Crawls that go on where they stopped: a manifest of the tables a run has finished.

A run's driver program writes its tables in an order that depends on settings and input
alone. So a later run of the same program names the same tables; those the manifest lists are
opened instead of computed, and the first unlisted one is where work goes on. A crawl that
stopped after its second round so neither parses nor walks those rounds again, and a deeper
crawl continues a shallower one.

The manifest is one JSON file that is replaced by a rename as a whole, after its table is
complete: readers see the old list or the new one. It holds the hash of settings and input and
each table's path, rows and buckets. What a stopped run left behind without listing it is
removed when the journal is opened. A journal serves one driver at a time.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.sources.scratch import Scratch

MANIFEST = "manifest.json"


class JournalMismatch(ValueError):
    """The folder's journal belongs to other settings or other input."""


class Journal(Scratch):
    """Tables of one crawl in a folder that outlives the session.

    ``folder`` has to be reachable by all executors; ``settings`` is the hash its tables
    belong to, as ``fingerprint`` gives it.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: str):
        super().__init__(spark)
        self.folder = folder.rstrip("/")
        self.settings = settings
        self.jvm = spark.sparkContext._jvm
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.store = self.root.getFileSystem(hadoop)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.store.getUri(), hadoop)
        self.entries: dict[str, dict] = {}
        self.reused: list[str] = []
        self._open()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def _open(self) -> None:
        self.store.mkdirs(self.root)
        if self.store.exists(self._path(MANIFEST)):
            stored = json.loads(self.spark.read.text(f"{self.folder}/{MANIFEST}", wholetext=True).first()[0])
            if stored["settings"] != self.settings:
                raise JournalMismatch(f"{self.folder} holds a crawl with other settings or input")
            self.entries = {entry["name"]: entry for entry in stored["tables"]}
        for found in self.store.listStatus(self.root):
            name = found.getPath().getName()
            if name != MANIFEST and name not in self.entries:
                self.store.delete(found.getPath(), True)

    def _finished(self, name: str) -> bool:
        if name in self.entries:
            self.reused.append(name)
            return True
        return False

    def _buckets(self, name: str) -> int:
        return self.entries[name]["buckets"]

    def _publish(self, name: str, buckets: int | None = None) -> None:
        path = f"{self.folder}/{name}"
        rows = self.spark.read.parquet(path).count()  # read from the files' footers
        self.entries[name] = {"name": name, "path": path, "rows": rows, "buckets": buckets}
        new, rename = self._path(f"{MANIFEST}.new"), self.jvm.org.apache.hadoop.fs.Options.Rename
        out = self.store.create(new, True)
        out.write(bytearray(json.dumps({"settings": self.settings, "tables": list(self.entries.values())}, indent=1).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        self.files.rename(new, self._path(MANIFEST), over)


def fingerprint(config: CrawlConfig, numbered: bool, text: bool, pages: DataFrame | str, *rows: DataFrame | None) -> str:
    """Hash of what a crawl's tables depend on: settings, the pages' files or, without files,
    their plan's rows, and the rows of the small inputs, in any order. ``pages`` may be a text that
    stands for them."""
    parts = [json.dumps(asdict(config), sort_keys=True), str((numbered, text))]
    if isinstance(pages, str):
        parts.append(pages)
    else:
        parts += [pages.schema.simpleString(), *(sorted(pages.inputFiles()) or [_rows_hash(pages)])]
    parts += ["none" if r is None else _rows_hash(r) for r in rows]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _rows_hash(rows: DataFrame) -> str:
    each = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return str(tuple(rows.agg(F.count("*"), F.sum(each)).first()))
