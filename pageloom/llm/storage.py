"""Binary files that tasks write to and read from a folder all executors share.

A task names its files anew on every attempt and reports those it has finished, so a
repeated attempt never touches files that count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from pageloom.sources.scratch import shared_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder under the shared one, for any store that pyarrow can open."""
    root = shared_folder(spark)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return f"{root}/{label}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str, ending: str):
    """URI and output stream of a file no other attempt uses."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}{ending}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}")


def read(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as file:
        return file.read()


def stream(uri: str):
    store, path = opened(uri)
    return store.open_input_stream(path)
