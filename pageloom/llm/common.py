"""Words, written tables and row streams that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.sources.scratch import Scratch


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8. bytes.split() parts at just these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder and read back from there.

    It cuts lineage, survives lost executors and lets the optimizer see the true size,
    so that it alone decides what is small enough to broadcast.
    """
    return Scratch(df.sparkSession).write(df, label)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have, in whatever case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


ROWS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what Python makes of them stays small as well."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def by_text(batches: Iterator[pa.RecordBatch], text: str, row: Callable, schema: pa.Schema, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Columns ``keep`` as they are, then the fields that ``row(text)`` gives for each row."""
    names = [f.name for f in schema if f.name not in keep]
    for batch in slices(batches):
        rows = [row(t.as_py()) for t in batch.column(text)]
        columns = [batch.column(name) for name in keep]
        for i, name in enumerate(names):
            columns.append(pa.array([r[i] for r in rows], schema.field(name).type))
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([schema.field(n) for n in [*keep, *names]]))
