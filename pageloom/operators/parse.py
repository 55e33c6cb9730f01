"""Parse stage: the only step that leaves the JVM, once per page."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pageloom.config import CrawlConfig
from pageloom.functions import markup, selectors as css
from pageloom.functions.markup import PageReader, compile_selector

# The reader travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(css)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pages parsed and sent back together, which bounds what a task holds.
ROWS_AT_ONCE = 256

ANCHORS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("href", T.StringType()),
            T.StructField("in_dropped", T.BooleanType()),
            T.StructField("matched", T.ArrayType(T.IntegerType())),
        ]
    )
)
PARSED_FIELDS = [
    T.StructField("raw_text", T.StringType()),
    T.StructField("h1", T.StringType()),
    T.StructField("title_tag", T.StringType()),
    T.StructField("anchors", ANCHORS),
    T.StructField("parse_error", T.StringType()),
]


def parse_pages(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """Replace ``html`` by what the page holds; the other columns pass through.

    Adds ``raw_text, h1, title_tag, anchors, parse_error``. Only elements with an
    ``href`` that match a selector come out as anchors; ``matched`` holds the selectors'
    positions in ``config.selectors``. A null page gives nulls. Works on batch and
    streaming input, since each row stands alone.
    """
    kept = [field for field in pages.schema.fields if field.name != "html"]
    schema = T.StructType(kept + PARSED_FIELDS)
    parsed_schema = to_arrow_schema(T.StructType(PARSED_FIELDS))
    arrow_schema = to_arrow_schema(schema)
    selectors = config.selectors
    drop_tags = frozenset(config.drop_tags)
    collapse_blanks = config.collapse_blanks
    for selector in selectors:
        compile_selector(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader([compile_selector(s) for s in selectors], drop_tags, collapse_blanks)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = [_read(reader, html) for html in part.column("html").to_pylist()]
                columns = [part.column(f.name).cast(arrow_schema.field(f.name).type) for f in kept]
                columns += pa.RecordBatch.from_pylist(rows, schema=parsed_schema).columns
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return pages.mapInArrow(run, schema)


def _read(reader: PageReader, html: str | None) -> dict:
    if html is None:
        return {}
    try:
        text, h1, title, links = reader.read(html)
    except AssertionError as error:
        return {"parse_error": f"Page markup rejected: {error}"}
    return {"raw_text": text, "h1": h1, "title_tag": title, "anchors": links}
