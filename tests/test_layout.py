"""Laid-out page numbers against a serial count."""

import random

import pytest

from pageloom.operators.layout import LayoutSettings, laid_out
from pageloom.sources.scratch import Scratch


def serial(items, s):
    """Pages of one document's items, line by line."""
    out, page, used = [], 0, s.lines
    for n in items:
        n = max(1, n)
        if not page or not s.flow or s.lines - used < min(n, s.keep):
            page, used = page + 1, 0
        first = None
        for _ in range(n):
            if used == s.lines:
                page, used = page + 1, 0
            first = first or page
            used += 1
        out.append((first, page))
    return out


@pytest.mark.parametrize("settings", [LayoutSettings(lines=7), LayoutSettings(lines=7, flow=True), LayoutSettings(lines=5, flow=True, keep=5), LayoutSettings(lines=1, flow=True, keep=1), LayoutSettings(flow=True)], ids=str)
def test_pages(spark, settings):
    rng = random.Random(settings.lines)
    documents = {f"d{d}": [rng.choice([0, 1, 2, 3, 9, 40]) for _ in range(rng.choice([1, 5, 60]))] for d in range(9)}
    documents["long"] = [rng.randint(0, 12) for _ in range(2500)]
    documents[None] = [3, 4, 5]
    rows = [(d, i, n, "x") for d, items in documents.items() for i, n in enumerate(items)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc string, nr int, n int, fill string").repartition(5)
    got = laid_out(frame, "doc", ["nr"], "n", Scratch(spark), settings)
    assert got.columns == [*frame.columns, "first_page", "last_page"]
    found = {(r.doc, r.nr): (r.first_page, r.last_page) for r in got.collect()}
    want = {(d, i): p for d, items in documents.items() for i, p in enumerate(serial(items, settings))}
    assert found == want and got.count() == len(rows)


def test_nothing_to_lay_out(spark):
    frame = spark.createDataFrame([], "doc string, nr int, n int")
    assert laid_out(frame, "doc", ["nr"], "n", Scratch(spark)).isEmpty()
