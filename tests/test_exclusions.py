"""Exclusion tables against ``contains``."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.config import docs_config
from pageloom.operators import links as lk
from pageloom.operators.exclusions import Automaton, excluded_urls
from pageloom.sources.scratch import Scratch


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randint(1, n)))
    entries = [word(6) for _ in range(rng.randint(1, 12))]
    automaton = Automaton(entries)
    for _ in range(300):
        text = word(15)
        assert automaton.occurs_in(text) == any(e in text for e in entries)


@pytest.mark.parametrize("block,turn", [(10_000, 200_000), (3, 5)])
def test_tables(spark, block, turn):
    rng = random.Random(block)
    word = lambda n: "".join(rng.choice("abcé/") for _ in range(rng.randint(1, n)))
    entries = [word(9) + rng.choice(["xyz", "q", ""]) for _ in range(200)] + ["x", "", None, "/hot/a", "/hot/b", "/hot/a", "😀"]
    entries = [e for e in entries if e is None or len(e) != 1 or e in "xq"]
    urls = ["https://h/" + word(20) + rng.choice(["", "xyz", "q", "/hot/a"]) for _ in range(400)] + [None, "", "ab", "/hot/", "x", "a😀"]
    table = spark.createDataFrame([(e,) for e in entries], "entry string")
    frame = spark.createDataFrame([(u,) for u in urls + urls], "url string").repartition(3)
    found = [r.url for r in excluded_urls(frame, table, Scratch(spark), block, turn).collect()]
    want = {u for u in urls if u is not None and any(e and e in u for e in entries)}
    assert len(found) == len(set(found)) and set(found) == want and 5 < len(want) < len(set(urls)) - 5


def test_a_million_entries(spark):
    """As many entries as nobody writes into a plan; verdicts of a sample are those of ``contains``."""
    entries = spark.range(1_000_000).select(F.concat(F.lit("/e"), F.col("id") * 7, F.lit("-")).alias("entry"))
    urls = spark.range(3000).select(F.concat(F.lit("https://h/a/e"), F.col("id") * 5, F.element_at(F.array(F.lit("-x"), F.lit("x"), F.lit("-")), (F.col("id") % 3 + 1).cast("int"))).alias("url"))
    found = {r.url for r in excluded_urls(urls, entries, Scratch(spark)).collect()}
    assert found == {u for i in range(3000) if (u := f"https://h/a/e{i * 5}{('-x', 'x', '-')[i % 3]}") and i * 5 % 7 == 0 and i % 3 != 1}


def test_verdicts_of_a_table_and_literals(spark):
    links = spark.createDataFrame([("https://h/d/", u) for u in ("https://h/d/a", "https://h/d/search/", "https://h/d/private/x", "https://o/private/", "https://h/private#")], "src_url string, url string")
    table = spark.createDataFrame([("/private",), ("nowhere",)], "entry string")
    found = lk.table_verdicts(links, table, docs_config(), Scratch(spark)).collect()
    assert {r.url: r.verdict for r in found} == {
        "https://h/d/a": "keep", "https://h/d/search/": "excluded", "https://h/d/private/x": "excluded", "https://o/private/": "domain", "https://h/private#": "excluded",
    }
    none = lk.table_verdicts(links, table.limit(0), docs_config(), Scratch(spark))
    assert {r.url: r.verdict for r in none.collect()}["https://h/d/private/x"] == "keep"
