"""Tree, reports and sinks against straightforward walks of the same tree."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from small_site import SITE
from pageloom import crawl_site, write_outputs
from pageloom.config import menu_config
from pageloom.operators import extract as ex
from pageloom.operators import report as rp
from pageloom.operators import tree as tr
from pageloom.operators.ordinals import with_ordinal
from pageloom.sources import sinks
from pageloom.sources.scratch import Scratch
from pageloom.sources.snapshots import SEEDS_SCHEMA


@pytest.fixture(scope="module")
def crawl(spark, site_pages):
    seeds = spark.createDataFrame([("one", SITE + "docs/"), ("two", SITE + "docs/guide/")], SEEDS_SCHEMA)
    return crawl_site(site_pages, seeds, 3)


@pytest.fixture(scope="module")
def trees(crawl):
    """Nested nodes per crawl, built from the flat rows in preorder."""
    roots = {}
    known = {}
    for row in crawl.nodes.orderBy("crawl_id", "path").collect():
        node = {name: row[name] for name in ("url", "title", "level", "parent_url")}
        node["children"] = []
        known[row["crawl_id"], row["url"]] = node, row["text"]
        if row["parent_url"] is None:
            roots[row["crawl_id"]] = node
        else:
            known[row["crawl_id"], row["parent_url"]][0]["children"].append(node)
    texts = {key: text for key, (_, text) in known.items()}
    return roots, texts


def parts(folder, crawl_id):
    files = sorted((folder / f"crawl_id={crawl_id}").glob("part-*"))
    return "".join(file.read_text(encoding="utf-8") for file in files)


RULE = "=" * 80
TEXTS = {
    "one": f"""
{RULE}
Level 0: Docs Home
URL: https://d.example/docs/
{RULE}

Home tag Docs Home GRSXTBMEHello
world


  {RULE}
  Level 1: @
  URL: https://d.example/docs/api/ref
  {RULE}

  D
  R\u00e9f & more \U0001f600
  end


    {RULE}
    Level 2: Deep
    URL: https://d.example/docs/api/ref/deep/er
    {RULE}

    Deepme


  {RULE}
  Level 1: Guide
  URL: https://d.example/docs/guide/
  {RULE}

  GuideUpIRead ref or q.


    {RULE}
    Level 2: Intro
    URL: https://d.example/docs/guide/intro
    {RULE}

    Intro OneTwoThree

""".replace("@", ""),
    "two": f"""
{RULE}
Level 0: Guide
URL: https://d.example/docs/guide/
{RULE}

GuideUpIRead ref or q.


  {RULE}
  Level 1: Intro
  URL: https://d.example/docs/guide/intro
  {RULE}

  Intro OneTwoThree

""",
}


def preorder(node):
    yield node
    for child in node["children"]:
        yield from preorder(child)


def test_written_text_and_json(crawl, trees, tmp_path):
    write_outputs(crawl, "both", str(tmp_path), datetime(2024, 5, 6, 7, 8, 9))
    roots, _ = trees
    assert set(roots) == {"one", "two"}
    for crawl_id, root in roots.items():
        assert parts(tmp_path / "scraped_content", crawl_id) == TEXTS[crawl_id]
        document = parts(tmp_path / "menu_tree", crawl_id)
        assert document == json.dumps(root, indent=2) + "\n"
        assert json.loads(document) == root


def test_written_page_rows(spark, crawl, trees, tmp_path):
    write_outputs(crawl, "pdf", str(tmp_path), datetime(2024, 5, 6, 7, 8, 9))
    roots, texts = trees
    title = spark.read.parquet(str(tmp_path / "pages/title_page")).where("crawl_id = 'one'")
    assert [row["text"] for row in title.orderBy("line_no").collect()] == [
        "Web Scraper Output", f"Base URL: {SITE}docs/", "Generated: 2024-05-06 07:08:09", "Pages: 7",
    ]
    body = spark.read.parquet(str(tmp_path / "pages/body")).collect()
    for crawl_id, root in roots.items():
        expected = set()
        for page, node in enumerate(preorder(root), 3):
            ascii_text = texts[crawl_id, node["url"]].encode("ascii", "replace").decode()
            lines = [("heading", f"Level {node['level']}: {node['title']}"), ("url", f"URL: {node['url']}")]
            lines += [("body", line) for line in ascii_text.split("\n") if line.strip()]
            expected |= {(page, number, *line) for number, line in enumerate(lines, 1)}
        got = {tuple(row)[1:] for row in body if row["crawl_id"] == crawl_id}
        assert got == expected
    assert not (tmp_path / "scraped_content").exists()
    with pytest.raises(ValueError):
        write_outputs(crawl, "html", str(tmp_path))


def test_contents(crawl, trees):
    roots, _ = trees
    for numbers in ("reference", "ordinal"):
        rows = rp.contents(crawl.nodes, crawl.scratch, numbers).where("crawl_id = 'one'").orderBy("path").collect()
        for page, (row, node) in enumerate(zip(rows, preorder(roots["one"]), strict=True), 3):
            dots = "." * (50 - len(node["title"]) - 2 * node["level"])
            shown = 3 if numbers == "reference" else page
            assert row["entry"] == f"{node['title']} {dots} {shown}"
            assert row["indent_mm"] == 10 * node["level"]
    with pytest.raises(ValueError):
        rp.contents(crawl.nodes, crawl.scratch, "roman")


def test_long_titles_get_no_dots(spark):
    nodes = spark.createDataFrame([("c", ["k"], "t" * 60, 0)], "crawl_id string, path array<string>, title string, level int")
    assert rp.contents(nodes).first()["entry"] == "t" * 60 + "  3"


def test_children_are_numbered_in_order(crawl, trees):
    roots, _ = trees
    rows = tr.children(crawl.nodes, crawl.scratch).where("crawl_id = 'one'").collect()
    got = {(row["parent_url"], row["child_no"]): row["url"] for row in rows}
    expected = {
        (node["url"], number): child["url"]
        for node in preorder(roots["one"])
        for number, child in enumerate(node["children"], 1)
    }
    assert got == expected


def test_flat_reports(crawl, spark, tmp_path):
    content = crawl.content.where("crawl_id = 'one'")
    sinks.write_blocks(rp.flat_blocks(content), ["url"], str(tmp_path / "flat"))
    rows = sorted((row["url"], row["text"]) for row in content.collect())
    rule = "=" * 80
    expected = "".join(f"\n{rule}\nURL: {url}\n{rule}\n\n{text}\n\n" for url, text in rows)
    assert parts(tmp_path / "flat", "one") == expected
    numbered = rp.number_pages(content, crawl.scratch)
    raw = rp.flat_pages(numbered, menu_config()).orderBy("doc_page", "line_no").collect()
    lines = [
        (page, number, text)
        for page, (url, text_) in enumerate(rows, 2)
        for number, text in enumerate([f"URL: {url}", *(x for x in text_.split("\n") if x.strip())], 1)
    ]
    assert [(row["doc_page"], row["line_no"], row["text"]) for row in raw] == lines


def test_plain_sink(spark, site_pages, tmp_path):
    records = ex.plain_pages(site_pages)
    sinks.write_plain_text(records, str(tmp_path / "plain"))
    files = sorted((tmp_path / "plain").glob("part-*"))
    written = "".join(file.read_text(encoding="utf-8") for file in files)
    assert written == "".join(row["text"] + "\n" for row in records.orderBy("url").collect())


def test_ordinals_of_a_null_group(spark):
    rows = spark.createDataFrame([(None, "a"), ("g", "a"), (None, "b")], "g string, k string")
    numbered = with_ordinal(rows, ["g"], ["k"], "n", Scratch(spark)).collect()
    assert {tuple(row) for row in numbered} == {(None, "a", 1), (None, "b", 2), ("g", "a", 1)}


def test_ordinals_of_a_group_that_fills_every_partition(spark):
    rows = spark.range(0, 5000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.format_string("%08d", (F.col("id") * 7919) % 5000).alias("k"),
    )
    numbered = with_ordinal(rows, ["g"], ["k"], "n", Scratch(spark)).collect()
    by_group = {}
    for row in sorted(numbered, key=lambda r: (r["g"], r["k"])):
        by_group.setdefault(row["g"], []).append(row["n"])
    assert sum(map(len, by_group.values())) == 5000
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in by_group.values())
