"""Tree numbers from subtree sizes against a recursive walk; JSON of several roots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import tree as tr
from pageloom.sources.scratch import Scratch

SCHEMA = "crawl_id string, url string, title string, level int, parent_url string, path array<string>, ord long, parent_ord long"


def random_trees(seed, crawls=7, most=60, depth=4, hot=0):
    """Rows of random trees, with ``ord`` rising in tree order within a level, spread over partitions."""
    rng = random.Random(seed)
    nodes = []
    for c in range(crawls):
        own = [dict(crawl_id=f"c{c}", url=f"u{c}-{r}", level=0, parent=None, path=[f"0 {r}"]) for r in range(1 + (c % 3 == 0))]
        for i in range(rng.randrange(most) + hot * (c == 1)):
            above = own[0] if hot and c == 1 else rng.choice([n for n in own if n["level"] < depth])
            own.append(dict(crawl_id=f"c{c}", url=f"u{c}-{i}x", level=above["level"] + 1, parent=above, path=[*above["path"], f"{rng.random():.9f}{i}"]))
        nodes += own
    by_level = {}
    for node in nodes:
        by_level.setdefault(node["level"], []).append(node)
    for level in sorted(by_level):
        order = sorted(by_level[level], key=lambda n: (n["parent"]["ord"] if n["parent"] else -1, n["crawl_id"] if not n["parent"] else "", n["path"]))
        part, at = 0, 0
        for node in order:
            if rng.random() < 0.1:
                part, at = part + 1, 0
            node["ord"] = (part << 33) + at
            at += 1
    return nodes


def expected(nodes):
    children = {}
    for n in nodes:
        children.setdefault(n["parent"]["url"] if n["parent"] else n["crawl_id"], []).append(n)
    out = {}

    def walk(found, rank, post, roots):
        for number, n in enumerate(sorted(found, key=lambda n: n["path"]), 1):
            below = children.get(n["url"], [])
            first = rank
            rank, post = walk(below, rank + 1, post, roots)
            out[n["url"]] = (first, rank - first, post, number, number == len(found), roots)
            post += 1
        return rank, post

    for crawl in {n["crawl_id"] for n in nodes}:
        walk(children[crawl], 1, 1, len(children[crawl]))
    return out


def frame(spark, nodes):
    rows = [
        (n["crawl_id"], n["url"], n["url"].upper(), n["level"], n["parent"] and n["parent"]["url"], n["path"], n["ord"], n["parent"] and n["parent"]["ord"])
        for n in nodes
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("settings", [dict(seed=1), dict(seed=2, depth=2), dict(seed=3, depth=7), dict(seed=4, hot=3000), dict(seed=5, crawls=1, most=1)], ids=str)
def test_numbers_equal_a_walk(spark, settings):
    nodes = random_trees(**settings)
    numbered = tr.with_tree_numbers(frame(spark, nodes), Scratch(spark))
    got = {r.url: (r.rank, r.size, r.post, r.child_no, r.is_last, r.roots) for r in numbered.collect()}
    assert got == expected(nodes)
    assert numbered.count() == len(nodes)


def test_no_tree(spark):
    numbered = tr.with_tree_numbers(spark.createDataFrame([], SCHEMA), Scratch(spark))
    assert numbered.collect() == [] and {"rank", "size", "child_no"} <= set(numbered.columns)


def test_json_of_one_and_of_several_roots(spark):
    nodes = random_trees(9, crawls=4, most=25)
    numbered = tr.with_tree_numbers(frame(spark, nodes), Scratch(spark))
    lines = tr.json_lines(numbered).orderBy("crawl_id", "at", "turn", "line_no").collect()
    children = {}
    for n in sorted(nodes, key=lambda n: n["path"]):
        children.setdefault(n["parent"]["url"] if n["parent"] else n["crawl_id"], []).append(n)

    def nested(n):
        own = {"url": n["url"], "title": n["url"].upper(), "level": n["level"], "parent_url": n["parent"] and n["parent"]["url"]}
        return {**own, "children": [nested(c) for c in children.get(n["url"], [])]}

    for crawl in {n["crawl_id"] for n in nodes}:
        text = "\n".join(r.line for r in lines if r.crawl_id == crawl)
        roots = [nested(n) for n in children[crawl]]
        assert json.loads(text) == (roots if len(roots) > 1 else roots[0])
        assert text == json.dumps(roots if len(roots) > 1 else roots[0], indent=2)
    assert {len(children[f"c{c}"]) for c in range(4)} == {1, 2}


def test_children_come_from_the_numbers(spark):
    nodes = random_trees(6)
    numbered = tr.with_tree_numbers(frame(spark, nodes), Scratch(spark))
    by_path = tr.children(numbered.drop("child_no"), Scratch(spark)).select("crawl_id", "parent_url", F.col("child_no").cast("long"), "url", "title")
    assert sorted(map(tuple, tr.children(numbered, None).collect())) == sorted(map(tuple, by_path.collect()))
