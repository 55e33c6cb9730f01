"""The menu tree as rows: order, children, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.operators.ordinals import PARTITION_SHIFT, with_ordinal
from pageloom.sources.scratch import Scratch

# Sorts after every child's key, which starts with a digit.
AFTER_CHILDREN = "~"
# Blocks that close a node come after the one that opens its last descendant, deep ones first.
OPENS, LAST_TO_CLOSE = 0, 2147483647
# Trees deeper than this write every level while they are numbered.
LEVELS_IN_ONE_PLAN = 3


# --- numbers --------------------------------------------------------------------------


def _sizes(tree: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """``size`` of the subtree below and with each node, from the lowest level up."""
    below, levels = None, []
    for level in range(depth, -1, -1):
        here = tree.where(F.col("level") == level).select("crawl_id", "level", "ord", "parent_ord")
        if below is None:
            sized = here.withColumn("size", F.lit(1).cast("bigint"))
        else:
            sums = below.groupBy(F.col("parent_ord").alias("ord")).agg(F.sum("size").alias("below"))
            sized = here.join(sums, "ord", "left").select(*here.columns, (F.coalesce("below", F.lit(0)) + 1).alias("size"))
        below = scratch.write(sized, "tree_size") if depth > LEVELS_IN_ONE_PLAN else sized
        levels.append(below)
    return scratch.write(reduce(DataFrame.unionByName, levels), "tree_sizes")


def _among_siblings(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``ahead``, the size of all earlier siblings' subtrees, ``child_no`` and ``siblings``.

    Rows of a level lie in the order of ``ord``, children of one node together. So sums over
    the level, less those of the first sibling, are sums among siblings. They are taken within
    a partition and carried on by totals of one row a partition: a node with very many children
    is nobody's single task.
    """
    rows = sizes.withColumn("part", F.shiftright("ord", PARTITION_SHIFT))
    totals = rows.groupBy("level", "part").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    earlier = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "level", "part",
        F.coalesce(F.sum("total").over(earlier), zero).alias("total_before"),
        F.coalesce(F.sum("n").over(earlier), zero).alias("n_before"),
    )
    inside = Window.partitionBy("level", "part").orderBy("ord")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
    placed = rows.select("*", before.alias("before"), F.row_number().over(inside).alias("nth")).join(offsets, ["level", "part"])
    placed = placed.select(
        *sizes.columns,
        F.when(F.col("level") == 0, F.col("crawl_id")).alias("crawl"),
        (F.col("before") + F.col("total_before")).alias("before"),
        (F.col("nth") + F.col("n_before")).alias("nth"),
    )
    family = ["level", "parent_ord", "crawl"]
    first = placed.groupBy(*[F.col(name).alias(f"{name}_") for name in family]).agg(
        F.min("before").alias("first_before"), F.min("nth").alias("first_nth"), F.count("*").alias("siblings")
    )
    met = placed.join(first, [placed[name].eqNullSafe(first[f"{name}_"]) for name in family])
    return scratch.write(
        met.select(
            "level", "ord", "parent_ord", "size", "siblings",
            (F.col("before") - F.col("first_before")).alias("ahead"),
            (F.col("nth") - F.col("first_nth") + 1).alias("child_no"),
        ),
        "tree_places",
    )


def with_tree_numbers(tree: DataFrame, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """Number the scraped rows of a traversal, ``tree``, with longs alone. ``depth`` is its last level.

    Adds ``rank`` (place in preorder, from 1), ``size`` (of the subtree), ``post`` (place in
    postorder), ``child_no``, ``is_last`` (among its siblings) and ``roots`` (of its crawl). A
    node's descendants are the ranks from its own to ``rank + size - 1``. Sizes are summed from
    the lowest level up, ranks handed down from the top: each level meets only the next one.
    """
    if depth is None:
        depth = tree.agg(F.max("level")).first()[0] or 0
    places = _among_siblings(_sizes(tree, depth, scratch), scratch)
    above, levels = None, []
    for level in range(depth + 1):
        here = places.where(F.col("level") == level)
        if above is None:
            ranked = here.select("*", (F.col("ahead") + 1).alias("rank"), F.col("siblings").alias("roots"))
        else:
            parents = above.select(F.col("ord").alias("parent_ord"), F.col("rank").alias("parent_rank"), "roots")
            met = here.join(parents, "parent_ord")
            ranked = met.select(*here.columns, (F.col("parent_rank") + 1 + F.col("ahead")).alias("rank"), "roots")
        above = scratch.write(ranked, "tree_rank") if depth > LEVELS_IN_ONE_PLAN else ranked
        levels.append(above)
    numbers = reduce(DataFrame.unionByName, levels).select(
        "level", "ord", "rank", "size", "child_no", "roots",
        (F.col("rank") + F.col("size") - F.col("level") - 1).alias("post"),
        (F.col("child_no") == F.col("siblings")).alias("is_last"),
    )
    return tree.join(numbers, ["level", "ord"]).drop("ord", "parent_ord")


# --- order and children ---------------------------------------------------------------


def preorder(nodes: DataFrame) -> DataFrame:
    """Each node before its children; arrays compare by element, prefixes first."""
    return nodes.orderBy("crawl_id", "path")


def with_preorder_rank(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``rank``, the node's place in its tree, from 1."""
    return with_ordinal(nodes, ["crawl_id"], ["path"], "rank", scratch)


def children(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The children of each node as ordered rows: ``crawl_id, parent_url, child_no, url, title``.

    Nodes with tree numbers bring them along; others are numbered by their paths.
    """
    if "child_no" in nodes.columns:
        below = nodes.where(F.col("parent_url").isNotNull())
        return below.select("crawl_id", "parent_url", F.col("child_no").cast("bigint").alias("child_no"), "url", "title")
    below = nodes.where(F.col("parent_url").isNotNull()).select(
        "crawl_id", "parent_url", "path", "url", "title"
    )
    return with_ordinal(below, ["crawl_id", "parent_url"], ["path"], "child_no", scratch).drop("path")


# --- JSON -----------------------------------------------------------------------------


def json_blocks(nodes: DataFrame) -> DataFrame:
    """The nested JSON document of each crawl, cut into ordered blocks of lines.

    ``nodes`` have tree numbers. Every node gives one block that opens it and, if it has
    children, one that closes it after the last of them: ``crawl_id, at, turn, path, lines``.
    In the order of ``crawl_id, at, turn``, three numbers and a name, the lines form the
    document, so a tree of any size is written without being held in one row. A crawl with
    several roots becomes an array of them.
    """
    several = F.col("roots") > 1
    outer = F.concat(F.when(several, "  ").otherwise(""), F.repeat(F.lit("    "), F.col("level")))
    inner = F.concat(outer, F.lit("  "))
    is_root, has_children = F.col("level") == 0, F.col("size") > 1
    end = F.concat(outer, F.lit("}"), F.when(F.col("is_last"), "").otherwise(","))
    nothing = F.array().cast("array<string>")
    begins = F.when(several & is_root & (F.col("child_no") == 1), F.array(F.lit("["))).otherwise(nothing)
    ends = F.when(several & is_root & F.col("is_last"), F.array(F.lit("]"))).otherwise(nothing)

    def field(name: str, value: Column) -> Column:
        return F.concat(inner, F.lit(f'"{name}": '), value, F.lit(","))

    fields = [
        F.concat(outer, F.lit("{")),
        field("url", tx.json_string(F.col("url"))),
        field("title", tx.json_string(F.col("title"))),
        field("level", F.col("level").cast("string")),
        field("parent_url", tx.json_string(F.col("parent_url"))),
    ]
    open_ = F.concat(begins, F.array(*fields, F.concat(inner, F.lit('"children": ['))))
    leaf = F.concat(begins, F.array(*fields, F.concat(inner, F.lit('"children": []')), end), ends)
    close = F.concat(F.array(F.concat(inner, F.lit("]")), end), ends)
    after = F.concat("path", F.array(F.lit(AFTER_CHILDREN)))

    def block(at: Column, turn: Column, path: Column, lines: Column) -> Column:
        return F.struct(at.alias("at"), turn.alias("turn"), path.alias("path"), lines.alias("lines"))

    opening = block(F.col("rank"), F.lit(OPENS), F.col("path"), F.when(has_children, open_).otherwise(leaf))
    closing = block(F.col("rank") + F.col("size") - 1, F.lit(LAST_TO_CLOSE) - F.col("level"), after, close)
    blocks = F.array_compact(F.array(opening, F.when(has_children, closing)))
    return nodes.select("crawl_id", F.inline(blocks))


def json_lines(nodes: DataFrame) -> DataFrame:
    """``json_blocks`` as one row per line: ``crawl_id, at, turn, path, line_no, line``."""
    return _numbered(json_blocks(nodes))


def _numbered(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("crawl_id", "at", "turn", "path", F.posexplode("lines").alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)
