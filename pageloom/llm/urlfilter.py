"""URL filters: a trie over reversed host labels and path segments; the longest rule wins.

Rules are rows (host, path, action); a rule fits its host and all its subdomains if the
URL's path starts with the rule's path. The last segment of a rule's path may end in the
middle of a segment of the URL. Of the rules that fit, the one with the longest host and
path together wins, then the one with the longer host, then ``block``.

The trie is broadcast if the rules are few enough (``max_rules``, ``max_chars``, both
counted first); beyond that, hosts, their parent domains and the beginnings of paths are
joined with the rules, which gives the same answer.

Defined results: a null URL or one without ``://`` has an empty host and path. Where no
rule fits, the verdict is ``default``, or ``block`` for an empty host. A null host or
path of a rule counts as empty (any host, any path); repeated rules count once. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 500_000
MAX_CHARS = 64 << 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class PathNode:
    next: dict[str, PathNode] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)  # start of a segment: path, action


@dataclass
class HostNode:
    next: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode = field(default_factory=PathNode)


def build(rules) -> HostNode:
    root = HostNode()
    for host, path, action in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.next.setdefault(label, HostNode())
        at = node.paths
        *segments, last = path.split("/")
        for segment in segments:
            at = at.next.setdefault(segment, PathNode())
        if at.ends.get(last, ("", ""))[1] != "block":
            at.ends[last] = (path, action)
    return root


def longest_path(node: PathNode, segments: list[str]) -> tuple[str, str] | None:
    """The deepest path of this host that the URL's path starts with."""
    best = None
    for segment in segments:
        if node.ends:
            for n in range(min(len(segment), max(map(len, node.ends))), -1, -1):
                if segment[:n] in node.ends:
                    best = node.ends[segment[:n]]
                    break
        node = node.next.get(segment)
        if node is None:
            break
    return best


def decide(root: HostNode, host: str, path: str) -> tuple[str, str] | None:
    """Rule (host and path) and action for a URL; None if no rule fits."""
    segments, labels = path.split("/"), host.split(".") if host else []
    best, node, depth = None, root, 0
    while node is not None:
        if found := longest_path(node.paths, segments):
            suffix = ".".join(labels[len(labels) - depth :])
            rank = (len(suffix) + len(found[0]), len(suffix))
            if best is None or rank > best[0]:
                best = (rank, suffix + found[0], found[1])
        if depth == len(labels):
            break
        node, depth = node.next.get(labels[-1 - depth]), depth + 1
    return best and best[1:]


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def filter_urls(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow", max_rules: int = MAX_RULES, max_chars: int = MAX_CHARS) -> DataFrame:
    """``keep``, then host, path, rule and verdict of every row."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").distinct()
    size = rules.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.length("path")).alias("chars")).first()
    if size.n > max_rules or (size.chars or 0) > max_chars:
        return joined(pages, rules, keep, url, default)
    trie = pages.sparkSession.sparkContext.broadcast(build(sorted(map(tuple, rules.collect()))))
    kept = pages.select(*keep, F.col(url).alias("url_"))
    fields = ("host", "path", "rule", "verdict")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes if n != "url_"), *(f"{f} string" for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("url_"):
                host, path = split_url(value.as_py())
                rule, action = decide(trie.value, host, path) or (None, default if host else "block")
                rows.append((host, path, rule, action))
            made = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + made, names=[*keep, *fields])

    return kept.mapInArrow(run, schema)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...], url: str, default: str) -> DataFrame:
    """The same by a join, for rules of any number: each host and parent domain, with each beginning of
    the path that is as long as some rule's, meets the one rule it equals. The lengths that occur
    are collected; there are no more of them than the longest path has characters."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    text = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row_"), *keep, host_of(text).alias("host"), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("row_", "path", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("host_"))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    parts = hosts.select("row_", "host_", F.explode(F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))).alias("path_"))
    r = rules.select(F.col("host").alias("host_"), F.col("path").alias("path_"), "action")
    hit = parts.join(r, ["host_", "path_"])
    order = F.struct(F.length("host_") + F.length("path_"), F.length("host_"), F.col("action") == "block")
    best = hit.groupBy("row_").agg(F.max_by(F.struct(F.concat("host_", "path_").alias("rule"), "action"), order).alias("best"))
    verdict = F.coalesce("best.action", F.when(F.col("host") == "", "block").otherwise(default))
    return rows.join(best, "row_", "left").select(*keep, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
