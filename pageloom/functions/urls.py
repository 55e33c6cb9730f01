"""URL columns: parts, validity, resolution against a page, link rules.

``parse_url`` rejects URLs that a browser follows, so the parts come from the generic
syntax of RFC 3986 as one pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import NON_CONTENT_TOKENS

URL_PATTERN = (
    "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?"
)
_LEADING = "".join(chr(c) for c in range(33))


def _tidy(url: Column) -> Column:
    """Leading control characters and blanks go, tabs and line ends go anywhere."""
    trimmed = F.ltrim(url, F.lit(_LEADING))
    return reduce(lambda text, char: F.replace(text, F.lit(char), F.lit("")), "\t\r\n", trimmed)


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression, also within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _struct(**fields: Column) -> Column:
    """Struct whose names also hold within a lambda."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_tidy(url), URL_PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def split_url(url: Column) -> Column:
    """Struct of all parts. A last path segment that ends in a bare ``;`` loses it."""

    def parts(tidy: Column) -> Column:
        found = [F.regexp_extract(tidy, URL_PATTERN, group) for group in range(1, 6)]
        return _struct(
            scheme=F.lower(found[0]),
            netloc=found[1],
            path=F.regexp_replace(found[2], "(?s)^((?:.*/)?[^/;]*);$", "$1"),
            query=found[3],
            fragment=found[4],
        )

    return _let(_tidy(url), parts)


def _brackets_match(host: Column) -> Column:
    return F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))


def is_valid_url(url: Column) -> Column:
    """Scheme and host are both there. Null counts as invalid."""
    host = netloc(url)
    return F.coalesce((scheme(url) != "") & (host != "") & _brackets_match(host), F.lit(False))


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def segment_count(url: Column) -> Column:
    """Pieces of the path between slashes; an empty path counts as one."""
    return F.size(F.split(path(url), "/", -1))


def last_segment(url: Column) -> Column:
    """Last piece of the path, without ``;parameters``."""
    return F.substring_index(F.element_at(F.split(path(url), "/", -1), -1), ";", 1)


# The largest int, so no count of segments goes beyond it.
MOST_SEGMENTS = 2147483647


def sort_key(url: Column, by_depth: bool = True) -> Column:
    """String that orders siblings: more path segments first, then by URL."""
    if not by_depth:
        return F.concat(F.lit("0 "), url)
    deep_first = F.lpad((F.lit(MOST_SEGMENTS) - segment_count(url)).cast("string"), 10, "0")
    return F.concat(deep_first, F.lit(" "), url)


# --- resolution -----------------------------------------------------------------------


def _without_dots(path_: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``;parameters`` of the last one stay."""
    parameters = F.regexp_extract(path_, ";[^/]*$", 0)
    plain = F.substring(path_, F.lit(1), F.length(path_) - F.length(parameters))
    # A path that ends in a dot segment names a folder.
    pieces = F.split(F.regexp_replace(plain, "(^|/)([.][.]?)$", "$1$2/"), "/", -1)

    def step(done: Column, piece: Column) -> Column:
        return (
            F.when(piece == ".", done)
            .when(piece == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(piece)))
        )

    kept = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return F.concat(F.regexp_replace(F.array_join(kept, "/"), "^$", "/"), parameters)


def link_base(url: Column) -> Column:
    """What links on the page at ``url`` are resolved against."""

    def with_folder(part: Column) -> Column:
        folder = F.regexp_extract(part["path"], "(?s)^(.*/)?", 1)
        return _struct(
            scheme=part["scheme"],
            netloc=part["netloc"],
            path=part["path"],
            query=part["query"],
            folder=F.when(folder == "", "/").otherwise(folder),
        )

    return _let(split_url(url), with_folder)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on a page whose ``link_base`` is ``base``.

    A link with another scheme stays as it is. The result is null where the host's
    brackets do not match.
    """

    def absolute(part: Column) -> Column:
        own_host, own_path = part["netloc"] != "", part["path"] != ""
        relative = ~own_host & own_path
        in_folder = F.regexp_replace(F.concat(base["folder"], part["path"]), "/{2,}", "/")
        merged = (
            F.when(relative & ~F.startswith(part["path"], F.lit("/")), in_folder)
            .when(own_host | own_path, part["path"])
            .otherwise(base["path"])
        )
        target = _let(
            merged,
            lambda m: F.when(relative & m.rlike("(^|/)[.][.]?(/|;|$)"), _without_dots(m)).otherwise(m),
        )
        asked = F.when(own_host | own_path | (part["query"] != ""), part["query"]).otherwise(base["query"])
        return F.concat(
            base["scheme"],
            F.lit("://"),
            F.when(own_host, part["netloc"]).otherwise(base["netloc"]),
            F.regexp_replace(target, "^(?=[^/])", "/"),
            F.regexp_replace(asked, "^(?=.)", "?"),
            F.regexp_replace(part["fragment"], "^(?=.)", "#"),
        )

    def checked(part: Column) -> Column:
        other_scheme = (part["scheme"] != "") & (part["scheme"] != base["scheme"])
        return (
            F.when(~_brackets_match(part["netloc"]), F.lit(None).cast("string"))
            .when(other_scheme | (base["netloc"] == ""), href)
            .otherwise(absolute(part))
        )

    return _let(split_url(href), checked)


def join_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on the page at ``base``."""
    return F.when(href == "", base).otherwise(_let(link_base(base), lambda b: resolve(b, href)))


# --- link rules -----------------------------------------------------------------------


def same_domain(url: Column, base_domain: Column, base_root: Column | None = None) -> Column:
    """Hosts are equal, case and port included; an empty base allows every host.

    With ``base_root`` (scheme and host of the base) most links pass without a regex:
    they start with it and their host ends there.
    """
    same = (base_domain == "") | (netloc(url) == base_domain)
    if base_root is None:
        return same
    after = F.substring(url, F.length(base_root) + 1, F.lit(1))
    return (F.startswith(url, base_root) & after.isin("", "/", "?", "#")) | same


def _contains_any(url: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda hit, needle: hit | F.contains(url, F.lit(needle)), needles, F.lit(False))


def has_excluded_path(url: Column, excluded: tuple[str, ...]) -> Column:
    """Any entry occurs anywhere in the URL."""
    return _contains_any(url, excluded)


def has_fragment_or_query(url: Column) -> Column:
    return (fragment(url) != "") | (query(url) != "")


def is_non_content(url: Column) -> Column:
    return _contains_any(url, NON_CONTENT_TOKENS)


def base_prefix(base_url: Column, mode: str) -> Column:
    """What a link has to start with."""
    if mode == "seed":
        return base_url
    if mode == "site":
        return site_root(base_url)
    return F.lit("")
