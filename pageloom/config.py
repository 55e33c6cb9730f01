"""Crawl settings. Plain driver-side values; lists become array literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Default selectors, excluded paths and tag sets; results depend on them.
MENU_SELECTORS = (
    'nav[role="navigation"] a',
    ".sidebar-menu a",
    ".docs-menu a",
    ".toc a",
    ".nav-links a",
    ".menu-item a",
    'a[href^="/"]',
    'a[href^="./"]',
    'a[href^="../"]',
)
PRIORITY_SELECTORS = (
    'nav[role="navigation"] a',
    ".sidebar-menu a",
    ".docs-menu a",
    ".toc a",
)
EXCLUDED_PATHS = (
    "/search",
    "/login",
    "/signup",
    "/register",
    "/contact",
    "/download",
    "/print",
)
NON_CONTENT_TOKENS = ("javascript:", "mailto:", "tel:", "#", "?")
PAGE_DROP_TAGS = ("script", "style", "nav", "footer", "iframe")
PLAIN_DROP_TAGS = ("script", "style")
RETRYABLE_STATUS = (429, 500, 502, 503, 504)
MIN_PRIORITY_LINKS = 5
TIMEOUT_SECONDS = 60

LINKS_FROM = ("cleaned", "raw")
PREFIX_MODES = ("seed", "site", "off")


@dataclass(frozen=True)
class CrawlConfig:
    """What to extract and which links to follow.

    ``links_from``: 'cleaned' looks for links after the dropped elements are gone,
    'raw' before. ``prefix``: a link must start with the crawl's base URL ('seed'),
    with its scheme and host ('site'), or need not ('off'). ``collapse_blanks`` reduces a
    text piece that holds only blanks to one space or newline, outside ``pre``, as tree builders do.
    """

    menu_selectors: tuple[str, ...] = field(default=None)
    priority_selectors: tuple[str, ...] = PRIORITY_SELECTORS
    excluded_paths: tuple[str, ...] = EXCLUDED_PATHS
    drop_tags: tuple[str, ...] = PAGE_DROP_TAGS
    collapse_blanks: bool = True
    links_from: str = "cleaned"
    prefix: str = "seed"
    priority_fallback: bool = True
    same_domain: bool = True
    sort_by_depth: bool = True
    sanitize_body: bool = True
    timeout: int = TIMEOUT_SECONDS
    output_dir: str = "output"
    # Leave pages of hosts that no crawl stays on out before they are parsed.
    only_base_hosts: bool = True
    # A URL requested by this many frontier rows is joined apart, in parts of about this many rows.
    hot_rows: int = 200_000
    # Crawls at least this deep number all URLs first, and their rounds shuffle longs alone.
    numbered_from_depth: int = 3
    # Buckets of the written page table; None derives them from the input's size.
    buckets: int | None = None

    def __post_init__(self):
        if self.menu_selectors is None:
            object.__setattr__(self, "menu_selectors", MENU_SELECTORS)
        for name in ("menu_selectors", "priority_selectors", "excluded_paths", "drop_tags"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.links_from not in LINKS_FROM:
            raise ValueError(f"links_from must be one of {LINKS_FROM}")
        if self.prefix not in PREFIX_MODES:
            raise ValueError(f"prefix must be one of {PREFIX_MODES}")

    @property
    def selectors(self) -> tuple[str, ...]:
        """Every selector the page parser has to match, each once."""
        return tuple(dict.fromkeys(self.priority_selectors + self.menu_selectors))

    def with_(self, **changes) -> CrawlConfig:
        return replace(self, **changes)


def docs_config(**changes) -> CrawlConfig:
    """Default profile: priority selectors, excluded paths, same-domain check, ranking."""
    return CrawlConfig(**changes)


def menu_config(**changes) -> CrawlConfig:
    """Every selector always; only validity, base prefix and non-content tokens filter."""
    values = dict(
        priority_selectors=(),
        excluded_paths=(),
        priority_fallback=False,
        same_domain=False,
        sort_by_depth=False,
        sanitize_body=False,
    )
    return CrawlConfig(**{**values, **changes})


def plain_config(**changes) -> CrawlConfig:
    """One page at a time: only script and style are dropped, no links, no title."""
    values = dict(
        menu_selectors=(),
        priority_selectors=(),
        excluded_paths=(),
        drop_tags=PLAIN_DROP_TAGS,
        priority_fallback=False,
        sanitize_body=False,
    )
    return CrawlConfig(**{**values, **changes})
