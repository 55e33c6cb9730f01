"""Per-page reader used inside the parse stage: markup in, text pieces and links out.

Selectors such as ``.toc a`` depend on the elements that are open, which no regular
expression can follow, so one walk over the tokens of the standard library's parser
serves the text, the titles and the links of a page.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from pageloom.functions.selectors import Chain, Matcher, compile_selector

# Elements that never have content, elements whose text is not page text,
# and elements that keep their blanks.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex"
    " keygen link menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN_TEXT_TAGS = frozenset({"script", "style", "template", "rt", "rp"})
KEEP_BLANKS_TAGS = frozenset({"pre", "textarea"})

_BLANK_PIECE = re.compile("[ \n\t\f\r]+")


__all__ = ["PageReader", "compile_selector"]


class PageReader(HTMLParser):
    """Collects page text, first heading, title element and matching links of one page."""

    def __init__(
        self, selectors: list[list[Chain]], drop_tags: frozenset[str], collapse_blanks: bool = False
    ):
        super().__init__(convert_charrefs=False)
        self.matcher = Matcher(selectors)
        self.drop_tags = drop_tags
        self.collapse_blanks = collapse_blanks
        self.bare_matches: dict[str, int] = {}

    def updatepos(self, i, j):
        """Line numbers are of no use here."""
        return j

    def read(self, html: str):
        self.reset()
        # Open elements: (tag, bits that chains have reached at it, and at it or above).
        self.open: list[tuple[str, int, int]] = []
        self.open_tags: dict[str, int] = {}
        self.dropped = self.hidden = self.keep = 0
        self.pending: list[str] = []
        self.text: list[str] = []
        self.captured: dict[str, list[str]] = {}
        self.capturing: dict[int, str] = {}
        self.links: list[dict] = []
        self.feed(html)
        self.close()
        self._flush()
        heading, title = (
            "".join(self.captured[tag]) if tag in self.captured else None for tag in ("h1", "title")
        )
        return "".join(self.text), heading, title, self.links

    # Text -------------------------------------------------------------------------
    def _flush(self):
        if not self.pending:
            return
        piece = "".join(self.pending)
        self.pending = []
        if self.dropped or self.hidden:
            return
        if self.collapse_blanks and not self.keep and _BLANK_PIECE.fullmatch(piece):
            piece = "\n" if "\n" in piece else " "
        self.text.append(piece)
        for tag in self.capturing.values():
            self.captured[tag].append(piece)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        try:
            number = int(name[1:], 16) if name[0] in "xX" else int(name)
            try:
                text = bytes([number]).decode("windows-1252")
            except ValueError:
                text = chr(number)
            text.encode("utf-8")
        except (ValueError, OverflowError):
            text = "\N{REPLACEMENT CHARACTER}"
        self.pending.append(text)

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA["):])
            self._flush()

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    # Elements ---------------------------------------------------------------------
    def _start(self, tag, attributes, stays_open):
        self._flush()
        _, parent, above = self.open[-1] if self.open else ("", 0, 0)
        matcher = self.matcher
        if attributes:
            attributes = {name: value or "" for name, value in attributes}
            here = matcher.reached(matcher.steps_met(tag, attributes), above, parent)
            if "href" in attributes and (hits := matcher.selected(here)):
                self.links.append(
                    {
                        "pos": len(self.links),
                        "href": attributes["href"],
                        "in_dropped": bool(self.dropped or tag in self.drop_tags),
                        "matched": hits,
                    }
                )
        else:
            # Elements without attributes meet the same steps wherever they stand.
            met = self.bare_matches.get(tag)
            if met is None:
                met = self.bare_matches[tag] = matcher.steps_met(tag, {})
            here = matcher.reached(met, above, parent)
        if not stays_open:
            return
        self.open.append((tag, here, above | here))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self._count(tag, 1)
        if tag in ("h1", "title") and tag not in self.captured and not self.dropped:
            self.captured[tag] = []
            self.capturing[len(self.open)] = tag

    def _count(self, tag, change):
        if tag in self.drop_tags:
            self.dropped += change
        if tag in HIDDEN_TEXT_TAGS:
            self.hidden += change
        if tag in KEEP_BLANKS_TAGS:
            self.keep += change

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, tag not in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self.open_tags.get(tag):
            return
        while True:
            self.capturing.pop(len(self.open), None)
            name, *_ = self.open.pop()
            self.open_tags[name] -= 1
            self._count(name, -1)
            if name == tag:
                return
