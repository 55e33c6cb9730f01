"""CSS selectors, all matched together while a page is read.

Grammar: lists ``a, b`` of chains with descendant (blank) and child (``>``) steps; a step has a tag or
``*``, ``#id``, ``.class``, ``[attr]``, ``[attr="v"]`` and ``[attr^="v"]``. Everything else raises.

Steps that are the same in several selectors are one. A step is found through its rarest
condition: its id, a class, an attribute's value, the beginning of one, an attribute, its tag, in
that order; so an element meets only steps that share such a condition with it, however many
selectors there are. Chain progress is a set of bits, one for each step of each chain, for
what some element above has reached and for what the parent has; an element's own bits follow
from both with a few operations on whole sets.
"""

from __future__ import annotations

import re

# Pieces of a chain: a comma or child sign, blanks, or a step, whose brackets may hold any of them.
_PIECE = re.compile(r"""\s*([>,])\s*|(\s+)|((?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s>,\[])+)""")
_STEP = re.compile(r"""(\*|[A-Za-z][A-Za-z0-9-]*)?((?:[.#][A-Za-z_][\w-]*|\[[^\]]*\])*)""")
_CONDITION = re.compile(r"""([.#])([A-Za-z_][\w-]*)|\[([A-Za-z_][\w-]*)(?:(\^?=)(?:"([^"]*)"|'([^']*)'))?\]""")


class Step:
    """Tag, id, classes and attribute tests that one element has to meet."""

    def __init__(self, text: str):
        match = _STEP.fullmatch(text)
        conditions = match and match.group(2)
        if not text or match is None or _CONDITION.sub("", conditions):
            raise ValueError(f"unsupported selector part: {text!r}")
        self.tag = (match.group(1) or "").lower().replace("*", "")
        ids, classes, tests = set(), set(), set()
        for sign, name, attribute, operator, double, single in _CONDITION.findall(conditions):
            if sign:
                (ids if sign == "#" else classes).add(name)
            else:
                tests.add((attribute.lower(), operator, double or single))
        self.ids, self.classes, self.tests = sorted(ids), sorted(classes), sorted(tests)
        self.key = (self.tag, tuple(self.ids), tuple(self.classes), tuple(self.tests))

    def matches(self, tag: str, attributes: dict[str, str], classes: set[str]) -> bool:
        if self.tag and self.tag != tag:
            return False
        if any(attributes.get("id") != name for name in self.ids) or any(name not in classes for name in self.classes):
            return False
        for name, operator, value in self.tests:
            own = attributes.get(name)
            if own is None:
                return False
            if operator == "=" and own != value:
                return False
            if operator == "^=" and not (value and own.startswith(value)):
                return False
        return True

    def handle(self) -> tuple:
        """Where the step is looked up."""
        if self.ids:
            return "id", self.ids[0]
        if self.classes:
            return "class", self.classes[0]
        for wanted in ("=", "^=", ""):
            for name, operator, value in self.tests:
                if operator == wanted:
                    return ("attribute", name) if not operator else (operator, name, value)
        return "tag", self.tag


Chain = list[tuple[str, Step]]  # each step with the sign in front of it: "" for the first, " " or ">"


def compile_selector(selector: str) -> list[Chain]:
    """The chains of a selector list; other grammar raises ``ValueError``."""
    chains: list[Chain] = [[]]
    sign, at, text = "", 0, selector.strip()
    while at < len(text):
        piece = _PIECE.match(text, at)
        if piece is None:
            raise ValueError(f"unsupported selector: {selector!r}")
        at = piece.end()
        if piece.group(3):
            if chains[-1] and not sign:
                raise ValueError(f"unsupported selector: {selector!r}")
            chains[-1].append((sign, Step(piece.group(3))))
            sign = ""
        elif sign or not chains[-1]:
            raise ValueError(f"unsupported selector: {selector!r}")
        elif piece.group(1) == ",":
            chains.append([])
        else:
            sign = piece.group(1) or " "
    if sign or not all(chains):
        raise ValueError(f"unsupported selector: {selector!r}")
    return chains


class Matcher:
    """All selectors of a page reader."""

    def __init__(self, selectors: list[list[Chain]]):
        steps: dict[tuple, tuple[Step, int]] = {}
        self.first = self.below = self.within = self.last = 0  # bits that begin chains, that wait for a descendant or a child, that end chains
        self.ends: dict[int, int] = {}  # bit to selector
        bit = 0
        for number, chains in enumerate(selectors):
            for chain in chains:
                self.first |= 1 << bit
                for at, (_, step) in enumerate(chain):
                    known, bits = steps.get(step.key, (step, 0))
                    steps[step.key] = (known, bits | 1 << bit)
                    if at + 1 == len(chain):
                        self.last |= 1 << bit
                        self.ends[bit] = number
                    elif chain[at + 1][0] == ">":
                        self.within |= 1 << bit
                    else:
                        self.below |= 1 << bit
                    bit += 1
        self.steps: dict[tuple, list[tuple[Step, int]]] = {}
        for step, bits in steps.values():
            self.steps.setdefault(step.handle(), []).append((step, bits))
        # Lengths of the beginnings that are asked of an attribute, and the attributes any step asks for.
        self.beginnings: dict[str, list[int]] = {}
        for handle in self.steps:
            if handle[0] == "^=" and handle[2]:
                self.beginnings.setdefault(handle[1], []).append(len(handle[2]))
        self.beginnings = {name: sorted(set(n)) for name, n in self.beginnings.items()}

    def steps_met(self, tag: str, attributes: dict[str, str]) -> int:
        """Bits of the steps that an element meets by itself."""
        known, met = self.steps, 0
        classes = set(attributes["class"].split()) if "class" in attributes else set()
        handles = [("tag", tag), ("tag", "")]
        if attributes:
            handles += [("class", name) for name in classes]
            if "id" in attributes:
                handles.append(("id", attributes["id"]))
            for name, value in attributes.items():
                handles += [("=", name, value), ("attribute", name)]
                if name in self.beginnings:
                    handles += [("^=", name, value[:n]) for n in self.beginnings[name] if n <= len(value)]
        for handle in handles:
            for step, bits in known.get(handle, ()):
                if step.matches(tag, attributes, classes):
                    met |= bits
        return met

    def reached(self, met: int, above: int, parent: int) -> int:
        """Bits of the steps that an element completes chains up to."""
        return met & (self.first | (above & self.below) << 1 | (parent & self.within) << 1)

    def selected(self, here: int) -> list[int]:
        """Numbers of the selectors that end at an element."""
        found, ends = set(), here & self.last
        while ends:
            bit = ends.bit_length() - 1
            found.add(self.ends[bit])
            ends ^= 1 << bit
        return sorted(found)
