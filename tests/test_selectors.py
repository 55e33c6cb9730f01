"""The shared selector matcher against a plain one that tries every selector on every element."""

import random
import time

import pytest

from pageloom.config import MENU_SELECTORS
from pageloom.functions.markup import PageReader
from pageloom.functions.selectors import Matcher, compile_selector


def plain_matches(chain, element):
    """Whether ``element`` ends the chain, trying all ways to place its steps."""
    tag, attributes, parent = element
    sign, step = chain[-1]
    if not step.matches(tag, attributes, set(attributes.get("class", "").split())):
        return False
    if len(chain) == 1:
        return True
    above = parent
    while above is not None:
        if plain_matches(chain[:-1], above):
            return True
        if sign == ">":
            return False
        above = above[2]
    return False


def random_page(rng):
    """Markup with every element closed, and its elements with their parents."""
    elements, markup = [], []

    def grow(parent, depth):
        for _ in range(rng.randint(1, 4)):
            tag, attributes = rng.choice("abdp"), {}
            if rng.random() < 0.6:
                attributes["class"] = " ".join(rng.sample(["x", "y", "z", "a"], rng.randint(0, 3)))
            if rng.random() < 0.3:
                attributes["id"] = rng.choice("ij")
            if rng.random() < 0.3:
                attributes["data-k"] = rng.choice(["", "v", "vw"])
            if tag == "a":
                attributes["href"] = f"{rng.choice(['/', './', '#', ''])}{len(elements)}"
            element = (tag, attributes, parent)
            elements.append(element)
            markup.append(f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attributes.items())}>")
            if depth < 5:
                grow(element, depth + 1) if rng.random() < 0.7 else None
            markup.append(f"</{tag}>")

    grow(None, 0)
    return "".join(markup), elements


def random_selector(rng):
    def step():
        text = rng.choice(["", "", "a", "b", "p", "*"])
        text += rng.choice(["", "", ".x", ".y", ".x.z", "#i", "#j.x", "[data-k]", '[data-k="v"]', '[data-k^="v"]', "[href]", '[href^="/"]', '[href^=""]', ".a[data-k='vw']"])
        return text or "a"

    def chain():
        return rng.choice([" ", " > ", ">"]).join(step() for _ in range(rng.randint(1, 4)))

    return rng.choice([", ", ","]).join(chain() for _ in range(rng.choice([1, 1, 2, 3])))


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_plain_matcher(seed):
    rng = random.Random(seed)
    selectors = [random_selector(rng) for _ in range(80)]
    compiled = [compile_selector(s) for s in selectors]
    reader = PageReader(compiled, frozenset())
    for _ in range(12):
        html, elements = random_page(rng)
        expected = []
        for element in elements:
            hits = [i for i, chains in enumerate(compiled) if any(plain_matches(c, element) for c in chains)]
            if hits and "href" in element[1]:
                expected.append((element[1]["href"], hits))
        assert [(link["href"], link["matched"]) for link in reader.read(html)[3]] == expected


def test_new_grammar():
    html = '<div id="menu"><ul><li><a href="1">1</a></li></ul><a href="2" data-x>2</a></div><a href="3">3</a>'
    selectors = ("#menu > a", "#menu a, [data-x]", "div > ul > li > a", "ul > a", "*[href]", "a[href='3'], a[href='1']")
    links = PageReader([compile_selector(s) for s in selectors], frozenset()).read(html)[3]
    assert [link["matched"] for link in links] == [[1, 2, 4, 5], [0, 1, 4], [4, 5]]
    assert compile_selector("a[b=',>']")[0][0][1].tests == [("b", "=", ",>")]


def test_a_thousand_selectors_cost_little_more_than_nine():
    rng = random.Random(3)
    html = "".join(random_page(rng)[0] for _ in range(60)) * 3
    nine = [compile_selector(s) for s in MENU_SELECTORS]
    kinds = (".menu-{} a", "#part-{} > a", 'a[href^="/section/{}"]', "[data-n{}] a", 'nav[title="{}"] li a')
    many = nine + [compile_selector(kinds[i % 5].format(i)) for i in range(991)]

    def seconds(selectors):
        reader, best = PageReader(selectors, frozenset()), 9.0
        for _ in range(5):
            start = time.process_time()
            reader.read(html)
            best = min(best, time.process_time() - start)
        return best

    assert len(many) == 1000
    assert seconds(many) < 2 * seconds(nine)


def test_equal_steps_are_one():
    matcher = Matcher([compile_selector(f".m{i} a") for i in range(100)])
    assert sum(map(len, matcher.steps.values())) == 101
