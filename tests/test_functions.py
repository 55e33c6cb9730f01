"""Text and URL columns against plain readings of the same rules."""

import json
import random
from urllib.parse import urljoin, urlparse, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.operators.extract import slug_title

ALPHABET = "ab é\U0001f600ßA1-.'\"\\  \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　​"


# Line ends of the documented rule, then every character that counts as blank.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def clean(text):
    """Character scan: a phrase ends at a line end or at two spaces, and blanks at its ends go."""
    found, phrase, line_start = [], "", True
    at = 0
    while at < len(text):
        here = text[at]
        if here in LINE_ENDS:
            found.append(phrase)
            phrase, line_start = "", True
        elif here.isspace() and line_start:
            pass
        elif text.startswith("  ", at):
            found.append(phrase)
            phrase = ""
            at += 1
        else:
            phrase, line_start = phrase + here, False
        at += 1
    found.append(phrase)
    out = []
    for phrase in found:
        first = next((i for i, c in enumerate(phrase) if not c.isspace()), None)
        if first is not None:
            last = max(i for i, c in enumerate(phrase) if not c.isspace())
            out.append(phrase[first : last + 1])
    return "\n".join(out)


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(5000)]


def columns(spark, values, **exprs):
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    return frame.select("t", *[e.alias(n) for n, e in exprs.items()]).collect()


def test_text_columns(spark, strings):
    t = F.col("t")
    rows = columns(
        spark, strings, clean=tx.clean_text(t), strip=tx.strip(t), ascii=tx.ascii_only(t),
        title=tx.title_case(t), json=tx.json_string(t),
    )
    for row in rows:
        text = row["t"]
        assert row["clean"] == clean(text)
        assert row["strip"] == text.strip()
        assert row["ascii"] == text.encode("ascii", "replace").decode("ascii")
        assert row["title"] == text.title()
        assert row["json"] == json.dumps(text)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=40))
def test_clean_text_of_any_string(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    for row in columns(spark, texts, clean=tx.clean_text(F.col("t"))):
        assert row["clean"] == clean(row["t"])


def test_long_blank_runs_take_linear_time(spark):
    text = "a" + "\t" * 200_000 + "b" + " \t" * 200_000 + "\nc" + "\xa0" * 200_000
    assert columns(spark, [text], clean=tx.clean_text(F.col("t")))[0]["clean"] == clean(text)


PIECES = (
    "http:", "https:", "HTTP:", "mailto:a@b", "javascript:", "//", "h", "/", "a", "b.c", "..", ".", "./", "../",
    "?", "#", "q=1", ";", "x;p", "é", " ", "\t", "d.example", "/docs/", "ß", "%20", ":", "@", "-", "[::1]",
)
BASES = (
    "https://d.example/docs/", "http://h", "http://h/", "https://d.example/docs/a/b;x?q=1#f",
    "http://h/a//b/c", "http://h:80/a/../b", "https://H.ex/é/x", "http://h/a/;",
)


def joined(base, href):
    try:
        return urljoin(base, href)
    except ValueError:
        return "unjoinable"


def test_urls_against_the_standard_library(spark):
    rng = random.Random(11)
    cases = [
        (rng.choice(BASES), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))) for _ in range(6000)
    ]
    u = F.col("href")
    rows = (
        spark.createDataFrame(cases, "base string, href string")
        .select(
            "base", "href", urls.join_url(F.col("base"), u).alias("url"), urls.scheme(u), urls.netloc(u),
            urls.path(u), urls.query(u), urls.fragment(u), urls.is_valid_url(u).alias("valid"),
            urls.segment_count(u).alias("segments"),
        )
        .collect()
    )
    checked = 0
    for row in rows:
        expected = joined(row["base"], row["href"])
        if expected == "unjoinable":
            continue
        checked += 1
        assert row["url"] == expected, (row["base"], row["href"])
        parts = urlparse(row["href"])
        assert tuple(row[3:8]) == tuple(urlsplit(row["href"]))
        assert row["valid"] == all([parts.scheme, parts.netloc])
        assert row["segments"] == len(urlsplit(row["href"]).path.split("/"))
    assert checked > 4000


def test_unmatched_brackets(spark):
    row = spark.sql("SELECT 'http://h/' AS base, 'http://[::1/x' AS href").select(
        urls.join_url(F.col("base"), F.col("href")).alias("url"), urls.is_valid_url(F.col("href")).alias("valid")
    )
    assert tuple(row.first()) == (None, False)
    assert spark.sql("SELECT CAST(NULL AS string) AS u").select(urls.is_valid_url(F.col("u"))).first()[0] is False


def test_same_domain_shortcut_changes_nothing(spark):
    rng = random.Random(3)
    ends = ("", "/", "?q", "#f", ".evil", ":80", "\t/x", "@h", "/a")
    cases = [(f"https://d.ex{rng.choice(ends)}", rng.choice(("d.ex", "d.ex:80", ""))) for _ in range(300)]
    u, d = F.col("u"), F.col("d")
    rows = spark.createDataFrame(cases, "u string, d string").select(
        urls.same_domain(u, d).alias("plain"),
        urls.same_domain(u, d, F.concat(F.lit("https://"), d)).alias("quick"),
    )
    assert all(row["plain"] == row["quick"] for row in rows.collect())


def test_slug_title(spark):
    cases = {
        "https://h/docs/getting-started": "Getting Started",
        "https://h/docs/": "",
        "https://h": "",
        "https://h/a.b-it's;v=1": "A.B It'S",
    }
    rows = columns(spark, list(cases), title=slug_title(F.col("t")))
    assert {row["t"]: row["title"] for row in rows} == cases


def test_sort_key_orders_by_depth_then_url(spark):
    values = ["https://h/b", "https://h/a/b/c", "https://h/a", "https://h", "https://h/a/b/"]
    rows = columns(spark, values, key=urls.sort_key(F.col("t")))
    ordered = [row["t"] for row in sorted(rows, key=lambda row: row["key"])]
    assert ordered == sorted(values, key=lambda u: (-len(urlparse(u).path.split("/")), u))
