"""Page reading, records and links."""

import pytest
from pyspark.sql import functions as F

from small_site import PAGES, SITE
from pageloom.config import MENU_SELECTORS, PAGE_DROP_TAGS, CrawlConfig, docs_config
from pageloom.functions import urls
from pageloom.functions.markup import PageReader, compile_selector
from pageloom.operators import extract as ex
from pageloom.operators import links as lk
from pageloom.operators.parse import parse_pages
from pageloom.sources.snapshots import PAGES_SCHEMA, is_retryable, page_lookup
from pageloom.streaming import link_stream, page_stream, record_stream


def read(html, selectors=MENU_SELECTORS, drop=PAGE_DROP_TAGS, **options):
    return PageReader([compile_selector(s) for s in selectors], frozenset(drop), **options).read(html)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>a<p>b</p>c", "abc"),
        ("a</div>b", "ab"),
        ("<div><b>x</div>y</b>z", "xyz"),
        ("<nav>in<div>side</nav>out", "out"),
        ("<!-- c --><!DOCTYPE html><?pi x>t", "t"),
        ("<script>if (a<b) '</p>'</script>t<style>p{}</style>", "t"),
        ("&lt;&amp;&eacute;&unknown; &#65;&#x42;&#150;&copy,", "<&é&unknown AB–©,"),
        ("&#xD800;&#99999999999;x", "��x"),
        ("<template>t</template><ruby>r<rt>u</rt></ruby>", "r"),
        ("a<br/>b<hr>c<div/>d", "abcd"),
        ("<![CDATA[x]]>y", "xy"),
        ("<iframe>i</iframe><footer>f<p>g</footer>h", "h"),
        ("", ""),
    ],
)
def test_text(html, text):
    assert read(html)[0] == text


def test_blank_pieces_may_be_collapsed():
    html = "<b>a</b>   <i>b</i> \n  <pre>  </pre>"
    assert read(html)[0] == "a   b \n    "
    assert read(html, collapse_blanks=True)[0] == "a b\n  "


def test_first_heading_and_title_outside_dropped_elements():
    html = "<title>T</title><nav><h1>no</h1></nav><h1>A<b>b</b></h1><h1>second</h1><svg><title>s</title></svg>"
    assert read(html)[1:3] == ("Ab", "T")
    assert read("<h1>never closed")[1:3] == ("never closed", None)


def test_selectors():
    html = (
        '<div class="x toc"><p><a href="1">1</a></p></div><a href="/2" class="toc">2</a>'
        '<nav role="navigation"><a href="3">3</a></nav><a href="../4">4</a><a>5</a><a href="./6?a&amp;b">6</a>'
    )
    links = read(html)[3]
    assert [(link["href"], link["in_dropped"]) for link in links] == [
        ("1", False), ("/2", False), ("3", True), ("../4", False), ("./6?a&b", False),
    ]
    assert [link["matched"] for link in links] == [[3], [6], [0], [8], [7]]
    nested = read('<i class="a"><b class="c"><a href="x">x</a></b></i>', (".a .c a", ".c .a a", "i.a b a"))[3]
    assert nested[0]["matched"] == [0, 2]


@pytest.mark.parametrize("selector", ["a >", "a:hover", "", "a,", "> a", "a > > b", "a ~ b", "a + b", "[x", "a[b~='c']", "#", "a,,b"])
def test_other_selectors_raise(selector):
    with pytest.raises(ValueError):
        compile_selector(selector)


def test_plain_profile_of_one_page(spark):
    html = (
        "<html><body><div class='content'><h1>Test Title</h1>\n<p>Test paragraph 1</p>\n"
        "<p>Test paragraph 2</p></div><script>x</script>\n<nav>n</nav></body></html>"
    )
    pages = spark.createDataFrame([(1, SITE, html), (2, "invalid-url", html)], PAGES_SCHEMA)
    rows = ex.plain_pages(pages).collect()
    assert [row["text"] for row in rows] == ["Test Title\nTest paragraph 1\nTest paragraph 2\nn", None]
    assert [row["error"] for row in rows] == [None, "Invalid URL provided"]


def test_rejected_pages_keep_their_row(spark):
    pages = spark.createDataFrame([(1, SITE + "a", "<p>x"), (2, SITE + "b", "<![bad[x]]>")], PAGES_SCHEMA)
    rows = ex.page_records(pages, docs_config()).orderBy("page_id").collect()
    assert [(row["text"], row["title"]) for row in rows] == [("x", "A"), (None, None)]
    assert rows[0]["error"] is None and rows[1]["error"].startswith("Page markup rejected: ")


def test_siblings_of_any_depth_are_ordered(spark):
    deep = [SITE + "/".join("x" * n) for n in (10_001, 10_007, 2)]
    rows = spark.createDataFrame([(u,) for u in deep], "url string").orderBy(urls.sort_key(F.col("url"))).collect()
    assert [row["url"] for row in rows] == [deep[1], deep[0], deep[2]]


def test_titles_fall_back_to_the_base_url(spark):
    pages = spark.createDataFrame(
        [(1, SITE + "first-steps", "<p>x"), (2, SITE + "x", "<h1> </h1><title> T </title>")], PAGES_SCHEMA
    )
    titles = ex.page_records(pages, docs_config()).orderBy("page_id").select("title").collect()
    assert [row["title"] for row in titles] == ["First Steps", "T"]
    fixed = ex.page_records(pages, docs_config(), F.lit("https://h/my-base"))
    assert fixed.orderBy("page_id").first()["title"] == "My Base"


def verdicts(pages, config, page):
    links = lk.link_rows(lk.with_page_links(parse_pages(pages, config), config))
    checked = lk.link_verdicts(links.where(F.col("src_url") == SITE + page), config, F.lit(SITE + "docs/"))
    return {row["url"].replace(SITE, ""): row["verdict"] for row in checked.collect()}


def test_fixture_verdicts(site_pages):
    expected = {
        "docs/api/ref": "keep",
        "docs/guide/": "keep",
        "docs/missing": "keep",
        "docs/search": "excluded",
        "https://other.example/docs/x": "domain",
        "docs/guide/#top": "fragment_query",
        "blog/": "prefix",
    }
    assert verdicts(site_pages, CrawlConfig(), "docs/") == expected
    assert verdicts(site_pages, CrawlConfig(links_from="raw"), "docs/") == {**expected, "docs/nav-only": "keep"}
    # Two priority links only, so the other selectors count too.
    assert verdicts(site_pages, CrawlConfig(), "docs/guide/") == {
        "docs/": "keep",
        "docs/guide/intro": "keep",
        "docs/api/ref": "keep",
        "docs/guide/intro?x=1": "fragment_query",
    }


def test_enough_priority_links_leave_the_others_out(spark):
    toc = "".join(f'<a href="/t{i}">t</a>' for i in range(5))
    html = f'<div class="toc">{toc}</div><a href="/other">o</a>'
    pages = spark.createDataFrame(
        [(1, SITE, html), (2, SITE + "b", html.replace("/t4", "/t3"))], PAGES_SCHEMA
    )
    config = CrawlConfig()
    rows = lk.with_page_links(parse_pages(pages, config), config).orderBy("page_id").collect()
    assert [len(row["priority_links"]) for row in rows] == [5, 4]
    assert [SITE + "other" in row["links"] for row in rows] == [False, True]


def test_settings():
    assert CrawlConfig(menu_selectors=None).menu_selectors == MENU_SELECTORS
    with pytest.raises(ValueError):
        CrawlConfig(prefix="host")
    with pytest.raises(ValueError):
        CrawlConfig(links_from="anywhere")


def test_lookup_and_status(spark):
    pages = spark.createDataFrame(
        [(1, SITE + "a", "x", 200), (2, SITE + "b", "x", 429), (3, SITE + "b", "x", 200)],
        "page_id long, url string, html string, status int",
    )
    requests = spark.createDataFrame([(SITE + "a",), (SITE + "b",), (SITE + "c",), ("nope",)], "url string")
    errors = {row["url"]: row["error"] for row in page_lookup(requests, pages, CrawlConfig()).collect()}
    assert errors == {
        SITE + "a": None,
        SITE + "b": "Failed to fetch URL (HTTP 429)",
        SITE + "c": "Failed to fetch URL: no page stored",
        "nope": "Invalid URL provided",
    }
    retry = pages.select("status", is_retryable(F.col("status")).alias("again")).distinct().collect()
    assert {tuple(row) for row in retry} == {(200, False), (429, True)}


def test_streams_give_what_batches_give(spark, site_pages, tmp_path):
    site_pages.repartition(3).write.parquet(str(tmp_path / "in"))
    config = CrawlConfig(links_from="raw")
    pages = page_stream(spark, str(tmp_path / "in"))
    batch = {
        "records": ex.page_records(site_pages, config),
        "links": lk.link_rows(lk.with_page_links(parse_pages(site_pages, config), config)),
    }
    streams = {"records": record_stream(pages, config), "links": link_stream(pages, config)}
    for name, stream in streams.items():
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c_{name}"))
        query = writer.trigger(availableNow=True).start(str(tmp_path / name))
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).select(*batch[name].columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, batch[name].collect()))
    assert len(PAGES) == batch["records"].count()
