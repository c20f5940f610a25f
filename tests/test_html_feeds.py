import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import feeds, fetch
from newsloom.operators.html import extract_articles
from newsloom.operators.html.dom import parse
from newsloom.operators.html.strategies import default_registry, run_page

PARA = "<p>The council met on Monday, and after a long debate it approved the bridge, the road and the new park for all residents of the town.</p>"
LD = {"@context": "x", "@graph": [{"@type": "WebSite"}, {"@type": ["NewsArticle"], "headline": "Bridge approved", "articleBody": "The council met. " * 20, "author": [{"name": "A. Writer"}, "a. writer"], "datePublished": "2024-03-01T10:00:00+02:00", "keywords": "bridge, town", "mainEntityOfPage": {"@id": "https://e.org/x/?utm_source=1"}}]}
ARTICLE = f"""<html lang="en"><head><title>T</title><meta property="og:title" content="OG"><meta property="og:image" content="/i.png"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{json.dumps(LD)[:-1]},}}</script></head><body><nav>menu words</nav><div class="cookie-banner cookie">We use cookies</div><article><h1>Head</h1>{PARA * 3}</article></body></html>"""


def extract(spark, html, url="https://e.org/x"):
    return extract_articles(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")).first()


def test_json_ld_wins_and_gaps_are_filled(spark):
    r = extract(spark, ARTICLE)
    assert (r.strategy_used, r.title, r.authors, r.tags) == ("json_ld", "Bridge approved", ["A. Writer"], ["bridge", "town"])
    assert r.canonical_url == "https://e.org/x" and r.published_at.isoformat() == "2024-03-01T08:00:00" and r.language == "en"
    assert r.images[0].url == "https://e.org/i.png" and r.open_graph["title"] == "OG" and r.twitter_card == {"card": "summary"}
    assert "cookies" not in r.body_text and r.quality_score > 0.7 and r.strategies_attempted[0] == "json_ld" and len(r.strategies_attempted) == 6


def test_boilerplate_goes_and_containers_are_found(spark):
    r = extract(spark, f'<body><div class="sidebar">Sidebar text</div><div id="main-content">{PARA}{PARA.replace("Monday", "Friday")}{PARA.replace("Monday", "Sunday")}<table><tr><td>cell</td></tr></table></div></body>')
    assert "Sidebar" not in r.body_text and "council" in r.body_text and r.open_graph is None and r.json_ld is None
    assert len(r.paragraphs) >= 3 and not r.missing_body


def test_missing_metadata_flags(spark):
    r = extract(spark, "<p>Some short text here, but not much.</p><p>Another line of it.</p><p>tiny</p>")
    assert r.missing_title and r.missing_author and r.missing_date and r.strategy_used == "fallback" and r.body_text.count("\n\n") == 1
    assert "Article has no title" in r.warnings and any("unusually short" in w for w in r.warnings)


@pytest.mark.parametrize("html", ["", None, "<html><body></body></html>", "<p>unclosed <b>bold<div><h1 id=x>head</h1", "<![CDATA[x]]><!-- c", "\x00<p>퟿"])
def test_odd_pages_do_not_fail(spark, html):
    r = extract(spark, html)
    assert r.word_count >= 0 and r.strategy_used in ("fallback", "none", "readability", "dom_heuristic")


def test_tree():
    root = parse("<p>a<p>b<ul><li>1<li>2</ul><script>var t='</p>'</script><br>c</b>")
    assert [p.text() for p in root.all("p")] == ["a", "b"] and [x.text() for x in root.all("li")] == ["1", "2"] and root.text(strip=True) == "ab12c"


def test_custom_and_failing_strategies():
    registry = default_registry()
    registry.register("own", lambda page: {"success": True, "confidence": 1.0, "title": "mine"}, position=0)
    registry.register("bad", lambda page: 1 / 0)
    results, _ = run_page("<p>x</p>", "u", registry.build())
    assert results[0]["title"] == "mine" and results[-1]["error"].startswith("ZeroDivisionError")


RSS = b"""<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title><link>https://e.org/</link><language>en</language>
<item><title>One</title><link>/1?utm_source=a</link><guid>g1</guid><description>d</description><content:encoded>full</content:encoded><author>A</author><category>c</category><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><enclosure url="/a.mp3" type="audio/mpeg" length="12"/><media:content url="https://e.org/i.jpg" medium="image" fileSize="x"/></item>
<item><title>Again</title><guid>g1</guid></item><item><title>No guid</title><link>/2</link><pubDate>bad</pubDate></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><title>A</title><link href="https://e.org/f"/><entry><id>i1</id><title>T</title><link rel="enclosure" href="/x.pdf" length="5"/><link href="/e1"/><updated>2024-01-02T05:04:05+02:00</updated><author><name>N</name></author><category term="t"/></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title><link>https://e.org/</link></channel><item rdf:about="https://e.org/r1"><title>T</title><dc:creator>C</dc:creator><dc:date>2024-01-02</dc:date></item></rdf:RDF>"""


def test_feeds(spark):
    rows = [("rss", "https://e.org/feed", RSS), ("atom", "https://e.org/feed", ATOM), ("rdf", "https://e.org/feed", RDF), ("empty", "u", b" "), ("bad", "u", b"<rss><channel>"), ("html", "u", b"<html/>"), ("none", "u", None)]
    df = spark.createDataFrame(rows, "source_id string, url string, content binary")
    got = {}
    for r in feeds.collect(df).orderBy("position").collect():
        got.setdefault(r.source_id, []).append(r)
    one, two = got["rss"]
    assert (one.title, one.raw_content, one.canonical_url, one.size_bytes) == ("One", "full", "https://e.org/1?utm_source=a", 4)
    assert [(a.url, a.content_type, a.size_bytes) for a in one.attachments] == [("https://e.org/a.mp3", "audio/mpeg", 12), ("https://e.org/i.jpg", "image", None)]
    assert two.title == "No guid" and two.publication_date is None and set(two.fingerprints) == {"canonical_url", "title", "content"}
    assert got["atom"][0].original_url == "https://e.org/e1" and got["atom"][0].updated_at.hour == 3 and got["atom"][0].feed_language == "de"
    assert got["rdf"][0].guid == "https://e.org/r1" and got["rdf"][0].author == "C"
    assert {r.source_id: r.error for r in feeds.errors(df).collect()} == {"empty": "rss_empty_feed", "none": "rss_empty_feed", "bad": "rss_invalid_xml", "html": "rss_unsupported_format"}


def test_decode_robots_and_status(spark):
    df = spark.createDataFrame([("é".encode("latin-1"), None, None), ("é".encode(), "", "text/html; charset=utf-8"), ("é".encode("cp1252"), "cp1252", None), (b"x", "nope", None)], "c binary, e string, t string")
    assert [r[0] for r in df.select(fetch.decode(F.col("c"), F.col("e"), F.col("t"))).collect()] == ["é", "é", "é", "x"]
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /p", 200, "b", "https://e.org/p/1"), ("User-agent: *\nDisallow: /p", 404, "b", "https://e.org/p/1"), (None, 200, "b", "https://e.org/p")], "r string, s int, a string, u string")
    assert [r[0] for r in robots.select(fetch.robots_allowed("r", "s", "a", "u")).collect()] == [False, True, True]
    codes = spark.createDataFrame([(200,), (304,), (404,), (429,), (503,)], "s int")
    assert [r[0] for r in codes.select(fetch.feed_health(F.col("s"))).collect()] == ["healthy", "healthy", "failing", "degraded", "degraded"]


def test_normalized_fetches(spark):
    df = spark.createDataFrame([("u", "https://E.org:443/", 200, b"abc", {"content-type": 'text/html; charset="utf-8"', "content-length": "x"}, 1.0, ["a"], False, None, None)], "requested_url string, final_url string, status int, content binary, headers map<string,string>, elapsed_ms double, redirect_chain array<string>, not_modified boolean, filtered_reason string, error string")
    r = fetch.normalize_fetches(df).first()
    assert (r.url, r.content_type, r.declared_encoding, r.content_length, r.redirect_count) == ("https://E.org", "text/html", "utf-8", None, 1)


def test_collector_registry():
    made = fetch.CollectorRegistry()
    made.register(" RSS ", 1)
    assert made.get("rss") == 1 and made.keys() == ["rss"]
    with pytest.raises(ValueError):
        made.register("rss", 2)
    made.unregister("rss")
    with pytest.raises(LookupError):
        made.get("rss")


def test_results_of_few_pages_are_held_at_once(spark, monkeypatch):
    from newsloom.operators.html import extract

    runs = []

    class Frame:
        schema = spark.createDataFrame([], "page_id long, url string, html string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, shape):
            runs.append(run)

    import pyarrow as pa

    extract.run_strategies(Frame())
    pages = [None, "", *["<h1>t</h1><p>" + "word " * 20 + "</p>"] * 148]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(["http://e.org/"] * 150), pa.array(pages)], names=["page_id", "url", "html"])
    sizes = [x.num_rows for x in runs[0](iter([batch]))]
    assert sum(sizes) == 150 and max(sizes) <= 64
    monkeypatch.setattr(extract, "SLICE", 1)
    out = list(runs[0](iter([batch])))
    assert sum((x.column(0).to_pylist() for x in out), []) == list(range(150)) and max(x.num_rows for x in out[1:]) == 1
