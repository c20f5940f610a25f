"""Operators over small fixed inputs, with the rows they must give as SQL values.

What SQL cannot compute (markup, feeds, scores of character runs) is worked out by
hand from the rules and stands here as expected values beside its input.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.config import DedupConfig, Taxonomy
from newsloom.functions import dates, similarity, text, url
from newsloom.operators import feeds, fetch
from newsloom.operators.html import extract_articles
from newsloom.operators.html.extract import run_strategies
from newsloom.plans import bloom, classify, dedup, rules, warehouse

from .registry import query

_SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def expected(schema: str, *rows: tuple) -> str:
    """SQL of fixed rows; a value that is a list of one text is an SQL expression."""

    def literal(v) -> str:
        if isinstance(v, list):
            return v[0]
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"

    fields = [x.split() for x in schema.split(", ")]
    made = ", ".join(f"CAST(c{k} AS {_SQL_TYPES[kind]}) AS {name}" for k, (name, kind) in enumerate(fields))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {made} FROM (VALUES {values}) AS v({', '.join(f'c{k}' for k in range(len(fields)))})"


def frame(load, rows: list[tuple], schema: str) -> DataFrame:
    return load("region").sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- pages

#: 20 words with one comma, 100 to 199 characters.
LINE = "The council met on Monday and approved the new bridge, the ring road and the park after a long debate."
_LD = {
    "@context": "https://schema.org",
    "@graph": [
        {"@type": "WebSite", "name": "w"},
        {
            "@type": ["NewsArticle"], "headline": "Bridge approved", "alternativeHeadline": "A long debate", "articleBody": " ".join([LINE] * 12),
            "author": [{"name": "A. Writer"}, "a. writer", {"name": "B. Second"}], "datePublished": "2024-03-01T10:00:00+02:00", "dateModified": "1709290800",
            "keywords": "bridge, town, Bridge", "articleSection": ["Local"], "image": {"url": "/i/one.png"}, "mainEntityOfPage": {"@id": "HTTPS://E.org/x/?utm_source=1&b=2"},
        },
    ],
}
_SOCIAL = (
    '<meta property="og:title" content="Social title"><meta property="og:description" content="Social text"><meta property="og:image" content="/og.png"><meta property="og:image:width" content="640">'
    '<meta property="og:url" content="https://e.org/four/?utm_medium=z"><meta property="article:published_time" content="2024-02-03T04:05:06Z"><meta property="article:section" content="World">'
    '<meta property="article:tag" content="a, b"><meta property="article:author" content="C. Third"><meta name="twitter:card" content="summary"><meta name="twitter:title" content="Bird">'
    '<meta name="description" content=" Described "><meta name="keywords" content="k1, k2,">'
)
PAGES = [
    (1, "https://e.org/x", f'<html lang="en"><head><title>T</title><script type="application/ld+json">{json.dumps(_LD)[:-1]},}}</script></head><body><nav>menu</nav><p>Short.</p></body></html>'),
    (2, "https://e.org/two", '<body><div class="sidebar">Sidebar words</div><div id="main-content">' + "".join(f"<p>{k} {LINE}</p>" for k in range(10)) + "</div></body>"),
    (3, "https://e.org/three", "<p>Some short text here, but not much.</p><p>Another line of it.</p><p>tiny</p>"),
    (4, "https://e.org/four", f'<html lang="de"><head><title>T</title>{_SOCIAL}</head><body><article><h1>Head</h1>' + "".join(f"<p>{k} {LINE}</p>" for k in range(3)) + "</article></body></html>"),
    (5, "https://e.org/five", "<html><body></body></html>"),
]
LONG = f"length('{LINE}')"


def _articles(load):
    return extract_articles(frame(load, PAGES, "page_id long, url string, html string"))


def _words(column: str):
    return F.array_join(column, "|")


@query(
    expected(
        "page_id long, title string, subtitle string, authors string, published_at timestamp, updated_at timestamp, language string, strategy_used string, confidence double, word_count int, reading_time_minutes double, paragraphs int, body_hash string",
        (1, "Bridge approved", "A long debate", "A. Writer|B. Second", "2024-03-01 08:00:00", "2024-03-01 11:00:00", "en", "json_ld", 1.0, 240, 1.1, 1, [f"sha256(rtrim(repeat('{LINE} ', 12)))"]),
        (2, None, None, "", None, None, None, "readability", 0.85, 210, 0.9, 10, [f"sha256(array_to_string(list_transform(range(10), lambda k: k || ' {LINE}'), chr(10) || chr(10)))"]),
        (3, None, None, "", None, None, None, "fallback", 0.05, 11, 0.0, 2, ["sha256('Some short text here, but not much.' || chr(10) || chr(10) || 'Another line of it.')"]),
        (4, "Head", None, "C. Third", "2024-02-03 04:05:06", None, "de", "dom_heuristic", 0.3, 64, 0.3, 4, [f"sha256('Head' || chr(10) || chr(10) || array_to_string(list_transform(range(3), lambda k: k || ' {LINE}'), chr(10) || chr(10)))"]),
        (5, None, None, "", None, None, None, "none", 0.0, 0, 0.0, 0, None),
    )
)
def html_article_fields(load):
    """Which strategy gives the body, what fills the gaps, and the finished texts."""
    return _articles(load).select(
        "page_id", "title", "subtitle", _words("authors").alias("authors"), "published_at", "updated_at", "language", "strategy_used", F.round("confidence", 6).alias("confidence"), "word_count", "reading_time_minutes",
        F.size("paragraphs").alias("paragraphs"), F.sha2("body_text", 256).alias("body_hash"),
    )


@query(
    expected(
        "page_id long, canonical_url string, categories string, tags string, images string, json_ld_blocks int, open_graph string, twitter_card string, meta_description string, meta_keywords string",
        (1, "https://e.org/x?b=2", "Local", "bridge|town", "https://e.org/i/one.png", 2, None, None, None, None),
        (2, None, "", "", None, None, None, None, None, None),
        (3, None, "", "", None, None, None, None, None, None),
        (
            4, "https://e.org/four", "World", "a|b", "https://e.org/og.png", None,
            "article:author=C. Third|article:published_time=2024-02-03T04:05:06Z|article:section=World|article:tag=a, b|description=Social text|image:width=640|image=/og.png|title=Social title|url=https://e.org/four/?utm_medium=z",
            "card=summary|title=Bird", "Described", "k1|k2",
        ),
        (5, None, "", "", None, None, None, None, None, None),
    )
)
def html_article_metadata(load):
    """JSON-LD, OpenGraph, Twitter and meta tags as they reach the article."""
    entries = lambda c: F.when(F.size(F.map_keys(c)) > 0, F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|"))
    return _articles(load).select(
        "page_id", "canonical_url", _words("categories").alias("categories"), _words("tags").alias("tags"), F.array_join(F.transform("images", lambda i: i["url"]), "|").alias("images"),
        F.when(F.size("json_ld") > 0, F.size("json_ld")).alias("json_ld_blocks"), entries("open_graph").alias("open_graph"), entries("twitter_card").alias("twitter_card"), "meta_description", _words("meta_keywords").alias("meta_keywords"),
    )


NO_TITLE, NO_AUTHOR, NO_DATE, NO_BODY = "Article has no title", "Article has no identified author", "Article has no published date", "Article body is missing or too short (<100 chars)"
STUB = "Article body is unusually short (<50 words) -- possible paywall stub"


@query(
    expected(
        "page_id long, missing_title boolean, missing_author boolean, missing_date boolean, missing_body boolean, content_length int, boilerplate_ratio double, quality_score double, warnings string",
        (1, False, False, False, False, [f"12 * {LONG} + 11"], 0.0, 1.0, ""),
        (2, True, True, True, False, [f"10 * ({LONG} + 2) + 18"], 0.0, 0.61, "; ".join((NO_TITLE, NO_AUTHOR, NO_DATE))),
        (3, True, True, True, True, 56, 0.0345, 0.08, "; ".join((NO_TITLE, NO_AUTHOR, NO_DATE, NO_BODY, STUB))),
        (4, False, False, False, False, [f"3 * ({LONG} + 2) + 10"], 0.0, 0.72, ""),
        (5, True, True, True, True, 0, 0.0, 0.06, "; ".join((NO_TITLE, NO_AUTHOR, NO_DATE, NO_BODY))),
    )
)
def html_article_quality(load):
    """Flags, boilerplate ratio, blended score and warnings."""
    return _articles(load).select(
        "page_id", "missing_title", "missing_author", "missing_date", "missing_body", "content_length", F.round("boilerplate_ratio", 4).alias("boilerplate_ratio"), F.round("quality_score", 4).alias("quality_score"), F.array_join("warnings", "; ").alias("warnings")
    )


@query(
    expected(
        "page_id long, strategy string, success boolean, confidence double, body_chars int",
        *[(1, n, ok, c, b) for n, ok, c, b in (("json_ld", True, 1.0, [f"12 * {LONG} + 11"]), ("open_graph", False, 0.0, 0), ("article_library", False, 0.0, 0), ("readability", False, 0.0, 0), ("dom_heuristic", False, 0.0, 0), ("fallback", True, 0.05, 0))],
        *[(2, n, ok, c, b) for n, ok, c, b in (("json_ld", False, 0.0, 0), ("open_graph", False, 0.0, 0), ("article_library", False, 0.0, 0), ("readability", True, 0.85, [f"10 * ({LONG} + 2) + 18"]), ("dom_heuristic", True, 0.4, [f"10 * ({LONG} + 2) + 18"]), ("fallback", True, 0.05, [f"10 * ({LONG} + 2) + 18"]))],
        *[(3, n, ok, c, b) for n, ok, c, b in (("json_ld", False, 0.0, 0), ("open_graph", False, 0.0, 0), ("article_library", False, 0.0, 0), ("readability", False, 0.0, 0), ("dom_heuristic", False, 0.0, 0), ("fallback", True, 0.05, 56))],
        *[(4, n, ok, c, b) for n, ok, c, b in (("json_ld", False, 0.0, 0), ("open_graph", True, 0.7, 0), ("article_library", False, 0.0, 0), ("dom_heuristic", True, 0.3, [f"3 * ({LONG} + 2) + 10"]), ("fallback", True, 0.05, [f"3 * ({LONG} + 2) + 4"]))],
        *[(5, n, False, 0.0, 0) for n in ("json_ld", "open_graph", "article_library", "readability", "dom_heuristic", "fallback")],
    )
)
def html_strategy_results(load):
    """Every strategy's own result: success, confidence and length of its body. Page 4's readability result is left to pytest."""
    made = run_strategies(frame(load, PAGES, "page_id long, url string, html string")).select("page_id", F.explode("results").alias("r"))
    made = made.where("not (page_id = 4 and r.strategy = 'readability')")
    return made.select("page_id", "r.strategy", "r.success", F.round("r.confidence", 6).alias("confidence"), F.coalesce(F.length("r.body_text"), F.lit(0)).alias("body_chars"))


BOILER = '<body><header>head</header><div class="top-nav nav">menu<p>inner</p></div><main><div role="x" id="cookie">c</div><p>kept one</p><aside>a</aside><p aria-hidden="true">hidden</p><form>f</form><p>kept two <svg>s</svg>end</p><blockquote><p>said</p></blockquote></main><div class="newsletter">n</div><footer>foot</footer></body>'


@query(expected("k int, cleaned string, blocks string", (1, "kept one|kept two|end|said", "kept one||kept two end||said||said")))
def html_boilerplate(load):
    """What marks go, with all below them, and the text of what stays: every block, a block within a block once more."""
    from newsloom.operators.html import clean
    from newsloom.operators.html.dom import parse

    root = parse(BOILER)
    clean.remove_boilerplate(root)
    return frame(load, [(1, root.text("|", strip=True), clean.fragment_text(root).replace("\n", "|"))], "k int, cleaned string, blocks string")


# ---------------------------------------------------------------- feeds and fetches

RSS = (
    '<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title><link>https://e.org/</link><language>en</language>'
    "<item><title>One  Title</title><link>/1?utm_source=a</link><guid>g1</guid><description>d</description><content:encoded>full text</content:encoded><author>A</author><category>c</category><category>d</category>"
    '<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><enclosure url="/a.mp3" type="audio/mpeg" length="12"/><media:content url="https://e.org/i.jpg" medium="image" fileSize="x"/></item>'
    "<item><title>Again</title><guid>g1</guid></item><item><title>No guid</title><link>/2</link><pubDate>bad</pubDate></item></channel></rss>"
)
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><title>A</title><link href="https://e.org/f"/><entry><id>i1</id><title>T</title><link rel="enclosure" href="/x.pdf" type="application/pdf" length="5"/><link href="/e1"/>'
    "<published>2024-01-02T00:00:00Z</published><updated>2024-01-02T05:04:05+02:00</updated><author><name>N</name></author><category term=\"t\"/><summary>s</summary></entry></feed>"
)
RDF = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title><link>https://e.org/</link></channel>'
    '<item rdf:about="https://e.org/r1"><title>T</title><dc:creator>C</dc:creator><dc:date>2024-01-02</dc:date><dc:subject>x</dc:subject></item></rdf:RDF>'
)
FEEDS = [("rss", "https://e.org/feed", RSS), ("atom", "https://e.org/feed", ATOM), ("rdf", "https://e.org/feed", RDF), ("empty", "u", " "), ("bad", "u", "<rss><channel>"), ("html", "u", "<html/>"), ("none", "u", None), ("bare", "u", "<rss></rss>")]


def _feeds(load):
    return frame(load, FEEDS, "source_id string, url string, x string").select("source_id", "url", F.encode("x", "UTF-8").alias("content"))


@query(
    expected(
        "source_id string, position int, guid string, title string, original_url string, canonical_url string, author string, publication_date timestamp, updated_at timestamp, raw_content string, size_bytes int, categories string, attachments string, format string, feed_language string",
        ("rss", 0, "g1", "One  Title", "https://e.org/1?utm_source=a", "https://e.org/1?utm_source=a", "A", "2024-01-02 03:04:05", None, "full text", 9, "c|d", "https://e.org/a.mp3 audio/mpeg 12 enclosure|https://e.org/i.jpg image - media:content", "rss2", "en"),
        ("rss", 2, None, "No guid", "https://e.org/2", "https://e.org/2", None, None, None, "No guid", 7, "", "", "rss2", "en"),
        ("atom", 0, "i1", "T", "https://e.org/e1", "https://e.org/e1", "N", "2024-01-02 00:00:00", "2024-01-02 03:04:05", "s", 1, "t", "https://e.org/x.pdf application/pdf 5 atom:link", "atom", "de"),
        ("rdf", 0, "https://e.org/r1", "T", "https://e.org/r1", "https://e.org/r1", "C", "2024-01-02 00:00:00", None, "T", 1, "x", "", "rdf", None),
    )
)
def feed_formats(load):
    """RSS, Atom and RDF entries as raw documents, with attachments; the second entry of a guid is dropped."""
    shown = lambda a: F.concat_ws(" ", a["url"], a["content_type"], F.coalesce(a["size_bytes"].cast("string"), F.lit("-")), a["origin"])
    made = feeds.collect(_feeds(load))
    return made.select(
        "source_id", "position", "guid", "title", "original_url", "canonical_url", "author", "publication_date", "updated_at", "raw_content", "size_bytes", _words("categories").alias("categories"), F.array_join(F.transform("attachments", shown), "|").alias("attachments"), "format", "feed_language"
    )


@query(
    expected(
        "source_id string, position int, key string, hash string",
        ("rss", 0, "guid", ["sha256('g1')"]), ("rss", 0, "canonical_url", ["sha256('https://e.org/1?utm_source=a')"]), ("rss", 0, "title", ["sha256('one title')"]), ("rss", 0, "content", ["sha256('full text')"]),
        ("rss", 2, "canonical_url", ["sha256('https://e.org/2')"]), ("rss", 2, "title", ["sha256('no guid')"]), ("rss", 2, "content", ["sha256('no guid')"]),
        ("atom", 0, "guid", ["sha256('i1')"]), ("atom", 0, "canonical_url", ["sha256('https://e.org/e1')"]), ("atom", 0, "title", ["sha256('t')"]), ("atom", 0, "content", ["sha256('s')"]),
        ("rdf", 0, "guid", ["sha256('https://e.org/r1')"]), ("rdf", 0, "canonical_url", ["sha256('https://e.org/r1')"]), ("rdf", 0, "title", ["sha256('t')"]), ("rdf", 0, "content", ["sha256('t')"]),
    )
)
def feed_fingerprints(load):
    made = feeds.collect(_feeds(load))
    return made.select("source_id", "position", F.explode("fingerprints").alias("key", "hash"))


@query(expected("source_id string, error string", ("empty", "rss_empty_feed"), ("none", "rss_empty_feed"), ("bad", "rss_invalid_xml"), ("html", "rss_unsupported_format"), ("bare", "rss_invalid_feed")))
def feed_errors(load):
    return feeds.errors(_feeds(load)).select("source_id", "error")


@query(
    expected(
        "requested_url string, url string, content_type string, declared_encoding string, content_length long, redirect_count int, server string, status int",
        ("u1", "https://E.org", "text/html", "utf-8", None, 1, "s", 200),
        ("u2", "http://e.org/a?a=1&b=2", "text/plain", None, 7, 2, None, 200),
        ("u3", "https://e.org/b", None, None, 3, 0, None, 404),
    )
)
def fetch_normalize(load):
    """Fetches as raw documents: URL form, declared charset, stated or counted length."""
    rows = [
        ("u1", "https://E.org:443/", 200, "abc", {"content-type": 'text/html; charset="utf-8"', "content-length": "x", "server": "s"}, ["a"]),
        ("u2", "http://e.org:80/a/?b=2&utm_term=q&a=1", 200, "abc", {"content-type": "text/plain", "content-length": "7"}, ["a", "b"]),
        ("u3", "https://e.org/b", 404, "abc", {}, []),
    ]
    made = frame(load, rows, "requested_url string, final_url string, status int, c string, headers map<string,string>, redirect_chain array<string>")
    made = made.select("*", F.encode("c", "UTF-8").alias("content"), F.lit(1.0).alias("elapsed_ms"), F.lit(False).alias("not_modified"), F.lit(None).cast("string").alias("filtered_reason"), F.lit(None).cast("string").alias("error"))
    return fetch.normalize_fetches(made).select("requested_url", "url", "content_type", "declared_encoding", "content_length", "redirect_count", "server", "status")


@query(expected("k int, text string", (1, "é"), (2, "é"), (3, "é"), (4, "x"), (5, "é"), (6, None)))
def byte_decode(load):
    """The given encoding, the content type's charset, UTF-8, Latin-1: whichever decodes first."""
    rows = [(1, "E9", None, None), (2, "C3A9", "", "text/html; charset=utf-8"), (3, "E9", "cp1252", None), (4, "78", "nope", None), (5, "E9", None, "text/html; charset=utf-8"), (6, None, None, None)]
    made = frame(load, rows, "k int, h string, e string, t string")
    return made.select("k", fetch.decode(F.unhex("h"), F.col("e"), F.col("t")).alias("text"))


@query(expected("k int, allowed boolean", (1, False), (2, True), (3, True), (4, True), (5, False), (6, True)))
def robots_rules(load):
    deny, own = "User-agent: *\nDisallow: /p", "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:"
    rows = [(1, deny, 200, "bot", "https://e.org/p/1"), (2, deny, 404, "bot", "https://e.org/p/1"), (3, None, 200, "bot", "https://e.org/p"), (4, deny, 200, "bot", "https://e.org/q"), (5, own, 200, "bot", "https://e.org/"), (6, own, 200, "other", "https://e.org/")]
    return frame(load, rows, "k int, r string, s int, a string, u string").select("k", fetch.robots_allowed("r", "s", "a", "u").alias("allowed"))


@query(expected("status int, outcome string, health string", (200, "ok", "healthy"), (304, "not_modified", "healthy"), (404, "failed", "failing"), (408, "retryable", "degraded"), (429, "retryable", "degraded"), (503, "retryable", "degraded")))
def feed_health(load):
    s = F.col("status")
    return frame(load, [(x,) for x in (200, 304, 404, 408, 429, 503)], "status int").select("status", fetch.feed_status(s).alias("outcome"), fetch.feed_health(s).alias("health"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS etag, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id END AS last_modified
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0) WHERE n = 1"""
)
def conditional_store(load):
    """The latest validators of every URL."""
    k = F.col("event_id")
    rows = load("events").select(F.col("user_id").cast("string").alias("url"), F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("etag"), F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("last_modified"), F.struct("ts", "event_id").alias("fetched_at"))
    return fetch.conditional_state(rows)


# ---------------------------------------------------------------- texts, dates, URLs

@query(
    expected(
        "k int, title string, content string, relevance string, tidy string",
        (1, "fish chips fine strasse ss", "fish & chips fine strasse ss", "fish & chips fine strasse ss", "Fish &amp; Chips ﬁne STRASSE ß"),
        (2, "big news today", '"big" news - today!', "“big” news — today!", "“Big” NEWS — Today!"),
        (3, "café fi", "café fi", "café fi", "Café ﬁ"),
        (4, "", "", "", None),
    )
)
def exact_text_forms(load):
    """The forms that unescape entities, compose characters and fold case in full."""
    rows = [(1, "Fish &amp; Chips ﬁne STRASSE ß"), (2, "  “Big”  NEWS — Today! "), (3, "Cafe\u0301 ﬁ"), (4, None)]
    t = F.col("t")
    return frame(load, rows, "k int, t string").select("k", text.fold_title(t, True).alias("title"), text.fold_content(t, exact=True).alias("content"), text.fold_text(t, True).alias("relevance"), text.tidy_whitespace(t, True).alias("tidy"))


@query(expected("k int, items string, paragraphs string, kept string, slug string", (1, "A|b", "x  y|z", "ab|cd", "a_big_name"), (2, "", "", "", "one")))
def list_forms(load):
    """Distinct items in order, distinct paragraphs, short ones dropped, slugs."""
    rows = [(1, ["A ", "b", "a", " ", None, "B"], ["x  y", "X y", "", "z"], ["ab", " c ", "cd"], "A Big Name"), (2, [], [], [], "one")]
    made = frame(load, rows, "k int, a array<string>, p array<string>, s array<string>, n string")
    return made.select("k", _words(text.distinct_in_order(F.col("a"))).alias("items"), _words(text.distinct_paragraphs(F.col("p"))).alias("paragraphs"), _words(text.non_empty(F.col("s"), 2)).alias("kept"), text.slug(F.col("n")).alias("slug"))


@query(
    expected(
        "a string, b string, sequence double, tokens double, hybrid double",
        ("abcd", "bcde", 0.75, 0.0, 0.3375), ("a b", "a b", 1.0, 1.0, 1.0), ("", "x", 0.0, 0.0, 0.0), ("night", "nacht", 0.6, 0.0, 0.27),
        ("one two three five", "one two three four", 0.833333, 0.6, 0.705),
    )
)
def similarity_values(load):
    """Ratcliff-Obershelp by hand: twice the matching characters over all."""
    rows = [("abcd", "bcde"), ("a b", "a b"), ("", "x"), ("night", "nacht"), ("one two three five", "one two three four")]
    a, b = F.col("a"), F.col("b")
    return frame(load, rows, "a string, b string").select("a", "b", F.round(similarity.sequence_ratio(a, b), 6).alias("sequence"), F.round(similarity.token_jaccard(a, b), 6).alias("tokens"), F.round(similarity.hybrid(a, b), 6).alias("hybrid"))


@query(
    expected(
        "k int, article timestamp, feed timestamp",
        (1, "2024-01-02 03:04:05", None), (2, "2024-01-02 03:04:05", None), (3, "2024-01-02 03:04:05", None), (4, None, "2024-01-02 03:04:05"), (5, None, "2024-01-02 03:04:05"),
        (6, "2024-01-02 03:04:05", "2024-01-02 03:04:05"), (7, None, None), (8, None, None), (9, "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
    )
)
def date_forms(load):
    rows = [(1, "1704164645"), (2, "1704164645000"), (3, "January 2, 2024 03:04:05"), (4, "Tue, 02 Jan 2024 03:04:05 GMT"), (5, "Tue, 02 Jan 2024 05:04:05 +0200"), (6, "2024-01-02T05:04:05+02:00"), (7, "not a date"), (8, None), (9, "2024-01-02")]
    made = frame(load, rows, "k int, t string")
    free = F.when(F.col("k") == 3, dates.parse_article_date(F.col("t"), free_form=True)).otherwise(dates.parse_article_date(F.col("t")))
    return made.select("k", free.alias("article"), dates.parse_feed_date(F.col("t")).alias("feed"))


@query(expected("k int, seconds double", (1, 1.0), (2, 2.0), (3, 4.0), (4, 8.0)))
def backoff_series(load):
    return frame(load, [(k,) for k in (1, 2, 3, 4)], "k int").select("k", dates.backoff_seconds(F.col("k"), 1.0, 2.0).alias("seconds"))


@query(expected("cron string, next_run timestamp", ("*/15 8-10 * * 1-5", "2024-01-08 08:00:00"), ("0 0 1 * *", "2024-02-01 00:00:00"), ("30 12 * * 0", "2024-01-07 12:30:00"), ("0 0 31 2 *", None)))
def cron_next_run(load):
    after = datetime(2024, 1, 5, 10, 50)
    return frame(load, [(c, dates.next_run(c, after)) for c in ("*/15 8-10 * * 1-5", "0 0 1 * *", "30 12 * * 0", "0 0 31 2 *")], "cron string, next_run timestamp")


@query(
    expected(
        "k int, media string, article string, identity string",
        (1, "https://ex.org/i.png?w=8&utm_term=1", "https://ex.org/i.png?w=8", "/i.png?w=8&utm_term=1"),
        (2, "https://ex.org/a/c", "https://ex.org/a/c", "../c"),
        (3, "https://Cdn.org/x;p=1?b=%20c", "https://cdn.org/x;p=1?b=+c", "https://cdn.org/x?b=+c"),
        (4, None, None, None),
    )
)
def relative_urls(load):
    """Media URLs keep all they have; article URLs lose tracking; the identity form drops path parameters and takes no base."""
    rows = [(1, "/i.png?w=8&utm_term=1"), (2, "../c"), (3, "https://Cdn.org/x;p=1?b=%20c"), (4, " ")]
    made, base = frame(load, rows, "k int, u string").withColumn("base", F.lit("https://ex.org/a/b/")), F.col("base")
    return made.select("k", url.media_url(F.col("u"), base).alias("media"), url.article_url(F.col("u"), base).alias("article"), url.identity_url(F.col("u")).alias("identity"))


# ---------------------------------------------------------------- duplicates and models

NEAR_A, NEAR_B = "aa bb cc dd ee ff gg hh ii jj", "aa bb cc dd ee ff gg hh ii kk"


@query(
    expected(
        "document_id string, status string, matched_id string, confidence double, strategy string, reasons string",
        ("d0", "new_document", None, 0.0, None, "no duplicate candidate exceeded configured thresholds"),
        ("d1", "possible_duplicate", "d0", 0.7489, "similarity_scoring", "publication times were within configured proximity window"),
        ("d2", "new_document", None, 0.0, None, "no duplicate candidate exceeded configured thresholds"),
        ("d3", "near_duplicate", "d2", 0.801, "similarity_scoring", "normalized title similarity exceeded threshold; cleaned content similarity exceeded threshold; publication times were within configured proximity window; match came from a different source"),
        ("d4", "exact_duplicate", "d2", 0.98, "content_fingerprint", "content fingerprint matched exactly"),
        ("d5", "near_duplicate", "d2", 0.94, "content_fingerprint", "content fingerprint matched exactly across different sources"),
        ("d6", "exact_duplicate", "d0", 0.99, "guid", "GUID matched an existing document"),
        ("d7", "exact_duplicate", "d6", 1.0, "canonical_url", "canonical URL matched an existing document"),
    )
)
def duplicate_verdicts(load):
    """Scores by hand from the shares: .12 title, .58 content, .12 time, .08 source, .10 fingerprint, and the bonus or penalty of the source."""
    rows = [
        ("d0", 0, "https://e.org/0", "abcd", "one two three four", "s1", "g0"), ("d1", 1, "https://e.org/1", "bcde", "one two three five", "s1", None),
        ("d2", 2, "https://e.org/2", "wxyz", NEAR_A, "s1", None), ("d3", 3, "https://e.org/3", "wxyz", NEAR_B, "s2", None), ("d4", 4, "https://e.org/4", "q", NEAR_A.upper(), "s1", None),
        ("d5", 5, "https://e.org/5", "r", NEAR_A, "s3", None), ("d6", 6, "https://e.org/6?utm_source=a", "s", "other words", "s4", "g0"), ("d7", 7, "https://E.org/6/", "t", "more of them", "s5", None),
    ]
    made = frame(load, rows, "document_id string, seq long, url string, title string, body_text string, source_id string, guid string").withColumn("published_at", F.to_timestamp(F.lit("2024-05-01 08:00:00")))
    found = dedup.analyze(made, DedupConfig(), exact_text=True)
    return found.select("document_id", "status", "matched_id", F.round("confidence", 6).alias("confidence"), "strategy", F.array_join("reasons", "; ").alias("reasons"))


@query(
    expected(
        "k int, guid string, source string, url string",
        (1, "m1", "s one", "https://e.org/c"), (2, "f2", "meta source", "https://e.org/u"), (3, "https://e.org/id", None, None), (4, "urn:main", None, None), (5, None, None, None),
    )
)
def identity_keys(load):
    """GUID from metadata, fields, JSON-LD; source from fields, metadata; canonical URL before URL."""
    rows = [
        (1, {"guid": "m1"}, "f1", "S  One", "https://E.org/c?utm_term=1", "https://e.org/u", None), (2, {"publisher": "Meta Source"}, "f2", None, None, "https://e.org/u/", None),
        (3, {}, None, None, None, None, ['{"a":1}', '{"@id":"https://e.org/id"}']), (4, None, None, None, None, None, ['{"mainEntityOfPage":"urn:main"}']), (5, None, None, None, None, None, None),
    ]
    made = frame(load, rows, "k int, metadata map<string,string>, guid string, source_id string, canonical_url string, url string, json_ld array<string>")
    kept = dedup.fingerprints(made)
    return kept.select("k", F.col("k_guid").alias("guid"), F.col("k_source").alias("source"), F.col("k_url").alias("url"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM documents WHERE length(text) < 600), s AS (SELECT doc_id, k, unnest(range(4)) AS seed FROM t)
SELECT doc_id, CAST(seed AS INTEGER) AS seed, list_min(list_transform(k, lambda x: CAST('0x' || substr(sha256(seed || ':' || x), 1, 15) AS BIGINT))) AS least FROM s WHERE len(k) > 0"""
)
def minhash_signature(load):
    toks = text.tokens(F.lower("text"))
    rows = load("documents").where(F.length("text") < 600).select("doc_id", text.minhash(toks, 4).alias("m")).where("m is not null")
    return rows.select("doc_id", F.posexplode("m").alias("seed", "least"))


@query(
    """WITH t AS (SELECT doc_id, list_transform(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x: CAST('0x' || substr(sha256(x), 1, 15) AS BIGINT)) AS h FROM documents WHERE length(text) < 600)
SELECT doc_id, CAST(list_sum(list_transform(range(12), lambda b: CASE WHEN 2 * len(list_filter(h, lambda x: (x >> b) & 1 = 1)) > len(h) THEN 1 << b ELSE 0 END)) AS BIGINT) AS bits FROM t"""
)
def simhash_signature(load):
    """The library's own short fingerprint, by the lowest 12 bits of the words' hashes."""
    return load("documents").where(F.length("text") < 600).select("doc_id", text.simhash(text.tokens(F.lower("text")), 12).alias("bits"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def bloom_precheck(load):
    """Rows that may be known by the filter, then by the exact look-up: the filter never drops one that is."""
    known = load("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    n = bloom.buckets_for(10_000)
    may = bloom.may_hold(load("orders"), "o_custkey", bloom.build(known, "o_custkey", n), n)
    return may.join(known, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(
    expected(
        "article_id int, status string, model string, retries long, calls long, failures string, error string, input_tokens long, latency_ms double",
        (1, "classified", "auto", 0, 1, "", None, 10, 1.5),
        (2, "classified", "auto", 1, 2, "invalid JSON", None, 30, 4.0),
        (3, "failed", "spare", 2, 4, "", "timeout", 0, 0.0),
        (4, "failed", None, 0, 0, None, "no response", 0, 0.0),
    )
)
def replay_observability(load):
    """Calls, retries, faults, tokens and latency of recorded model calls."""
    from newsloom.config import ClassificationConfig

    good = '{"theme":[],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":0.9}'
    rows = [(1, "auto", 0, good, None, 10, 1.5), (1, "auto", 1, good, None, 99, 9.0), (2, "auto", 0, "{", None, 10, 1.5), (2, "auto", 1, good, None, 20, 2.5)] + [(3, m, k, None, "timeout", None, None) for m in ("auto", "spare") for k in (0, 1)]
    made = frame(load, rows, "article_id int, model string, attempt int, content string, error_code string, input_tokens long, latency_ms double")
    out = classify.replay(frame(load, [(k,) for k in (1, 2, 3, 4)], "article_id int"), made, ClassificationConfig(fallback_models=["spare"], max_retries=1), Taxonomy())
    return out.select("article_id", "status", "model", F.col("retries").cast("long").alias("retries"), F.col("calls").cast("long").alias("calls"), F.array_join("validation_failures", "; ").alias("failures"), "error", "input_tokens", "latency_ms")


MODES = (("any", ["bridge", "river"], [], None), ("all", ["bridge", "river"], [], None), ("any", ["bridge"], ["toll"], None), ("boolean", [], ["toll"], '"river bank" OR (bridge AND NOT toll)'), ("any", [], [], None))


@query(
    expected(
        "k int, any_of boolean, all_of boolean, excluding boolean, by_query boolean, no_terms boolean",
        (1, True, True, True, True, True), (2, True, False, False, False, True), (3, False, False, False, False, True), (4, True, False, False, True, True), (5, False, False, False, False, True),
    )
)
def source_keyword_modes(load):
    rows = [(1, "The Bridge over the river"), (2, "A bridge and its toll"), (3, "Abridged text"), (4, "On the river  bank"), (5, None)]
    f = text.fold_text(F.col("t"))
    tests = [rules.source_keywords(f, terms, out, mode, q).alias(n) for n, (mode, terms, out, q) in zip(("any_of", "all_of", "excluding", "by_query", "no_terms"), MODES)]
    return frame(load, rows, "k int, t string").select("k", *tests)


CHECKS = (("a AND (b OR c)", None), ("(a", "unbalanced parentheses"), ("a)", "invalid parentheses"), ("AND a", "operator without left operand"), ("a OR", "query cannot end with an operator"), ("a NOT b", None), ("()", "invalid parentheses"), ("", None))


@query(expected("query string, fault string", *CHECKS))
def boolean_query_check(load):
    return frame(load, [(q, rules.check_query(q)) for q, _ in CHECKS], "query string, fault string")


@query(
    expected(
        "k int, keyword_group string, term string, start int, finish int",
        (1, "g", "bridge", 4, 10), (1, "g", "bridge", 19, 25), (1, "g", "riv", 30, 33), (2, "g", "riv", 0, 3), (2, "h", "ro[a-z]d", 6, 10),
    )
)
def keyword_offsets(load):
    rows = [(1, "The bridge is the (bridge) at riverside; abridged"), (2, "River road"), (3, None), (4, "bridge banned")]
    words = frame(load, [("g", "bridge", "exact", False), ("g", "riv", "stem", False), ("h", "ro[a-z]d", "regex", False), ("g", "banned", "exact", True)], "`group` string, term string, match_type string, negative boolean")
    found = warehouse.keyword_offsets(frame(load, rows, "k int, t string"), words, "k", "t")
    return found.select("k", F.col("group").alias("keyword_group"), "term", "start", F.col("end").alias("finish"))
