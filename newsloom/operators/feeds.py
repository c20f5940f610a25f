"""RSS 2.0, Atom and RDF feeds: bytes in, one row an entry out.

Parsing is one Arrow stage; fingerprints, first-wins dedup and the projection to
raw documents are built-in expressions over its rows.
"""

from __future__ import annotations

from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from newsloom.functions.dates import read_feed_date
from newsloom.functions.text import stable_hash
from newsloom.functions.url import feed_url
from newsloom.plans.dedup import first_wins

RDF_ABOUT = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}about"
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"

ATTACHMENT = "struct<url:string,content_type:string,size_bytes:bigint,origin:string>"
ENTRY = (
    "source_id string, feed_url string, feed_title string, feed_language string, format string, position int, guid string, title string, link string, "
    f"summary string, content string, author string, categories array<string>, published_at timestamp, updated_at timestamp, attachments array<{ATTACHMENT}>, error string"
)


class FeedError(ValueError):
    """``code`` is rss_empty_feed, rss_invalid_xml, rss_unsupported_format or rss_invalid_feed."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _name(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _all(node, name: str) -> list:
    return [c for c in node if _name(c) == name] if node is not None else []


def _text(node) -> str | None:
    return ("".join(node.itertext()).strip() or None) if node is not None else None


def _get(node, *names: str) -> str | None:
    """Text of the first child of the first name that has any."""
    for name in names:
        for child in _all(node, name):
            if found := _text(child):
                return found
    return None


def _size(text: str | None) -> int | None:
    try:
        return int(text) if text else None
    except ValueError:
        return None


def _atom_link(node, base: str) -> str | None:
    links = _all(node, "link")
    chosen = next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0] if links else None)
    return urljoin(base, chosen.get("href")) if chosen is not None and chosen.get("href") else None


def _file(url, base, kind, size, origin) -> dict:
    return {"url": urljoin(base, url), "content_type": kind, "size_bytes": _size(size), "origin": origin}


def _rss_entry(item, base: str) -> dict:
    link = _get(item, "link", "guid")
    files = [_file(e.get("url"), base, e.get("type"), e.get("length"), "enclosure") for e in _all(item, "enclosure") if e.get("url")]
    files += [_file(m.get("url"), base, m.get("type") or m.get("medium"), m.get("fileSize"), "media:content") for m in _all(item, "content") if m.get("url")]
    return {
        "guid": _get(item, "guid"), "title": _get(item, "title"), "link": urljoin(base, link) if link else None, "summary": _get(item, "description"), "content": _get(item, "encoded"),
        "author": _get(item, "author", "creator"), "categories": [t for c in _all(item, "category") if (t := _text(c))],
        "published_at": read_feed_date(_get(item, "pubDate", "date")), "updated_at": read_feed_date(_get(item, "updated")), "attachments": files,
    }


def _atom_entry(entry, base: str) -> dict:
    link = _atom_link(entry, base) or _get(entry, "id")
    authors = _all(entry, "author")
    files = [_file(x.get("href"), base, x.get("type"), x.get("length"), "atom:link") for x in _all(entry, "link") if x.get("rel") == "enclosure" and x.get("href")]
    return {
        "guid": _get(entry, "id"), "title": _get(entry, "title"), "link": urljoin(base, link) if link else None, "summary": _get(entry, "summary"), "content": _get(entry, "content"),
        "author": (_get(authors[0], "name") or _text(authors[0])) if authors else None,
        "categories": [t for c in _all(entry, "category") if (t := c.get("term") or c.get("label"))],
        "published_at": read_feed_date(_get(entry, "published")), "updated_at": read_feed_date(_get(entry, "updated")), "attachments": files,
    }


def _rdf_entry(item, base: str) -> dict:
    link = _get(item, "link") or item.get(RDF_ABOUT)
    return {
        "guid": item.get(RDF_ABOUT), "title": _get(item, "title"), "link": urljoin(base, link) if link else None, "summary": _get(item, "description"), "content": _get(item, "encoded"),
        "author": _get(item, "creator"), "categories": [t for c in _all(item, "subject") if (t := _text(c))], "published_at": read_feed_date(_get(item, "date")), "updated_at": None, "attachments": [],
    }


def parse_feed(content: bytes, url: str) -> tuple[dict, list[dict]]:
    """(feed, entries); raises FeedError."""
    if not content or not content.strip():
        raise FeedError("rss_empty_feed")
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise FeedError("rss_invalid_xml") from e
    kind = _name(root)
    if kind == "rss":
        head = root.find("channel")
        if head is None:
            raise FeedError("rss_invalid_feed")
        base, form, items, read = _get(head, "link") or url, "rss2", head.findall("item"), _rss_entry
    elif kind == "feed":
        head, base, form, items, read = root, _atom_link(root, url) or url, "atom", _all(root, "entry"), _atom_entry
    elif kind == "RDF":
        head = next(iter(_all(root, "channel")), None)
        base, form, items, read = _get(head, "link") or url, "rdf", _all(root, "item"), _rdf_entry
    else:
        raise FeedError("rss_unsupported_format")
    language = root.get(XML_LANG) if form == "atom" else _get(head, "language")
    return {"feed_url": base, "feed_title": _get(head, "title"), "feed_language": language, "format": form}, [read(i, base) for i in items]


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Entries of feeds (source_id, url, content). A feed that fails gives one row with its error and no position."""
    shape = to_arrow_schema(_parse_datatype_string(ENTRY), timestamp_utc=True)

    def run(batches):
        for batch in batches:
            rows = []
            for source, url, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    feed, entries = parse_feed(bytes(content or b""), url or "")
                except FeedError as e:
                    rows.append({"source_id": source, "feed_url": url, "error": e.code})
                    continue
                rows += [{"source_id": source, **feed, "position": n, **entry} for n, entry in enumerate(entries)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return feeds.select(F.col("source_id").cast("string").alias("source_id"), "url", "content").mapInArrow(run, ENTRY)


def finalize(entries: DataFrame) -> DataFrame:
    """Adds canonical_url and fingerprints (map of the keys that are set)."""
    blank = F.lit("")
    canonical = F.when(F.coalesce("link", blank) != "", feed_url(F.col("link"))).otherwise(feed_url(F.coalesce("guid", blank)))
    body = F.coalesce(F.nullif("content", blank), F.nullif("summary", blank), F.nullif("title", blank))
    df = entries.withColumn("canonical_url", canonical)
    made = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("guid", "canonical_url", "title", "content")]),
        F.array(*[F.when(F.coalesce(c, blank) != "", stable_hash(c)) for c in (F.col("guid"), F.col("canonical_url"), F.col("title"), body)]),
    )
    df = df.withColumn("fingerprints", F.map_filter(made, lambda _, v: v.isNotNull()))
    link = F.coalesce(F.nullif("link", blank), F.nullif("canonical_url", blank), F.col("guid"), blank)
    return df.withColumn("link", link).withColumn("canonical_url", F.coalesce(F.nullif("canonical_url", blank), F.col("link")))


def entry_keys() -> list:
    return [F.try_element_at(F.col("fingerprints"), F.lit(k)) for k in ("guid", "canonical_url", "title", "content")]


def collect(feeds: DataFrame) -> DataFrame:
    """Distinct entries of every feed, first in document order wins, as raw documents."""
    entries = finalize(parse_feeds(feeds).where("error is null"))
    kept = first_wins(entries, entry_keys(), [F.col("position")], [F.col("source_id")])
    blank = F.lit("")
    raw = F.coalesce(F.nullif("content", blank), F.nullif("summary", blank), F.nullif("title", blank), blank)
    return kept.select(
        "source_id", "position", F.col("link").alias("original_url"), "canonical_url", "title", "author", F.col("published_at").alias("publication_date"), "updated_at",
        raw.alias("raw_content"), F.octet_length(raw).alias("size_bytes"), "categories", "attachments", "fingerprints", "guid", "format", "feed_language",
    )


def errors(feeds: DataFrame) -> DataFrame:
    """(source_id, feed_url, error) of feeds that do not parse."""
    return parse_feeds(feeds).where("error is not null").select("source_id", "feed_url", "error")
