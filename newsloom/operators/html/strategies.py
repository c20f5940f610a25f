"""Extraction strategies: each reads a parsed page and gives fields, success and a confidence.

Registered strategies run in order; one that raises gives a failed result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import urljoin

from . import clean
from .dom import Node

#: JSON-LD types that are articles; hints of readability scoring; hints of content containers.
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting", "Report", "AnalysisNewsArticle", "ReviewNewsArticle", "OpinionNewsArticle")
POSITIVE = re.compile("article|body|content|entry|main|page|post|text|blog|story", re.I)
NEGATIVE = re.compile("comment|combx|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter|share|related|widget", re.I)
CONTAINER_HINTS = (
    "article-body", "article-content", "post-content", "entry-content", "story-body", "story-content", "content-body",
    "page-content", "main-content", "articleBody", "post-body", "blog-post", "single-content",
)
SCORED = ("p", "div", "section", "article", "td", "pre")

_WORDS = re.compile(r"\w+")


class Page:
    """A page parsed once; ``cleaned`` removes boilerplate in place, so raw facts are read before."""

    def __init__(self, html: str, url: str):
        from .dom import parse

        self.url, self.root = url, parse(html)
        self.metas = [n.attrs for n in self.root.walk() if n.name == "meta"]
        self.blocks = json_ld(self.root)
        self.text_length = len(self.root.text(strip=True))
        self.language = self._language()
        self.description = next((m["content"].strip() for m in self.metas if m.get("name") == "description" and m.get("content")), None)
        words = next((m["content"] for m in self.metas if m.get("name") == "keywords" and m.get("content")), "")
        self.keywords = [w.strip() for w in words.split(",") if w.strip()]
        self._clean, self._measures = False, None

    def _language(self) -> str | None:
        top = self.root.first("html")
        found = [top.get("lang") if top else None]
        found += [m.get("content") for m in self.metas if "content-language" in (m.get("http-equiv") or "").lower()][:1]
        found += [m.get("content") for m in self.metas if m.get("property") == "og:locale"][:1]
        return next((f.strip() for f in found if f), None)

    def social(self, prefix: str, *keep: str) -> dict[str, str]:
        """Meta tags of a namespace by what follows the prefix (those of ``keep`` by their whole name); the first of a name counts."""
        found: dict[str, str] = {}
        for m in self.metas:
            order = ("name", "property") if prefix == "twitter:" else ("property", "name")
            name = m.get(order[0]) or m.get(order[1]) or ""
            if m.get("content") is None:
                continue
            if name.lower().startswith(prefix):
                found.setdefault(name[len(prefix) :].strip(), m["content"].strip())
            elif any(name.lower().startswith(k) for k in keep):
                found.setdefault(name.strip(), m["content"].strip())
        return found

    def canonical_link(self) -> str | None:
        """Of a link element; no strategy uses it."""
        return next((n.get("href").strip() for n in self.root.all("link") if "canonical" in (n.get("rel") or "").split() and n.get("href")), None)

    def cleaned(self) -> Node:
        if not self._clean:
            clean.remove_boilerplate(self.root)
            self._clean = True
        return self.root

    def measured(self) -> dict:
        """Measures of the cleaned tree."""
        if self._measures is None:
            self._measures = self.cleaned().measures()
        return self._measures

    def media(self, url: str | None) -> str | None:
        url = (url or "").strip()
        try:
            return urljoin(self.url or "", url) if url else None
        except ValueError:
            return url


def json_ld(root: Node) -> list[dict]:
    """Objects of all JSON-LD scripts, @graph opened up; a trailing comma is forgiven, other faults skip the script."""
    found: list[dict] = []

    def add(item) -> None:
        if isinstance(item, list):
            for x in item:
                add(x)
        elif isinstance(item, dict):
            if isinstance(item.get("@graph"), list):
                add([x for x in item["@graph"] if isinstance(x, dict)])
            else:
                found.append(item)

    for node in root.all("script"):
        if node.get("type") != "application/ld+json":
            continue
        raw = node.raw().strip()
        for text in (raw, re.sub(r",\s*([\]}])", r"\1", raw)):
            try:
                add(json.loads(text))
                break
            except ValueError:
                continue
    return found


def parse_date(value) -> datetime | None:
    """Epoch seconds or milliseconds, else free-form; what is left open comes from a fixed day."""
    from dateutil import parser

    text = str(value).strip() if value is not None else ""
    if not text:
        return None
    try:
        if re.fullmatch(r"\d{10}|\d{13}", text):
            return datetime.fromtimestamp(int(text) / (1000 if len(text) == 13 else 1), timezone.utc)
        found = parser.parse(text, default=datetime(2000, 1, 1))
    except (ValueError, OverflowError, TypeError):
        return None
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


def _distinct(items) -> list[str]:
    seen: dict[str, str] = {}
    for x in items:
        if x.strip():
            seen.setdefault(x.strip().lower(), x.strip())
    return list(seen.values())


def _strings(value) -> list[str]:
    """A list, or a text parted by commas."""
    parts = value if isinstance(value, list) else value.split(",") if isinstance(value, str) else []
    return _distinct(str(p) for p in parts)


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _named(value) -> list[str]:
    found = [x if isinstance(x, str) else str(x.get("name") or "") for x in _listed(value) if isinstance(x, (str, dict))]
    return _distinct(found)


def _image(url, alt=None, caption=None, hero=False, width=None, height=None) -> dict:
    return {"url": url, "alt": alt, "caption": caption, "is_hero": hero, "width": width, "height": height}


def _int(text) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def failed(why: str) -> dict:
    return {"success": False, "confidence": 0.0, "error": why}


def from_json_ld(page: Page) -> dict:
    if not page.blocks:
        return failed("page holds no JSON-LD")
    wanted = {t.lower() for t in ARTICLE_TYPES}
    block = next((b for b in page.blocks if any(str(t).lower() in wanted for t in _listed(b.get("@type")))), None)
    if block is None:
        return failed("no article among the JSON-LD blocks")
    text = lambda *keys: next((clean.tidy(str(block[k])) or None for k in keys if block.get(k)), None)
    body = text("articleBody")
    authors = _named(block.get("author"))
    publisher = block.get("publisher")
    if not authors and isinstance(publisher, dict) and publisher.get("name"):
        authors = [str(publisher["name"]).strip()]
    urls = [x if isinstance(x, str) else x.get("url") for x in _listed(block.get("image")) if isinstance(x, (str, dict))]
    page_ref = block.get("mainEntityOfPage")
    title, date = text("headline", "name"), parse_date(block.get("datePublished"))
    return {
        "success": bool(title),
        "confidence": 0.4 * bool(title) + 0.4 * bool(body) + 0.1 * bool(authors) + 0.1 * bool(date),
        "title": title,
        "subtitle": text("alternativeHeadline"),
        "summary": text("description"),
        "authors": authors,
        "published_at": date,
        "updated_at": parse_date(block.get("dateModified")),
        "language": text("inLanguage") or page.language,
        "body_text": body,
        "paragraphs": clean.paragraphs(body or ""),
        "categories": _strings(block.get("articleSection")),
        "tags": _strings(block.get("keywords")),
        "images": [_image(m, hero=True) for u in urls if (m := page.media(u))],
        "canonical_url": page_ref.get("@id") if isinstance(page_ref, dict) else page_ref if isinstance(page_ref, str) else None,
        "json_ld": [json.dumps(b, ensure_ascii=False) for b in page.blocks],
    }


def from_open_graph(page: Page) -> dict:
    og, tw = page.social("og:", "article:"), page.social("twitter:")
    if not og and not tw:
        return failed("page holds no social tags")
    either = lambda *keys: next((og[k] for k in keys if og.get(k)), None)
    title, summary = either("title") or tw.get("title"), either("description") or tw.get("description")
    shown = page.media(either("image", "image:secure_url") or tw.get("image"))
    images = [_image(shown, hero=True, width=_int(og.get("image:width")), height=_int(og.get("image:height")))] if shown else []
    film = page.media(either("video", "video:url") or tw.get("player")) if og.get("type") == "video" or tw.get("card") == "player" else None
    section, author = og.get("article:section"), og.get("article:author")
    return {
        "success": bool(title or summary or images),
        "confidence": 0.3 * bool(title) + 0.2 * bool(images) + 0.2 * bool(summary),
        "title": title,
        "summary": summary,
        "authors": [author] if author else [],
        "published_at": parse_date(either("article:published_time", "published_time")),
        "updated_at": parse_date(either("article:modified_time", "modified_time")),
        "language": page.language,
        "categories": [section] if section else [],
        "tags": [t.strip() for t in (og.get("article:tag") or "").split(",") if t.strip()],
        "images": images,
        "videos": [{"url": film, "thumbnail_url": shown}] if film else [],
        "canonical_url": og.get("url"),
        "meta_description": page.description,
        "meta_keywords": page.keywords,
        "open_graph": og,
        "twitter_card": tw,
    }


def from_article_library(page: Page) -> dict:
    """The slot of an optional library, which is never there."""
    return failed("article library is not installed")


def _of_container(page: Page, node: Node, text: str, headings: tuple[str, ...], captions: bool) -> dict:
    root, images = page.cleaned(), []
    head = next((h for name in headings if (h := root.first(name)) is not None), None)
    for img in node.all("img"):
        url = page.media(img.get("src") or img.get("data-src"))
        figure = next((a for a in img.above() if a.name == "figure"), None) if captions else None
        caption = figure.first("figcaption") if figure else None
        if url:
            images.append(_image(url, img.get("alt"), clean.tidy(caption.text()) if caption else None))
    return {
        "title": (clean.tidy(head.text()) or None) if head else None,
        "language": page.language,
        "body_text": text,
        "body_html": node.html(),
        "paragraphs": clean.paragraphs(text),
        "images": images,
    }


def _body(page: Page) -> Node:
    return page.cleaned().first("body") or page.cleaned()


def from_readability(page: Page) -> dict:
    points: dict[int, list] = {}
    measured = page.measured()
    for node in _body(page).all(*SCORED):
        own = measured[id(node)]
        if own.spaced < 25:
            continue
        worth = 1.0 + own.commas + min(own.spaced // 100, 3)
        for holder, share in zip(node.above(), (1.0, 0.5)):
            if id(holder) not in points:
                marks = f"{' '.join((holder.get('class') or '').split())} {holder.get('id') or ''}"
                points[id(holder)] = [holder, 25.0 * bool(POSITIVE.search(marks)) - 25.0 * bool(NEGATIVE.search(marks))]
            points[id(holder)][1] += worth * share
    if not points:
        return failed("nothing to score")

    def unlinked(node: Node) -> float:
        own = measured[id(node)]
        return 1 - min(1.0, own.linked / own.size) if own.size else 1.0

    node, worth = max(((n, w * unlinked(n)) for n, w in points.values()), key=lambda x: x[1])
    if worth <= 0:
        return failed("every score is zero or less")
    text = clean.tidy(clean.fragment_text(node))
    if len(text) < 150:
        return failed("text of the best element is under 150 characters")
    made, words = _of_container(page, node, text, ("h1", "title"), True), len(_WORDS.findall(text))
    sure = 0.15 * bool(made["title"]) + 0.55 * (words > 150) + min(worth / 100, 0.3)
    return {"success": words >= 80, "confidence": min(1.0, sure), **made}


def from_dom(page: Page, class_hints: bool = False) -> dict:
    """Semantic containers, and ids that hint at one; ``class_hints`` also looks at classes."""
    body = _body(page)
    tests = [lambda n, t=t: n.name == t for t in ("article", "main")]
    tests += [lambda n: n.get("role") == "main", lambda n: n.get("itemprop") == "articleBody"]
    for hint in CONTAINER_HINTS:
        if class_hints:
            tests.append(lambda n, h=hint: h.lower() in (n.get("class") or "").lower())
        tests.append(lambda n, h=hint: h.lower() in (n.get("id") or "").lower())
    fits: list[list[Node]] = [[] for _ in tests]
    for n in body.walk():
        for k, test in enumerate(tests):
            if test(n):
                fits[k].append(n)
    found = list({id(n): n for nodes in fits for n in nodes}.values())
    if not found:
        return failed("no container by tag, role or id")
    measured = page.measured()
    sizes = {id(n): sum(measured[id(p)].size for p in n.all("p", "li")) or measured[id(n)].size for n in found}
    node = max(found, key=lambda n: sizes[id(n)])
    if sizes[id(node)] < 150:
        return failed("text of the largest container is under 150 characters")
    text = clean.tidy(clean.fragment_text(node))
    made, words = _of_container(page, node, text, ("h1",), False), len(_WORDS.findall(text))
    sure = 0.1 * bool(made["title"]) + 0.4 * (words > 150) + 0.2 * (node.name in ("article", "main"))
    return {"success": words >= 60, "confidence": min(1.0, sure), **made}


def from_fallback(page: Page) -> dict:
    root = page.cleaned()
    parts = [t for p in root.all("p") if len(t := clean.tidy(p.text(" ", strip=True))) > 10]
    seen: dict[str, str] = {}
    for part in parts:
        seen.setdefault(" ".join(part.split()).lower(), part)
    kept = list(seen.values())
    head = root.first("h1") or root.first("title")
    title = (clean.tidy(head.text()) or None) if head else None
    done = bool(title or kept)
    return {
        "success": done,
        "confidence": 0.05 if done else 0.0,
        "error": None if done else "neither title nor paragraphs",
        "title": title,
        "language": page.language,
        "body_text": "\n\n".join(kept) or None,
        "paragraphs": kept,
        "meta_description": page.description,
    }


Strategy = Callable[[Page], dict]


class StrategyRegistry:
    """Strategies by name, in order; earlier ones win ties."""

    def __init__(self, made: list[tuple[str, Strategy]]):
        self._made = list(made)

    def register(self, name: str, strategy: Strategy, position: int | None = None) -> None:
        self.unregister(name)
        self._made.insert(len(self._made) if position is None else position, (name, strategy))

    def unregister(self, name: str) -> None:
        self._made = [x for x in self._made if x[0] != name]

    def build(self) -> list[tuple[str, Strategy]]:
        return list(self._made)


def default_registry() -> StrategyRegistry:
    return StrategyRegistry(
        [("json_ld", from_json_ld), ("open_graph", from_open_graph), ("article_library", from_article_library), ("readability", from_readability), ("dom_heuristic", from_dom), ("fallback", from_fallback)]
    )


def run_page(html: str, url: str, strategies: list[tuple[str, Strategy]]) -> tuple[list[dict], int]:
    """(a result for each strategy, length of the page's own text). Strategies that read the raw page come before those that clean it."""
    try:
        page = Page(html or "", url or "")
    except Exception as e:  # a page that cannot be read fails every strategy
        return [{"strategy": n, **failed(f"{type(e).__name__}: {e}")} for n, _ in strategies], 0
    out = []
    for name, strategy in strategies:
        try:
            out.append({"strategy": name, **strategy(page)})
        except Exception as e:
            out.append({"strategy": name, **failed(f"{type(e).__name__}: {e}")})
    return out, page.text_length
