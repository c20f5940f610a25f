"""A small element tree on the standard library's HTML tokenizer.

Void elements hold nothing, script and style are raw text, and an opening tag
closes what it implies (a paragraph by a block, a list item by a list item, ...).
An end tag closes the nearest open element of its name; without one it is ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template"))
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: tag -> (open tags that it closes, tags that it does not look beyond)
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    **{b: (("p",), ("td", "th", "li", "table", "button")) for b in BLOCKS},
}


class Measure(NamedTuple):
    """Pieces of text, their characters, commas among these, and characters within links (of links in links, again)."""

    pieces: int
    size: int
    commas: int
    linked: int

    @property
    def spaced(self) -> int:
        """Length of the pieces with a blank between each two."""
        return self.size + max(self.pieces - 1, 0)


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def where(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def get(self, attr: str) -> str | None:
        return self.attrs.get(attr)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.name not in RAW:
                stack += reversed(item.children)

    def text(self, between: str = "", strip: bool = False) -> str:
        if not strip:
            return between.join(self.strings())
        return between.join(s for x in self.strings() if (s := x.strip()))

    def measures(self) -> dict[int, Measure]:
        """Of the stripped text below each element, by its id: one pass from the leaves."""
        out: dict[int, Measure] = {}
        for node in reversed([self, *self.walk()]):
            pieces = size = commas = linked = 0
            for child in node.children if node.name not in RAW else ():
                if isinstance(child, str):
                    bare = child.strip()
                    pieces, size, commas = pieces + bool(bare), size + len(bare), commas + bare.count(",")
                else:
                    own = out[id(child)]
                    pieces, size, commas = pieces + own.pieces, size + own.size, commas + own.commas
                    linked += own.linked + (own.size if child.name == "a" else 0)
            out[id(node)] = Measure(pieces, size, commas, linked)
        return out

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def html(self) -> str:
        from html import escape

        def tag(node: Node) -> str:
            inner = "".join(tag(c) if isinstance(c, Node) else c if node.name in RAW else escape(c, quote=False) for c in node.children)
            attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in node.attrs.items())
            return f"<{node.name}{attrs}>" if node.name in VOID else f"<{node.name}{attrs}>{inner}</{node.name}>"

        return tag(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("[document]")

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            node = self.open
            while node is not self.root and node.name not in stops:
                if node.name in closes:
                    self.open = node.parent or self.root
                    if tag not in ("tr",):
                        break
                node = node.parent or self.root
        held: dict = {}
        for k, v in attrs:
            held.setdefault(k, v if v is not None else "")
        made = Node(tag, held, self.open)
        self.open.children.append(made)
        if tag not in VOID:
            self.open = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open.name == tag:
            self.open = self.open.parent or self.root

    def handle_endtag(self, tag):
        node = self.open
        while node is not self.root:
            if node.name == tag:
                self.open = node.parent or self.root
                return
            node = node.parent or self.root

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
