"""What needs a walk through markup: visible text, allow-listed markup, main content and images, as Arrow-batched functions."""

from __future__ import annotations

import json
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from gleanery.functions.markup import VOID

HIDDEN = {"script", "style", "noscript", "template"}
FURNITURE = {"nav", "header", "footer", "aside", "form"}
# Elements and attributes that articles and comments keep.
ALLOWED = {
    "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "blockquote", "pre", "code", "em", "strong", "a", "img", "figure", "figcaption", "table", "thead", "tbody", "tr", "th",
    "td", "caption", "hr", "br",
}
ALLOWED_IN_COMMENTS = {"p", "a", "em", "i", "strong", "b", "code", "pre", "blockquote", "ul", "ol", "li", "br", "del", "sup", "sub"}
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "th": ("colspan", "rowspan", "scope"), "td": ("colspan", "rowspan")}
# Where events of a portal page stand, the first that yields any counts, and what is left out there.
EVENT_PLACES = ("div.current-events-content", "div.description", "div.current-events-main", "section", "body")
LEFT_OUT = {"script", "style", "sup", "table", "figure", "img", "link", "meta", "noscript", "input", "button"}
LEFT_OUT_CLASSES = {"mw-editsection", "reference", "navbox", "metadata", "noprint", "current-events-navbar", "current-events-heading", "hatnote", "mw-jump-link"}
BLOCKS = {"p", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "td"}


class Walk(HTMLParser):
    """Collects text outside hidden elements, allowed markup, text by its innermost block, and image addresses."""

    def __init__(self, base: str, allowed: set[str] = ALLOWED):
        super().__init__(convert_charrefs=True)
        self.base, self.allowed, self.hidden, self.furniture = base, allowed, 0, 0
        self.text: list[str] = []
        self.markup: list[str] = []
        self.blocks: list[str] = []
        self.images: list[str] = []
        self.open: list[str] = []
        self.block: list[str] | None = None

    def flush(self) -> None:
        if self.block is not None and (found := " ".join("".join(self.block).split())):
            self.blocks.append(found)
        self.block = None

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        self.hidden += tag in HIDDEN
        self.furniture += tag in FURNITURE
        if self.hidden:
            return
        if tag in BLOCKS:
            self.flush()
            self.block = None if self.furniture else []
            self.text.append(" ")
        if tag == "img" and (src := largest(given.get("srcset", "")) or given.get("src", "")):
            address = urljoin(self.base, src)
            if address.startswith(("http://", "https://")) and address not in self.images:
                self.images.append(address)
        if tag in self.allowed:
            kept = ""
            for name in ATTRIBUTES.get(tag, ()):
                value = given.get(name, "")
                if name in ("href", "src"):
                    value = urljoin(self.base, value)
                    if not value.startswith(("http://", "https://", "mailto:")):
                        continue
                kept += f' {name}="{escape(value)}"' if value else ""
            self.markup.append(f"<{tag}{kept}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.furniture -= tag in FURNITURE and self.furniture > 0
        if tag in BLOCKS and not self.hidden:
            self.flush()
            self.text.append(" ")
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.markup.append(f"</{last}>")
            self.markup.append(f"</{tag}>")

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        self.markup.append(escape(data, quote=False))
        if self.block is not None:
            self.block.append(data)


def largest(srcset: str, most: int = 2000) -> str:
    """The widest candidate of at most ``most`` pixels, else the narrowest of all; empty without candidates."""
    found = []
    for part in srcset.split(", "):
        pieces = part.strip().rstrip(",").split()
        if pieces:
            width = pieces[1][:-1] if len(pieces) > 1 and pieces[1].endswith("w") else ""
            found.append((int(width) if width.isdigit() else 0, pieces[0]))
    fit = [f for f in found if f[0] <= most]
    return max(fit, key=lambda f: f[0])[1] if fit else min(found)[1] if found else ""


def walked(html: str | None, base: str | None = None, allowed: set[str] = ALLOWED) -> Walk:
    w = Walk(base or "", allowed)
    w.feed(html or "")
    w.close()
    w.flush()
    w.markup += [f"</{t}>" for t in reversed(w.open)]
    return w


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Text outside scripts, styles and templates, white space collapsed; empty for null."""
    return html.map(lambda h: " ".join("".join(walked(h).text).split()))


@F.pandas_udf(StringType())
def sanitised(html: pd.Series, base: pd.Series) -> pd.Series:
    """Markup of allowed elements and attributes alone, balanced, with absolute addresses; empty for null."""
    return pd.Series(["".join(walked(h, b).markup) for h, b in zip(html, base, strict=True)])


@F.pandas_udf(StringType())
def main_text(html: pd.Series) -> pd.Series:
    """Blocks of text outside page furniture, one a line; empty if there is none."""
    return html.map(lambda h: "\n".join(walked(h).blocks))


@F.pandas_udf(ArrayType(StringType()))
def image_addresses(html: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute addresses of images in their order, each once."""
    return pd.Series([walked(h, b).images for h, b in zip(html, base, strict=True)])


@F.pandas_udf(StringType())
def sanitised_comment(html: pd.Series) -> pd.Series:
    """Markup of the elements that comments keep, balanced, a bare text as a paragraph; empty for null."""

    def one(h: str | None) -> str:
        kept = "".join(walked(h, None, ALLOWED_IN_COMMENTS).markup).strip()
        return kept if not kept or kept.startswith("<") else f"<p>{kept}</p>"

    return html.map(one)


class Element:
    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def left_out(self) -> bool:
        return self.name in LEFT_OUT or self.attrs.get("role") == "navigation" or not LEFT_OUT_CLASSES.isdisjoint(self.attrs.get("class", "").split())

    def text(self, lists: bool) -> str:
        """Text without what is left out, and without inner lists unless ``lists``."""
        parts = [c if isinstance(c, str) else "" if c.left_out() or (not lists and c.name in ("ul", "ol")) else c.text(lists) for c in self.children]
        return " ".join(" ".join(parts).split())

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


class Tree(HTMLParser):
    """Elements under their parents; a list item or paragraph ends where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.found: list[Element] = []

    def handle_starttag(self, tag, attrs):
        if tag == "li" or tag in ("p", "ul", "ol", "div", "section", "h2", "h3", "h4"):
            ends, within = ("li", ("ul", "ol")) if tag == "li" else ("p", ("li", "div", "section", "body"))
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name in within:
                    break
                if self.open[i].name == ends:
                    del self.open[i:]
                    break
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        self.found.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def events_of(listing: Element, parent: str, prefix: str, depth: int) -> list[tuple]:
    """Rows (id, parent, depth, label) of a list and the lists within; items without text and inner items are left out."""
    rows = []
    for n, item in enumerate((e for e in listing.elements() if e.name == "li" and not e.left_out()), 1):
        name = f"{prefix}{n}"
        below = [r for e in item.elements() if e.name in ("ul", "ol") for r in events_of(e, name, f"{name}-", depth + 1)]
        said = item.text(False)
        if said or below:
            rows += [(name, parent, depth, said), *below]
    return rows


def sections_of(html: str | None) -> list[tuple]:
    """Rows (id, parent, depth, label): sections with the title before their list, and their events."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    for place in EVENT_PLACES:
        name, _, wanted = place.partition(".")
        rows, n = [], 0
        for container in (e for e in tree.found if e.name == name and (not wanted or wanted in e.attrs.get("class", "").split())):
            title = None
            for e in container.elements():
                if e.left_out():
                    continue
                if e.name in ("p", "h2", "h3", "h4", "dt") and e.text(True):
                    title = e.text(True)
                elif e.name in ("ul", "ol") and (events := events_of(e, f"s{n + 1}", f"s{n + 1}-e", 1)):
                    n += 1
                    rows += [(f"s{n}", None, 0, title or "Other events"), *events]
                    title = None
        if rows:
            return rows
    return []


EVENTS = ArrayType(StructType().add("id", StringType()).add("parent", StringType()).add("depth", IntegerType()).add("label", StringType()))
COMMENTS = ArrayType(StructType().add("place", IntegerType()).add("parent", IntegerType()).add("depth", IntegerType()).add("author", StringType()).add("points", LongType()).add("text", StringType()))


@F.pandas_udf(EVENTS)
def page_sections(html: pd.Series) -> pd.Series:
    """Sections and nested events of portal pages; none for null."""
    return html.map(sections_of)


def comments_of(children: list, depth: int, out: list, parent: int) -> bool:
    """Appends rows (place, parent, depth, author, points, text) of nested replies of both shapes; true if any stays. A comment without
    text stays if a reply to it does, in the shape that nests ``children``; in listings it goes with all below."""
    any_ = False
    for node in children:
        listed = isinstance(node.get("data"), dict)
        c = node["data"] if listed else node
        text = ((c.get("body") if listed else c.get("text")) or "").strip()
        if (listed and (node.get("kind") != "t1" or c.get("stickied") or text in ("", "[removed]", "[deleted]"))) or c.get("type") == "story":
            continue
        replies = c.get("replies") if listed else c.get("children")
        below = ((replies.get("data") or {}).get("children") if isinstance(replies, dict) else None) if listed else replies
        out.append(None)
        place = len(out)
        if not (comments_of(below or [], depth + 1, out, place) or text):
            out.pop()
            continue
        out[place - 1] = (place, parent, depth, c.get("author") or "[deleted]", c.get("score" if listed else "points"), text)
        any_ = True
    return any_


def thread_of(body: str | None) -> list[tuple]:
    try:
        read = json.loads(body or "null")
    except ValueError:
        return []
    if isinstance(read, list):
        read = (read[1].get("data") or {}) if len(read) > 1 else {}
    out: list[tuple] = []
    comments_of((read or {}).get("children") or [], 0, out, 0)
    return out


@F.pandas_udf(COMMENTS)
def nested_comments(body: pd.Series) -> pd.Series:
    """The comments of a discussion in reading order, places from 1, parent 0 for the first level; none for a text that isn't JSON."""
    return body.map(thread_of)
