"""Extraction from HTML: metadata, text, links, headings, images, JSON-LD.

One tolerant tree builder on the standard library's tokenizer serves all
extractors.  Pages are parsed in Arrow batches; what comes out is a nested row,
and everything after that (link edges, crawlable links) is Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PARSED_PAGE

# --- fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
NO_TEXT = frozenset("script style noscript header footer nav aside form button input select textarea iframe svg canvas".split())
NO_CHANGE_TEXT = frozenset("script style nav footer header".split())
SKIPPED_LINKS = ("javascript:", "mailto:", "tel:", "#")
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
LINK_TEXT, HEADING_TEXT, MOST_IMAGES = 200, 200, 50
META_FIELDS = {
    "description": "description", "author": "author", "robots": "robots", "og:title": "og_title", "og:description": "og_description",
    "og:image": "og_image", "og:type": "og_type", "twitter:card": "twitter_card",
}
# --- end of fixed values


class Node:
    """An element: its tag, attributes, and children (elements and text)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        """Text of the element in document order, leaving out some elements."""
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in without:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "", without: frozenset[str] = frozenset()) -> str:
        """Stripped pieces of text, joined."""
        return separator.join(s for s in (x.strip() for x in self.strings(without)) if s)


class _Builder(HTMLParser):
    """Builds a tree of any input: unknown end tags are ignored, open elements
    are closed by their ancestors' end tags, paragraphs by blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and any(n.tag == "p" for n in self.open[-8:]):
            self._close("p", CLOSES_P - {"p"})
        if tag in CLOSES_SAME:
            self._close(tag, CLOSES_SAME[tag])
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def _close(self, tag: str, borders) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in borders:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    """Element tree of a page; null and empty input give an empty tree."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _metadata(nodes: list[Node]) -> dict:
    out = dict.fromkeys([*META_FIELDS.values(), "title", "keywords", "canonical_url", "language"])
    for node in nodes:
        if node.tag == "title" and out["title"] is None:
            out["title"] = node.text()
        elif node.tag == "meta":
            name = (node.attrs.get("name") or node.attrs.get("property") or "").lower()
            content = node.attrs.get("content", "")
            if name == "keywords":
                out["keywords"] = [k.strip() for k in content.split(",")]
            elif name in META_FIELDS:
                out[META_FIELDS[name]] = content
        elif node.tag == "link" and out["canonical_url"] is None and "canonical" in node.attrs.get("rel", "").lower().split():
            out["canonical_url"] = node.attrs.get("href")
        elif node.tag == "html" and out["language"] is None:
            out["language"] = node.attrs.get("lang")
    return out


def _absolute(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _host(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


def _links(nodes: list[Node], base: str) -> list[dict]:
    own = _host(base)
    anchors, frames = [], []
    for node in nodes:
        if node.tag == "a" and "href" in node.attrs:
            href = node.attrs["href"]
            url = None if href.startswith(SKIPPED_LINKS) else _absolute(base, href)
            if url is not None:
                anchors.append({"url": url, "text": node.text()[:LINK_TEXT], "is_internal": _host(url) == own, "nofollow": "nofollow" in node.attrs.get("rel", "").split(), "link_type": "anchor"})
        elif node.tag in ("frame", "iframe") and node.attrs.get("src"):
            src = node.attrs["src"]
            url = None if src.startswith("javascript:") else _absolute(base, src)
            if url is not None:
                frames.append({"url": url, "text": "", "is_internal": _host(url) == own, "nofollow": False, "link_type": "frame"})
    return anchors + frames


def _structured(nodes: list[Node]) -> list[str]:
    out = []
    for node in nodes:
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(node.strings()))
            except ValueError:
                continue
            out += [json.dumps(x, ensure_ascii=False) for x in (data if isinstance(data, list) else [data])]
    return out


def parse_html(html: str | None, base_url: str | None) -> dict:
    """All that is extracted from one page.  Text is what is outside of scripts,
    page frame and forms, white space collapsed; the title counts as text."""
    base = base_url or ""
    root = tree(html)
    nodes = list(root.walk())
    headings: dict[str, list[str]] = {f"h{i}": [] for i in range(1, 7)}
    images = []
    for node in nodes:
        if node.tag in headings and (text := node.text()):
            headings[node.tag].append(text[:HEADING_TEXT])
        elif node.tag == "img" and (src := node.attrs.get("src") or node.attrs.get("data-src")) and len(images) < MOST_IMAGES:
            images.append({"src": _absolute(base, src), "alt": node.attrs.get("alt", ""), "title": node.attrs.get("title", "")})
    return {
        "url": base_url, "metadata": _metadata(nodes), "text_content": re.sub(r"\s+", " ", root.text(" ", NO_TEXT)).strip(), "links": _links(nodes, base),
        "structured_data": _structured(nodes), "headings": list(headings.items()), "images": images,
    }


_LINK = pa.struct([("url", pa.string()), ("text", pa.string()), ("is_internal", pa.bool_()), ("nofollow", pa.bool_()), ("link_type", pa.string())])
_META_ORDER = ["title", "description", "keywords", "author", "canonical_url", "language", "og_title", "og_description", "og_image", "og_type", "twitter_card", "robots"]
_PAGE = pa.schema([
    ("url", pa.string()), ("metadata", pa.struct([(f, pa.list_(pa.string()) if f == "keywords" else pa.string()) for f in _META_ORDER])),
    ("text_content", pa.string()), ("links", pa.list_(_LINK)), ("structured_data", pa.list_(pa.string())),
    ("headings", pa.map_(pa.string(), pa.list_(pa.string()))), ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("title", pa.string())]))),
])


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Parsed pages of `pages`; one row each, in the schema of `schemas.PARSED_PAGE`.
    A null html gives a row without content."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows = [parse_html(h, u) for u, h in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGE)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(parse, PARSED_PAGE)


def change_text(html: str | None) -> tuple[str, str]:
    """(text, title) as change detection compares them: one line for each piece
    of text, without scripts, styles, navigation, header and footer."""
    root = tree(html)
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    return root.text("\n", NO_CHANGE_TEXT), title


def page_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, text, title) of pages in the form change detection compares."""
    schema = pa.schema([("url", pa.string()), ("text", pa.string()), ("title", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [change_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in texts], pa.string()), pa.array([t for _, t in texts], pa.string())], schema=schema)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(extract, "url string, text string, title string")


def crawlable_links(links: Column, robots: Column | None = None, respect_nofollow: bool = True, internal_only: bool = True) -> Column:
    """Addresses to follow: first occurrences in order, without nofollow and
    external links as asked; none if the page's robots entry holds nofollow."""
    kept = links
    if respect_nofollow:
        kept = F.filter(kept, lambda x: ~x["nofollow"])
    if internal_only:
        kept = F.filter(kept, lambda x: x["is_internal"])
    urls = F.array_distinct(F.transform(kept, lambda x: x["url"]))
    if robots is not None:
        urls = F.when(F.lower(robots).contains("nofollow"), F.array().cast("array<string>")).otherwise(urls)
    return F.coalesce(urls, F.array().cast("array<string>"))


def link_edges(parsed: DataFrame) -> DataFrame:
    """(src, pos, dst, text, is_internal, nofollow, link_type): one row a link."""
    return parsed.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "l")).select("src", "pos", F.col("l.url").alias("dst"), "l.text", "l.is_internal", "l.nofollow", "l.link_type")


def structured_variants(parsed: DataFrame) -> DataFrame:
    """(url, pos, item) with each JSON-LD object as a variant."""
    return parsed.select("url", F.posexplode("structured_data").alias("pos", "text")).select("url", "pos", F.try_parse_json("text").alias("item"))
