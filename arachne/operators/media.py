"""Media references in HTML, and their first one of each source."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arachne.functions.url import DAILYMOTION, FLICKR, INSTAGRAM, MEDIA_SUFFIX, TWITPIC, VIMEO, YOUTUBE
from arachne.shared import small_batches

SCHEMA = "src string, alt string, w string, h string, pageUrl string, parentTxt string, domSib int, domDepth int, domElem string"
FIELDS = ("src", "alt", "w", "h", "pageUrl", "parentTxt", "domSib", "domDepth", "domElem")
#: Code points of a text that are kept.
LONGEST = 500


def _pattern(p: str, flags: int = re.ASCII) -> re.Pattern:
    """A pattern of the JVM's in Python's form: there a dot spares more line ends."""
    return re.compile(re.sub(r"(?<!\\)\.", r"[^\\n\\r\\x85\\u2028\\u2029]", p.removeprefix("(?i)")), flags)


_SITES = [_pattern(p) for p in (INSTAGRAM, YOUTUBE, VIMEO, DAILYMOTION, FLICKR, TWITPIC)]
_SUFFIX = _pattern(MEDIA_SUFFIX, re.ASCII | re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base link meta title style script noscript".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STOPS = frozenset("body head ul ol dl table select div".split())
_MEDIA = frozenset("img a link video source iframe embed object".split())


class Node:
    """An element: its depth below the document, how many elements it holds, and what of its text is needed at most."""

    __slots__ = ("tag", "attrs", "parent", "children", "depth", "elements", "raw")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.elements, self.raw = 0, ""

    def gather(self) -> None:
        """Set `raw`: the text's beginning with each run of white space as one space, from that of the children."""
        if self.tag in ("script", "style"):
            return
        out = " " if self.tag in _BLOCKS or self.tag == "br" else ""
        for c in self.children:
            if len(out) > LONGEST + 1:
                break
            more = _collapsed(c) if isinstance(c, str) else c.raw
            out += more[1:] if out.endswith(" ") and more.startswith(" ") else more
        self.raw = out[: LONGEST + 2]

    def text(self) -> str | None:
        return self.raw.strip()[:LONGEST] or None


def _collapsed(s: str) -> str:
    words = " ".join(s.split())
    if not words:
        return " " if s else ""
    return " " * s[0].isspace() + words + " " * s[-1].isspace()


class TreeBuilder(HTMLParser):
    """A tree with html, head and body implied, as browsers have it for well-formed pages. Work and memory grow in proportion to
    the page, however deep or wide it is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: Counter = Counter()
        self.found = False
        self.root = Node("#document", {}, None)
        self.html = self._add("html", {}, self.root)
        self.head = self._add("head", {}, self.html)
        self.body = self._add("body", {}, self.html)
        self.at = self.head

    @staticmethod
    def _add(tag, attrs, parent):
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        parent.elements += 1
        return node

    def _leave(self, node: Node) -> None:
        """Close the open elements down to `node`, and that."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def _shut(self, tags) -> bool:
        """Close the innermost open element of one of these tags, unless an element that keeps others in stands before it."""
        if any(self.open[t] for t in tags):
            x = self.at
            while x.tag not in _STOPS:
                if x.tag in tags:
                    self._leave(x)
                    return True
                x = x.parent
        return False

    def _to_body(self) -> None:
        while self.at is not self.head and self.at is not self.body:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.at = self.body

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            getattr(self, tag).attrs |= attrs
            if tag == "body" and self.at is self.head:
                self._to_body()
            return
        if self.at is self.head and tag not in _HEAD:
            self.at = self.body
        if not self._shut(_CLOSES.get(tag, ())) and (tag in _BLOCKS or tag in ("li", "dt", "dd")):
            self._shut(("p",))
        node = self._add(tag, attrs, self.at)
        self.found |= tag in _MEDIA
        if tag not in _VOID:
            self.open[tag] += 1
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            self._to_body()
        elif self.open[tag] > 0:
            x = self.at
            while x.tag != tag:
                x = x.parent
            self._leave(x)

    def handle_data(self, data):
        if self.at is self.head:
            if not data.strip():
                return
            self.at = self.body
        self.at.children.append(data)


def is_media(url: str) -> bool:
    return bool(url) and (_SUFFIX.fullmatch(url) is not None or any(p.fullmatch(url) for p in _SITES))


def _reference(node: Node) -> tuple | None:
    """(src, alt, w, h) of an element that refers to media."""
    a, tag = node.attrs, node.tag
    if tag == "img":
        return a.get("src", ""), a.get("alt", ""), a.get("width", ""), a.get("height", "")
    if tag in ("a", "link"):
        return (a["href"], node.text(), None, None) if is_media(a.get("href", "")) else None
    if tag == "video" or tag == "source" and node.parent.tag == "video":
        of = node if tag == "video" else node.parent
        return a.get("src", ""), of.text(), of.attrs.get("width", ""), of.attrs.get("height", "")
    if tag in ("iframe", "embed", "object"):
        src = a.get("data" if tag == "object" else "src", "")
        return (src, a.get("name", "") if tag == "object" else node.text(), a.get("width", ""), a.get("height", "")) if is_media(src) else None
    return None


def media_refs(html: str | None, page_url: str | None, only_img: bool = False) -> list[dict]:
    """References in the order in which elements end. Null html has none.

    only_img: the older form, which gives `img` elements alone, in the order in which they begin, without their place in
    the page.
    """
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    if not builder.found:
        return []
    order, todo = [], [builder.root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    order.reverse()  # each element after all that it holds, and these from first to last
    for node in order:
        node.gather()
    if only_img:
        starts, todo = [], [builder.root]
        while todo:
            node = todo.pop()
            if node.tag == "img":
                starts.append(node)
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        order = starts
    out = []
    for node in order:
        ref = _reference(node) if node.tag in _MEDIA else None
        if ref and ref[0]:
            place = (None, None, None) if only_img else (node.parent.elements - 1, node.depth, node.tag)
            out.append(dict(zip(FIELDS, (*ref, page_url, node.parent.text(), *place), strict=True)))
    return out


def extract_media(pages: DataFrame, html_col: str = "html", url_col: str = "url", only_img: bool = False) -> DataFrame:
    """A row per media reference of all pages; pages without any have none. Other columns are ignored."""
    small_batches(pages.sparkSession)
    schema = pa.schema([(n, pa.int32() if n in ("domSib", "domDepth") else pa.string()) for n in FIELDS])

    def found(batches):
        rows, volume = [], 0
        for b in batches:
            for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True):
                more = media_refs(h, u, only_img)
                rows += more
                volume += 1000 * len(more)
                if volume > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, volume = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url")).mapInArrow(found, SCHEMA)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the least in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def media_json(refs: DataFrame) -> DataFrame:
    """Lines of JSON objects, each followed by a comma, without null fields."""
    return refs.select(F.concat(F.to_json(F.struct(*refs.columns)), F.lit(",")).alias("value"))


def register_udtf(spark) -> None:
    """SELECT * FROM pages, LATERAL extract_media(html, url)"""
    from pyspark.sql.functions import udtf

    class ExtractMedia:
        def eval(self, html: str, url: str):
            for r in media_refs(html, url):
                yield tuple(r.values())

    spark.udtf.register("extract_media", udtf(ExtractMedia, returnType=SCHEMA))
