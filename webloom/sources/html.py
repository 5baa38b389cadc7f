"""Pages from HTML: one pass of a tolerant parser per page, in Arrow batches, to nested columns.

The parser is the standard library's tokenizer with a stack of open elements; void elements, implied ends of
p and li, and raw text of script and style are handled, other repairs of a browser aren't.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import url as U

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe".split())
BLOCK = {"p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell", "pre": "code", "blockquote": "quote", "figcaption": "caption", "dt": "list_item", "dd": "list_item"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
SECTIONING = frozenset("article aside main nav section".split())
#: Elements that say where they stand by themselves, and those that end an open paragraph.
LANDMARKS = SECTIONING | {"header", "footer"}
ENDS_PARAGRAPH = frozenset(("p", "li", *HEADINGS, "div", "ul", "ol", "table"))
# Fixed values of the rules: roles and names that tell where on a page something stands.
ROLES = {"navigation": "nav", "banner": "nav", "contentinfo": "footer", "complementary": "aside"}
CLASS_POSITIONS = (("footer", {"footer", "colophon"}), ("aside", {"sidebar", "aside"}), ("nav", {"nav", "navbar", "navigation", "menu", "header", "masthead", "topbar", "breadcrumb", "breadcrumbs"}))
SCOPED = {"header", "masthead", "footer", "colophon"}
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:", "data:", "sms:", "fax:")
_NAME = re.compile("[a-z0-9]+")
#: Plain markup: text, then an end tag or a start tag whose attributes have values in double quotes or none.
_PLAIN = re.compile(r'([^<]*)<(?:/([a-zA-Z][-.a-zA-Z0-9:_]*)>|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-.a-zA-Z0-9:_]*(?:="[^"]*")?)*)[ \t\n\r\f]*>)')
_ATTRIBUTE = re.compile(r'([a-zA-Z][-.a-zA-Z0-9:_]*)(?:="([^"]*)")?')


class Place(NamedTuple):
    """What an open element and those around it say about where they stand: nearest landmark, nearest name, inside a section."""

    landmark: str | None = None
    marked: str | None = None
    sectioned: bool = False


@lru_cache(4096)
def plain_attributes(text: str) -> tuple:
    return tuple((name.lower(), value and unescape(value)) for name, value in (m.groups() for m in _ATTRIBUTE.finditer(text)))


class Tokenizer(HTMLParser):
    """The standard library's tokenizer, its loop short-cut for plain markup: the same calls in the same order.

    All other markup goes through the standard methods, and from the first place where these want more text, through the
    standard loop. Line numbers aren't kept.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def goahead(self, end):
        raw, at = self.rawdata, 0
        while self.cdata_elem is None:
            m = _PLAIN.match(raw, at)
            if m:
                text, closed, tag, attrs = m.groups()
                if closed or tag.lower() not in self.CDATA_CONTENT_ELEMENTS:
                    if text:
                        self.handle_data(unescape(text))
                    if closed:
                        self.handle_endtag(closed.lower())
                    else:
                        self.handle_starttag(tag.lower(), plain_attributes(attrs) if attrs else ())
                    at = m.end()
                    continue
            start = raw.find("<", at)
            if start < 0:
                break
            if at < start:
                self.handle_data(unescape(raw[at:start]))
            at = start
            next_ = raw[at + 1 : at + 2]
            if next_.isascii() and next_.isalpha():
                over = self.parse_starttag(at)
            elif next_ == "/":
                over = self.parse_endtag(at)
            elif raw.startswith("<!--", at):
                over = self.parse_comment(at)
            elif next_ == "!":
                over = self.parse_html_declaration(at)
            else:
                break
            if over < 0:
                break
            at = over
            if self.cdata_elem in ("script", "style") and (m := self.interesting.search(raw, at)):
                if at < m.start():
                    self.handle_data(raw[at : m.start()])
                at = m.start()
                over = self.parse_endtag(at)
                if over < 0:
                    break
                at = over
        self.rawdata = raw[at:]
        super().goahead(end)


def placed(outer: Place, tag: str, attrs: dict) -> Place:
    """Where an element stands: where its parent does unless it says more itself."""
    if tag not in LANDMARKS and "role" not in attrs and "class" not in attrs and "id" not in attrs:
        return outer
    role = ROLES.get((attrs.get("role") or "").strip().lower())
    own = role or (tag if tag in ("nav", "aside") else None)
    if own is None and not outer.sectioned:
        own = {"header": "nav", "footer": "footer"}.get(tag)
    marked = None
    if tag not in ("body", "html") and (attrs.get("class") or attrs.get("id")):
        names = set(_NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())) - (SCOPED if outer.sectioned else set())
        marked = next((position for position, marks in CLASS_POSITIONS if names & marks), None)
    return Place(own or outer.landmark, marked or outer.marked, outer.sectioned or tag in SECTIONING)


def tidy(parts) -> str:
    return " ".join("".join(parts).split())


class PageParser(Tokenizer):
    """Collects what a page says about itself."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, dict]] = []
        self.places: list[Place] = []  # of the open elements
        self.count: dict[str, int] = {}  # of the open elements, by tag
        self.page = {"title": None, "h1": None, "lang": None, "canonical": None, "base": None, "noindex": False, "hreflang": [], "links": [], "headings": [], "blocks": [], "schema": [], "body_class": None, "generator": None}
        self.texts: list[tuple[str, list[str]]] = []  # collecting elements, innermost last
        self.anchor: dict | None = None
        self.visible: list[str] = []

    def position(self) -> str:
        """Where the innermost open element stands: its landmark, else what names say, else the body."""
        inner = self.places[-1] if self.places else Place()
        return inner.landmark or inner.marked or "body"

    def entered(self, tag: str, attrs: dict) -> None:
        self.open.append((tag, attrs))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.places.append(placed(self.places[-1] if self.places else Place(), tag, attrs))

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        page = self.page
        if tag == "html":
            page["lang"] = (attrs.get("lang") or "").split("-")[0].lower() or None
        elif tag == "body":
            page["body_class"] = attrs.get("class")
        elif tag == "base" and page["base"] is None:
            page["base"] = attrs.get("href")
        elif tag == "link":
            rel = (attrs.get("rel") or "").lower().split()
            if "canonical" in rel and page["canonical"] is None:
                page["canonical"] = attrs.get("href")
            if "alternate" in rel and attrs.get("hreflang") and attrs.get("href"):
                page["hreflang"].append({"lang": attrs["hreflang"], "url": attrs["href"]})
        elif tag == "meta":
            name, content = (attrs.get("name") or "").lower(), (attrs.get("content") or "").lower()
            if name in ("robots", "googlebot") and {"noindex", "none"} & {x.strip() for x in content.split(",")}:
                page["noindex"] = True
            if name == "generator":
                page["generator"] = attrs.get("content")
        elif tag == "img" and self.anchor is not None and self.anchor["alt"] is None:
            self.anchor["alt"] = attrs.get("alt")
        if tag in ENDS_PARAGRAPH:  # an open paragraph, or item, ends here
            for end in ("p", "li") if tag == "li" else ("p",):
                if self.count.get(end) and not (end == "li" and any(t in ("ul", "ol") for t, _ in self.open[max(i for i, (t, _) in enumerate(self.open) if t == "li") :])):
                    self.handle_endtag(end)
        if tag in VOID:
            return
        if tag == "a" and attrs.get("href") is not None:
            self.anchor = {"href": attrs["href"].strip(), "position": self.position(), "nofollow": "nofollow" in (attrs.get("rel") or "").lower().split(), "alt": None, "aria": attrs.get("aria-label"), "parts": []}
        self.entered(tag, attrs)
        if tag == "title" and page["title"] is None or tag in HEADINGS or tag in BLOCK or tag == "script" and (attrs.get("type") or "").lower() == "application/ld+json":
            self.texts.append((tag, []))

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        while self.open:
            last, _ = self.open.pop()
            self.places.pop()
            self.count[last] -= 1
            self._ended(last)
            if last == tag:
                break

    def _ended(self, tag):
        page = self.page
        if tag == "a" and self.anchor is not None:
            a, self.anchor = self.anchor, None
            if a["href"] and not a["href"].lower().startswith(SKIPPED_SCHEMES):
                page["links"].append({"href": a["href"], "anchor": tidy(a["parts"]) or tidy([a["alt"] or ""]) or tidy([a["aria"] or ""]), "position": a["position"], "nofollow": a["nofollow"], "ordinal": len(page["links"])})
        if self.texts and self.texts[-1][0] == tag:
            _, parts = self.texts.pop()
            text = tidy(parts)
            if tag == "title":
                page["title"] = text if page["title"] is None else page["title"]
            elif tag == "script":
                page["schema"] += schema_items("".join(parts))
            elif text:
                region = "chrome" if self.position() != "body" else "content"
                if tag in HEADINGS:
                    page["headings"].append({"level": HEADINGS[tag], "text": text, "ordinal": len(page["headings"])})
                    page["h1"] = text if tag == "h1" and page["h1"] is None else page["h1"]
                page["blocks"].append({"kind": "heading" if tag in HEADINGS else BLOCK[tag], "region": region, "level": HEADINGS.get(tag), "text": text, "ordinal": len(page["blocks"]) + 1})

    def handle_data(self, data):
        inside = self.open[-1][0] if self.open else ""
        if inside in HIDDEN:
            if inside == "script" and self.texts and self.texts[-1][0] == "script":
                self.texts[-1][1].append(data)
            return
        if self.anchor is not None:
            self.anchor["parts"].append(data)
        for _, parts in self.texts[-1:]:
            parts.append(data)
        if inside != "title":
            self.visible.append(data)

    def done(self) -> dict:
        self.close()
        while self.open:
            self.places.pop()
            last, _ = self.open.pop()
            self.count[last] -= 1
            self._ended(last)
        self.page["words"] = len(" ".join(self.visible).split())
        return self.page


def schema_items(text: str) -> list[dict]:
    """The nodes of a JSON-LD block, lists and @graph opened; a broken block is one invalid node."""
    try:
        todo, out = [json.loads(text)], []
    except ValueError:
        return [{"type": "invalid", "json": text}]
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            if isinstance(node.get("@graph"), list):
                todo = node["@graph"] + todo
            else:
                kinds = node.get("@type")
                out.append({"type": str(kinds[0] if isinstance(kinds, list) and kinds else kinds or "").rsplit("/", 1)[-1], "json": json.dumps(node, sort_keys=True, ensure_ascii=False)})
    return out


PARSED = (
    "page_id long, url string, title string, h1 string, lang string, canonical string, base string, noindex boolean, hreflang array<struct<lang:string,url:string>>, "
    "links array<struct<href:string,anchor:string,position:string,nofollow:boolean,ordinal:int>>, headings array<struct<level:int,text:string,ordinal:int>>, "
    "blocks array<struct<kind:string,region:string,level:int,text:string,ordinal:int>>, schema array<struct<type:string,json:string>>, body_class string, generator string, words int"
)


def parse_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """pages (page_id, url, html) -> a row with nested columns for each: those named besides page_id and url, all where none is."""
    kinds = {"lang_url": pa.list_(pa.struct([("lang", pa.string()), ("url", pa.string())]))}
    schema = pa.schema(
        [("page_id", pa.int64())] + [(n, pa.string()) for n in ("url", "title", "h1", "lang", "canonical", "base")] + [("noindex", pa.bool_()), ("hreflang", kinds["lang_url"])]
        + [("links", pa.list_(pa.struct([("href", pa.string()), ("anchor", pa.string()), ("position", pa.string()), ("nofollow", pa.bool_()), ("ordinal", pa.int32())])))]
        + [("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("ordinal", pa.int32())])))]
        + [("blocks", pa.list_(pa.struct([("kind", pa.string()), ("region", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("ordinal", pa.int32())])))]
        + [("schema", pa.list_(pa.struct([("type", pa.string()), ("json", pa.string())]))), ("body_class", pa.string()), ("generator", pa.string()), ("words", pa.int32())]
    )
    columns = ("page_id", "url", *columns) if columns else tuple(schema.names)
    schema = pa.schema([schema.field(c) for c in columns])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for page_id, url, html in zip(*(batch.slice(at, 200).column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    parser = PageParser()
                    parser.feed(html or "")
                    out.append({"page_id": page_id, "url": url} | parser.done())
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType([T.StructType.fromDDL(PARSED)[c] for c in columns]))


def links_of(parsed: DataFrame) -> DataFrame:
    """A row for each link, its address made absolute: from_page_id, from_url, to_url, anchor, position, nofollow, ordinal."""
    rows = parsed.select(F.col("page_id").alias("from_page_id"), F.col("url").alias("from_url"), F.explode("links").alias("l"))
    origin = F.regexp_extract("from_url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.concat(origin, F.regexp_extract(F.when(U.path(F.col("from_url")) == "", "/").otherwise(U.path(F.col("from_url"))), "^(.*/)", 1))
    href = F.col("l.href")
    to = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("from_url", "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | href.startswith("?") | (href == ""), F.concat(F.regexp_replace("from_url", "[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    return rows.select("from_page_id", "from_url", to.alias("to_url"), *(F.col(f"l.{c}").alias(c) for c in ("anchor", "position", "nofollow", "ordinal")))


def headings_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.inline("headings"))


def blocks_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.inline("blocks"))


def robots_rules(files: DataFrame) -> DataFrame:
    """files (host, text) -> host, agent, allow, pattern: the groups of robots.txt, agents in lower case."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("host", "at", line.alias("line"))
    field, value = F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    rows = rows.select("host", "at", field.alias("field"), value.alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow"))

    order = Window.partitionBy("host").orderBy("at")
    rows = rows.withColumn("opens", (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")).withColumn("group", F.sum(F.col("opens").cast("int")).over(order))
    agents = rows.filter("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    paths = rows.filter("field <> 'user-agent' AND value <> ''").select("host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(paths, ["host", "group"]).select("host", "agent", "allow", "pattern").distinct()


def sitemap_urls(files: DataFrame) -> DataFrame:
    """files (sitemap, xml) -> sitemap, ordinal, loc, lastmod of each <url> or <sitemap>."""
    entries = files.select("sitemap", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)).alias("ordinal", "entry"))
    said = lambda tag: F.nullif(F.btrim(F.regexp_replace(F.regexp_extract("entry", rf"(?s)<{tag}>(.*?)</{tag}>", 1), "&amp;", "&"), F.lit(" \t\r\n")), F.lit(""))
    return entries.select("sitemap", "ordinal", said("loc").alias("loc"), said("lastmod").alias("lastmod")).filter("loc IS NOT NULL")
