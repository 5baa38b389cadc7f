"""What a page's element tree says beyond links and headings: main content, menus, breadcrumb, texts by area, structured items, tables.

A tree is built once for each page with the standard library's tokenizer; words are numbered through the page, so
each element is a range of words and its text, length and number of words are known without walking it again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import HEADINGS, SKIPPED_SCHEMES, VOID, Place, Tokenizer, placed, tidy

#: An open element of the second kind ends where one of the first kind begins.
ENDS = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ENDS |= {t: ("p",) for t in ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "header", "footer", "main", *HEADINGS)}
#: Elements that an implied end doesn't look beyond.
BOUNDS = frozenset("ul ol table div section article aside nav header footer main body".split())
# Fixed values of the rules.
NOISE = frozenset("script style noscript iframe template".split())
CODE = frozenset("script style noscript template pre code".split())
COOKIE_WORDS = ("cookie", "consent", "gdpr")
CONTENT_NAMES = ("#content", "#main", "#main-content", "#article", ".content", ".main-content", ".post-content", ".entry-content", ".article-body")
CRUMB_WORDS = ("breadcrumb", "morzsa")
PAGER_NAMES = ("pagination", "page-numbers", "pager")
OPEN_GRAPH = ("og:", "article:", "book:", "profile:", "product:", "music:", "video:")
NOINDEX = frozenset(("noindex", "none"))
VALUED_DIRECTIVES = frozenset(("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"))
MAIN_WORDS = 100
HOME_WORDS = ("home", "főoldal", "kezdőlap")


class Element:
    __slots__ = ("tag", "attrs", "kids", "up", "place", "first", "last", "order", "end")

    def __init__(self, tag: str, attrs: dict, up: Element | None, place: Place):
        self.tag, self.attrs, self.up, self.place = tag, attrs, up, place
        self.kids: list[Element] = []
        self.first = self.last = self.order = self.end = 0

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def names(self) -> list[str]:
        if "class" not in self.attrs and "id" not in self.attrs:
            return []
        return f"{self.get('class')} {self.get('id')}".lower().split()

    def above(self) -> Iterator[Element]:
        at = self.up
        while at is not None:
            yield at
            at = at.up


class Tree(Tokenizer):
    """all: the elements in order; words: the page's words, and for each the element it stands in."""

    def __init__(self, text: str):
        super().__init__()
        self.root = self.now = Element("", {}, None, Place())
        self.all: list[Element] = []
        self.words: list[str] = []
        self.owner: list[Element] = []
        self.count: dict[str, int] = {}  # open elements by tag
        self.feed(text)
        self.close()
        while self.now.up is not None:
            self._leave()
        self.root.last, self.root.end = len(self.words), len(self.all)

    def handle_starttag(self, tag, attrs):
        for kind in ENDS.get(tag, ()):
            if not self.count.get(kind):
                continue
            at = self.now
            while at.up is not None and at.tag != kind and (at.tag not in BOUNDS or at.tag == tag):
                at = at.up
            if at.up is not None and at.tag == kind:
                while self.now is not at:
                    self._leave()
                self._leave()
        attrs = dict(attrs)
        one = Element(tag, attrs, self.now, placed(self.now.place, tag, attrs))
        one.first, one.order = len(self.words), len(self.all)
        self.all.append(one)
        self.now.kids.append(one)
        self.now = one
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in VOID:
            self._leave()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self.now.tag != tag:
                self._leave()
            self._leave()

    def _leave(self):
        now = self.now
        now.last, now.end = len(self.words), len(self.all)
        self.count[now.tag] -= 1
        self.now = now.up

    def handle_data(self, data):
        if self.now.tag in ("script", "style"):
            return
        words = data.split()
        self.words += words
        self.owner += [self.now] * len(words)

    def inside(self, e: Element) -> list[Element]:
        """The elements below e, in order."""
        return self.all[e.order + 1 : e.end] if e.up is not None else self.all

    def text(self, e: Element) -> str:
        return " ".join(self.words[e.first : e.last])


def noindex(tree: Tree, header: str | None) -> bool:
    """A robots or googlebot meta element, or a line of the X-Robots-Tag header for all agents or googlebot, says noindex or none."""
    said = lambda text: {x.strip().lower() for x in text.split(",")} & NOINDEX
    if any(e.tag == "meta" and e.get("name").lower() in ("robots", "googlebot") and said(e.get("content")) for e in tree.all):
        return True
    for line in (header or "").splitlines():
        m = re.match(r"\s*([^\s:,]+)\s*:(.*)$", line)
        agent = m[1].lower() if m and m[1].lower() not in VALUED_DIRECTIVES else None
        if agent in (None, "googlebot") and said(m[2] if agent else line):
            return True
    return False


def main_content(tree: Tree) -> tuple[str, str]:
    """The page's main text and how it was found: main, article, role, a name of the content's container, the best of div and section, or the body without its frame."""

    def hidden(e: Element) -> bool:
        style = e.get("style").lower().replace(" ", "")
        return e.tag in NOISE or "display:none" in style or "visibility:hidden" in style or any(w in n for n in (e.get("class").lower(), e.get("id").lower()) for w in COOKIE_WORDS)

    # The page without hidden elements: where each word, element, link and paragraph goes.
    gone = bytearray(len(tree.words))
    away = bytearray(len(tree.all))
    for e in tree.all:
        if not away[e.order] and hidden(e):
            gone[e.first : e.last] = b"\1" * (e.last - e.first)
            away[e.order : e.end] = b"\1" * (e.end - e.order)
    sums = lambda values: [0, *accumulate(values)]
    count, letters = sums(1 - g for g in gone), sums(0 if g else len(w) for w, g in zip(tree.words, gone, strict=True))
    seen = sums(1 - a for a in away)
    links, paragraphs = (sums(int(e.tag == tag and not away[e.order]) for e in tree.all) for tag in ("a", "p"))
    n = lambda e: count[e.last] - count[e.first]
    size = lambda e: letters[e.last] - letters[e.first] + max(n(e) - 1, 0)
    text = lambda e: " ".join(w for w, g in zip(tree.words[e.first : e.last], gone[e.first : e.last], strict=True) if not g)
    here = [e for e in tree.all if not away[e.order]]

    for tag in ("main", "article"):
        best = max((e for e in here if e.tag == tag), key=size, default=None)
        if best is not None and n(best) > MAIN_WORDS:
            return text(best), f"semantic_{tag}"
    for e in here:
        if e.get("role").lower() == "main" and n(e) > MAIN_WORDS:
            return text(e), "role_main"
    for name in CONTENT_NAMES:
        e = next((e for e in here if (e.get("id") == name[1:] if name[0] == "#" else name[1:] in e.get("class").split())), None)
        if e is not None and n(e) > MAIN_WORDS:
            return text(e), "content_selector"

    def worth(e: Element) -> float:
        below = slice(e.order + 1, e.end)
        inner = seen[below.stop] - seen[below.start]
        return size(e) / (links[below.stop] - links[below.start] + 1) * (1 + (paragraphs[below.stop] - paragraphs[below.start]) / max(inner, 1))

    best = max((e for e in here if e.tag in ("div", "section") and n(e) > MAIN_WORDS), key=worth, default=None)
    if best is not None:
        return text(best), "readability"
    body = next((e for e in here if e.tag == "body"), tree.root)
    for e in here:
        if e.tag in ("header", "nav", "footer", "aside"):
            gone[e.first : e.last] = b"\1" * (e.last - e.first)
    return text(body), "fallback_body"


def short_type(kind) -> str | None:
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    return ",".join(re.split(r"[/#]", k)[-1] for k in kinds) or None


def add(item: dict, name: str, value) -> None:
    """A property that repeats becomes a list."""
    item[name] = value if name not in item else [*(item[name] if isinstance(item[name], list) else [item[name]]), value]


def _value(tree: Tree, e: Element) -> str:
    """What an element says as a property's value."""
    if e.tag == "meta" or "content" in e.attrs:
        return e.get("content")
    for tags, name in ((("a", "area", "link"), "href"), (("img", "audio", "video", "source", "track", "embed", "iframe"), "src"), (("object",), "data"), (("data", "meter"), "value"), (("time",), "datetime")):
        if e.tag in tags and name in e.attrs:
            return e.get(name)
    return tree.text(e)


def structured_items(tree: Tree) -> list[dict]:
    """Microdata, RDFa and Open Graph items of the page as objects, in this order."""
    skipped = [e for e in tree.all if e.tag in ("template", "noscript")]
    here = [e for e in tree.all if not any(s.order < e.order < s.end for s in skipped)]

    def item(e: Element, opens: str, types: str, key: str, names: tuple[str, ...]) -> dict:
        kinds = e.get(types).split()
        out = {"@type": kinds if len(kinds) > 1 else kinds[0]} if kinds else {}
        for n in names:
            if e.get(n):
                out.setdefault("@id", e.get(n))
        if opens == "typeof" and (vocab := next((x.get("vocab") for x in (e, *e.above()) if x.get("vocab")), None)):
            out["@context"] = vocab
        inner = iter(tree.inside(e))
        skip_to = 0
        for x in inner:
            if x.order < skip_to:
                continue
            nested = opens in x.attrs
            if x.get(key):
                value = item(x, opens, types, key, names) if nested else _value(tree, x)
                for name in x.get(key).split():
                    add(out, name, value)
            if nested:
                skip_to = x.end
        return out

    rows = [("microdata", item(e, "itemscope", "itemtype", "itemprop", ("itemid",))) for e in here if "itemscope" in e.attrs and "itemprop" not in e.attrs]
    rows += [("rdfa", item(e, "typeof", "typeof", "property", ("resource", "about"))) for e in here if "typeof" in e.attrs and not ("property" in e.attrs and any("typeof" in x.attrs for x in e.above()))]
    graph: dict = {}
    for e in here:
        if e.tag == "meta" and e.get("property").startswith(OPEN_GRAPH) and e.get("content"):
            add(graph, e.get("property"), e.get("content"))
    if graph:
        rows.append(("opengraph", graph | ({"@type": graph["og:type"]} if "og:type" in graph else {})))
    return [{"syntax": syntax, "type": short_type(x.get("@type")), "json": json.dumps(x, ensure_ascii=False, sort_keys=True), "ordinal": k} for k, (syntax, x) in enumerate(rows, 1)]


def is_breadcrumb(e: Element) -> bool:
    if not e.attrs:
        return False
    marks = (e.get("class") + " " + e.get("id") + " " + e.get("aria-label")).lower()
    return any(w in marks for w in CRUMB_WORDS) or "breadcrumblist" in e.get("itemtype").lower()


def base_of(tree: Tree, url: str) -> str:
    href = next((e.get("href") for e in tree.all if e.tag == "base" and e.get("href")), "")
    return urljoin(url, href) if href else url


def label_of(tree: Tree, e: Element) -> str:
    images = [x.get("alt") for x in tree.inside(e) if x.tag == "img"]
    return tree.text(e) or next(filter(None, map(tidy, images)), "") or tidy(e.get("aria-label")) or tidy(e.get("title"))


def visible_breadcrumb(tree: Tree, base: str) -> list[dict]:
    """The first breadcrumb that has links: their addresses and texts, then the text after the last, which has no address."""
    for e in filter(is_breadcrumb, tree.all):
        links = [x for x in tree.inside(e) if x.tag == "a" and urlsplit(urljoin(base, x.get("href"))).scheme in ("http", "https") and "href" in x.attrs]
        if links:
            trail = [{"url": urljoin(base, x.get("href")), "label": label_of(tree, x)} for x in links]
            tail = " ".join(tree.words[links[-1].last : e.last]).strip(" /›»>|·-")
            return trail + ([{"url": None, "label": tail}] if tail else [])
    return []


def _side(e: Element) -> bool:
    named = e.tag not in ("body", "html") and ("class" in e.attrs or "id" in e.attrs)
    return e.tag == "aside" or e.get("role").lower() == "complementary" or named and bool({"sidebar", "aside"} & set(re.findall("[a-z0-9]+", " ".join(e.names()))))


def _area(e: Element) -> str | None:
    """The menu area that an element opens."""
    role = e.get("role").lower()
    in_footer = lambda: any(x.tag == "footer" or x.get("role").lower() == "contentinfo" for x in e.above())
    if e.tag == "footer" or role == "contentinfo":
        return "footer"
    if _side(e):
        return None if in_footer() else "sidebar"
    if e.tag in ("header", "nav") or role in ("navigation", "banner"):
        inner = any(x.tag in ("main", "article") or x.get("role").lower() == "main" or _side(x) for x in e.above())
        return None if inner or in_footer() else "header"
    return None


def menu_entries(tree: Tree, base: str) -> list[dict]:
    """Menu items by area, each address once in an area, with the item or label they hang below.

    An item is below another where an element has two children with links, of different tags: one with that item
    alone, the other with the items below. Breadcrumbs, pagers, cards and the main content's own navigation are no
    menus. Addresses' folders aren't used to find parents.
    """
    area: dict[int, str] = {}
    barred: set[int] = set()
    for e in tree.all:
        above = e.up.order if e.up is not None and e.up.up is not None else -1
        pager = any(n.startswith(PAGER_NAMES) for n in e.names()) or "pagination" in e.get("aria-label").lower() or e.tag == "nav" and any(x.tag == "a" and {"next", "prev"} & set(x.get("rel").lower().split()) for x in tree.inside(e))
        if above in barred or is_breadcrumb(e) or pager or e.tag == "article" and above in area:
            barred.add(e.order)
            continue
        here = _area(e) or area.get(above)
        if here:
            area[e.order] = here
    heads = [e for e in tree.all if e.order in area and e.tag == "a" and "href" in e.attrs and not {"next", "prev"} & set(e.get("rel").lower().split())]
    number = {}  # links within each element
    for a in heads:
        for x in (a, *a.above()):
            number.setdefault(x.order, []).append(a)

    def target(a: Element) -> str | None:
        href = a.get("href")
        return None if not href or href.startswith("#") or href.lower().startswith(SKIPPED_SCHEMES) else urljoin(base, href).split("#")[0]

    def marker(a: Element) -> str | None:
        near = [n for x in (a, *list(a.above())[:3]) for n in x.names()]
        if any(re.search(r"\b(logo|brand)\b", n) for n in near) or not tree.text(a) and any(x.tag == "img" for x in tree.inside(a)):
            return "logo"
        return "home_icon" if not tree.text(a) and any(w in (a.get("class") + a.get("aria-label") + a.get("title")).lower() for w in HOME_WORDS) else None

    def leads(a: Element) -> bool:
        """Whether others may hang below a link: it has a text, is no logo and leads to no home page."""
        return bool(label_of(tree, a)) and marker(a) is None and (target(a) is None or urlsplit(target(a)).path not in ("", "/"))

    def parent(a: Element) -> Element | None:
        own = a
        for x in a.above():
            if x.order not in area:
                return None
            linked = [k for k in x.kids if k.order in number]
            if len(linked) == 2 and linked[0].tag != linked[1].tag:
                head, rest = linked if len(number[linked[0].order]) == 1 else linked[::-1]
                if rest is own and len(number[head.order]) == 1 and leads(number[head.order][0]):
                    return number[head.order][0]
            own = x
        return None

    found: dict[tuple, dict] = {}
    for a in heads:
        url = target(a)
        if url is None:
            continue
        up = parent(a)
        row = {"area": area[a.order], "url": url, "label": label_of(tree, a), "parent": None if up is None else target(up) or label_of(tree, up), "parent_is_label": up is not None and target(up) is None, "marker": marker(a)}
        old = found.get((row["area"], url))
        if old is None:
            found[row["area"], url] = row
        elif old["parent"] is None and row["parent"] is not None:
            old.update(parent=row["parent"], parent_is_label=row["parent_is_label"])
    return [row | {"ordinal": k} for k, row in enumerate(found.values(), 1)]


def _where(e: Element) -> str:
    return e.place.landmark or e.place.marked or "body"


def _code(tree: Tree) -> bytearray:
    """For each element, whether it is code or stands in code."""
    off = bytearray(len(tree.all))
    for e in tree.all:
        if e.tag in CODE:
            off[e.order : e.end] = b"\1" * (e.end - e.order)
    return off


def area_texts(tree: Tree) -> list[dict]:
    """Visible text by area without code."""
    off = _code(tree)
    body = next((e for e in tree.all if e.tag == "body"), tree.root)
    areas: dict[str, list[str]] = {}
    for k in range(body.first, body.last):
        e = tree.owner[k]
        if e.up is None or not off[e.order]:
            areas.setdefault(_where(e), []).append(tree.words[k])
    return [{"area": a, "text": " ".join(ws)} for a, ws in sorted(areas.items())]


def image_texts(tree: Tree) -> list[dict]:
    """Alternative texts of images."""
    off = _code(tree)
    return [{"area": _where(e), "text": tidy(e.get("alt"))} for e in tree.all if e.tag == "img" and not off[e.order] and e.get("alt")]


def link_targets(tree: Tree, base: str) -> list[dict]:
    """Links with decoded addresses."""
    off = _code(tree)
    links = [(e, e.get("href")) for e in tree.all if e.tag == "a" and not off[e.order]]
    return [{"area": _where(e), "url": unquote(urljoin(base, h).split("#")[0]), "label": label_of(tree, e)} for e, h in links if h and not h.startswith("#")]


def page_texts(tree: Tree, base: str) -> dict:
    """Visible text by area without code, alternative texts of images, links with decoded addresses."""
    return {"areas": area_texts(tree), "alts": image_texts(tree), "targets": link_targets(tree, base)}


def table_rows(tree: Tree) -> list[dict]:
    """Rows of data tables: the headings above, and each cell with its column's header (of the table's first row of th, else null)."""
    out, path = [], {}
    for e in tree.all:
        if e.tag in HEADINGS:
            path = {k: v for k, v in path.items() if k < HEADINGS[e.tag]} | {HEADINGS[e.tag]: tree.text(e)}
        if e.tag != "table":
            continue
        header: list[str] = []
        for row in (x for x in tree.inside(e) if x.tag == "tr" and next(y for y in x.above() if y.tag == "table") is e):
            cells = [x for x in row.kids if x.tag in ("td", "th")]
            if cells and not header and all(c.tag == "th" for c in cells):
                header = [tree.text(c) for c in cells]
                continue
            out.append({"heading_path": [path[k] for k in sorted(path)], "cells": [{"header": header[i] if i < len(header) else None, "value": tree.text(c)} for i, c in enumerate(cells)], "ordinal": len(out) + 1})
    return out


def _struct(**fields) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_S, _I = pa.string(), pa.int32()
#: What a page's row may hold: each column's types, and what gives it of the tree, its base address and the page's header.
PARTS = {
    "noindex": ("boolean", pa.bool_(), lambda tree, base, robots: noindex(tree, robots)),
    "main_text": ("string", _S, None), "main_method": ("string", _S, None),
    "structured": ("array<struct<syntax:string,type:string,json:string,ordinal:int>>", _struct(syntax=_S, type=_S, json=_S, ordinal=_I), lambda tree, base, robots: structured_items(tree)),
    "menu": (
        "array<struct<area:string,url:string,label:string,parent:string,parent_is_label:boolean,marker:string,ordinal:int>>",
        _struct(area=_S, url=_S, label=_S, parent=_S, parent_is_label=pa.bool_(), marker=_S, ordinal=_I), lambda tree, base, robots: menu_entries(tree, base),
    ),
    "crumbs": ("array<struct<url:string,label:string>>", _struct(url=_S, label=_S), lambda tree, base, robots: visible_breadcrumb(tree, base)),
    "areas": ("array<struct<area:string,text:string>>", _struct(area=_S, text=_S), lambda tree, base, robots: area_texts(tree)),
    "alts": ("array<struct<area:string,text:string>>", _struct(area=_S, text=_S), lambda tree, base, robots: image_texts(tree)),
    "targets": ("array<struct<area:string,url:string,label:string>>", _struct(area=_S, url=_S, label=_S), lambda tree, base, robots: link_targets(tree, base)),
    "rows": (
        "array<struct<heading_path:array<string>,cells:array<struct<header:string,value:string>>,ordinal:int>>",
        _struct(heading_path=pa.list_(_S), cells=_struct(header=_S, value=_S), ordinal=_I), lambda tree, base, robots: table_rows(tree),
    ),
}


def parse_dom(pages: DataFrame, *parts: str) -> DataFrame:
    """pages (page_id, url, html, and x_robots if it is there: the X-Robots-Tag header, a line for each value) -> a row with nested columns for each. A null page is empty.

    Only the parts named are worked out, all of PARTS where none is.
    """
    header = F.col("x_robots") if "x_robots" in pages.columns else F.lit(None).cast("string")
    parts = parts or tuple(PARTS)
    schema = pa.schema([("page_id", pa.int64()), ("url", _S), *((p, PARTS[p][1]) for p in parts)])
    makers = [(p, PARTS[p][2]) for p in parts if PARTS[p][2]]
    main = {"main_text", "main_method"} & set(parts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for page_id, url, html, robots in zip(*(batch.slice(at, 200).column(c).to_pylist() for c in ("page_id", "url", "html", "x_robots")), strict=True):
                    tree = Tree(html or "")
                    base = base_of(tree, url or "")
                    row = {"page_id": page_id, "url": url} | {p: f(tree, base, robots) for p, f in makers}
                    if main:
                        row["main_text"], row["main_method"] = main_content(tree)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", header.alias("x_robots"))
    return rows.mapInArrow(run, ", ".join(("page_id long", "url string", *(f"{p} {PARTS[p][0]}" for p in parts))))
