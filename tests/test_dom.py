"""Element trees on hand-made pages."""

import json
import os
from html.parser import HTMLParser

import pytest
from webloom.plans import registry
from webloom.sources import dom as D
from webloom.sources import html as H

TOP = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

PAGE = """<html><head><base href="https://x.hu/b/"><meta property="og:type" content="article"><meta property="og:image" content="a"><meta property="og:image" content="b"></head><body>
<header><a class="logo" href="/"><img alt="X"></a><nav><ul><li><a href="/a">A</a><ul><li><a href="/a/1">A1</a><li><a href="/a/2">A2</a></ul></li><li><a href="#">Több</a><ul><li><a href="c">C</a></ul></li><li><a href="mailto:x">m</a></ul></nav></header>
<div class="breadcrumb"><a href="/">Home</a> / <a href="/a">A</a> › Most</div><main><h1>Egy</h1><p>short text</p><table><tr><th>K<th>V<tr><td>a<td>1<tr><td>b<td>2</table><pre>code</pre>
<div itemscope itemtype="https://schema.org/Product" itemid="#p"><span itemprop="name">N</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="5"></div><a itemprop="url" href="/p">l</a></div>
<div vocab="https://schema.org/" typeof="Person"><span property="name">Z</span></div><nav><a href="/in">in</a></nav></main><aside><ul class="pagination"><li><a href="?page=2">2</a></ul><article><a href="/card">card</a></article></aside>
<footer><a href="/f#x">F</a><div class="cookie-bar">cookies</div></footer></body></html>"""
TREE = D.Tree(PAGE)
BASE = D.base_of(TREE, "https://x.hu/q")


def test_menu():
    got = [(m["area"], m["url"], m["label"], m["parent"], m["parent_is_label"], m["marker"]) for m in D.menu_entries(TREE, BASE)]
    assert got == [
        ("header", "https://x.hu/", "X", None, False, "logo"), ("header", "https://x.hu/a", "A", None, False, None), ("header", "https://x.hu/a/1", "A1", "https://x.hu/a", False, None),
        ("header", "https://x.hu/a/2", "A2", "https://x.hu/a", False, None), ("header", "https://x.hu/b/c", "C", "Több", True, None), ("footer", "https://x.hu/f", "F", None, False, None),
    ]


def test_breadcrumb_and_tables():
    assert [(c["url"], c["label"]) for c in D.visible_breadcrumb(TREE, BASE)] == [("https://x.hu/", "Home"), ("https://x.hu/a", "A"), (None, "Most")]
    assert [[(c["header"], c["value"]) for c in r["cells"]] for r in D.table_rows(TREE)] == [[("K", "a"), ("V", "1")], [("K", "b"), ("V", "2")]]
    assert D.table_rows(TREE)[0]["heading_path"] == ["Egy"]
    assert D.visible_breadcrumb(D.Tree("<div class=breadcrumb>no link</div>"), "https://x.hu/") == []


def test_structured_items():
    rows = D.structured_items(TREE)
    assert [(r["syntax"], r["type"]) for r in rows] == [("microdata", "Product"), ("rdfa", "Person"), ("opengraph", "article")]
    product, person, graph = (json.loads(r["json"]) for r in rows)
    assert product["offers"] == {"@type": "https://schema.org/Offer", "price": "5"} and (product["@id"], product["name"], product["url"]) == ("#p", "N", "/p")
    assert person == {"@context": "https://schema.org/", "@type": "Person", "name": "Z"} and graph["og:image"] == ["a", "b"]
    assert [r["type"] for r in D.structured_items(D.Tree("<template><div itemscope itemtype=x></div></template><div itemscope itemtype='https://a/B https://a/C'></div>"))] == ["B,C"]


def test_main_content():
    long = "word " * 101
    how = lambda text: D.main_content(D.Tree(text))[1]
    assert how(f"<main>{long}</main><article>{long}{long}</article>") == "semantic_main" and how(f"<main>x</main><article>{long}</article>") == "semantic_article"
    assert how(f"<div role=main>{long}</div>") == "role_main" and how(f"<div class='a content'>{long}</div>") == "content_selector" and how(f"<div>{long}</div>") == "readability"
    # Many links make a block a poor text.
    assert D.main_content(D.Tree(f"<div id=a>{'<a>link</a> ' * 300}</div><section>{long}</section>"))[0] == long.strip()
    assert D.main_content(D.Tree("<body><nav>n</nav>a <b>b</b><div class=cookie-x>c</div><p style='display: none'>d<footer>e</footer></body>")) == ("a b", "fallback_body")
    assert D.main_content(D.Tree("")) == ("", "fallback_body")


def test_noindex():
    none = D.Tree("<meta name=description content=noindex>")
    said = [D.noindex(none, h) for h in (None, "noindex", "googlebot: noindex", "other: none", "max-snippet: 5, noindex", "x: a\nnone", "nofollow")]
    assert said == [False, True, True, False, True, True, False]
    assert D.noindex(D.Tree("<meta name=Googlebot content='NOFOLLOW, None'>"), None)


def test_texts():
    texts = D.page_texts(TREE, BASE)
    assert {a["area"]: a["text"] for a in texts["areas"]}["body"] == "Egy short text K V a 1 b 2 N l Z"
    assert texts["alts"] == [{"area": "nav", "text": "X"}] and {"area": "footer", "url": "https://x.hu/f", "label": "F"} in texts["targets"]
    assert D.page_texts(D.Tree("<p>a <code>b</code><img alt='  '><a href='#x'>c</a><a href='/%C3%A9'>d</a>"), "https://x.hu/") == {"areas": [{"area": "body", "text": "a c d"}], "alts": [], "targets": [{"area": "body", "url": "https://x.hu/é", "label": "d"}]}


#: What a query over shop pages asks of their trees.
ASKED = {"area_texts": ["areas"], "image_texts": ["alts"], "link_areas": ["targets"], "menu_items": ["menu"], "noindex_pages": ["noindex"], "structured_items": ["structured"], "visible_breadcrumbs": ["crumbs"]}


@pytest.mark.parametrize("name", ASKED)
def test_queries_ask_for_their_part_on_all_cores(spark, monkeypatch, name):
    real, seen = D.parse_dom, []
    monkeypatch.setattr(D, "parse_dom", lambda pages, *parts: seen.append((list(parts), pages.rdd.getNumPartitions())) or real(pages, *parts))
    registry.queries()[name](spark, TOP)
    ((parts, partitions),) = seen
    assert parts == ASKED[name] and partitions >= 4 * spark.sparkContext.defaultParallelism


def test_parts_are_those_of_the_whole_row(spark):
    pages = spark.createDataFrame([(1, "https://x.hu/q", PAGE, "noindex"), (2, None, None, None)], "page_id long, url string, html string, x_robots string")
    whole = {r.page_id: r for r in D.parse_dom(pages).collect()}
    assert set(whole[1].asDict()) == {"page_id", "url", *D.PARTS} and whole[2].main_method == "fallback_body"
    for part in D.PARTS:
        assert {r.page_id: r[part] for r in D.parse_dom(pages, part).collect()} == {k: r[part] for k, r in whole.items()}


def calls(base, text):
    """What a tokenizer calls, in order."""
    out = []
    said = {f"handle_{n}": lambda self, *a, n=n: out.append((n, *(list(x) if isinstance(x, (list, tuple)) else x for x in a))) for n in ("starttag", "endtag", "data", "comment", "decl", "pi")}
    one = type("One", (base,), said)()
    one.feed(text)
    one.close()
    return out


def test_tokenizer_calls_as_the_standard_one():
    odd = ["a &lt b &am", "<p>a<", "<P CLASS='x' id=y checked/>z</P >", '<a href="a&amp;b>c" alt>t</a>', "<script>a<b></p></SCRIPT >c", "<style>a", "<!doctype html><!-- a > b --><!x><?pi?>", "<p a=1", "</>< p>&#65;", '<p a="1"b="2" =c>d']
    for text in (PAGE, *odd, *(a + b for a in odd for b in odd)):
        assert calls(H.Tokenizer, text) == calls(HTMLParser, text)
