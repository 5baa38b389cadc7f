"""Golden values of text and URL functions, and operators on small hand-made sites."""

import time

import pytest
from pyspark.sql import functions as F
from webloom import schemas
from webloom.functions import text as X
from webloom.functions import url as U
from webloom.operators import analytics as A
from webloom.operators import findings as D
from webloom.operators import graph as G
from webloom.operators import links as L
from webloom.operators import pages as P
from webloom.operators import profile as S
from webloom.operators import resolve as R
from webloom.operators import views as V
from webloom.site import Site
from webloom.sources import html as H
from webloom.sources import structured as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,key", [("Straße", "strasse"), ("Measurement &amp; Data", "measurement & data"), ("  É-Terv — Műhely ", "e terv muhely"), (None, None), ("", ""), ("A B", "a b")])
def test_fold(text, key):
    assert X.fold(text) == key


@pytest.mark.parametrize(
    "text,key,span", [("A zq.shop oldal", "zq", None), ("A zq shop", "zq", [2, 4]), ("Az É-Tervező itt", "e tervezo", [3, 12]), ("abc", "", None), (None, "a", None), ("Kimérés", "meres", None), ("Mérés, majd", "meres", [0, 5])]
)
def test_find_key(text, key, span):
    assert X.find_key(text, key) == span


SITES = {"bare": ("x.hu", False, None), "www": ("www.x.hu", False, None), "https": ("x.hu", True, None), "slash": ("x.hu", False, True), "none": ("x.hu", False, False), "full": ("x.hu", True, True), "no": (None, False, None)}
#: Golden cases of addresses: site, address, normal form.
ADDRESSES = [
    ("no", "HTTP://Example.com:80", "http://example.com/"), ("no", "https://x.hu/a?utm_source=f&b=2&a=1#t", "https://x.hu/a?a=1&b=2"), ("no", "https://x.hu/?REF=1&gclid=2", "https://x.hu/"), ("no", "https://x.hu/%7euser/%c3%a9 é", "https://x.hu/~user/%C3%A9%20%C3%A9"),
    ("no", "mailto:a@b.c", None), ("no", "https://", None), ("no", "https://x.hu:99999/", None), ("no", "https://x.hu/a%2Fb+c", "https://x.hu/a%2Fb+c"), ("no", "https://x.hu:8443/a", "https://x.hu:8443/a"),
    ("no", "https://[::1]:8080/a", "https://[::1]:8080/a"), ("full", "http://www.x.hu/a", "https://x.hu/a/"), ("full", "http://www.x.hu/a/b.pdf", "https://x.hu/a/b.pdf"), ("full", "http://other.hu/a/", "http://other.hu/a/"),
    ("bare", "https://X.hu/Rolam", "https://x.hu/Rolam"), ("bare", "https://WWW.X.HU/", "https://x.hu/"), ("www", "https://x.hu/a", "https://www.x.hu/a"), ("bare", "https://en.x.hu/a", "https://en.x.hu/a"), ("bare", "https://www.y.com/a", "https://www.y.com/a"),
    ("https", "http://en.x.hu/a", "https://en.x.hu/a"), ("https", "http://y.com/a", "http://y.com/a"), ("bare", "http://x.hu/a", "http://x.hu/a"), ("bare", "https://x.hu/#", "https://x.hu/"), ("bare", "https://x.hu/a?referrer=x", "https://x.hu/a?referrer=x"),
    ("bare", "https://x.hu/a?utmx=1", "https://x.hu/a?utmx=1"), ("bare", "https://x.hu/a?fbclid&b=1", "https://x.hu/a?b=1"), ("bare", "https://x.hu/a?a=2&a=1", "https://x.hu/a?a=2&a=1"), ("bare", "https://x.hu/a?b=%20&a=x+y", "https://x.hu/a?a=x+y&b=%20"),
    ("bare", "https://x.hu/a?b&a=", "https://x.hu/a?a=&b"), ("bare", "https://x.hu/a?&a=1&", "https://x.hu/a?a=1"), ("bare", "https://x.hu/?", "https://x.hu/"), ("slash", "https://x.hu/a?x=1", "https://x.hu/a/?x=1"), ("none", "https://x.hu/a//", "https://x.hu/a"),
    ("none", "https://x.hu/", "https://x.hu/"), ("slash", "https://x.hu/CV.PDF", "https://x.hu/CV.PDF"), ("slash", "https://x.hu/f.woff", "https://x.hu/f.woff"), ("slash", "https://x.hu/verzio-2.0", "https://x.hu/verzio-2.0/"), ("slash", "https://x.hu/a.aspx", "https://x.hu/a.aspx/"),
    ("slash", "https://y.com/a", "https://y.com/a"), ("bare", "https://x.hu/szép kert", "https://x.hu/sz%C3%A9p%20kert"), ("bare", "https://x.hu/100%/", "https://x.hu/100%25/"), ("bare", "https://x.hu/a:b@c+d,e;f=g", "https://x.hu/a:b@c+d,e;f=g"), ("bare", "https://x.hu/[a]", "https://x.hu/%5Ba%5D"),
    ("bare", "https://x.hu/a%3Ab%2Bc", "https://x.hu/a%3Ab%2Bc"), ("bare", "https://x.hu/k%f6nyv", "https://x.hu/k%F6nyv"), ("bare", "https://x.hu/?%61b=%7Ex%2Dy", "https://x.hu/?ab=~x-y"), ("bare", "https://x.hu/?q=a+b%2Bc%26d%3de&f[0]=1", "https://x.hu/?f[0]=1&q=a+b%2Bc%26d%3De"),
    ("bare", "https://x.hu/?q=k%f6nyv&b={c}", "https://x.hu/?b={c}&q=k%F6nyv"), ("slash", "https://x.hu/doc%2Epdf", "https://x.hu/doc.pdf"), ("bare", "https://x.hu?x=1", "https://x.hu/?x=1"), ("https", "http://x.hu:80/a", "https://x.hu/a"), ("bare", "  https://x.hu/a \n", "https://x.hu/a"),
    ("full", "HTTP://WWW.X.HU:80/Blog?utm_source=fb&b=2&a=1#top", "https://x.hu/Blog/?a=1&b=2"), ("bare", "/rolam", None), ("bare", "https:///rolam", None), ("bare", "https://x.hu:abc/", None), ("bare", "javascript:void(0)", None), ("bare", None, None),
]


def test_normal_addresses(spark):
    rows = spark.createDataFrame([(i, u, *SITES[k]) for i, (k, u, _) in enumerate(ADDRESSES)], "i int, url string, seed string, https boolean, slash boolean")
    out = rows.select("i", U.normalize_site_url("url", F.col("seed"), F.col("https"), F.col("slash")).alias("x"), "seed", "https", "slash")
    got = {r.i: r.x for r in out.collect()}
    assert [(u, got[i]) for i, (_, u, _) in enumerate(ADDRESSES)] == [(u, w) for _, u, w in ADDRESSES]
    again = out.filter("x IS NOT NULL").select("x", U.normalize_site_url("x", F.col("seed"), F.col("https"), F.col("slash")).alias("y"))
    assert all(r.x == r.y for r in again.collect())


def test_internal_addresses(spark):
    cases = [("en.x.hu", "/", "x.hu", True), ("cdn.x.hu", "/a.js", "x.hu", False), ("x.hu", "/cdn-cgi/l/a", "x.hu", False), ("x.hu", "/cdn-cgi-help/", "x.hu", True), ("x.hu.example.com", "/", "x.hu", False), ("x.co.uk", "/", "shop.x.co.uk", True), ("y.co.uk", "/", "shop.x.co.uk", False), ("b.github.io", "/", "a.github.io", False), ("static.x.hu", "/a", "static.x.hu", True)]
    rows = spark.createDataFrame(cases, "host string, path string, seed string, want boolean")
    assert [r.host for r in rows.withColumn("got", U.is_internal(F.col("host"), F.col("path"), F.col("seed"))).filter("got <> want").collect()] == []
    v = F.lit
    assert [one(spark, U.registrable_domain(v(h))) for h in ("WWW.Y.HU", "127.0.0.1", "localhost")] == ["y.hu", "127.0.0.1", "localhost"]
    assert one(spark, U.slash_alternate(v("https://x.hu/a?b"))) == "https://x.hu/a/?b" and one(spark, U.slash_alternate(v("https://x.hu/"))) is None
    assert one(spark, U.folders(v("https://x.hu"))) == ["/"] and one(spark, U.same_page(v("https://x.hu/a/"), v("https://x.hu/a?b")))


@pytest.mark.parametrize(
    "paths,want",
    [(["/", "/a/", "/b/", "/c"], True), (["/a", "/b", "/c/"], False), (["/a/", "/b"], None), (["/", "/cv.pdf"], None), (["/a", "/x.pdf", "/y.html", "/b/"], None), (["/ipad-10.9/", "/v-2.0/", "/c"], True), ([*(f"/n{i}" for i in range(50)), *(f"/s{i}/" for i in range(100))], False), (["/"] * 49 + ["/a/", "/b", "/c"], True)],
)
def test_trailing_slash(spark, paths, want):
    rows = spark.createDataFrame([("s", i, f"https://x.hu{p}") for i, p in enumerate(paths)], "site string, page_id long, url string")
    assert S.trailing_slash(rows).first().trailing_slash is want


def test_native_text(spark):
    v = F.lit
    assert one(spark, X.occurs(v("meres"), v("a meresek"))) and not one(spark, X.occurs(v("meres"), v("kimeres"))) and not one(spark, X.occurs(v("kk"), v("kkx y")))
    assert one(spark, X.without_legal_form(v("Minta Kft."))) == "Minta"
    assert one(spark, X.label_parts(v("Mérés & adat, riport / terv"))) == ["Mérés", "adat", "riport", "terv"]
    assert one(spark, X.title_ending(v("Kapcsolat | Minta Kft"))) == "Minta Kft" and one(spark, X.title_ending(v("Kapcsolat"))) is None
    assert one(spark, X.jaccard(X.tokens(v("a b c")), X.tokens(v("b c d")))) == 0.5 and one(spark, X.jaccard(X.tokens(v("")), X.tokens(v("")))) == 0
    assert one(spark, X.detect_language(v("this is the page that was with them"))) == "en" and one(spark, X.detect_language(v("qq"))) is None
    assert one(spark, X.acronym(v("Search Engine Optimization (SEO)"))).asDict() == {"long": "Search Engine Optimization", "short": "SEO"}
    assert one(spark, X.is_abbreviation(v("seo"), v("search engine optimization"))) and not one(spark, X.is_abbreviation(v("seox"), v("search")))
    assert [one(spark, X.trivial_anchor(v(a))) for a in ("12", "ab", "VII", "Mix", "Szolgáltatás")] == ["anchor_without_letter", "anchor_short", "anchor_roman_numeral", None, None]
    a, b = '<p nonce="1">x</p><!-- generated in 0.1 seconds -->', '<p nonce="2">x</p><!-- generated in 0.2 seconds -->'
    assert one(spark, X.stable_hash(v(a))) == one(spark, X.stable_hash(v(b))) != one(spark, X.stable_hash(v("<p>y</p>")))
    assert one(spark, X.normal_key(v("Tracking and Measurement"))) == one(spark, X.normal_key(v("tracking & measurement")))


def test_text_slots(spark):
    def said(texts, short=False):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.x for r in rows.select("i", X.text_slots(F.col("t"), short).alias("x")).orderBy("i").collect()]

    assert all(x.brackets for x in said(["Írj ide: [IDE_JÖN_A_LINK]", "Welcome to [COMPANY NAME]", "[PLACEHOLDER]", "[COMPANY NAME 2]"]))
    assert not any(x.brackets for x in said(["[1] és [2]", "[OK]", "[Lásd a táblázatot]", "[A]", "[UPDATED 2025]", "[2025 UPDATED]", "[10_20]", "{{ nev }}", "[your name]"]))
    assert [x.lorem for x in said(["Intro. Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod", "the lorem ipsum is filler text", "lorem ipsum lorem ipsum lorem a b c", "in est id ut et sed sit ad non qui ea", ""])] == [True, False, False, False, False]
    assert [x.lorem for x in said(["Qui in ea voluptate", "Culpa qui official", "Lorem", "in est id ut et", "Error in the id of the non member", "Lorem ipsum generator for designers and developers"], True)] == [True, True, False, False, False, False]
    assert [x.cms_default for x in said(["Hello world!", "Mintaoldalak gyűjteménye", "Just another WordPress site"])] == [True, False, True]
    assert [x.slot for x in said(["[Ide jön a leírás]", "Ide jön a szöveg", "(ide jön majd valami)", "Szöveg helye", "Your text here", "ide jön Péter"])] == [True, True, True, True, True, False]


def test_titles(spark):
    v = F.lit
    assert one(spark, X.title_endings(v("Egy | Kettő - Három"))) == ["Kettő - Három", "Három"] and one(spark, X.title_endings(v("Egy-kettő"))) == []
    assert one(spark, X.cut_suffix(v("Mérés - terv | Minta"), F.array(v("minta")))) == "Mérés - terv" and one(spark, X.cut_suffix(v("Mérés | Más"), F.array(v("minta")))) == "Mérés | Más"
    assert one(spark, X.loosely_named(v("data layers"), v("the data layer here"))) and not one(spark, X.loosely_named(v("data layers"), v("data")))
    assert one(spark, X.shares_word(v("marketing terv"), v("marketinges"))) and not one(spark, X.shares_word(v("terv"), v("terv")))
    assert one(spark, X.stable_hash(v("a<!-- WP Rocket x -->"))) == one(spark, X.stable_hash(v("a<!-- took 12 ms -->"))) == one(spark, X.stable_hash(v("a")))


def test_native_urls(spark):
    v = F.lit
    assert one(spark, U.page_url(v("https://x.hu/a/?b#c"))) == "https://x.hu/a" and one(spark, U.canonical_key(v("https://x.hu/a/?b#c"))) == "https://x.hu/a?b"
    assert one(spark, U.registrable_domain(v("a.b.co.uk"))) == "b.co.uk" and one(spark, U.registrable_domain(v("shop.x.hu"))) == "x.hu"
    assert one(spark, U.folders(v("https://x.hu/a/b/c"))) == ["/a/b", "/a", "/"]
    assert one(spark, U.form_differences(v("http://www.x.hu/A/"), v("https://x.hu/a"))) == ["protocol", "www", "trailing_slash", "case"] and one(spark, U.form_differences(v("https://y.hu/"), v("https://x.hu/"))) == []
    assert one(spark, U.relation(v("https://x.hu/a/b"), v("https://x.hu/a"))) == "parent_child" and one(spark, U.relation(v("https://x.hu/a/b"), v("https://x.hu/a/c"))) == "sibling"
    assert one(spark, P.legal_kind(v("https://x.hu/adatvedelmi-nyilatkozat_2"))) == "privacy" and one(spark, P.legal_kind(v("https://x.hu/garancialis-javitas-blog"))) is None
    assert one(spark, P.support_address(v("https://x.hu/hu/Impresszum/"))) and one(spark, P.helper_name(v("https://x.hu/akcios-termekek")))
    assert one(spark, S.phone_countries(v("Tel: +36 30 123 4567, +353 1 234 5678"))) == ["HU", "IE"] and one(spark, S.currency_countries(v("10 GBP vagy 100 Ft"))) == ["GB", "HU"]


PAGE = """<html lang="hu-HU"><head><title>Egy &amp; kettő</title><link rel="canonical" href="/a"><link rel="alternate" hreflang="en" href="https://x.hu/en/"><meta name="robots" content="noindex, follow">
<script type="application/ld+json">{"@graph": [{"@type": "Service", "name": "S", "@id": "https://x.hu/a#s"}, {"@type": ["Article"], "author": {"@type": "Person", "name": "P"}}]}</script><script type="application/ld+json">{broken</script></head>
<body><header><a href="/m">Menü</a></header><div class="sidebar"><a href="mailto:x@y">levél</a><a href="b?c" rel="nofollow"><img alt="Kép"></a></div><main><h1>Cím</h1><p>Első <b>bekezdés<p>második<h3>Mély</h3><ul><li>x<li>y</ul></main>
<footer><a href="https://z.hu/" aria-label="Z"></a></footer><script>var t="</p><a href='/no'>";</script></body></html>"""


def test_parse(spark):
    pages = spark.createDataFrame([(1, "https://x.hu/d/a", PAGE), (2, "https://x.hu/", None), (3, "https://x.hu/q", "<p>unclosed <a href=''>")], "page_id long, url string, html string")
    parsed = H.parse_pages(pages)
    p = {r.page_id: r for r in parsed.collect()}
    assert (p[1].title, p[1].h1, p[1].lang, p[1].canonical, p[1].noindex) == ("Egy & kettő", "Cím", "hu", "/a", True)
    assert [(x.href, x.anchor, x.position, x.nofollow) for x in p[1].links] == [("/m", "Menü", "nav", False), ("b?c", "Kép", "aside", True), ("https://z.hu/", "Z", "footer", False)]
    assert [(b.kind, b.text) for b in p[1].blocks] == [("heading", "Cím"), ("paragraph", "Első bekezdés"), ("paragraph", "második"), ("heading", "Mély"), ("list_item", "x"), ("list_item", "y")]
    assert [x.type for x in p[1].schema] == ["Service", "Article", "invalid"] and p[2].links == [] and p[3].links == []
    assert [r.to_url for r in H.links_of(parsed).orderBy("ordinal").collect()] == ["https://x.hu/m", "https://x.hu/d/b?c", "https://z.hu/"]
    nodes = T.nodes_of(parsed)
    assert sorted(r.type for r in nodes.collect()) == ["Article", "Person", "Service"]


def test_positions():
    """Landmarks, the nearest first; header and footer of a section are none; then names."""
    cases = [
        ("<nav><a href=x>a</a></nav>", "nav"), ("<header><a href=x>a</a></header>", "nav"), ("<article><header><a href=x>a</a></header></article>", "body"), ("<footer><main><a href=x>a</a></main></footer>", "footer"), ("<div role=complementary><a href=x>a</a></div>", "aside"),
        ("<aside><div class=footer><a href=x>a</a></div></aside>", "aside"), ("<div id=site-footer><p class=menu><a href=x>a</a></p></div>", "nav"), ("<section><div class=masthead><a href=x>a</a></div></section>", "body"), ("<section><div class='masthead menu'><a href=x>a</a></div></section>", "nav"),
        ("<body class=sidebar><a href=x>a</a></body>", "body"), ("<nav></nav><a href=x>a</a>", "body"),
    ]
    for text, want in cases:
        parser = H.PageParser()
        parser.feed(text)
        assert [x["position"] for x in parser.done()["links"]] == [want], text


def test_breadcrumbs(spark):
    block = '{"itemListElement": [{"position": 2, "item": {"@id": "https://x.hu/b", "name": "B"}}, {"name": "X", "item": "https://x.hu/x"}, {"position": "1", "name": "A"}]}'
    row = spark.createDataFrame([(block,), (None,)], "b string").select(T.breadcrumb_trail("b").alias("t"), T.breadcrumb_trail_open("b").alias("o")).collect()
    assert [x.name for x in row[0].t] == ["A", "B", "X"] and [x.name for x in row[0].o] == ["A", "B", "X"] and row[1].t == []


def test_robots_and_sitemaps(spark):
    text = "User-agent: A\nUser-agent: *\nDisallow: /x\nAllow: /x/y$ # here\n\nUser-agent: b\nDisallow: /*.pdf\nDisallow:\n"
    rules = H.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    assert sorted(tuple(r) for r in rules.collect()) == [("h", "*", False, "/x"), ("h", "*", True, "/x/y$"), ("h", "a", False, "/x"), ("h", "a", True, "/x/y$"), ("h", "b", False, "/*.pdf")]
    urls = spark.createDataFrame([("h", p) for p in ("/x", "/x/y", "/x/yz", "/q.pdf", "/")], "host string, path string")
    said = lambda agent: {r.path: r.allowed for r in L.robots_decision(urls, rules, agent).collect()}
    assert said("other") == {"/x": False, "/x/y": True, "/x/yz": False, "/q.pdf": True, "/": True} and said("b") == {"/x": True, "/x/y": True, "/x/yz": True, "/q.pdf": False, "/": True}
    xml = "<urlset><url><loc> https://x.hu/?a&amp;b </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x.hu/2</loc></url></urlset>"
    got = H.sitemap_urls(spark.createDataFrame([("s", xml)], "sitemap string, xml string")).orderBy("ordinal").collect()
    assert [(r.loc, r.lastmod) for r in got] == [("https://x.hu/?a&b", "2024-01-01"), ("https://x.hu/2", None)]


def test_graph_loops(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 6), (7, 4), (8, 99)], "page_id long, canonical_id long")
    got = {r.page_id: (r.target, r.issue) for r in G.canonical_targets(chain).collect()}
    assert got == {1: (3, "duplicate"), 2: (3, "duplicate"), 3: (3, None), 4: (None, "loop"), 5: (None, "loop"), 6: (6, None), 7: (None, "loop"), 8: (99, "duplicate")}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (2, 2)], "from_id long, to_id long")
    assert {r.node: r.depth for r in G.depths(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: r.root for r in G.components(edges.toDF("a", "b")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    parents = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4)], "node long, parent long")
    assert {(r.node, r.ancestor, r.level) for r in G.ancestors(parents).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2), (5, 4, 1)}


def test_main_entity(spark):
    rows = [(1, 10, "h1", 3), (1, 10, "primary", 3), (1, 11, "primary", 9), (1, 12, "url", 50), (2, 12, "top_mentions", 1), (3, 13, "anchored", 1), (3, 14, "schema_about", 1), (3, 15, "h1", 1), (3, 15, "primary", 1), (3, 16, "profile", 2)]
    got = G.main_entities(spark.createDataFrame(rows, "page_id long, entity_id long, kind string, mentions long")).collect()
    # An entity that is only on the list of primary ones isn't secondary; of three that might be, two are.
    assert {(r.page_id, r.entity_id, r.role, r.confidence) for r in got} == {(1, 10, "main", "strong"), (2, 12, "main", "weak"), (3, 13, "main", "strong"), (3, 16, "secondary", None), (3, 14, "secondary", None)}


def test_confidence(spark):
    kinds = {1: ["primary"], 2: ["primary", "heading"], 3: ["h1", "url"], 4: ["title"], 5: ["h1", "title"], 6: ["group_primary", "title"], 7: ["group_primary", "inbound_anchor"]}
    rows = [(p, 9, k, 1, 0 if p == 1 else 4 if k == "primary" else None) for p, ks in kinds.items() for k in ks]
    got = G.main_entities(spark.createDataFrame(rows, "page_id long, entity_id long, kind string, mentions long, primary_index int")).collect()
    assert {r.page_id: r.confidence for r in got} == {1: "medium", 2: "medium", 3: "medium", 4: "weak", 5: "weak", 6: "strong", 7: "weak"}


def test_language_pairs_decide_together(spark):
    pages = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 3, True)], "page_id long, pair_id long, first_lang boolean")
    rows = [(1, 20, "primary", 1, 1), (1, 21, "primary", 1, 1), (2, 20, "primary", 1, 1), (2, 22, "primary", 9, 0), (3, 31, "primary", 1, None), (3, 30, "primary", 1, None)]
    got = G.main_entities(spark.createDataFrame(rows, "page_id long, entity_id long, kind string, mentions long, primary_index int"), pages).filter("role = 'main'").collect()
    assert {r.page_id: r.entity_id for r in got} == {1: 20, 2: 22, 3: 30}
    duplicates = spark.createDataFrame([(3, 1)], "page_id long, original_id long")
    mains = spark.createDataFrame([(1, 20, "main"), (3, 30, "main")], "page_id long, entity_id long, role string")
    assert {tuple(r) for r in G.inherited(mains, duplicates).collect()} == {(1, 20, "main"), (3, 20, "main")}


def test_weights(spark):
    mentions = spark.createDataFrame([(1, 7, "h1", "content", False, 1), (1, 7, "body", "content", False, 2), (2, 7, "body", "chrome", False, 1), (3, 7, "body", "content", True, 1), (4, 7, "anchor", "content", False, 1), (5, 8, "body", "content", False, 1), (9, 7, "h1", "content", False, 1)], "page_id long, entity_id long, position string, region string, skip boolean, n int")
    mains = spark.createDataFrame([(1, 7, "main"), (2, 7, "secondary"), (9, 7, "main")], "page_id long, entity_id long, role string")
    inbound = spark.createDataFrame([(1, "g", True), (1, "g", True), (1, "g", False), (1, "g", False), (1, "k", False), (9, "g", True)], "to_page_id long, group string, body boolean")
    got = {r.entity_id: r for r in G.entity_weights(mentions, mains, inbound, spark.createDataFrame([(9,)], "page_id long")).collect()}
    from math import log2

    assert [got[7][c] for c in ("pages", "mentions", "structural", "main_pages", "secondary_pages", "content_anchors", "nav_anchors")] == [2, 4, 2, 1, 1, 2, 2]
    assert got[7].weight == round(log2(3) + 0.5 * log2(5) + log2(3) + 2 * log2(2) + 0.5 * log2(3) + 0.1 * log2(3), 4) and got[8].weight == round(0.25 * (1 + 0.5), 4)


def test_chain_levels(spark):
    items = spark.createDataFrame([("a", "x", None), ("a", "y", "x"), ("a", "z", "y"), ("b", "y", None), ("a", "p", "q"), ("a", "q", "p")], "area string, key string, parent string")
    assert {(r.area, r.key, r.level) for r in G.chain_levels(items, ["area"]).collect()} == {("a", "x", 0), ("a", "y", 1), ("a", "z", 2), ("b", "y", 0), ("a", "p", 1), ("a", "q", 1)}


def test_votes_and_merges(spark):
    signals = spark.createDataFrame([("a", "tld", "HU"), ("a", "phone", "HU"), ("a", "schema", "HU"), ("a", "og_locale", "US"), ("b", "hreflang", "DE"), ("b", "hreflang", "AT")], "site string, kind string, country string")
    assert {tuple(r) for r in S.target_countries(signals).collect()} == {("a", "HU", "high"), ("b", None, None)}
    rows = [(1, "k", "core", None, "llm", 5, None), (2, "k", None, 7, "llm", 1, None), (3, "k", None, 8, "schema", 9, None), (4, "k", "step", None, "rule", 2, None)]
    made = spark.createDataFrame(rows, "entity_id long, key string, tier string, anchor_page_id long, source string, mentions long, subtype string")
    assert {(r.kept_id, r.removed_id) for r in R.merges(made, ["key"], "x").collect()} == {(3, 1), (3, 4)}


def test_findings(spark):
    pages = spark.createDataFrame([(1, 700), (2, 10)], "page_id long, words int")
    heads = spark.createDataFrame([(1, 1, 1, "A"), (1, 1, 3, "B"), (1, 3, 5, "C")], "page_id long, level int, ordinal int, text string")
    blocks = spark.createDataFrame([(1, 1, 1, 1), (1, 2, None, 5), (1, 3, 1, 1), (1, 4, None, 9), (1, 5, 3, 1)], "page_id long, ordinal int, level int, words int")
    found = D.numbered([D.heading_findings(pages, A.sections(blocks), heads)])
    got = [(r.finding_id, r.type, r.page_id) for r in found.orderBy("finding_id").collect()]
    assert got == [(1, "missing_h1", 2), (2, "multiple_h1", 1), (3, "empty_section", 1), (4, "skipped_level", 1), (5, "missing_h2", 1)]
    mains = spark.createDataFrame([(p, 9, "strong", "main") for p in (1, 2, 3)], "page_id long, entity_id long, confidence string, role string")
    titled = spark.createDataFrame([(1, "hu", "https://x/1", "Alfa beta gamma"), (2, "hu", "https://x/2", "alfa Beta gamma"), (3, "hu", "https://x/3", "more")], "page_id long, lang string, url string, title string")
    assert [(r.type, r.severity, r.evidence) for r in D.cannibalization(mains, titled).collect()] == [("cannibalization", "medium", "hu:3")]


def test_site(spark, tmp_path):
    site = Site(spark, str(tmp_path))
    site.load_pages(spark.createDataFrame([(1, "https://x.hu/", '<a href="/a">A</a>'), (2, "https://x.hu/a", "<p>b")], "page_id long, url string, html string"))
    assert {r.page_id: (r.inbound, r.outbound) for r in site.page_facts().collect()} == {1: (0, 1), 2: (1, 0)}
    site.write("findings", spark.createDataFrame([(1, "missing_h1", "high", 1, None, "s", "e")], schemas.schema("findings")))
    bad = spark.createDataFrame([(1, "missing_h1", "odd", 1, None, "s", "e")], schemas.schema("findings"))
    with pytest.raises(Exception, match="severity"):
        site.write("findings", bad)
    assert site.table_rows("findings").first().severity == "high"
    V.write_csv(site.read("links"), str(tmp_path / "csv"), ["from_page_id", "ordinal"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1


def test_same_for_any_partitions(spark):
    from webloom.plans import registry

    key, results = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in ("1", "7"):
        spark.conf.set(key, n)
        results.append(registry.queries()["all_findings"](spark, "/root/testdata/sf0.001").orderBy("finding_id").collect())
    spark.conf.set(key, before)
    assert results[0] == results[1]


@pytest.mark.parametrize(
    "form,text,cut,want",
    [("Tracking and Measurement", "Tracking & Measurement szolgáltatás", False, True), ("Eterv", "E-Terv", False, True), ("Mérés", "Kimérés", False, False), ("Google Tag Manager beállítás", "Tag Manager | Minta", False, True), ("Keresőoptimalizálás webáruházaknak", "Keresőoptimalizálás webáruhá", True, True), ("Keresőoptimalizálás webáruházaknak", "Keresőoptimalizálás webáruhá", False, False), ("x", None, False, False)],
)
def test_named(spark, form, text, cut, want):
    row = spark.createDataFrame([([form], text)], "forms array<string>, text string")
    assert X.with_named(row, "x", "forms", "text", cut).first().x == want


def test_more_findings(spark):
    make = spark.createDataFrame
    kinds = lambda df: sorted((r.type, r.severity, r.page_id) for r in df.collect())
    assert kinds(D.h1_outside_content(make([(1, 1, "chrome", "a"), (2, 1, "chrome", "b"), (2, 1, "content", "c")], "page_id long, level int, region string, text string"))) == [("h1_outside_content", "medium", 1)]
    legal = D.legal_pages(make([("s", "terms")], "site string, kind string"), make([(4, "privacy", False), (5, "contact", True)], "page_id long, kind string, in_footer boolean"))
    assert {(r.severity, r.page_id) for r in legal.collect()} == {("low", 4), ("medium", None)}
    assert kinds(D.soft_404(make([(1, "not_found"), (2, "other")], "page_id long, page_type string"))) == [("soft_404", "medium", 1)]
    assert len(D.schema_id_names(make([("#a", ["x", "y"])], "id string, names array<string>")).collect()) == 1
    assert kinds(D.article_markup(make([("s", 1, "article", True), ("s", 2, "offer", True), ("s", 3, "offer", False)], "site string, page_id long, role string, has_article boolean"))) == [("article_markup_on_other_pages", "medium", 2)]
    homes = make([("hu", "https://x.hu/"), ("en", "https://x.hu/en/")], "lang string, url string")
    assert kinds(D.breadcrumb_foreign_home(make([(1, "en", "https://x.hu/"), (2, "hu", "https://x.hu/")], "page_id long, lang string, first_url string"), homes)) == [("breadcrumb_foreign_home", "low", 1)]
    items = make([("en", "header", "Home", "https://x.hu/"), ("hu", "header", "Gone", "https://x.hu/g")], "lang string, area string, anchor string, url string")
    states = make([("https://x.hu/g", 404, "https://x.hu/g"), ("https://x.hu/", 200, "https://x.hu")], "url string, status int, final_url string")
    assert [r.type for r in D.menu_targets(items, states, homes).collect()] == ["menu_home_target", "menu_broken_target"]
    crumbs = make([(i, "k", ["home"]) for i in range(3)], "page_id long, key string, steps array<string>")
    assert len(D.breadcrumb_ignores_menu(make([("k", "p")], "key string, parent string"), crumbs).collect()) == 1
    links = make([(1, "https://x.hu/cart/a", "/cart", False, True, "nav"), (2, "https://x.hu/b", "/b", False, True, "body"), (3, "https://x.hu/c", None, True, True, "nav")], "to_page_id long, to_url string, pattern string, allowed boolean, indexable boolean, position string")
    assert sorted(r.severity for r in D.robots_blocked_links(links).collect()) == ["high", "low"]
    rules = make([("h", "googlebot", False, "/"), ("h", "gptbot", False, "/"), ("h", "bingbot", False, "/x")], "host string, agent string, allow boolean, pattern string")
    assert sorted((r.evidence, r.severity) for r in D.robots_blocked_bots(rules).collect()) == [("h:googlebot", "high"), ("h:gptbot", "low")]
    pages = make([(1, "Más", "Mérés és adat", 7, "Mérés"), (2, "Mérés", "x", 7, "Mérés")], "page_id long, title string, text string, entity_id long, name string")
    assert [(r.page_id, r.evidence) for r in D.title_without_main_entity(pages).collect()] == [(1, "visible only")]
    assert kinds(D.title_mismatch(pages.withColumnRenamed("text", "h1"))) == [("h1_title_mismatch", "high", 1), ("h1_title_mismatch", "medium", 2)]
    forms = D.link_forms(make([(1, 2, "http://x.hu/a", "https://x.hu/a", "nav"), (1, 3, "https://x.hu/b", "https://x.hu/b", "nav")], "from_page_id long, to_page_id long, raw_url string, stored_url string, position string"), F.lit(False))
    assert [(r.page_id, r.severity, r.evidence) for r in forms.collect()] == [(2, "medium", "protocol:1")]


def test_filler_in_long_texts(spark):
    """A text's words are found once, not once for each window: 20,000 words took minutes. Other cases of letters count in texts that aren't ASCII."""
    plain, lorem = "word other thing " * 7000, "lorem ipsum dolor one two three four five six sit amet consectetur"
    texts = [plain, f"{plain}{lorem}", "ipsum " * 9, "HELLO World !", "\u017fample page", "Your Text Here", "SZ\u00d6VEG helye", "your text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    began = time.time()
    got = [(r.x.lorem, r.x.cms_default, r.x.slot) for r in rows.select("i", X.text_slots(F.col("t")).alias("x")).orderBy("i").collect()]
    assert time.time() - began < 40
    no = (False, False, False)
    assert got == [no, (True, False, False), no, (False, True, False), (False, True, False), (False, False, True), (False, False, True), no]
