"""Offers, names, roles, leases and budgets on small cases: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F
from webloom.operators import findings as D
from webloom.operators import offers as O
from webloom.operators import views as V
from webloom.streaming import incremental as I


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


BLOCKS = "page_id long, ordinal int, kind string, text string, first_cell string"


def test_prices_are_named_by_blocks_before(spark):
    data = [
        (1, 1, "heading", "Basic plan", None), (1, 2, "paragraph", "from $ 9", None), (1, 3, "paragraph", "or 100 EUR", None), (1, 4, "code", "Big plan", None), (1, 5, "card", "12 Ft", None),
        (2, 1, "table_row", "Gold · 9 EUR", "Gold · best"), (2, 2, "table_row", "9 EUR", None), (2, 3, "paragraph", "hourly rate 9 EUR", None), (2, 4, "paragraph", None, None),
        (3, 1, "heading", "Far away", None), *[(3, n, "code", "x", None) for n in range(2, 6)], (3, 6, "paragraph", "5 USD", None),
    ]
    assert rows(O.pricing_rows(spark.createDataFrame(data, BLOCKS))) == [(1, 1, "Basic plan"), (2, 1, "Gold")]
    assert rows(O.pricing_rows(spark.createDataFrame([], BLOCKS))) == []


def test_attributes_of_names(spark):
    got = lambda name: tuple(one(spark, O.product_attributes(F.col("n")), n=name))
    assert got("Heater 3,5 kW 3Fázis A+++ CWH09VN-K6DNB6F") == ("3,5 kW", 3, "A+++", "CWH09VN-K6DNB6F")
    assert got("Fan 400m3/h, (1 F)") == ("400 m3/h", 1, None, None)
    assert got("12 W 7kw A+") == ("12 W", None, "A+", None)
    assert got("") == got("plain name") == (None,) * 4


def test_spans_of_names(spark):
    got = lambda text, name: [tuple(x) for x in one(spark, O.surface_spans(F.col("t"), F.col("n")), t=text, n=name)]
    assert got("Élő kő, ÉLŐ  KŐ. élő kövek xélő kő", "élő kő") == [(0, 6), (8, 15)]
    assert got("a.b axb A.B", "a.b") == [(0, 3), (8, 11)] and got(r"x\Ey", r"x\Ey") == [(0, 4)]
    assert got("text", "") == got("", "name") == [] and got("12 name3", "name") == [(3, 7)]


def test_names_of_sites(spark):
    titles = [("s", i, f"Page {i} | Tools - Shop") for i in range(4)] + [("s", i, f"Page {i} | Shop") for i in range(4, 8)] + [("s", 8, None), ("s", 9, " "), ("t", 10, "A - B"), ("s", 8, None)]
    df = spark.createDataFrame(titles, "site string, page_id long, title string")
    assert rows(O.site_names(df)) == [("s", "Shop", 8)]
    assert rows(O.site_names(df.limit(0))) == []


def test_classes(spark):
    entities = spark.createDataFrame([(1, "org", "Q1"), (2, "concept", "Q2"), (3, "concept", "Q3"), (4, "concept", "Q35120"), (5, "org", None), (2, "concept", "Q2")], "entity_id long, type string, kb_id string")
    classes = spark.createDataFrame([("Q1", "P31", "Q2"), ("Q2", "P31", "Q3"), ("Q2", "P279", "Q3"), ("Q3", "P279", "Q1"), ("Q3", "P31", "Q2"), ("Q1", "P31", "Q35120"), ("Q1", "P31", "Q1"), (None, "P31", None)], "kb_id string, property string, class_id string")
    want = [(1, 2, "P31", None), (1, 4, "P31", "generic_class"), (2, 3, "P279", None), (3, 1, "P279", "other_type"), (3, 2, "P31", "instance_of_type")]
    assert rows(O.class_relations(entities, classes)) == want


def test_roles_of_nodes(spark):
    columns = "page_id long, url string, role string, page_type string, types array<string>, is_home boolean, placeholder boolean, legal boolean, has_anchor boolean, list_share double"
    plain = [None, None, None, None, None, None]
    data = [(1, "https://a.hu/kapcsolat", "article", None, *plain), (2, "https://a.hu/recontact", "article", None, *plain), (3, "https://a.hu/x", "support", "category", ["AboutPage"], True, None, None, None, None), (4, None, "support", "category", None, False, False, False, True, 0.9)]
    assert rows(O.node_roles(spark.createDataFrame(data, columns))) == [(1, "support", "contact"), (2, "article", None), (3, "home", None), (4, "category", None)]


def test_evidence(spark):
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail")) for k, d in (("url", ""), ("top_mentions", "7"), ("primary", "0"), ("home", ""))))
    assert one(spark, O.evidence_text(kinds)) == "home; primary#0; top_mentions:7; url"


def test_offers_and_decisions(spark):
    offers = spark.createDataFrame([(1, ["SEO és Content", "seo"]), (2, []), (3, None)], "entity_id long, names array<string>")
    concepts = spark.createDataFrame([(7, "Seo"), (9, "SEO"), (8, "content"), (6, None)], "concept_id long, name string")
    assert rows(O.offer_relations(offers, concepts)) == [(1, 7, "SEO"), (1, 8, "Content")]
    items = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None)], "page_id long, name string, type string")
    answers = spark.createDataFrame([(1, "a", "x", 1, True), (1, "a", "x", 2, False), (1, "b", "x", 1, False), (1, "b", "x", 2, True), (1, "c", "x", 1, False)], "page_id long, name string, type string, run_id int, keep boolean")
    assert rows(O.verified(items, answers)) == [(1, "b", "x"), (1, "c", None)]


def test_filler(spark):
    text = "Lorem ipsum dolor amet " * 5
    data = [(1, "paragraph", "content", text), (1, "title", "content", "one two three " * 20), (2, "paragraph", "content", text + "plain words only " * 9), (3, "paragraph", "chrome", text), (4, "paragraph", "content", None)]
    assert rows(O.filler_pages(spark.createDataFrame(data, "page_id long, kind string, region string, text string"))) == [(1,)]


def test_blocked_on_purpose(spark):
    got = lambda url: one(spark, D.intended_block(F.col("u")), u=url)
    assert [got(f"https://a.hu{p}") for p in ("/cart", "/my-account/x", "/Kereses.php", "/p?filter_x=1", "/p?S=a", "/accounting", "/feedback", "/p?sorted=1", "/", "/wp-json/")] == ["cart", "account", "search", "filter", "search", None, None, None, None, "admin"]


def test_frontier_keeps_smallest_depths(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 3), ("b", 1), ("a", 5)], [("a", 2), (None, 4)]):
        spark.createDataFrame(part, "url string, depth int").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("url string, depth int").option("maxFilesPerTrigger", 1).parquet(source)
        I.frontier(stream, out).option("checkpointLocation", str(tmp_path / "done")).trigger(availableNow=True).start().awaitTermination()
    assert rows(I.frontier_table(spark, out)) == [("a", 2), ("b", 1), (None, 4)]


def test_leases(spark):
    queue = spark.createDataFrame([("a", 1, 0, "queued"), ("b", 0, 1, "queued"), ("c", 0, 0, "done"), ("d", 0, 2, "leased")], "url string, depth int, priority int, status string")
    state = lambda df: {r.url: r.status for r in df.collect()}
    assert state(I.leased(queue, 1)) == {"a": "queued", "b": "leased", "c": "done", "d": "leased"}
    assert state(I.leased(I.reissued(queue), 2)) == {"a": "queued", "b": "leased", "c": "done", "d": "leased"}


def test_budget_and_overrun(spark):
    calls = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 1, 50)], "domain string, at int, cost int")
    assert rows(V.within_budget(calls, ["domain"], ["at"], "cost", 4, 10).select("domain", "at", "spent", "allowed")) == [("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 10, False), ("b", 1, 0, True)]
    runs = [(1, p, p * 10 if p <= 10 else p * 100, 20) for p in range(1, 16)] + [(2, 1, 5, 20)]
    assert rows(V.overrun(spark.createDataFrame(runs, "run_id int, page int, seconds int, expected int"), 5.5)) == [(1, 12), (2, None)]
