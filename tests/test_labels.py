"""Acronyms, requests, markup, headings and items on small cases: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F
from webloom.operators import labels as B
from webloom.operators import resolve as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_parts_of_names(spark):
    assert one(spark, B.expansions, " Search Work (SEO)") == ["Search Work", "SEO"]
    assert one(spark, B.expansions, "Plain (words)") == one(spark, B.expansions, "") == []
    assert one(spark, B.long_form, "GEO (Generative Engines)") == "Generative Engines" and one(spark, B.long_form, "GEO") is None and one(spark, B.long_form, None) is None


def test_meanings_of_acronyms(spark):
    texts = ["Is Generative Engine Work (GEW) here, generative engine work (GEW)?", "AB (Alpha beta) and AB (alpha gamma delta)", "Ötös Ágy (ÖÁ)", "Other Words (XY)", None, "", "no brackets", "we all do use big red Bright Cat Dog Eel Fox Gnu (BCDEFG)"]
    want = [("AB", "Alpha beta", 1), ("BCDEFG", "Bright Cat Dog Eel Fox Gnu", 1), ("GEW", "Generative Engine Work", 2), ("ÖÁ", "Ötös Ágy", 1)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows(B.acronym_meanings(df)) == want
    assert rows(B.acronym_meanings(df.limit(0))) == []


def test_requests(spark):
    key = lambda t: one(spark, B.request_key, t)
    assert key("https://k/a?q=Big%20%20Cat&titles=B|a%7CA") == key("https://k/a?q=big+cat&titles=a|b")
    assert key("https://k/a?q=x") != key("https://k/b?q=x") and key("https://k/a") == "https://k/a?" and key("https://k/a?q=100%") == "https://k/a?q=100%25"


def test_markup(spark):
    data = [(1, "offer", ["Article", "Article"]), (2, "offer", ["Article", "Product"]), (3, "article", ["Service", "Product"]), (4, "article", None), (5, None, ["Article"]), (6, "home", ["Article"])]
    assert rows(B.markup_contradictions(spark.createDataFrame(data, "page_id long, role string, types array<string>"))) == [(1, "article", "Article"), (3, "thing", "Product, Service")]


def test_headings(spark):
    heads = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (1, 5, 14), (2, 1, 10), (1, 6, None)], "page_id long, ordinal int, entity_id long")
    mains = spark.createDataFrame([(1, 10, "main"), (2, 11, "secondary")], "page_id long, entity_id long, role string")
    relations = spark.createDataFrame([(10, 11), (12, 10), (13, 99), (10, 99), (13, 99), (14, 98)], "from_id long, to_id long")
    got = {(p, o): r for p, o, _, r in rows(B.heading_relations(heads, mains, relations))}
    assert got == {(1, 1): "main", (1, 2): "related", (1, 3): "related", (1, 4): "related", (1, 5): "unrelated", (2, 1): "no_main", (1, 6): "unrelated"}


def test_items_above(spark):
    urls = ["https://a.hu/", "https://a.hu/c", "https://a.hu/c/", "https://a.hu/c/d/e", "https://a.hu/cd", "https://b.hu/c/d"]
    got = dict(tuple(r)[1:] for r in rows(B.items_above(spark.createDataFrame([("m", u) for u in urls], "level string, url string"))))
    assert got == {u: "https://a.hu/c/" if u.endswith("/e") else None for u in urls}


def test_structured_and_links(spark):
    ld = spark.createDataFrame([(1, 1, "B", "{}"), (1, 0, "A", "{}")], "page_id long, ordinal int, type string, json string")
    items = spark.createDataFrame([(1, 0, "rdfa", "C", None)], "page_id long, ordinal int, syntax string, type string, json string")
    assert [r[1:4] for r in rows(B.structured_in_order(ld, items))] == [(0, "jsonld", "A"), (1, "jsonld", "B"), (2, "rdfa", "C")]
    links = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", None), (1, 2, None, None)], "from_page_id long, ordinal int, to_url string, to_page_id long")
    more = links.withColumn("to_page_id", F.when(F.col("ordinal") < 2, F.coalesce("to_page_id", F.lit(7))))
    assert [r[3:] for r in rows(B.link_rows(links, more))] == [(5, "stored"), (7, "inferred"), (None, "none")]


def test_aligned_headings(spark):
    pages = {1: "2332232", 2: "233232", 3: "3", 4: "32323"}
    heads = [(p, p * 100 + i, i, int(x)) for p, levels in pages.items() for i, x in enumerate(levels)]
    pairs = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (1, 4), (1, 9)], "left_id long, right_id long")
    got = rows(B.aligned_headings(pairs, spark.createDataFrame(heads, "page_id long, block_id long, ordinal int, level int")))
    own = [(1, 1, 100 + i, 100 + i) for i in range(7)]
    # 1 has sections of 2, 0, 1 and 0 headings below, 2 has 2, 1, 0: one from the front, two from the back. 4 has 1, 1.
    assert got == sorted(own + [(1, 2, 100, 200), (1, 2, 101, 201), (1, 2, 102, 202), (1, 2, 104, 203), (1, 2, 105, 204), (1, 2, 106, 205)])


def test_people_of_two_words(spark):
    people = spark.createDataFrame([(1, "Anna Kiss"), (2, "KISS Anna"), (3, "Anna Mária Kiss"), (4, "Kiss Mária Anna"), (5, "Anna"), (6, "anna"), (7, None)], "entity_id long, name string")
    assert rows(R.person_merges(people, 2)) == [(1, 2)]
    assert rows(R.person_merges(people)) == [(1, 2), (3, 4), (5, 6)]
