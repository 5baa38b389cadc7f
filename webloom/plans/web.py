"""Queries over raw web pages and texts: parsing, links, addresses, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import analytics as A
from ..operators import findings as D
from ..operators import links as L
from ..sources import html as H
from .projections import query, table

UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
TITLE = UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")
H1 = UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
KEY = "regexp_replace(regexp_replace({}, '[?#].*$', ''), '/+$', '')"
HOST = "lower(regexp_extract({}, '^[a-zA-Z]+://([^/?#:]+)', 1))"
PATH = "regexp_extract({}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


def parsed(s, d):
    return H.parse_pages(table(s, d, "pages"))


@query("parsed_pages", f"SELECT page_id, trim({TITLE}) AS title, trim({H1}) AS h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages")
def _(s, d):
    return parsed(s, d).select("page_id", "title", "h1", "lang", F.size("links").cast("long").alias("links"))


LINK_ROWS = f"""a AS (SELECT page_id AS from_page_id, url AS from_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
k AS (SELECT from_page_id, regexp_extract(from_url, '^([a-zA-Z]+://[^/?#]+)', 1) || {UNESCAPE.format("href")} AS to_url FROM a),
g AS (SELECT {KEY.format('url')} AS key, min(page_id) AS to_page_id FROM pages GROUP BY ALL),
r AS (SELECT k.*, to_page_id FROM k LEFT JOIN g ON {KEY.format('to_url')} = g.key),
c AS (SELECT from_page_id, to_url, to_page_id FROM r GROUP BY ALL)"""


def counted_links(s, d):
    return L.counted(L.resolved(H.links_of(parsed(s, d)), table(s, d, "pages").select("page_id", "url")))


@query(
    "page_facts",
    f"""WITH {LINK_ROWS}, o AS (SELECT from_page_id, count(*) AS outbound, count(*) FILTER (WHERE to_page_id = from_page_id) AS self_links FROM c GROUP BY ALL),
    i AS (SELECT to_page_id, count(*) AS inbound, count(DISTINCT from_page_id) AS referrers FROM c WHERE to_page_id IS NOT NULL AND to_page_id <> from_page_id GROUP BY ALL)
    SELECT page_id, url, coalesce(outbound, 0)::BIGINT AS outbound, coalesce(self_links, 0)::BIGINT AS self_links, coalesce(inbound, 0)::BIGINT AS inbound, coalesce(referrers, 0)::BIGINT AS referrers
    FROM pages LEFT JOIN o ON page_id = from_page_id LEFT JOIN i ON page_id = i.to_page_id""",
)
def _(s, d):
    return L.page_facts(table(s, d, "pages").select("page_id", "url"), counted_links(s, d))


@query("link_targets", f"WITH {LINK_ROWS} SELECT to_url, count(DISTINCT from_page_id)::BIGINT AS pages FROM r GROUP BY to_url")
def _(s, d):
    return H.links_of(parsed(s, d)).groupBy("to_url").agg(F.countDistinct("from_page_id").alias("pages"))


@query("link_positions", "SELECT page_id, 'nav' AS position, len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a '))::BIGINT AS n FROM pages WHERE html LIKE '%<nav>%<a %'")
def _(s, d):
    return H.links_of(parsed(s, d)).filter("position = 'nav'").groupBy(F.col("from_page_id").alias("page_id"), "position").agg(F.count(F.lit(1)).alias("n"))


@query("page_addresses", f"SELECT page_id, {HOST.format('url')} AS host, {PATH.format('url')} AS path, {KEY.format('url')} AS page_url, nullif(regexp_extract({PATH.format('url')}, '^/([a-z][a-z])(/|$)', 1), '') AS lang, regexp_matches(url, '[?&](page|paged|p)=[0-9]+') AS paginated FROM pages")
def _(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.page_url(u).alias("page_url"), U.path_language(u).alias("lang"), U.is_pagination(u).alias("paginated"))


@query("normalized_addresses", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\\1', 'g'), '([?&])&+', '\\1', 'g'), '[?&]+$', ''), '^(https?://[^/]+)$', '\\1/') AS url FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", U.normalize_url("url").alias("url"))


@query("registrable_domains", f"SELECT array_to_string(list_slice(string_split({HOST.format('url')}, '.'), -2, -1), '.') AS domain, count(*)::BIGINT AS pages, count(DISTINCT {HOST.format('url')})::BIGINT AS hosts FROM pages GROUP BY ALL")
def _(s, d):
    h = U.host(F.col("url"))
    return table(s, d, "pages").groupBy(U.registrable_domain(h).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(h).alias("hosts"))


@query(
    "address_forms",
    f"""WITH p AS (SELECT page_id, url, 'https://' || regexp_replace({HOST.format('url')}, '^www[.]', '') || coalesce(nullif(regexp_replace({PATH.format('url')}, '/+$', ''), ''), '/') AS stored FROM pages)
    SELECT page_id, array_to_string(list_filter([CASE WHEN url LIKE 'http:%' THEN 'protocol' END, CASE WHEN {HOST.format('url')} LIKE 'www.%' THEN 'www' END, CASE WHEN {PATH.format('url')} LIKE '%/' AND {PATH.format('url')} <> '/' THEN 'trailing_slash' END], lambda x: x IS NOT NULL), ',') AS forms FROM p""",
)
def _(s, d):
    u = F.col("url")
    cut = F.regexp_replace(U.path(u), "/+$", "")
    stored = F.concat(F.lit("https://"), F.regexp_replace(U.host(u), r"^www\.", ""), F.when(cut == "", "/").otherwise(cut))
    return table(s, d, "pages").select("page_id", F.array_join(U.form_differences(u, stored), ",").alias("forms"))


@query("page_languages", "SELECT lang, pages, row_number() OVER (ORDER BY pages DESC, lang)::BIGINT AS place FROM (SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, count(*)::BIGINT AS pages FROM pages GROUP BY ALL)")
def _(s, d):
    n = parsed(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    return A.identified(n, "place", [F.desc("pages"), F.asc("lang")])


@query("robots_decisions", f"""WITH p AS (SELECT DISTINCT {HOST.format('url')} AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '#.*$', '') AS path FROM pages), r AS (SELECT host, path, CASE WHEN regexp_matches(path, '^/en/.*[?]page=') THEN '/en/*?page=' WHEN path LIKE '/en/%' THEN '/en/' WHEN path LIKE '/de/%' THEN '/de/' END AS pattern FROM p) SELECT host, path, pattern IS NULL OR pattern = '/en/' AS allowed, pattern FROM r""")
def _(s, d):
    hosts = table(s, d, "pages").select(U.host(F.col("url")).alias("host")).distinct()
    body = "User-agent: *\nDisallow: /en/*?page=\nAllow: /en/\nDisallow: /de/\nUser-agent: examplebot\nUser-agent: other\nDisallow: /fr/$\nDisallow: /es/9 # nines\n"
    rules = H.robots_rules(hosts.withColumn("text", F.lit(body)))
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "#.*$", "")
    return L.robots_decision(table(s, d, "pages").select(U.host(F.col("url")).alias("host"), path.alias("path")).distinct(), rules, "googlebot")


@query("path_parents", f"""WITH p AS (SELECT page_id, url, {HOST.format('url')} AS h, list_filter(string_split({PATH.format('url')}, '/'), lambda x: x <> '') AS parts, coalesce(nullif({PATH.format(KEY.format('url'))}, ''), '/') AS own FROM pages),
    s AS (SELECT h, own, min(page_id) AS parent_id FROM p GROUP BY ALL), a AS (SELECT page_id, h, unnest([n for n in range(greatest(len(parts), 1))]) AS n, parts FROM p), f AS (SELECT page_id, h, '/' || array_to_string(parts[1:n], '/') AS folder FROM a),
    b AS (SELECT f.page_id, arg_max(parent_id, length(folder)) AS parent_id FROM f JOIN s ON s.h = f.h AND s.own = f.folder WHERE f.page_id <> parent_id GROUP BY f.page_id) SELECT p.page_id, p.url, b.parent_id FROM p LEFT JOIN b ON b.page_id = p.page_id""")
def _(s, d):
    return L.path_parents(table(s, d, "pages").select("page_id", "url"))


@query("title_pairs", f"""WITH t AS (SELECT page_id, lower({TITLE}) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
    w AS (SELECT page_id, lang, list_distinct(list_filter(regexp_split_to_array(title, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS ws FROM t)
    SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS similarity FROM w a JOIN w b ON a.lang = b.lang AND a.page_id < b.page_id
    WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.6""")
def _(s, d):
    rows = parsed(s, d).select("page_id", "lang", X.tokens(F.col("title")).alias("tokens"))
    return A.similar_pairs(rows, ["lang"], "tokens", 0.6).withColumn("similarity", F.round("similarity", 6))


def _stop(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in X.STOP_WORDS[lang])
    return f"CASE WHEN length(text) > 0 THEN len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({words}))) * 1000.0 / length(text) ELSE 0 END"


@query("stop_word_language", f"WITH s AS (SELECT doc_id, {_stop('hu')} AS hu, {_stop('en')} AS en FROM documents) SELECT doc_id, CASE WHEN greatest(hu, en) >= 3 THEN CASE WHEN hu >= en THEN 'hu' ELSE 'en' END END AS detected FROM s")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.detect_language(F.col("text")).alias("detected"))


@query("alias_keys", "SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name)), '[-\\s]+', ' ', 'g')) AS key FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.alias_key("p_name").alias("key"))


@query("page_hashes", f"SELECT page_id, sha256(html) AS stable, sha256(trim({TITLE}) || chr(31) || trim({H1}) || chr(31)) AS content FROM pages")
def _(s, d):
    rows = parsed(s, d).select("page_id", "title", "h1").join(table(s, d, "pages").select("page_id", "html"), "page_id")
    return rows.select("page_id", X.stable_hash(F.col("html")).alias("stable"), X.content_hash(F.col("title"), F.col("h1"), F.lit("")).alias("content"))


@query("collapsed_texts", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.collapse(F.col("text")).alias("text"))


@query("single_lower_words", "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word = lower(word) AND word <> upper(word) GROUP BY word")
def _(s, d):
    w = F.col("word")
    return table(s, d, "conversations").select(F.explode(F.split("text", " ")).alias("word")).filter((w == F.lower(w)) & (w != F.upper(w))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("trivial_anchors", f"""WITH a AS (SELECT trim(regexp_replace({UNESCAPE.format("unnest(regexp_extract_all(html, '<a href=[^>]*>(.*?)</a>', 1))")}, '\\s+', ' ', 'g')) AS anchor FROM pages),
    k AS (SELECT anchor, trim(regexp_replace(lower(anchor), '[-\\s]+', ' ', 'g')) AS key FROM a), r AS (SELECT anchor, CASE WHEN NOT regexp_matches(key, '\\p{{L}}') THEN 'anchor_without_letter' WHEN length(key) <= 2 THEN 'anchor_short'
    WHEN regexp_matches(key, '^[ivxlcdm]+$') AND regexp_matches(key, '^m{{0,4}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$') AND regexp_matches(trim(anchor), '^[A-Z]+$') THEN 'anchor_roman_numeral' END AS reason FROM k) SELECT reason, anchor, count(*)::BIGINT AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
def _(s, d):
    return H.links_of(parsed(s, d)).withColumn("reason", X.trivial_anchor(F.col("anchor"))).filter("reason IS NOT NULL").groupBy("reason", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query("heading_findings")
def _(s, d):
    pages = parsed(s, d)
    blocks = H.blocks_of(pages).select("page_id", "ordinal", "level", F.size(F.split("text", r"\s+")).alias("words"))
    named = H.blocks_of(pages).filter("level IS NOT NULL").select("page_id", "ordinal", "level", "text")
    return D.heading_findings(pages.select("page_id", "words"), A.sections(blocks), named)
