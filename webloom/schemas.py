"""Columns of the engine's tables and the values that some may take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "site": "domain string, seed_url string, crawled_at timestamp_ntz, target_country string, languages array<string>, tech array<string>, tech_signals array<string>, trailing_slash boolean, page_count int, render_mode string, https_redirect boolean, https_redirect_status int, robots_txt string, robots_status int, target_country_confidence string, target_country_candidates string, market_scope string, market_scope_city string, home_urls array<string>",
    "crawl_runs": "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, max_pages int, concurrency int, pages_done int, pages_failed int, pages_skipped int, pages_per_sec double, bytes_stored bigint, notes string, mode string, crawl_id int, skipped_by_limit int, include string, exclude string, stopped string",
    "crawl_queue": "url string, depth int, priority int, status string, discovered_from string, error string, updated_at timestamp_ntz",
    "pages": "page_id bigint, url string, status int, error string, canonical string, noindex boolean, title string, meta_description string, h1 string, lang string, hreflang array<string>, page_type string, word_count int, main_content string, external_link_count int, raw_html_hash string, rendered_html binary, render_ms int, fetched_at timestamp_ntz, run_id int, final_url string, main_content_method string, seen_crawl_id int, x_robots_tag string, redirect_hops int, redirect_chain string",
    "links": "from_page_id bigint, to_url string, to_page_id bigint, anchor string, position string, nofollow boolean, ordinal int, raw_url string",
    "link_variants": "raw_url string, normalized_url string, status int, final_url string, hops int, chain string, error string, fetched_at timestamp_ntz",
    "headings": "page_id bigint, level int, text string, ordinal int",
    "schema_blocks": "page_id bigint, type string, json string, ordinal int",
    "structured_data": "page_id bigint, syntax string, type string, json string, ordinal int",
    "sitemap_files": "snapshot string, ordinal int, url string, source string, found boolean, is_index boolean, urls int, fetched_at timestamp_ntz",
    "sitemap_urls": "snapshot string, ordinal int, raw_url string, url string, internal boolean, lastmod string, sitemap_file string, source string, fetched_at timestamp_ntz",
    "blocks": "block_id bigint, page_id bigint, ordinal int, kind string, region string, level int, heading_path array<string>, text string, cells string",
    "entities": "entity_id bigint, name string, lang string, type string, aliases array<string>, kg_status string, kg_id string, source string, subtype string, role string, namespace string, page_id bigint, wikidata_id string, anchor_page_id bigint, tier string, flags array<string>, wikidata_status string, attributes string, label_type string, label_subtype string",
    "page_entities": "mention_id bigint, page_id bigint, entity_id bigint, block_id bigint, char_start int, char_end int, surface_form string, position string, description string, context string, flags array<string>, block_corrected string, block_given string",
    "mention_sources": "mention_id bigint, source string, run_id int, llm_call_id int, count int",
    "entity_runs": "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, method string, pages int, pages_with_entities int, entities int, row_count int, llm_calls int, by_position string, skipped string, model string, cost_usd double, fabricated int, seconds double",
    "entity_run_pages": "run_id int, page_id bigint, status string, reasons string, call_ids array<bigint>, chunks int, fabricated int, seconds double, error string, extraction string, refined string, finished_at timestamp_ntz, raw_html_hash string, input_hash string, blocks_hash string",
    "entity_aliases": "entity_id bigint, alias string, source string, lang string",
    "entity_relations": "from_id bigint, to_id bigint, type string, source string, evidence string",
    "merge_log": "merge_id bigint, run_id int, kept_id bigint, removed_id bigint, kept_name string, removed_name string, rule string, evidence string, merged_at timestamp_ntz",
    "validation_cache": "service string, request_key string, response string, fetched_at timestamp_ntz",
    "page_nodes": "page_id bigint, url string, role string, support_kind string, title string, h1 string, lang string, group_key string, hreflang_pages array<string>, main_status string, canonical_page bigint, canonical_issue string, decision string",
    "edges": "edge_id bigint, from_kind string, from_id bigint, to_kind string, to_id bigint, type string, source string, evidence string, weight double",
    "page_main_entity": "page_id bigint, entity_id bigint, role string, rank int, confidence string, evidence string, external_confirmation string",
    "entity_weights": "entity_id bigint, pages int, mentions int, structural int, main_pages int, secondary_pages int, content_anchors int, nav_anchors int, single_mention boolean, weight double",
    "menu_items": "item_id bigint, lang string, area string, ordinal int, url string, page_id bigint, anchor string, parent_id bigint, level int, marker string, pages int, area_pages int",
    "menu_page_differences": "page_id bigint, lang string, area string, kind string, url string, anchor string, parent string",
    "findings": "finding_id bigint, type string, severity string, page_id bigint, entity_id bigint, summary string, evidence string",
    "llm_calls": "call_id bigint, domain string, page_id bigint, model string, tokens_in int, tokens_out int, cost_usd double, purpose string, latency_ms int, called_at timestamp_ntz, attempts int, last_error string, fabricated_count int",
}

VALUES = {
    ("crawl_queue", "status"): ("queued", "done", "failed", "robots_blocked"),
    ("links", "position"): ("nav", "body", "footer", "aside"),
    ("structured_data", "syntax"): ("json-ld", "microdata", "rdfa", "opengraph"),
    ("blocks", "region"): ("content", "chrome"),
    ("entity_relations", "type"): ("offers", "part_of", "brand_of", "in_category"),
    ("findings", "severity"): ("high", "medium", "low"),
    ("menu_page_differences", "kind"): ("extra", "missing"),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def checked(df: DataFrame, name: str) -> DataFrame:
    """df in the table's columns; a column that is missing or a value that isn't allowed is an error, the latter when rows are read."""
    want = schema(name)
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))
    for (table, column), values in VALUES.items():
        if table == name:
            bad = F.concat(F.lit(f"{name}.{column} can't be "), F.col(column))
            df = df.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(bad).cast("string")))
    return df
