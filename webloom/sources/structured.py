"""Structured data of parsed pages: typed nodes, breadcrumb trails, node references."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "id", "name", "url", "json")]))
TRAIL = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "name")]))


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def _typed(data) -> list[dict]:
    """Every object with a type, the outer before the inner; a graph's context is the outer one's."""
    out, todo = [], [data]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            for kind in x["@type"] if isinstance(x.get("@type"), list) else [x.get("@type")]:
                if isinstance(kind, str):
                    out.append({"type": kind.replace("#", "/").replace(":", "/").rsplit("/", 1)[-1], "id": _text(x.get("@id")), "name": _text(x.get("name")), "url": _text(x.get("url")), "json": json.dumps(x, sort_keys=True, ensure_ascii=False)})
            todo = [v for v in x.values() if isinstance(v, (dict, list))] + todo
    return out


def _loads(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(NODE)
def typed_nodes(blocks: pd.Series) -> pd.Series:
    """All typed nodes of a JSON-LD block; none of a broken one."""
    return blocks.map(lambda b: _typed(_loads(b)))


def _trail(text, missing_last: bool) -> list[dict]:
    data = _loads(text)
    items = data.get("itemListElement") if isinstance(data, dict) else None
    rows = []
    for i, e in enumerate(items if isinstance(items, list) else [items] if isinstance(items, dict) else []):
        if not isinstance(e, dict):
            continue
        item = e.get("item")
        inner = item if isinstance(item, dict) else {}
        try:
            place = float(e.get("position"))
        except (TypeError, ValueError):
            place = float("inf") if missing_last else float(i + 1)
        url = item if isinstance(item, str) else inner.get("@id") or inner.get("url")
        rows.append((place, i, {"url": _text(url), "name": str(e.get("name") or inner.get("name") or "")}))
    return [r for *_, r in sorted(rows, key=lambda r: r[:2])]


@F.pandas_udf(TRAIL)
def breadcrumb_trail(blocks: pd.Series) -> pd.Series:
    """A BreadcrumbList's steps by position; one without a position stands at its own place."""
    return blocks.map(lambda b: _trail(b, False))


@F.pandas_udf(TRAIL)
def breadcrumb_trail_open(blocks: pd.Series) -> pd.Series:
    """As breadcrumb_trail, but steps without a position come last."""
    return blocks.map(lambda b: _trail(b, True))


def nodes_of(parsed: DataFrame) -> DataFrame:
    """A row for each typed node of each page: page_id, url, node fields."""
    rows = parsed.select("page_id", F.col("url").alias("page"), F.explode("schema").alias("b")).filter("b.type <> 'invalid'")
    return rows.select("page_id", "page", F.inline(typed_nodes(F.col("b.json"))))


def id_with_names(nodes: DataFrame) -> DataFrame:
    """Node ids that carry several names: id, names."""
    return nodes.filter("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)


def is_own(node_url: Column, node_id: Column, page: Column) -> Column:
    """The node is about the page: its url or id is the page's address, fragment and last slash aside."""
    cut = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/+$", "")
    return F.coalesce(cut(node_url) == cut(page), F.lit(False)) | F.coalesce(cut(node_id) == cut(page), F.lit(False))
