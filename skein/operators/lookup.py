"""Reads of a graph: points, property filters, sorted pages with keyset cursors, incident edges, facets.

nodes: id, type, and any further columns. edges: id, type, source_id, target_id, ...
"""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, USUAL = 100, 25


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id).limit(1)


def exists(nodes: DataFrame, node_id: str) -> bool:
    return not get_node(nodes, node_id).isEmpty()


def matches(field: str, op: str, value) -> Column:
    """eq and neq with missing as a value of its own: a missing field equals nothing but missing."""
    same = F.col(field).eqNullSafe(F.lit(value))
    if op not in ("eq", "neq"):
        raise ValueError(f"no such operator: {op}")
    return same if op == "eq" else ~same


def find_by_type(nodes: DataFrame, kind: str, filters: list[tuple[str, str, object]] = ()) -> DataFrame:
    return nodes.where(reduce(lambda a, b: a & b, [matches(*f) for f in filters], F.col("type") == kind))


def edges_of(edges: DataFrame, node_id: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    out, into = F.col("source_id") == node_id, F.col("target_id") == node_id
    chosen = edges.where({"out": out, "in": into, "both": out | into}[direction])
    return chosen.where(F.col("type") == kind) if kind else chosen


def page_size(limit: float | None) -> int:
    return USUAL if limit is None else max(1, min(MOST, int(limit)))


def encode_cursor(value, node_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"sortValue": value, "id": node_id}).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str) -> tuple[object, str]:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return found.get("sortValue"), found["id"]
    except (ValueError, KeyError, AttributeError) as e:
        raise ValueError("malformed cursor") from e


def order(sort: str, descending: bool) -> list[Column]:
    """Missing values come last ascending and first descending; ids always ascend."""
    first = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return [first, F.col("id").asc()]


def after(sort: str, descending: bool, value, node_id: str) -> Column:
    """Strictly after a cursor in ``order``."""
    key, later = F.col(sort), F.col("id") > node_id
    if value is None:
        return key.isNotNull() | (key.isNull() & later) if descending else key.isNull() & later
    beyond = key < F.lit(value) if descending else (key > F.lit(value)) | key.isNull()
    return F.coalesce(beyond, F.lit(False)) | (key.eqNullSafe(F.lit(value)) & later)


def list_page(nodes: DataFrame, kind: str | None, filters: list[tuple[str, str, object]] = (), sort: str = "id", descending: bool = False, limit: float | None = None, cursor: str | None = None) -> DataFrame:
    """One page, in order; without a type there is nothing to list. A top-k plan, never a full sort."""
    if kind is None:
        return nodes.limit(0)
    found = find_by_type(nodes, kind, filters)
    if cursor is not None:
        found = found.where(after(sort, descending, *decode_cursor(cursor)))
    return found.orderBy(*order(sort, descending)).limit(page_size(limit))


def list_entries(nodes: DataFrame, kind: str | None, filters: list[tuple[str, str, object]] = (), sort: str = "id", descending: bool = False, limit: float | None = None, cursor: str | None = None, total: bool = True) -> dict:
    """A page as the service returns it: items, cursor of the next page or None, has_more, total or None."""
    n = page_size(limit)
    if kind is None:
        return {"items": [], "cursor": None, "has_more": False, "total": 0 if total else None}
    found = find_by_type(nodes, kind, filters)
    rest = found.where(after(sort, descending, *decode_cursor(cursor))) if cursor else found
    rows = rest.orderBy(*order(sort, descending)).limit(n + 1).collect()
    more, items = len(rows) > n, rows[:n]
    return {"items": items, "cursor": encode_cursor(items[-1][sort], items[-1]["id"]) if more else None, "has_more": more, "total": found.count() if total else None}


def faceted(rows: DataFrame, layers: list[str] = (), types: list[str] = (), lifecycles: list[str] = (), band: tuple[float, float] | None = None, dates: tuple[str, str] | None = None, text: str | None = None, owners: list[str] = (), contexts: list[str] = (), quality: tuple[float, float] | None = None, pushed: bool = False) -> DataFrame:
    """Rows that pass every facet in use; rows without a confidence or quality are outside any band.

    ``pushed``: a single lifecycle has gone into the read of the page (``pushed_filters``) and is not asked again.
    """
    out = rows
    if layers:
        out = out.where(F.col("layer").isin(*layers))
    if types:
        out = out.where(F.col("type").isin(*types))
    if len(lifecycles) > 1 or (lifecycles and not pushed):
        out = out.where(F.col("lifecycle_status").isin(*lifecycles))
    if band:
        out = out.where(F.col("confidence").between(*band))
    if dates:
        out = out.where(F.col("valid_from").between(*dates))
    if owners:
        out = out.where(F.col("owner").isin(*owners))
    if contexts:
        out = out.where(F.col("context").isin(*contexts))
    if quality:
        out = out.where(F.col("quality").between(*quality))
    if text:
        out = out.where(F.lower("name").contains(text.lower()) | F.lower("id").contains(text.lower()))
    return out


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value, n for each facet, in one pass over the rows."""
    counted = rows.groupingSets([[F.col(f)] for f in facets], *facets).agg(F.grouping_id(*facets).alias("_g"), F.count(F.lit(1)).alias("n"))
    bit = {f: (1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)) for i, f in enumerate(facets)}
    name = F.coalesce(*[F.when(F.col("_g") == bit[f], F.lit(f)) for f in facets])
    value = F.coalesce(*[F.when(F.col("_g") == bit[f], F.col(f).cast("string")) for f in facets])
    return counted.select(name.alias("facet"), value.alias("value"), "n")


def display_order(descending: bool, sort: str) -> list[Column]:
    """The order of displays: missing values last in either direction."""
    return [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), F.col("id").asc()]


def entry_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Relationships of one entry: type, direction, other_id, label (name or id); self-loops once, outgoing."""
    out = edges.where(F.col("source_id") == node_id).select("type", F.lit("out").alias("direction"), F.col("target_id").alias("other_id"))
    into = edges.where((F.col("target_id") == node_id) & (F.col("source_id") != node_id)).select("type", F.lit("in").alias("direction"), F.col("source_id").alias("other_id"))
    named = nodes.select(F.col("id").alias("other_id"), "name")
    return out.union(into).join(named, "other_id", "left").select("type", "direction", "other_id", F.coalesce("name", "other_id").alias("label"))


def pushed_filters(lifecycles: list[str] = (), owners: list[str] = ()) -> list[tuple[str, str, object]]:
    """Facets with a single value as equality filters of a page; those with several are left to ``faceted``."""
    single = [("lifecycle_status", lifecycles), ("owner", owners)]
    return [(field, "eq", values[0]) for field, values in single if len(values) == 1]


def list_all(nodes: DataFrame, kind: str, filters: list[tuple[str, str, object]] = ()) -> DataFrame:
    """Every entry of a type: what following cursors to the end gives, as one scan."""
    return find_by_type(nodes, kind, filters)


def cross_type_total(totals: list[int | None]) -> int | None:
    """The sum of the totals of several types; none if no type has one."""
    known = [t for t in totals if t is not None]
    return sum(known) if known else None


def entry(nodes: DataFrame, edges: DataFrame, node_id: str) -> dict:
    """The entry, its relationships as a table, and whether there is none."""
    row = get_node(nodes, node_id).first()
    return {"entry": row.asDict(recursive=True) if row else None, "relationships": entry_detail(nodes, edges, node_id), "not_found": row is None}
