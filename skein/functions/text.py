"""Scalar functions over names, coverage prose and display values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never link two names, and the least length of a salient token.
STOPWORDS = ["the", "and", "or", "of", "for", "to", "in", "on", "by", "with", "at", "as", "our", "its", "a", "an"]
LEAST_TOKEN = 3

# Prose markers of coverage claims, in the order in which they decide.
NONE_MARKERS = ["none", "not covered", "not supported", "no coverage", "unsupported", "no "]
PARTIAL_MARKERS = ["partial", "partially", "some ", "limited"]
FULL_MARKERS = ["full", "fully", "complete", "comprehensive", "covered", "supported"]


def normalise_name(name: Column) -> Column:
    """Lower case, everything but word characters (of any script) as one space."""
    spaced = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def norm(name: Column) -> Column:
    return F.lower(F.trim(name))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, untrimmed."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def salient_tokens(name: Column) -> Column:
    """Distinct tokens that say something, singular by a cut-off s, in order of appearance."""
    tokens = F.split(normalise_name(name), " ")
    kept = F.filter(tokens, lambda t: (F.length(t) >= LEAST_TOKEN) & ~t.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.when((F.length(t) > LEAST_TOKEN) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def _any(text: Column, markers: list[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | text.contains(m)
    return hit


def normalise_coverage(claim: Column, strict: bool = False) -> Column:
    """full, partial, none or null for a claim in prose.

    Markers are plain substrings, so "uncovered" counts as covered; ``strict`` asks for word bounds.
    """
    text = norm(claim)
    if strict:
        words = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z]+", " "), F.lit(" "))
        spaced = lambda markers: [f" {m.strip()} " for m in markers]
        none, partial, full = (_any(words, spaced(m)) for m in ([*NONE_MARKERS, "uncovered"], PARTIAL_MARKERS, FULL_MARKERS))
    else:
        none, partial, full = (_any(text, m) for m in (NONE_MARKERS, PARTIAL_MARKERS, FULL_MARKERS))
    exact = F.when(text.isin("full", "partial", "none"), text)
    return F.coalesce(exact, F.when(text == "", None).when(none, "none").when(partial, "partial").when(full, "full"))


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text; characters beyond the basic plane are two."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    high = lambda c: F.lit(0xD800) + F.shiftright(c - 0x10000, 10)
    low = lambda c: F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF))
    return F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(F.array(high(c), low(c)))))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a non-negative long."""
    return F.aggregate(utf16_units(text), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def entity_name(row: dict[str, Column] | None = None, mapping: bool = False) -> Column:
    """The first filled one of name, statement, expression and, for scoring, vendor capability; else the id."""
    fields = ["name", "statement", "expression"] + ["vendor_capability"] * mapping
    row = row or {}
    return first_filled(*[row.get(f, F.col(f)) for f in fields], row.get("id", F.col("id")))


def pseudo_embedding(text: Column, dims: int = 8) -> Column:
    """A stand-in for a gateway's embedding: the sum of the code points, times 1 to ``dims``, modulo 97, over 97."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    seed = F.aggregate(points, F.lit(0).cast("long"), lambda s, c: s + c)
    return F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.pmod(seed * i, F.lit(97)) / F.lit(97.0))


def format_value(value: Column) -> Column:
    """A variant as one line: a dash for null, arrays joined by commas, objects as JSON, all else as text."""
    one = lambda v: F.when(F.is_variant_null(v) | v.isNull(), F.lit("—")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(items.isNotNull(), F.array_join(F.transform(items, one), ", ")).otherwise(one(value))


def json_literal(text: Column) -> Column:
    """A literal as a variant; null where it is no JSON."""
    return F.try_parse_json(text)


def hashed_embedding(text: Column, dims: int = 16) -> Column:
    """A deterministic stand-in for an embedding: one hash per dimension, scaled to -1..1."""
    one = lambda i: (fnv1a(F.concat(F.lit(f"{i}:"), text)) / F.lit(4294967295.0) * 2 - 1).cast("float")
    return F.array(*[one(i) for i in range(dims)])


def confidence_label(confidence: Column) -> Column:
    percent = F.concat(F.lit(" ("), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%)"))
    band = F.when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").otherwise("Low")
    return F.when(confidence.isNotNull(), F.concat(band, percent))


def lifecycle_label(status: Column) -> Column:
    return F.when(status.isin("draft", "active", "deprecated", "retired"), F.initcap(status)).otherwise(F.coalesce(status, F.lit("Unknown")))


def format_date(value: Column) -> Column:
    """yyyy-MM-dd in UTC, the raw value if it is no date, a dash if there is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd"), value, F.lit("—"))


def humanise_field(name: Column) -> Column:
    """Field names in camel or snake case as title words."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.initcap(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def diagram_alias(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "[^A-Za-z0-9_]", "_")


def iso_millis(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def decision_type(value: Column) -> Column:
    return F.when(value.isin("automated", "manual", "hybrid"), value).otherwise("automated")


def gap_reason(functional: Column, technical: Column) -> Column:
    """What is missing, in words; null where nothing is."""
    return F.when(~functional & ~technical, "neither a functional nor a technical realisation").when(~functional, "technically realised, but not functionally").when(~technical, "functionally realised, but not technically")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def document_id(source_type: Column, path: Column, version: Column) -> Column:
    """An id that no other combination of the three parts gives: they are hashed as a JSON object."""
    return F.sha2(F.to_json(F.struct(source_type.alias("type"), path.alias("path"), version.alias("version"))), 256)


def content_type(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(md|markdown)$"), "markdown").when(F.lower(path).rlike(r"\.json$"), "structured").otherwise("plaintext")


def target_types(given: Column) -> Column:
    """Types that were asked for, each once, in the order of their first mention; null ones fall away."""
    return F.array_distinct(F.array_compact(given))
