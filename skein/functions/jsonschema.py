"""JSON Schemas as columns: a schema is compiled to an expression over VARIANT that names the first breach.

``breach`` gives "<path>: <keyword>" for the first rule that a value breaks, in the order of the schema, and null where
it breaks none; nothing leaves the JVM. A value that a rule says nothing about passes it, as the standard has it: a
pattern holds for texts only, a minimum for numbers only.

Keywords: type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength,
pattern, required, properties, additionalProperties, minItems, maxItems, items, allOf, anyOf, oneOf, not, if/then/else, and
$ref to a place in the same schema. Others are refused unless they only describe. A schema that refers to itself is
followed ``DEEPEST`` references deep, beyond which values pass. Patterns are Java's. Whole numbers are integers
however they are written. A missing value (SQL null) breaks only what requires it; JSON's null is a value.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 4
#: Keywords that describe and judge nothing.
SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format", "$comment", "then", "else", "deprecated", "readOnly", "writeOnly"}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    """The value as a double; null if it is no number."""
    return F.when(_kind(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _fields(value: Column) -> Column:
    return F.when(_kind(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def _items(value: Column) -> Column:
    return F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _is(value: Column, name: str) -> Column:
    if name == "integer":
        return F.coalesce(_number(value) % 1 == 0, F.lit(False))
    if name == "number":
        return _number(value).isNotNull()
    return {"string": _kind(value) == "STRING", "boolean": _kind(value) == "BOOLEAN", "null": _kind(value) == "VOID", "object": _kind(value).startswith("OBJECT"), "array": _kind(value).startswith("ARRAY")}[name]


def _equals(value: Column, wanted: object) -> Column:
    if wanted is None:
        return _is(value, "null")
    if isinstance(wanted, bool):
        return F.coalesce((_kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted), F.lit(False))
    if isinstance(wanted, (int, float)):
        return F.coalesce(_number(value) == float(wanted), F.lit(False))
    if isinstance(wanted, str):
        return F.coalesce(_text(value) == wanted, F.lit(False))
    return F.to_json(value) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _first(values: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """What is said of the first element of which anything is said."""
    return F.get(F.array_compact(F.transform(values, judge)), 0)


def _referred(root: dict, place: str) -> dict | bool:
    if not place.startswith("#"):
        raise ValueError(f"a reference out of the schema: {place}")
    found = root
    for step in filter(None, place[1:].split("/")):
        found = found[step.replace("~1", "/").replace("~0", "~")]
    return found


def breach(schema: dict | bool, value: Column, path: Column | str = "$", root: dict | None = None, depth: int = 0) -> Column:
    """The first breach of a schema in a VARIANT, as text; null for none and for a missing value."""
    path = F.lit(path) if isinstance(path, str) else path
    said = lambda word: F.concat(path, F.lit(f": {word}"))
    none = F.lit(None).cast("string")
    if schema is True:
        return none
    if schema is False:
        return F.when(value.isNotNull(), said("false"))
    root = schema if root is None else root
    below = lambda part, v=value, p=path, d=depth: breach(part, v, p, root, d)
    number, text, fields, items = _number(value), _text(value), _fields(value), _items(value)
    checks: list[Column] = []
    for word, rule in schema.items():
        fails = lambda bad, word=word: checks.append(F.when(F.coalesce(bad, F.lit(False)), said(word)))
        if word in SILENT:
            continue
        if word == "$ref":
            if depth < DEEPEST:
                checks.append(below(_referred(root, rule), d=depth + 1))
        elif word == "type":
            fits = F.lit(False)
            for name in [rule] if isinstance(rule, str) else rule:
                fits = fits | _is(value, name)
            fails(~fits)
        elif word in ("enum", "const"):
            fits = F.lit(False)
            for wanted in rule if word == "enum" else [rule]:
                fits = fits | _equals(value, wanted)
            fails(~fits)
        elif word == "minimum":
            fails(number < rule)
        elif word == "maximum":
            fails(number > rule)
        elif word == "exclusiveMinimum":
            fails(number <= rule)
        elif word == "exclusiveMaximum":
            fails(number >= rule)
        elif word == "multipleOf":
            fails(number % rule != 0)
        elif word == "minLength":
            fails(F.length(text) < rule)
        elif word == "maxLength":
            fails(F.length(text) > rule)
        elif word == "pattern":
            fails(~text.rlike(rule))
        elif word == "required":
            for name in rule:
                lacks = fields.isNotNull() & ~F.map_contains_key(fields, name)
                checks.append(F.when(F.coalesce(lacks, F.lit(False)), F.concat(path, F.lit(f".{name}: required"))))
        elif word == "properties":
            checks += [below(part, F.try_element_at(fields, F.lit(name)), F.concat(path, F.lit(f".{name}"))) for name, part in rule.items()]
        elif word == "additionalProperties":
            if rule is True:
                continue
            others = F.array_except(F.array_sort(F.map_keys(fields)), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
            if rule is False:
                checks.append(F.when(F.size(others) > 0, F.concat(path, F.lit("."), F.get(others, 0), F.lit(": additionalProperties"))))
            else:
                checks.append(_first(others, lambda k, _: below(rule, F.try_element_at(fields, k), F.concat(path, F.lit("."), k))))  # noqa: B023 called at once
        elif word == "minItems":
            fails(items.isNotNull() & (F.size(items) < rule))
        elif word == "maxItems":
            fails(items.isNotNull() & (F.size(items) > rule))
        elif word == "items":
            checks.append(_first(items, lambda v, i: below(rule, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))  # noqa: B023 called at once
        elif word == "allOf":
            checks += [below(part) for part in rule]
        elif word in ("anyOf", "oneOf"):
            holds = F.lit(0)
            for part in rule:
                holds = holds + below(part).isNull().cast("int")
            fails(holds == 0 if word == "anyOf" else holds != 1)
        elif word == "not":
            fails(below(rule).isNull())
        elif word == "if":
            holds = below(rule).isNull()
            for branch, when in (("then", holds), ("else", ~holds)):
                if branch in schema:
                    checks.append(F.when(when, below(schema[branch])))
        else:
            raise ValueError(f"a keyword that is not known: {word}")
    return F.when(value.isNotNull(), F.coalesce(*checks, none)) if checks else none


def completeness(names: list[str], value: Column) -> Column:
    """Share of required fields that a VARIANT has with a value that is not null, nor an empty text or list; 1 if none is required."""
    if not names:
        return F.lit(1.0)
    fields = _fields(value)

    def present(name: str) -> Column:
        v = F.try_element_at(fields, F.lit(name))
        filled = v.isNotNull() & (_kind(v) != "VOID") & F.coalesce(_text(v) != "", F.lit(True)) & F.coalesce(F.size(_items(v)) > 0, F.lit(True))
        return F.coalesce(filled, F.lit(False)).cast("double")

    total = present(names[0])
    for name in names[1:]:
        total = total + present(name)
    return total / len(names)
