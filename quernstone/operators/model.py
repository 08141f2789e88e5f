"""The property graph as DataFrames, and typed access to its JSON.

nodes: seq, id, type, name, boost, metadata (JSON text).  edges: seq, src, dst,
relationship, metadata.  notes: seq, entity, text, ts.  seq is given at first insertion and
breaks ties.  Edges may name ids that have no node.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "seq bigint, id string, type string, name string, boost double, metadata string"
EDGES = "seq bigint, src string, dst string, relationship string, metadata string"
NOTES = "seq bigint, entity string, text string, ts bigint"
KV = "key string, value string, created_at bigint, updated_at bigint"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    notes: DataFrame | None = None
    kv: DataFrame | None = None


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def json_value(metadata: Column, key: str) -> Column:
    """The value at a key of JSON text as a variant; null where the key is missing."""
    return F.try_variant_get(F.try_parse_json(metadata), _path(key), "variant")


def json_kind(value: Column) -> Column:
    """null, boolean, number, string, array or object; SQL's null where there is no value."""
    name = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value) | (name == "VOID"), "null")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .when(name.isNotNull(), "number")
    )


def json_number(metadata: Column, key: str) -> Column:
    """The number at a key, null for all else (numbers in strings too)."""
    value = json_value(metadata, key)
    return F.when(json_kind(value) == "number", F.try_variant_get(value, "$", "double"))


def json_string(metadata: Column, key: str) -> Column:
    value = json_value(metadata, key)
    return F.when(json_kind(value) == "string", F.try_variant_get(value, "$", "string"))


def _equals(value: Column, wanted: Any) -> Column:
    kind = json_kind(value)
    if wanted is None:
        return F.coalesce(kind == "null", F.lit(False))
    if isinstance(wanted, bool):
        test = (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        test = (kind == "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    elif isinstance(wanted, str):
        test = (kind == "string") & (F.try_variant_get(value, "$", "string") == wanted)
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def predicate(metadata: Column, key: str, wanted: Any) -> Column:
    """Whether the value at a key is as wanted: a scalar (of the same type and equal), or a dict of operators.

    Operators: exists (alone decides, if given), gt, lt, gte, lte (numbers only), contains (strings
    only), in (a list of scalars).  All given must hold; others are ignored.  A missing key
    equals nothing; a list as such is never equal.
    """
    value = json_value(metadata, key)
    if not isinstance(wanted, dict):
        return _equals(value, wanted)
    if "exists" in wanted:
        there = F.coalesce(json_kind(value) != "null", F.lit(False))
        return there if wanted["exists"] else ~there
    kind = json_kind(value)
    number = F.when(kind == "number", F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    tests = {"gt": lambda x: number > x, "lt": lambda x: number < x, "gte": lambda x: number >= x, "lte": lambda x: number <= x, "contains": lambda x: text.contains(x)}
    held = F.lit(True)
    for name, operand in wanted.items():
        if name in tests:
            held = held & F.coalesce(tests[name](operand), F.lit(False))
        elif name == "in":
            any_of = F.lit(False)
            for one in operand:
                any_of = any_of | _equals(value, one)
            held = held & any_of
    return held


def where_all(metadata: Column, where: dict[str, Any] | None) -> Column:
    """The conjunction of predicates; true for none."""
    held = F.lit(True)
    for key, wanted in (where or {}).items():
        held = held & predicate(metadata, key, wanted)
    return held
