"""Compile ordered rule lists to one Spark SQL expression (first match wins).

Rules are compiled to expression text, so that a list of two hundred phrases is
handed to Spark in one call.  `text` and `key` arguments are SQL expressions;
use named() for a plain column.  Turn the result into a column with F.expr.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> str:
    return f"`{column}`"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def any_of(predicates: Iterable[str]) -> str:
    return "(" + " OR ".join(predicates) + ")"


def contains_any(text: str, needles: Iterable[str]) -> str:
    """Plain substring test; a short needle also hits inside longer words."""
    return any_of(f"contains({text}, {literal(needle)})" for needle in needles)


def starts_with_any(text: str, prefixes: Iterable[str]) -> str:
    return any_of(f"startswith({text}, {literal(prefix)})" for prefix in prefixes)


def is_any(key: str, values: Iterable) -> str:
    return f"{key} IN ({', '.join(literal(value) for value in values)})"


def case_when(cases: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """CASE over (predicate, result) pairs of expressions."""
    branches = " ".join(f"WHEN {predicate} THEN {result}" for predicate, result in cases)
    return f"CASE {branches} ELSE {default} END"


def first_containing(text: str, rules: Iterable[tuple[str, list[str]]], default: str = "NULL") -> str:
    """Label of the first rule with a needle inside the text."""
    return case_when(((contains_any(text, needles), literal(label)) for label, needles in rules), default)


def first_prefix(text: str, rules: Iterable[tuple[str, list[str]]], default: str = "NULL") -> str:
    return case_when(((starts_with_any(text, prefixes), literal(label)) for label, prefixes in rules), default)


def label_lookup(key: str, members: Mapping[str, list], default: str = "NULL") -> str:
    """Label whose member list holds the key."""
    return case_when(((is_any(key, values), literal(label)) for label, values in members.items()), default)


def lookup(key: str, table: Mapping, default: str = "NULL") -> str:
    """Value of a small fixed table; keys sharing a value are tested as one set."""
    keys_by_value: dict = {}
    for entry, value in table.items():
        keys_by_value.setdefault(value, []).append(entry)
    return case_when(((is_any(key, keys), literal(value)) for value, keys in keys_by_value.items()), default)


def order_in(values: list[str], column: str) -> Column:
    """Position of the column's value in a canonical order, missing when it is not listed."""
    return F.expr(lookup(named(column), {value: place for place, value in enumerate(values, start=1)}))
