"""Value and index vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def append(vector: Column, value) -> Column:
    return F.array_append(vector, value if isinstance(value, Column) else F.lit(value))


def append_vector(vector: Column, other: Column) -> Column:
    return F.concat(vector, other)


def resize(vector: Column, n: int, fill) -> Column:
    """The first ``n`` values; further ones are ``fill``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(fill), n)), 1, n)


def largest(vector: Column) -> Column:
    return F.array_max(vector)


def dump(vector: Column, form: str = "%s") -> Column:
    """The values as text, one a line."""
    return F.array_join(F.transform(vector, lambda x: F.format_string(form, x)), "\n")


def sort_pairs(pairs: Column) -> Column:
    """An array of (key, value) structs by value, then key."""
    return F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["key"].alias("key")))), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
