"""Column functions for dynamically typed values: errors collapse to NULL, predicates pass only on true.

Users write ordinary Spark column or SQL expressions; these helpers supply the semantics that differ
from Spark's own.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def passes(predicate: Column) -> Column:
    """True only where the predicate is true: NULL (missing field, error) rejects."""
    return F.coalesce(predicate, F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def and_(left: Column, right: Column) -> Column:
    """Short-circuits on the left only: an error on the left is an error, whatever the right."""
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(~left, F.lit(False)).otherwise(right)


def or_(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(left, F.lit(True)).otherwise(right)


def int_divide(a: Column, b: Column) -> Column:
    """Truncates toward zero; NULL for division by zero."""
    return F.call_function("div", a, F.when(b != 0, b))


def int_modulo(a: Column, b: Column) -> Column:
    """Takes the sign of the dividend; NULL for a zero divisor."""
    return a % F.when(b != 0, b)


def double_modulo(a: Column, b: Column) -> Column:
    """Both sides lose their fraction first; NULL where the divisor's integer part is zero."""
    return int_modulo(a.cast("long"), b.cast("long"))


def number_or_one(text: Column) -> Column:
    """What SUM adds for a value of any type: a number as it is, anything else as 1."""
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(1.0)))


def item(array: Column, index: Column | int) -> Column:
    """array[index], negative from the end; NULL out of range."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.try_element_at(array, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def cut(array: Column, start: int | None = None, stop: int | None = None) -> Column:
    """array[start:stop] with Python's bounds."""
    n = F.size(array)
    at = lambda i, default: F.lit(default) if i is None else (F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0)))
    low = at(start, 0)
    high = n if stop is None else at(stop, 0)
    return F.slice(array, low + 1, F.greatest(high - low, F.lit(0)))


def half_open_range(start: Column, stop: Column, step: int = 1) -> Column:
    """Integers from start up to, not including, stop; empty in the wrong direction."""
    if step == 0:
        raise ValueError("range: step must not be zero")
    last = stop - (1 if step > 0 else -1)
    ok = start <= last if step > 0 else start >= last
    return F.when(ok, F.sequence(start, F.when(ok, last).otherwise(start), F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def merge_objects(*objects: Column) -> Column:
    """Map union in which the right-most value of a key wins."""
    return functools.reduce(lambda left, right: F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right), objects)


def without(obj: Column, *names: str) -> Column:
    return F.map_filter(obj, lambda k, _: ~k.isin(*names))


def json_type(text: Column) -> Column:
    """Type name of a JSON value given as text."""
    t = F.trim(text)
    return (
        F.when(t.isNull(), None)
        .when(t == "null", "null")
        .when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?\d+$"), "integer")
        .when(t.rlike(r"^-?\d*\.?\d+([eE][-+]?\d+)?$"), "double")
        .when(t.startswith("["), "array")
        .when(t.startswith("{"), "object")
        .otherwise("string")
    )


def dictionary(items: Column, key, value, keep=None) -> Column:
    """{key(x): value(x) for x in items if keep(x)}; of equal keys the last one's value."""
    rows = F.filter(items, keep) if keep else items
    pairs = F.transform(rows, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
