"""Metadata predicates compiled to columns.

A predicate is a dict of field to condition, all of which must hold: a scalar
(equality), ``{"in": [...]}``, or a range of ``gt gte lt lte``. Declared ("hot")
fields are typed columns; any other ("cold") field is looked up in a JSON text
column and compared with its JSON type, so ``"87"`` and ``87`` differ. A
condition that doesn't suit a field's type is false, never an error. An empty
predicate holds for every row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = {"gt": lambda c, x: c > x, "gte": lambda c, x: c >= x, "lt": lambda c, x: c < x, "lte": lambda c, x: c <= x}
FALSE, TRUE = F.lit, F.lit


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _is_in(cond) -> bool:
    return isinstance(cond, Mapping) and isinstance(cond.get("in"), (list, tuple))


def _is_range(cond) -> bool:
    return isinstance(cond, Mapping) and any(k in cond for k in RANGE)


def _range(c: Column, cond: Mapping) -> Column:
    """Bounds that are no numbers are ignored."""
    parts = [RANGE[k](c, F.lit(float(cond[k]))) for k in RANGE if k in cond and _number(cond[k])]
    return reduce(Column.__and__, parts, F.lit(True))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def hot_number(c: Column, cond) -> Column:
    """Range before IN where both are given; the stored 32-bit value is
    compared with the 64-bit literal."""
    v = c.cast("double")
    if _number(cond):
        test = v == F.lit(float(cond))
    elif _is_range(cond):
        test = _range(v, cond)
    elif _is_in(cond):
        test = v.isin([float(x) for x in cond["in"] if _number(x)]) if any(map(_number, cond["in"])) else F.lit(False)
    else:
        return F.lit(False)
    return F.coalesce(_finite(c.cast("double")) & test, F.lit(False))


def hot_boolean(c: Column, cond, missing_is_false_in_lists: bool = False) -> Column:
    """A missing value matches nothing; ``missing_is_false_in_lists`` restores
    the older rule that ``{"in": [False]}`` matches it too."""
    if isinstance(cond, bool):
        return F.coalesce(c == F.lit(cond), F.lit(False))
    if _is_in(cond):
        options = [x for x in cond["in"] if isinstance(x, bool)]
        if not options:
            return F.lit(False)
        v = F.coalesce(c, F.lit(False)) if missing_is_false_in_lists else c
        return F.coalesce(v.isin(options), F.lit(False))
    return F.lit(False)


def hot_enum(c: Column, cond, values: list[str]) -> Column:
    """Values outside the declared ones count as missing."""
    if isinstance(cond, str):
        options = [cond]
    elif _is_in(cond):
        options = [x for x in cond["in"] if isinstance(x, str)]
    else:
        return F.lit(False)
    options = [x for x in options if x in values]
    return F.coalesce(c.isin(options), F.lit(False)) if options else F.lit(False)


def _cold_equal(v: Column, kind: Column, x) -> Column:
    if isinstance(x, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(x))
    if isinstance(x, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(x))
    if _number(x):
        return _numeric(kind) & (F.try_variant_get(v, "$", "double") == F.lit(float(x)))
    if x is None:
        return kind == "VOID"
    return F.lit(False)


def _numeric(kind: Column) -> Column:
    return kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")


def cold(meta: Column, field: str, cond) -> Column:
    """IN before range where both are given."""
    quoted = field.replace("\\", "\\\\").replace("'", "\\'")
    v = F.try_variant_get(F.try_parse_json(meta), f"$['{quoted}']", "variant")
    kind = F.schema_of_variant(v)
    if _is_in(cond):
        test = _any([_cold_equal(v, kind, x) for x in cond["in"]])
    elif _is_range(cond):
        test = _numeric(kind) & _range(F.try_variant_get(v, "$", "double"), cond)
    else:
        test = _cold_equal(v, kind, cond)
    return F.coalesce(test, F.lit(False))


def compile_where(where: Mapping | None, schema: Mapping | None = None, meta: str = "meta", missing_is_false_in_lists: bool = False) -> Column:
    """``schema`` maps a hot field to ``"number"``, ``"boolean"`` or a list of
    enum values; every other field is cold."""
    parts = []
    for field, cond in (where or {}).items():
        kind = (schema or {}).get(field)
        if kind is None:
            parts.append(cold(F.col(meta), field, cond))
        elif kind == "number":
            parts.append(hot_number(F.col(field), cond))
        elif kind == "boolean":
            parts.append(hot_boolean(F.col(field), cond, missing_is_false_in_lists))
        else:
            parts.append(hot_enum(F.col(field), cond, list(kind)))
    return reduce(Column.__and__, parts, F.lit(True))
