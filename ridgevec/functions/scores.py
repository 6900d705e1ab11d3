"""Scores of array columns as built-in expressions.

Elements are stored as 32-bit floats and multiplied and added in double
precision, left to right, so a score doesn't depend on partitioning. A larger
score is always better: ``l2`` is the negated squared distance. Vectors of
different length, null vectors and null elements give null; callers drop null,
NaN and infinite scores before they order anything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("dot", "cosine", "l2")
#: Stands in for a squared norm of zero (fixed value).
TINY = 1e-12


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def negated_l2(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.lit(0.0) - _total(F.zip_with(a, b, square))


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Length one, each element rounded to 32 bits; a zero vector stays zero.
    The norm is bound once by the outer lambda, not once an element."""
    ss = squared_norm(v)
    inv = F.lit(1.0) / F.sqrt(F.when(ss > 0, ss).otherwise(F.lit(TINY)))
    return F.get(F.transform(F.array(inv), lambda i: F.transform(v, lambda x: (x.cast("double") * i).cast("float"))), 0)


def add(a: Column, b: Column) -> Column:
    """Elementwise sum in 32 bits."""
    return F.zip_with(a, b, lambda x, y: (x + y).cast("float"))


def _total32(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("float"), lambda s, x: s + x)


def dot32(a: Column, b: Column) -> Column:
    """As ``dot``, but each product and sum is rounded to 32 bits."""
    return _total32(F.zip_with(a, b, lambda x, y: x * y))


def l2sq32(a: Column, b: Column) -> Column:
    """Squared distance, rounded to 32 bits at each step."""
    return _total32(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm32(v: Column) -> Column:
    """Root, in double precision, of a sum of squares rounded at each step."""
    return F.sqrt(dot32(v, v).cast("double"))


def cosine32(a: Column, b: Column) -> Column:
    """Of 32-bit sums; minus infinity if either vector is zero."""
    n, m = norm32(a), norm32(b)
    return F.when((n == 0) | (m == 0), F.lit(float("-inf"))).otherwise(dot32(a, b).cast("double") / (n * m))


def query_vector(query: Sequence[float], dim: int | None = None) -> np.ndarray:
    """The query rounded to 32 bits; a wrong length is an error."""
    q = np.asarray(query, dtype=np.float32)
    if q.ndim != 1 or dim is not None and len(q) != dim:
        raise ValueError(f"query must have {dim} elements")
    return q


def unit_query(q: np.ndarray) -> np.ndarray:
    ss = 0.0
    for x in q.tolist():
        ss += x * x
    return (q.astype(np.float64) * (1.0 / math.sqrt(ss if ss > 0 else TINY))).astype(np.float32)


def _literal(q: np.ndarray) -> str:
    return "array(" + ", ".join(f"{x!r}D" if math.isfinite(x) else f"double('{x}')" for x in q.tolist()) + ")"


def score(vec: str, query: np.ndarray, metric: str, stored_unit: bool = False) -> Column:
    """Score of a vector column against one query; with ``stored_unit`` the
    column already holds unit vectors, as a store for cosine keeps them. Given
    as text, which is parsed at once, as it is made anew for every search."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = _literal(unit_query(query) if metric == "cosine" else query)
    total = "aggregate(zip_with({v}, {q}, (x, y) -> {term}), 0D, (s, x) -> s + x)"
    if metric == "l2":
        return F.expr("0D - " + total.format(v=vec, q=q, term="(cast(x as double) - y) * (cast(x as double) - y)"))
    product = total.format(v="v" if metric == "cosine" and not stored_unit else vec, q=q, term="cast(x as double) * y")
    if metric == "dot" or stored_unit:
        return F.expr(product)
    squares = f"aggregate({vec}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))"
    inverse = f"transform(array({squares}), n -> 1D / sqrt(if(n > 0, n, {TINY!r}D)))"
    return F.expr(f"transform(transform({inverse}, i -> transform({vec}, x -> cast(cast(x as double) * i as float))), v -> {product})[0]")


def finite(s: Column) -> Column:
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
