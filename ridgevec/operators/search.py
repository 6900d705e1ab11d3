"""Exact filtered top-k search, for one query and for many.

One query is a literal: the scan filters and scores in one stage and the top k
come from ``TakeOrderedAndProject`` - no join, no shuffle of vectors. Many
queries (a bounded, stated set) are scored in blocks where the data lie; every
block sends at most k hits a query to the merge.

The order is score descending, internal id ascending, on scores rounded to
``DIGITS`` decimals; null, NaN and infinite scores are no hits, k below one
gives none, and k is at most ``MOST``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgevec.functions import scores
from ridgevec.functions.predicates import compile_where

MOST, DIGITS = 256, 9
#: Queries that one search may state; more are searched in several calls.
MOST_QUERIES = 10_000


def clamp(k: int) -> int:
    return max(0, min(int(k), MOST))


def scored(vectors: DataFrame, query: Sequence[float], metric: str, where: Mapping | None = None, schema: Mapping | None = None, threshold: float | None = None, stored_unit: bool = False, dim: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, internal_id, *keep, score)`` of the rows with an external id and a
    finite score. A vector of another length, or with a null element, has a
    null score. Few DataFrame steps, as each is analysed when it is made."""
    q = scores.query_vector(query, dim)
    rows = vectors.where(compile_where(where, schema)) if where else vectors
    s = F.round(scores.score("vec", q, metric, stored_unit), DIGITS)
    test = "id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('infinity')"
    out = rows.select("id", "internal_id", *keep, s.alias("score"))
    return out.where(test if threshold is None else f"{test} AND score >= {float(threshold)!r}D")


def search(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Mapping | None = None, schema: Mapping | None = None, threshold: float | None = None, stored_unit: bool = False, keep: Sequence[str] = (), dim: int | None = None) -> DataFrame:
    """The best hits; rows without an external id are no hits, ``keep``
    attaches metadata columns."""
    hits = scored(vectors, query, metric, where, schema, threshold, stored_unit, dim, keep)
    return hits.orderBy(F.desc("score"), "internal_id").limit(clamp(k))


def get(vectors: DataFrame, external_id: str) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return vectors.where(F.col("id") == F.lit(external_id))


def candidates(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose internal id is listed; the plan picks the join by size."""
    return vectors.join(ids.select("internal_id").distinct(), "internal_id", "left_semi")


def _matrix(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right length without nulls, and their rows."""
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.flatnonzero((np.diff(off) == dim) & col.is_valid().to_numpy(zero_copy_only=False))
    at = off[ok][:, None] + np.arange(dim)[None, :]
    return flat[at] if len(ok) else np.zeros((0, dim)), ok


def score_block(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of each row for each query, rounded as those of a single query."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            ss = (x * x).sum(1)
            x = (x * (1.0 / np.sqrt(np.where(ss > 0, ss, scores.TINY)))[:, None]).astype(np.float32).astype(np.float64)
            q = np.stack([scores.unit_query(r) for r in q])
        q = q.astype(np.float64)
        s = x @ q.T
        if metric == "l2":
            s = 2 * s - (x * x).sum(1)[:, None] - (q * q).sum(1)[None, :]
        return np.round(s, DIGITS)


def _best(s: np.ndarray, ids: np.ndarray, k: int, threshold: float | None):
    """``(column, row)`` of the k best of each column, ties by id."""
    s = np.where(np.isfinite(s), s, -np.inf)
    if threshold is not None:
        s = np.where(s >= threshold, s, -np.inf)
    cols, rows = [], []
    for j in range(s.shape[1]):
        c = s[:, j]
        if len(c) > k:
            cut = np.partition(c, len(c) - k)[len(c) - k]
            at = np.flatnonzero(c >= cut)
        else:
            at = np.arange(len(c))
        at = at[c[at] > -np.inf]
        at = at[np.lexsort((ids[at], -c[at]))[:k]]
        cols.append(np.full(len(at), j))
        rows.append(at)
    return np.concatenate(cols) if cols else np.zeros(0, int), np.concatenate(rows) if rows else np.zeros(0, int)


def stated_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(qid, q)`` of a query table whose size is checked."""
    rows = queries.select("qid", "q").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; search them in several calls")
    rows = [r for r in rows if r["q"] is not None]
    if len({len(r["q"]) for r in rows}) > 1:
        raise ValueError("queries differ in length")
    return np.array([r["qid"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float32)


def batch_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Mapping | None = None, schema: Mapping | None = None, threshold: float | None = None, allowed: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    """``(qid, rank, id, internal_id, score)`` for every query. ``allowed``
    restricts a query to some list ids of the column ``list_id``."""
    qids, q = stated_queries(queries)
    kk = clamp(k)
    schema_out = "qid bigint, id string, internal_id bigint, score double"
    spark = vectors.sparkSession
    if not len(qids) or not kk:
        return spark.createDataFrame([], "qid bigint, rank int, id string, internal_id bigint, score double")
    rows = vectors.where("id IS NOT NULL")
    if where:
        rows = rows.where(compile_where(where, schema))
    cols = ["id", F.col("internal_id").cast("bigint").alias("internal_id"), F.col("vec").cast("array<float>").alias("vec")]
    if allowed is not None:
        lists = sorted({x for v in allowed.values() for x in v})
        rows = rows.where(F.col("list_id").isin(lists)) if lists else rows.limit(0)
        cols.append(F.col("list_id").cast("int").alias("list_id"))
    dim = q.shape[1]

    def run(batches):
        for b in batches:
            x, ok = _matrix(b.column(2), dim)
            ids = b.column(1).to_numpy(zero_copy_only=False)[ok]
            lists = b.column(3).to_numpy(zero_copy_only=False)[ok] if allowed is not None else None
            for s in range(0, len(qids), 256):
                block = score_block(x, q[s : s + 256], metric)
                if lists is not None:
                    for j, qid in enumerate(qids[s : s + 256]):
                        block[~np.isin(lists, allowed.get(int(qid), ())), j] = -np.inf
                col, row = _best(block, ids, kk, threshold)
                yield pa.record_batch([pa.array(qids[s + col]), b.column(0).take(pa.array(ok[row])), pa.array(ids[row].astype(np.int64)), pa.array(block[row, col])], names=["qid", "id", "internal_id", "score"])

    top = Window.partitionBy("qid").orderBy(F.desc("score"), "internal_id")
    hits = rows.select(*cols).mapInArrow(run, schema_out)
    return hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= kk).select("qid", "rank", "id", "internal_id", "score")
