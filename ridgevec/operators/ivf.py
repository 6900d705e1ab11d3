"""Inverted lists: training, assignment, probing and filtered search.

Lists are chosen by squared distance whatever the metric; for cosine both the
stored vectors and the query are unit vectors first. Every row is assigned in
the task that reads it, against a centroid matrix of bounded size. A search
turns its probes into an ``IN`` on ``list_id``, which prunes the folders of a
table written by :func:`write_lists`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.functions import scores
from ridgevec.functions.predicates import compile_where
from ridgevec.operators import kmeans
from ridgevec.operators.search import DIGITS, _matrix, batch_search, clamp, scored, stated_queries

#: Training sample and candidate cap of a search.
SAMPLE, MAX_CANDIDATES = 20_000, 200_000


@dataclass
class IvfIndex:
    centroids: np.ndarray  # (nlist, dim), 32-bit
    metric: str = "cosine"

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "list_id int, centroid array<float>")


def train(vectors: DataFrame, nlist: int, iters: int = 20, seed: int = 1234, sample: int = SAMPLE, metric: str = "cosine") -> IvfIndex:
    """Trains on the first ``sample`` rows by internal id; ``nlist`` is at most
    their number. No vectors is an error."""
    rows = vectors.where("vec IS NOT NULL").select("internal_id", "vec").orderBy("internal_id").limit(sample).collect()
    if not rows:
        raise ValueError("can't train on no vectors")
    x = np.array([r["vec"] for r in rows], np.float32)
    return IvfIndex(kmeans.train(x, min(nlist, len(x)), iters, seed), metric)


def given(centroids: Sequence[Sequence[float]], metric: str = "cosine") -> IvfIndex:
    return IvfIndex(np.asarray(centroids, np.float32), metric)


def assign(vectors: DataFrame, index: IvfIndex) -> DataFrame:
    """Adds ``list_id``; rows whose vector is null, of another length or not
    finite belong to no list and are left out."""
    c = index.centroids
    fields = [f for f in vectors.schema.fields if f.name != "list_id"]
    at = [f.name for f in fields].index("vec")

    def run(batches):
        for b in batches:
            x, ok = _matrix(b.column(at), c.shape[1])
            good = np.isfinite(x).all(1)
            rows = b.take(pa.array(ok[good]))
            yield pa.record_batch([*rows.columns, pa.array(kmeans.nearest_centroid(x[good], c).astype(np.int32))], names=[*[f.name for f in fields], "list_id"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*fields, StructField("list_id", IntegerType())])
    return vectors.select(*[f.name for f in fields]).mapInArrow(run, schema)


def write_lists(assigned: DataFrame, path: str) -> DataFrame:
    """One folder a list, read back; a hot list is written by many tasks, as
    nothing is shuffled by list."""
    assigned.write.mode("overwrite").partitionBy("list_id").parquet(path)
    return assigned.sparkSession.read.schema(assigned.schema).parquet(path)


def probes(index: IvfIndex, query: np.ndarray, nprobe: int) -> list[int]:
    """The ``nprobe`` nearest lists, ties to the lower id."""
    q = scores.unit_query(query) if index.metric == "cosine" else query
    d = np.round(kmeans.squared_distances(index.centroids, q), 9)
    return [int(i) for i in np.lexsort((np.arange(len(d)), d))[: max(0, min(nprobe, len(d)))]]


def search(assigned: DataFrame, index: IvfIndex, query: Sequence[float], k: int, nprobe: int = 8, where: Mapping | None = None, schema: Mapping | None = None, threshold: float | None = None, max_candidates: int | None = None, stored_unit: bool = False) -> DataFrame:
    """Hits of the probed lists. A candidate cap, if given, holds after the
    filter and takes lists in order of nearness, ids ascending."""
    q = scores.query_vector(query, index.centroids.shape[1])
    lists = probes(index, q, nprobe)
    rows = assigned.where(F.col("list_id").isin(lists)) if lists else assigned.limit(0)
    if max_candidates is not None:
        if where:
            rows, where = rows.where(compile_where(where, schema)), None
        order = F.array_position(F.array(*[F.lit(i) for i in lists]), F.col("list_id"))
        rows = rows.orderBy(order, "internal_id").limit(max_candidates)
    hits = scored(rows, q, index.metric, where, schema, threshold, stored_unit)
    return hits.orderBy(F.desc("score"), "internal_id").limit(clamp(k))


def probed(index: IvfIndex, queries: DataFrame, nprobe: int) -> dict[int, list[int]]:
    qids, q = stated_queries(queries)
    return {int(i): probes(index, v, nprobe) for i, v in zip(qids, q)}


def batch(assigned: DataFrame, index: IvfIndex, queries: DataFrame, k: int, nprobe: int = 8, where: Mapping | None = None, schema: Mapping | None = None, threshold: float | None = None) -> DataFrame:
    return batch_search(assigned, queries, k, index.metric, where, schema, threshold, probed(index, queries, nprobe))


def list_sizes(assigned: DataFrame, index: IvfIndex) -> DataFrame:
    """Rows of every list, empty lists as zero. Counts are folded before the
    shuffle; the lists' ids come from a range, not from the data."""
    n = assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    every = assigned.sparkSession.range(index.nlist).select(F.col("id").cast("int").alias("list_id"))
    return every.join(n, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("size"))


def list_stats(sizes: DataFrame) -> DataFrame:
    """Imbalance (largest over mean, 0 without rows) and population deviation."""
    return sizes.agg(
        F.round(F.coalesce(F.when(F.avg("size") > 0, F.max("size") / F.avg("size")), F.lit(0.0)), 6).alias("list_imbalance"),
        F.round(F.coalesce(F.stddev_pop("size"), F.lit(0.0)), 6).alias("list_std"),
    )


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """Mean of each list as ``(list_id, pos, mean)``, rounded as the order of
    adding is open."""
    x = assigned.select("list_id", F.posexplode("vec").alias("pos", "x"))
    return x.groupBy("list_id", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def apply_delta(assigned: DataFrame, delta: DataFrame, index: IvfIndex) -> DataFrame:
    """Upkeep without a rebuild: ``delta`` has ``(op, ...row)``; only its rows
    are assigned anew, deleted ids leave, all other rows keep their list."""
    fresh = assign(delta.where("op = 'upsert'").drop("op"), index)
    return assigned.join(delta.select("id").distinct(), "id", "left_anti").unionByName(fresh)


__all__ = ["DIGITS", "IvfIndex", "MAX_CANDIDATES", "SAMPLE", "apply_delta", "assign", "batch", "given", "list_sizes", "list_stats", "lloyd_step", "probed", "probes", "search", "train", "write_lists"]
