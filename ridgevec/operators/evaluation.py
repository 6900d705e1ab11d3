"""Recall, percentiles by rank, and gates on measured figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgevec.session import written


def recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """Per query, the part of the ``k`` exact hits that the other search has;
    a query without exact hits has recall 1."""
    both = exact.select("qid", "internal_id").join(approx.select("qid", "internal_id", F.lit(1).alias("hit")), ["qid", "internal_id"], "left")
    n = both.groupBy("qid").agg(F.count("hit").alias("hits"), F.least(F.count(F.lit(1)), F.lit(k)).alias("want"))
    return n.select("qid", F.when(F.col("want") > 0, F.col("hits") / F.col("want")).otherwise(1.0).alias("recall"))


def mean_recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    return recall(exact, approx, k).agg(F.round(F.avg("recall"), 6).alias("recall"))


def speedup(exact_ms: DataFrame, approx_ms: DataFrame, p: float = 0.95) -> DataFrame:
    """One row ``(speedup)``: the exact search's percentile over the other's, of
    latencies in the column ``ms``; zero where the other's is not positive."""
    a, b = (percentiles(x, "ms", {"p": p}).select(F.col("p").alias(n)) for x, n in ((exact_ms, "a"), (approx_ms, "b")))
    return a.join(F.broadcast(b)).select(F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("speedup"))  # one row each


def _nth(n: Column, p: float, rule: str) -> Column:
    if rule == "floor_n_minus_1":
        return F.floor(F.lit(p) * (n - 1)) + 1
    if rule == "floor_percent":
        return F.floor(F.lit(p * 100) / 100 * (n - 1)) + 1
    if rule == "floor_n":
        return F.least(n, F.floor(F.lit(p) * n) + 1)
    raise ValueError("unknown rank rule")


def percentiles(values: DataFrame, col: str, ps: Mapping[str, float], by: list[str] | None = None, rule: str = "floor_n_minus_1") -> DataFrame:
    """Exact elements of the sorted values at the ranks of a rule. Values are
    folded to counts, ranged over partitions in order, and ranked by running
    sums within each partition plus what the partitions before it hold, so no
    task sees a whole group. Nulls are left out."""
    by = by or []
    keys = [*by, "_v"]
    counts = values.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = written(counts.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranks")
    # a row for each group and partition it touches: partitions are few, and ranges of them are in order
    steps = placed.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    order = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"_base": F.sum("_s").over(order) - F.col("_s"), "_n": F.sum("_s").over(Window.partitionBy(*by))})
    within = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("_run", F.sum("_c").over(within)).join(steps.drop("_s"), [*by, "_p"])
    upto = F.col("_base") + F.col("_run")
    return run.groupBy(*by).agg(*[F.min(F.when(upto >= _nth(F.col("_n"), p, rule), F.col("_v"))).alias(name) for name, p in ps.items()])


#: Limits by figure; the suffix says which side fails (fixed values).
GATES = {
    "search_p95_ms_max": 80.0,
    "ingest_p95_ms_max": 50.0,
    "ivf_recall_at_10_min": 0.6,
    "ivf_speedup_min": 2.0,
    "warm_start_ms_max": 200.0,
    "frame_p95_ms_max": 20.0,
}


def gates(figures: DataFrame, limits: Mapping[str, float] = GATES) -> DataFrame:
    """``(gate, value, limit, status)`` of figures ``(name, value)``: pass,
    fail, or skip where there is no figure or the suffix says no side."""
    spark = figures.sparkSession
    rows = [(g, g.rsplit("_", 1)[0], g.rsplit("_", 1)[1], float(v)) for g, v in limits.items()]
    g = spark.createDataFrame(rows, "gate string, name string, side string, `limit` double")
    j = g.join(figures.select("name", F.col("value").cast("double").alias("value")), "name", "left")
    bad = F.when(F.col("side") == "max", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    status = F.when(F.col("value").isNull() | F.isnan("value") | ~F.col("side").isin("max", "min"), "skip").when(bad, "fail").otherwise("pass")
    return j.select("gate", "value", "limit", status.alias("status"))
