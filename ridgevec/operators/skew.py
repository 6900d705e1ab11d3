"""Problem 2: per-key results where a few keys hold most rows.

Every state kept per key is algebraic (counts, sums, extremes), so Spark's
hash aggregation folds each partition into one small state per key before
anything is shuffled; a key that holds a third of all rows costs the shuffle
no more than any other. No window and no collected list is keyed by the hot
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.session import table


def current_lists(assignments: DataFrame) -> DataFrame:
    """``(internal_id, list_id)``: each vector's list by its latest row; rows
    with a null id name no vector, a null time is the earliest of all, and of
    rows of the same time the larger list counts. Vectors whose current list
    is null or -1 are left out."""
    latest = F.max(F.struct(F.col("assigned_at").alias("t"), F.col("list_id").alias("l"))).alias("s")
    cur = assignments.where("internal_id IS NOT NULL").groupBy("internal_id").agg(latest)
    return cur.select("internal_id", F.col("s.l").alias("list_id")).where("list_id IS NOT NULL AND list_id <> -1")


def list_sizes(assignments: DataFrame) -> DataFrame:
    return current_lists(assignments).groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def heavy_lists(assignments: DataFrame, percent: int = 4) -> DataFrame:
    """Lists that hold at least ``percent`` of all vectors counted."""
    sizes = list_sizes(assignments)
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    return sizes.join(F.broadcast(total), F.col("n") * 100 >= F.col("total") * percent).select("list_id", "n", "total")


def list_report(assignments: DataFrame, nlist: int = 128) -> DataFrame:
    """One row: vectors counted, lists used, largest list, imbalance (largest
    over mean of all ``nlist`` lists, empty ones too) and population standard
    deviation of the sizes. No vector counted gives zeros."""
    s = list_sizes(assignments).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"),
        F.count(F.lit(1)).alias("lists_used"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("sq"),
    )
    mean = F.col("vectors") / F.lit(float(nlist))
    return s.select(
        "vectors",
        "lists_used",
        "largest",
        F.round(F.when(F.col("vectors") > 0, F.col("largest") / mean).otherwise(0.0), 6).alias("list_imbalance"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / F.lit(float(nlist)) - mean * mean)), 6).alias("list_std"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_lists(table(spark, sf_dir, "assignments")).select("list_id")


def p2_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_report(table(spark, sf_dir, "assignments"))
