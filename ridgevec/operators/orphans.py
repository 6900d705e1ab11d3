"""Problem 4: references to records that do not exist.

References are folded to one row per table, key, position and period first.
Keys that hold a notable share of them are few by arithmetic (a share of one
part in ``HEAVY_PARTS`` is reached by at most so many keys), so their target
states are broadcast; all other keys go through a shuffle join. Both counts are
united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.session import table, written

#: A key is heavy from this part of all folded references on; also the bound
#: of the number of heavy keys.
HEAVY_PARTS = 1000


def clean_id(c: str | Column) -> Column:
    """Trimmed and lower-cased; blank is null."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t != "", t)


def snapshot_states(snapshots: DataFrame) -> DataFrame:
    """``(sid, status, first_at)`` by the latest row of each snapshot; of rows
    of the same time the status that sorts last counts, a null time is the
    earliest. Rows without an id are no snapshots."""
    last = F.max(F.struct(F.col("recorded_at").alias("t"), F.lower(F.trim(F.col("status"))).alias("s"))).alias("last")
    keyed = snapshots.select(clean_id("snapshot_id").alias("sid"), "status", "recorded_at").where("sid IS NOT NULL")
    return keyed.groupBy("sid").agg(last, F.min("recorded_at").alias("first_at")).select("sid", F.col("last.s").alias("status"), "first_at")


def references(refs: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Folded references ``(ref_table, sid, chunk_index, period, written_at)``
    with the earliest time of each; null or blank keys refer to nothing."""
    parts = [
        df.select(F.lit(name).alias("ref_table"), clean_id("snapshot_id").alias("sid"), index.cast("int").alias("chunk_index"), F.date_format("written_at", "yyyy-MM").alias("period"), "written_at").where("sid IS NOT NULL")
        for name, (df, index) in refs.items()
    ]
    keys = ["ref_table", "sid", "chunk_index", "period"]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min("written_at").alias("written_at"))


def orphans(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Orphan references with the first reason that fits; a reference without
    a time can't be late."""
    refs = written(refs, "refs")
    sizes = refs.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    heavy = sizes.join(F.broadcast(total), F.col("n") * HEAVY_PARTS > F.col("total")).select("sid")
    heavy = written(heavy, "heavy")
    marked = refs.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "sid", "left")
    heavy_states = states.join(F.broadcast(heavy), "sid", "left_semi")
    hot = marked.where("heavy").drop("heavy").join(F.broadcast(heavy_states), "sid", "left")
    cold = marked.where("heavy IS NULL").drop("heavy").join(states, "sid", "left")
    reason = (
        F.when(F.col("status").isNull() & F.col("first_at").isNull(), "missing")
        .when(F.col("status") == "deleted", "deleted")
        .when(F.col("status") == "writing", "unfinished")
        .when(F.col("first_at") > F.col("written_at"), "late")
    )
    return hot.unionByName(cold).withColumn("reason", reason).where("reason IS NOT NULL").select("ref_table", "period", F.col("sid").alias("snapshot_id"), "chunk_index", "reason")


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, maps = table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "id_maps")
    refs = references({"vector_chunks": (chunks, F.col("chunk_index")), "id_maps": (maps, F.lit(-1))})
    return orphans(refs, snapshot_states(table(spark, sf_dir, "snapshots")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return _of(spark, sf_dir).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("snapshot_id").alias("snapshots"))
