"""Journal folding, live views, statistics and compaction.

The journal is an unordered table of ``(seq, ts, op, id, vec, meta)``; a fold is
one algebraic aggregation per external id, so arrival order and repeats don't
matter and a hot id is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgevec.session import written


def entries(journal: DataFrame, after: int | None = None, upto: int | None = None, dim: int | None = None) -> DataFrame:
    """Entries that count: known operation, sequence number, non-empty id; an
    upsert needs a vector, of length ``dim`` if that is given."""
    op = F.lower(F.trim("op"))
    rows = journal.withColumn("op", op).where("seq IS NOT NULL AND id IS NOT NULL AND id <> '' AND op IN ('upsert', 'delete')")
    vector = F.col("vec").isNotNull() if dim is None else F.size("vec") == dim
    rows = rows.where((F.col("op") == "delete") | vector)
    if after is not None:
        rows = rows.where(F.col("seq") > after)
    return rows if upto is None else rows.where(F.col("seq") <= upto)


def fold(journal: DataFrame, after: int | None = None, upto: int | None = None, dim: int | None = None) -> DataFrame:
    """``(id, seq, op, vec, meta)``: the winner of each id, deletes included.
    Metadata is what the last entry that gave some gave, unless a delete came
    after it; then, and if none ever did, it is ``{}``."""
    e = entries(journal, after, upto, dim)
    last = F.max(F.struct("seq", "op", "vec")).alias("w")
    gave = F.max(F.when((F.col("op") == "upsert") & F.col("meta").isNotNull(), F.struct("seq", "meta"))).alias("g")
    died = F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("d")
    f = e.groupBy("id").agg(last, gave, died)
    kept = F.when(F.col("g").isNotNull() & (F.col("d").isNull() | (F.col("g.seq") > F.col("d"))), F.col("g.meta")).otherwise("{}")
    return f.select("id", F.col("w.seq").alias("seq"), F.col("w.op").alias("op"), F.col("w.vec").alias("vec"), kept.alias("meta"))


def live(journal: DataFrame, **bounds) -> DataFrame:
    return fold(journal, **bounds).where("op = 'upsert'").drop("op")


def replay(base: DataFrame, journal: DataFrame, after: int, **bounds) -> DataFrame:
    """Base rows ``(id, vec, meta)`` with the entries after ``after`` applied;
    base rows count as upserts of that sequence number."""
    start = base.select(F.lit(after).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), "id", "vec", "meta")
    tail = journal.where(F.col("seq") > after).select(F.col("seq").cast("bigint").alias("seq"), "op", "id", "vec", "meta")
    return live(start.unionByName(tail), **bounds)


def latest_complete(snapshots: DataFrame) -> DataFrame:
    """The complete snapshot with the greatest sequence number (ties: later,
    then greater id), over the latest status of each; none gives no row."""
    state = snapshots.groupBy("snapshot_id").agg(F.max(F.struct("recorded_at", "status", "created_at", "snapshot_seq", "next_id")).alias("s"))
    done = state.where("s.status = 'complete'").select("snapshot_id", "s.created_at", "s.snapshot_seq", "s.next_id")
    return done.orderBy(F.desc("snapshot_seq"), F.desc("created_at"), F.desc("snapshot_id")).limit(1)


def truncate(journal: DataFrame, upto: int) -> DataFrame:
    return journal.where(F.col("seq") > upto)


def dense_ids(rows: DataFrame, order: str, first: int = 0) -> DataFrame:
    """Adds ``internal_id``: consecutive from ``first`` in the order of a
    column. Partitions are ranged and numbered on their own; only their sizes
    reach the driver, so no task sees all rows."""
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    placed = written(placed, "dense")
    sizes = {r["_p"]: (r["n"], r["lo"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("lo")).collect()}
    base, offsets = first, []
    for p in sorted(sizes):
        n, lo = sizes[p]
        offsets.append((p, base - lo))
        base += n
    if not offsets:
        return placed.drop("_p", "_m").withColumn("internal_id", F.lit(None).cast("bigint"))
    shift = placed.sparkSession.createDataFrame(offsets, "_p int, _o bigint")  # a row a partition
    return placed.join(F.broadcast(shift), "_p").withColumn("internal_id", F.col("_m") + F.col("_o")).drop("_p", "_m", "_o")


def store_stats(rows: DataFrame, dim: int, chunk_rows: int, next_id: int | None = None) -> DataFrame:
    """One row about ``(internal_id, id, deleted)``: counts, dead ratios, the
    dead tail (ids above the last live one), and chunks. ``next_id`` defaults
    to the largest id plus one; an empty table gives zeros."""
    alive = ~F.coalesce("deleted", F.lit(False))
    a = rows.where("internal_id IS NOT NULL").agg(
        F.count_if(alive).alias("live_count"),
        F.count_if(~alive).alias("deleted_count"),
        F.count_if(alive & F.col("id").isNotNull()).alias("id_count"),
        F.coalesce(F.max("internal_id") + 1, F.lit(0)).cast("bigint").alias("next_id"),
        F.coalesce(F.max(F.when(alive, F.col("internal_id"))), F.lit(-1)).cast("bigint").alias("last_live"),
    )
    if next_id is not None:
        a = a.withColumn("next_id", F.lit(next_id).cast("bigint"))
    total = F.col("live_count") + F.col("deleted_count")
    tail = F.col("next_id") - 1 - F.col("last_live")
    chunks = F.ceil(F.col("next_id") / F.lit(chunk_rows)).cast("bigint")
    return a.select(
        F.lit(dim).alias("dim"),
        F.lit(chunk_rows).alias("chunk_rows"),
        chunks.alias("chunks"),
        (chunks * chunk_rows).alias("capacity"),
        "live_count",
        "deleted_count",
        "id_count",
        "next_id",
        (F.col("next_id") - F.col("live_count")).alias("free_slots"),
        F.round(F.when(total > 0, F.col("deleted_count") / total).otherwise(0.0), 6).alias("dead_ratio"),
        tail.alias("tail_dead_count"),
        F.round(F.when(F.col("next_id") > 0, tail / F.col("next_id")).otherwise(0.0), 6).alias("tail_dead_ratio"),
    )


def compact(rows: DataFrame) -> DataFrame:
    """Rows up to the last live id; dead rows between live ones stay."""
    last = rows.agg(F.max(F.when(~F.coalesce("deleted", F.lit(False)), F.col("internal_id"))).alias("last_live"))  # one row
    return rows.join(F.broadcast(last), F.col("internal_id") <= F.col("last_live")).drop("last_live")


def compaction_report(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """What trailing compaction changes; without a dead tail, nothing."""
    s = store_stats(rows, 1, chunk_rows)
    new = F.col("next_id") - F.col("tail_dead_count")
    return s.select(F.col("next_id").alias("old_next_id"), new.alias("new_next_id"), (F.col("chunks") - F.ceil(new / F.lit(chunk_rows)).cast("bigint")).alias("trimmed_chunks"))
