"""The journal as a stream: stateful folding and incremental list upkeep."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.operators import ivf, store
from ridgevec.session import shared_dir, written


#: Micro-batches after which what they appended is folded.
COMPACT = 50


def _once(stream: DataFrame, mode: str, each, checkpoint: str) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def read_journal(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def stream_fold(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Last writer wins per id over a stream of entries; the state is one row
    an id and the order of arrival doesn't matter. Runs over what is available
    and returns the live rows ``(id, seq, meta)``.

    Each micro-batch appends only the ids whose row changed, under its own
    number, so that one that is run again writes the same folder; the fold of
    those rows is the state. With a ``folder``, a later call goes on from the
    checkpoint there. Every ``COMPACT`` batches the rows before are folded into
    one folder, which replaces them."""
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/ridgevec-fold-{uuid.uuid4().hex}"
    e = stream.where("seq IS NOT NULL AND id IS NOT NULL AND id <> '' AND op IN ('upsert', 'delete')")
    state = e.groupBy("id").agg(F.max(F.struct("seq", "op", "meta")).alias("w")).select("id", "w.seq", "w.op", "w.meta")
    schema = "id string, seq bigint, op string, meta string"

    def keep(df: DataFrame, batch: int) -> None:  # update mode: the rows that changed
        df.write.mode("overwrite").parquet(f"{base}/state/batch={batch}")
        if batch and batch % COMPACT == 0:
            _compact(spark, f"{base}/state", schema, batch, lambda rows: _last(rows, "seq", "op", "meta"))

    _once(state, "update", keep, f"{base}/checkpoint")
    rows = _last(_rows(spark, f"{base}/state", f"{schema}, batch bigint"), "seq", "op", "meta")
    return rows.where("op = 'upsert'").drop("op")


def _last(rows: DataFrame, *cols: str) -> DataFrame:
    """Of each id the row of greatest ``cols``."""
    return rows.groupBy("id").agg(F.max(F.struct(*cols)).alias("w")).select("id", *[f"w.{c}" for c in cols])


def _compact(spark: SparkSession, path: str, schema: str, batch: int, fold) -> None:
    """Folds all batches up to this one into this one's folder. A fold that is
    broken off leaves rows twice, which the next fold takes for one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = f"{path}-folded-{batch}"
    fold(spark.read.schema(f"{schema}, batch bigint").parquet(path)).write.mode("overwrite").parquet(fresh)
    names = [s.getPath().getName() for s in fs.listStatus(p(path))]
    fs.rename(p(fresh), p(f"{path}/batch=-{time.time_ns()}"))  # no number of a micro-batch, and a new one each time
    for name in names:
        if name.startswith("batch="):
            fs.delete(p(f"{path}/{name}"), True)


def stream_lists(stream: DataFrame, index: ivf.IvfIndex, folder: str | None = None) -> DataFrame:
    """Upkeep of inverted lists: each micro-batch assigns only its own upserts
    and appends the moves; a batch that is run again writes the same folder, so
    nothing is applied twice. The fold of the moves by id is the live table
    ``(id, list_id)``; every ``COMPACT`` batches they are folded on disk, too.
    With a ``folder``, a later call goes on from the checkpoint there."""
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/ridgevec-lists-{uuid.uuid4().hex}"
    schema = "id string, seq bigint, list_id int"

    def move(df: DataFrame, batch: int) -> None:
        e = store.entries(df, dim=index.centroids.shape[1])
        put = ivf.assign(e.where("op = 'upsert'").select("id", "seq", "vec"), index).select("id", "seq", "list_id")
        gone = e.where("op = 'delete'").select("id", "seq", F.lit(None).cast("int").alias("list_id"))
        put.unionByName(gone).write.mode("overwrite").parquet(f"{base}/moves/batch={batch}")
        if batch and batch % COMPACT == 0:
            _compact(spark, f"{base}/moves", schema, batch, lambda rows: _last(rows, "seq", "list_id"))

    _once(stream, "append", move, f"{base}/checkpoint")
    moves = _last(_rows(spark, f"{base}/moves", f"{schema}, batch bigint"), "seq", "list_id")
    return moves.where("list_id IS NOT NULL").select("id", "list_id")


__all__ = ["read_journal", "stream_fold", "stream_lists", "written"]
