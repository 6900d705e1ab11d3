"""Problem 5: a stream of inserts, updates and deletes applied with delete vectors.

:class:`DeleteVectorTable` is a stored table that is never rewritten. A batch of
changes is folded to the last one of each key; a key-to-position index of the
keys that the batch touches tells which file and row holds each one's image so
far; the images that are superseded get their bits set in bitmaps of 32,768
positions of a file, and new images are appended. A read scans the images and
drops the positions whose bit is set. Changes count by their sequence number, so
batches may come late, in any order or again, and give the same table.

A key is folded in the tasks before anything is shuffled, and every join is on
folded keys, so a key that holds most changes is one row there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.operators.orphans import clean_id, snapshot_states
from ridgevec.session import remove_at_exit, shared_dir, table

IMAGE = "db_name string, id string, seq bigint"
#: ``version`` is twice the sequence number, plus one for a delete.
INDEX = "db_name string, id string, version bigint, file bigint, pos bigint"
VECTOR = "file bigint, bucket bigint, bits binary"


def base_snapshots(snapshots: DataFrame) -> DataFrame:
    """``(db_name, sid, snapshot_seq)``: of each store the snapshot with the
    greatest ``created_at`` among those whose latest status is complete (ties:
    greater sequence number, then id)."""
    states = snapshot_states(snapshots).where("status = 'complete'").select("sid")
    rows = snapshots.select("db_name", clean_id("snapshot_id").alias("sid"), "created_at", "snapshot_seq").where("db_name IS NOT NULL")
    best = F.max(F.struct(F.col("created_at"), F.col("snapshot_seq"), F.col("sid"))).alias("b")
    return rows.join(states, "sid", "left_semi").groupBy("db_name").agg(best).select("db_name", F.col("b.sid").alias("sid"), F.col("b.snapshot_seq").alias("snapshot_seq"))


def last_sequences(meta_states: DataFrame) -> DataFrame:
    latest = F.max(F.struct(F.col("updated_at"), F.col("last_seq"))).alias("m")
    return meta_states.where("db_name IS NOT NULL").groupBy("db_name").agg(latest).select("db_name", F.col("m.last_seq").alias("upto"))


class DeleteVectorTable:
    """Images ``(db_name, id, seq)`` in batches of files under ``path``, with an
    index and delete vectors beside them. A batch counts once its index is
    complete, which is written last; what a failed one left is overwritten.
    One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        if path is None:
            path = f"{shared_dir(spark)}/ridgevec-rows-{uuid.uuid4().hex}"
            remove_at_exit(spark, path)
        self.path = path
        self.batches = 0
        jvm = spark.sparkContext._jvm
        at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path}/index/{n}/_SUCCESS")
        fs = at(0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        while fs.exists(at(self.batches)):
            self.batches += 1

    def _parts(self, kind: str, schema: str, only: int | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in (range(self.batches) if only is None else [only])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _images(self, only: int | None = None) -> DataFrame:
        file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
        return self._parts("images", IMAGE, only).select("db_name", "id", "seq", file.alias("file"), row.alias("pos"))

    def apply(self, changes: DataFrame) -> None:
        """Applies ``(db_name, id, seq, dead)``. Of changes of one key the last
        counts, of the same number a delete; those that the table has, or has
        gone beyond, change nothing. A missing number is before all others."""
        n = self.batches
        version = F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)) * 2 + F.col("dead").cast("bigint")
        last = changes.where("db_name IS NOT NULL AND id IS NOT NULL").groupBy("db_name", "id").agg(F.max(version).alias("version"))
        if n:
            # of the index only the keys of the batch, and of each its last entry
            keys = ["db_name", "id"]
            known = self._parts("index", INDEX).join(last.select(*keys), keys, "left_semi")
            at = F.max_by(F.struct("file", "pos"), "version").alias("at")
            known = known.groupBy(*keys).agg(F.max("version").alias("before"), at)
            last = last.join(known, keys, "left").where("before IS NULL OR version > before")
        else:
            last = last.select("*", F.lit(None).cast("bigint").alias("before"), F.lit(None).cast("struct<file: bigint, pos: bigint>").alias("at"))
        self._write(last, "changes", n)
        last = self._parts("changes", "db_name string, id string, version bigint, before bigint, at struct<file: bigint, pos: bigint>", n)
        alive = F.col("version") % 2 == 0
        self._write(last.where(alive).select("db_name", "id", F.shiftright("version", 1).alias("seq")), "images", n)
        old = last.where("at.file IS NOT NULL").select("at.file", "at.pos")
        bucket = F.bitmap_bucket_number("pos").alias("bucket")
        self._write(old.groupBy("file", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits")), "vectors", n)
        new = self._images(n).select("db_name", "id", (F.col("seq") * 2).alias("version"), "file", "pos")
        gone = last.where(~alive).select("db_name", "id", "version", F.lit(None).cast("bigint").alias("file"), F.lit(None).cast("bigint").alias("pos"))
        self._write(new.unionByName(gone), "index", n)
        self.batches += 1

    def _write(self, df: DataFrame, kind: str, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/{n}")

    def vectors(self) -> DataFrame:
        """``(file, bucket, bits)``: all bits set so far."""
        parts = self._parts("vectors", VECTOR)
        return parts if self.batches < 2 else parts.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def read(self) -> DataFrame:
        """The live rows ``(db_name, id, seq)``."""
        if not self.batches:
            return self.spark.createDataFrame([], IMAGE)
        at = self._images().withColumn("bucket", F.bitmap_bucket_number("pos")).join(self.vectors(), ["file", "bucket"], "left")
        bit = F.bitmap_bit_position("pos")
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        unset = F.col("bits").isNull() | (F.getbit(byte, (bit % 8).cast("int")) == 0)
        return at.where(unset).select("db_name", "id", F.nullif("seq", F.lit(-1)).alias("seq"))


def base_rows(id_maps: DataFrame, base: DataFrame) -> DataFrame:
    """Ids of the base snapshots as changes ``(db_name, id, seq, dead)``."""
    maps = id_maps.select(clean_id("snapshot_id").alias("sid"), "int_to_ext").join(base, "sid")
    return maps.select("db_name", F.explode("int_to_ext").alias("id"), F.col("snapshot_seq").alias("seq"), F.lit(False).alias("dead"))


def feed_entries(journal: DataFrame, base: DataFrame, upto: DataFrame) -> DataFrame:
    """Entries that count: ``(db_name, id, seq, dead)``. A store without a
    complete snapshot starts empty and from its first entry on; one without a
    header state has no bound and takes no entry."""
    e = journal.select("db_name", "id", "seq", F.lower(F.trim("op")).alias("op"))
    e = e.where("db_name IS NOT NULL AND id IS NOT NULL AND id <> '' AND seq IS NOT NULL AND op IN ('upsert', 'delete')")
    bounds = upto.join(base.select("db_name", "snapshot_seq"), "db_name", "left")
    e = e.join(bounds, "db_name").where("seq <= upto AND (snapshot_seq IS NULL OR seq > snapshot_seq)")
    return e.select("db_name", "id", "seq", (F.col("op") == "delete").alias("dead"))


def current_ids(journal: DataFrame, snapshots: DataFrame, id_maps: DataFrame, meta_states: DataFrame, batches: int = 1) -> DataFrame:
    """``(db_name, id, last_seq)`` of the ids live at the end: the base snapshots
    and then the journal, in ``batches`` batches that don't follow its order."""
    base = base_snapshots(snapshots)
    rows = DeleteVectorTable(journal.sparkSession)
    rows.apply(base_rows(id_maps, base))
    entries = feed_entries(journal, base, last_sequences(meta_states))
    for n in range(batches):
        rows.apply(entries.where(F.pmod("seq", F.lit(batches)) == batches - 1 - n))
    return rows.read().select("db_name", "id", F.col("seq").cast("int").alias("last_seq"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_ids(*(table(spark, sf_dir, t) for t in ("journal", "snapshots", "id_maps", "meta_states")))


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p5_found``, with the journal applied in two batches, the odd sequence
    numbers before the even ones."""
    return current_ids(*(table(spark, sf_dir, t) for t in ("journal", "snapshots", "id_maps", "meta_states")), batches=2)
