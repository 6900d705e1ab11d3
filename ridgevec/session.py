"""Session helpers: shared checkpoint folder, written intermediates, table paths."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.
    Only a local master without that setting gets a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_ridgevec_dir", None)
        if where is None:
            where = sc._ridgevec_dir = "file://" + tempfile.mkdtemp(prefix="ridgevec-")
    return where


def written(df: DataFrame, tag: str = "t") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the
    lineage is cut, the result survives lost executors, and later readers
    still prune columns. The folder is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ridgevec-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    atexit.register(_remove, spark, path)


def forget(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _remove(df.sparkSession, path)


class Former:
    """Written tables that newer ones have replaced. The last few stay, for
    plans over them that haven't run yet."""

    def __init__(self, keep: int = 8):
        self.keep, self.tables = keep, []

    def add(self, df: DataFrame) -> None:
        self.tables.append(df)
        while len(self.tables) > self.keep:
            forget(self.tables.pop(0))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is None:
            raise RuntimeError
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        if path.startswith("file://") and os.path.isdir(path[7:]):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def rows_in(df: DataFrame) -> int:
    """Row count; of a written table this reads file footers only."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
