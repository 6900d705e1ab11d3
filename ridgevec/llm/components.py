"""Connected components over an edge table by alternating stars.

Each round joins edges with the smallest neighbour of one end and re-hangs the
others on it; hubs are re-hung by equi-joins whose hub side is a plain row, so
a hub that holds a third of all edges is split by the adaptive skew join and
never gathered. Edges are written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgevec.session import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` are (hi, lo), hi > lo."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        up = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        out = up.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        out = edges.withColumnRenamed("hi", "u").join(least, "u").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        out = out.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi > lo").distinct()


def _print(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` of every id that has a link to another one; ``root`` is
    the smallest id of its component. Null ends and self links are no links;
    repeated links count once; no links give no rows."""
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = written(edges, "edges")
    before = _print(edges)
    for _ in range(max_rounds):
        old, edges = edges, written(_star(_star(edges, True), False), "edges")
        forget(old)
        now = _print(edges)
        if now == before:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
