"""Maintenance policy: which actions a store's statistics call for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgevec.operators import ivf
from ridgevec.session import written


@dataclass(frozen=True)
class Policy:
    trim_tail: bool = True
    trim_tail_min_dead: int = 1
    snapshot: bool = False
    snapshot_if_dead_ratio: float | None = None
    snapshot_min_interval_ms: int | None = None
    ivf_rebuild: bool = False
    ivf_rebuild_if_dead_ratio: float | None = None
    #: Settings of a throw-away index for list statistics: ``nlist`` and, if
    #: wanted, ``iters``, ``seed``, ``sample`` and ``metric``.
    ivf_stats: Mapping | None = None


def evaluate(stats: DataFrame, policy: Policy, now_ms: int | Column) -> DataFrame:
    """Adds ``do_trim``, ``do_snapshot`` and ``do_ivf_rebuild`` to rows with
    ``dead_ratio``, ``tail_dead_count`` and ``last_snapshot_at``. Null figures
    trigger nothing; a store that never had a snapshot is infinitely old."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    yes, no = F.lit(True), F.lit(False)
    trim = F.coalesce(F.col("tail_dead_count") >= policy.trim_tail_min_dead, no) if policy.trim_tail else no
    snap = yes if policy.snapshot else no
    if policy.snapshot_if_dead_ratio is not None:
        snap = snap | F.coalesce(F.col("dead_ratio") >= policy.snapshot_if_dead_ratio, no)
    if policy.snapshot_min_interval_ms is not None:
        snap = snap | (now - F.coalesce("last_snapshot_at", F.lit(0)) >= policy.snapshot_min_interval_ms)
    rebuild = yes if policy.ivf_rebuild else no
    if policy.ivf_rebuild_if_dead_ratio is not None:
        rebuild = rebuild | F.coalesce(F.col("dead_ratio") >= policy.ivf_rebuild_if_dead_ratio, no)
    return stats.withColumns({"do_trim": trim, "do_snapshot": snap, "do_ivf_rebuild": rebuild})


#: Figures of a report, as those of an empty store (fixed values).
EMPTY = {"live_count": 0, "deleted_count": 0, "dead_ratio": 0.0, "tail_dead_count": 0, "tail_dead_ratio": 0.0, "next_id": 0, "id_count": 0, "chunk_rows": 0, "chunks": 0}


def list_report(rows: DataFrame, settings: Mapping | None) -> dict:
    """List sizes, imbalance and deviation of an index trained on ``(internal_id,
    vec)`` for this report alone. Without settings, without a positive whole
    ``nlist``, or without rows there are none."""
    nlist = (settings or {}).get("nlist")
    if not isinstance(nlist, int) or isinstance(nlist, bool) or nlist <= 0 or not rows.limit(1).count():
        return {}
    more = {k: settings[k] for k in ("iters", "seed", "sample") if settings.get(k) is not None}
    index = ivf.train(rows, nlist, metric=settings.get("metric", "dot"), **more)
    sizes = written(ivf.list_sizes(ivf.assign(rows, index), index), "sizes")
    figures = ivf.list_stats(sizes).first()
    return {"list_sizes": [r["size"] for r in sizes.orderBy("list_id").collect()], **figures.asDict()}  # a row a list


def latest_reports(reports: DataFrame) -> DataFrame:
    """Each store's last report (ties: the one that sorts last)."""
    cols = [c for c in reports.columns if c not in ("db_name", "reported_at")]
    best = F.max(F.struct("reported_at", *cols)).alias("r")
    return reports.where("db_name IS NOT NULL").groupBy("db_name").agg(best).select("db_name", "r.*")


def list_figures(sizes: Column) -> tuple[Column, Column]:
    """Imbalance and population deviation of an array of list sizes; an empty
    array gives zeros, a null one nulls."""
    n = F.size(sizes)
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    squares = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(x, F.lit(0)))
    mean = total / F.greatest(n, F.lit(1))
    imbalance = F.when(sizes.isNotNull(), F.when(mean > 0, F.array_max(sizes) / mean).otherwise(0.0))
    std = F.when(sizes.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), squares / F.greatest(n, F.lit(1)) - mean * mean)))
    return imbalance, std
