"""Facades: an in-session vector database and a persistent one.

Both are thin: a database is a DataFrame of live rows plus settings, every
search is a plan over it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.functions import generators, scores
from ridgevec.operators import ivf, maintenance, store
from ridgevec.operators import search as srch
from ridgevec.session import Former, written
from ridgevec.sources.snapshots import SnapshotStore

ROWS = "id string, internal_id bigint, vec array<float>, meta string"


class VectorDB:
    """Exact and inverted-list search over rows held in the session.

    Cosine databases store unit vectors. Changes are gathered on the driver
    call by call or taken as DataFrames, and folded last-writer-wins."""

    def __init__(self, spark: SparkSession, dimensions: int, metric: str = "cosine", schema: Mapping | None = None, threshold: float | None = None):
        if not isinstance(dimensions, int) or isinstance(dimensions, bool) or dimensions <= 0:
            raise ValueError("dimensions must be a positive integer")
        if metric not in scores.METRICS:
            raise ValueError(f"metric must be one of {scores.METRICS}")
        self.spark, self.dim, self.metric, self.schema, self.threshold = spark, dimensions, metric, dict(schema or {}), threshold
        self._seq = 0
        self._small: list[tuple] = []
        self._rows = spark.createDataFrame([], ROWS)
        self._next = 0
        self._index: ivf.IvfIndex | None = None
        self._lists: DataFrame | None = None
        self._former = Former()

    @classmethod
    def open(cls, spark: SparkSession, dimensions: int, metric: str = "cosine", **kw) -> VectorDB:
        return cls(spark, dimensions, metric, **kw)

    # -- changes ----------------------------------------------------------
    def _checked(self, vector: Sequence[float]) -> list[float]:
        if len(vector) != self.dim:
            raise ValueError(f"vector must have {self.dim} elements")
        return [float(x) for x in scores.query_vector(vector)]

    def _note(self, op: str, id: str, vec, meta) -> None:
        if not isinstance(id, str) or not id:
            raise ValueError("id must be a non-empty string")
        self._seq += 1
        self._small.append((self._seq, op, id, vec, meta))

    def upsert(self, id: str, vector: Sequence[float], metadata: Mapping | None = None) -> None:
        """Metadata given replaces the former whole; omitted keeps it."""
        self._note("upsert", id, self._checked(vector), None if metadata is None else json.dumps(metadata))

    def delete(self, id: str) -> bool:
        there = self.get(id).limit(1).count() > 0
        self._note("delete", id, None, None)
        return there

    def upsert_batch(self, rows: DataFrame) -> None:
        """``(id, vec[, meta])``; of repeated ids one row counts."""
        if rows.where(f"id IS NULL OR id = '' OR vec IS NULL OR size(vec) <> {self.dim}").limit(1).count():
            raise ValueError(f"rows need an id and {self.dim} elements")
        self._flush()
        meta = F.col("meta").cast("string") if "meta" in rows.columns else F.lit(None).cast("string")
        change = rows.select(F.lit(self._seq + 1).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), "id", F.col("vec").cast("array<float>").alias("vec"), meta.alias("meta"))
        self._apply(change)

    def generate(self, seed: int, n: int, scale: float = 0.5, prefix: str = "id_", first: int = 0) -> None:
        self.upsert_batch(generators.lcg_vectors(self.spark, seed, n, self.dim, scale, prefix, first).select("id", "vec"))

    def _flush(self) -> None:
        if self._small:
            change = self.spark.createDataFrame(self._small, "seq bigint, op string, id string, vec array<float>, meta string")
            self._small = []
            self._apply(change)

    def _apply(self, change: DataFrame) -> None:
        if self.metric == "cosine":
            change = change.withColumn("vec", scores.unit(F.col("vec")))
        base, self._seq = self._rows, self._seq + 1
        start = base.select(F.lit(0).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), "id", "vec", "meta")
        now = store.live(start.unionByName(change), dim=self.dim)
        named = now.join(base.select("id", "internal_id"), "id", "left")
        old = named.where("internal_id IS NOT NULL").select("id", "internal_id", "vec", "meta")
        fresh = store.dense_ids(named.where("internal_id IS NULL").drop("internal_id"), "seq", self._next).select("id", "internal_id", "vec", "meta")
        self._rows = written(old.unionByName(fresh), "db")
        top = self._rows.agg(F.max("internal_id").alias("m")).first()["m"]
        self._next = max(self._next, -1 if top is None else top) + (top is not None and top >= self._next)
        if self._index is not None:
            # only the rows of the change are assigned; all others keep their list
            ids, lists = change.select("id").distinct(), self._lists
            put = self._rows.join(ids, "id", "left_semi").withColumn("op", F.lit("upsert"))
            gone = ids.join(self._rows.select("id"), "id", "left_anti").withColumn("op", F.lit("delete"))
            delta = put.unionByName(gone, allowMissingColumns=True)
            self._lists = written(ivf.apply_delta(lists, delta, self._index), "lists")
            self._former.add(lists)
        self._former.add(base)

    # -- export and restore -------------------------------------------------
    def snapshot(self) -> dict:
        """The state as a value: settings and a written table of its rows."""
        self._flush()
        rows = written(self._rows, "export") if self._next else self._rows
        return {"dim": self.dim, "metric": self.metric, "next_id": self._next, "rows": rows}

    def restore(self, state: Mapping) -> None:
        """Takes the state of a snapshot instead of its own; another dimension
        or metric is an error. Lists are to be built again."""
        if state["dim"] != self.dim or state["metric"] != self.metric:
            raise ValueError("the snapshot's dim and metric differ from the database's")
        self._small, self._index, self._lists = [], None, None
        self._rows, self._next = written(state["rows"].select("id", "internal_id", "vec", "meta"), "db"), state["next_id"]

    def export_rows(self) -> DataFrame:
        """``(internal_id, id, meta)`` in order of internal id."""
        self._flush()
        return self._rows.select("internal_id", "id", "meta").orderBy("internal_id")

    # -- reads ------------------------------------------------------------
    def rows(self) -> DataFrame:
        """Live rows; hot fields of the schema as typed columns."""
        self._flush()
        out = self._rows
        for field, kind in self.schema.items():
            v = F.try_variant_get(F.try_parse_json("meta"), f"$.{field}", "variant")
            t = F.schema_of_variant(v)
            if kind == "number":
                number = F.when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "float"))
                out = out.withColumn(field, number)
            elif kind == "boolean":
                out = out.withColumn(field, F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean")))
            else:
                text = F.when(t == "STRING", F.try_variant_get(v, "$", "string"))
                out = out.withColumn(field, F.when(text.isin(list(kind)), text))
        return out

    def size(self) -> int:
        self._flush()
        return self._rows.count()

    def get(self, id: str) -> DataFrame:
        self._flush()
        return srch.get(self._rows, id)

    def search(self, query: Sequence[float], k: int = 10, where: Mapping | None = None, score_threshold: float | None = None) -> DataFrame:
        """``(id, internal_id, score, metadata)``, best first."""
        if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
            raise ValueError("k must be a positive integer")
        t = self.threshold if score_threshold is None else score_threshold
        hits = srch.search(self.rows(), query, k, self.metric, where, self.schema, t, stored_unit=self.metric == "cosine", keep=("meta",), dim=self.dim)
        return hits.withColumnRenamed("meta", "metadata")

    def search_many(self, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
        return srch.batch_search(self.rows(), queries, k, self.metric, schema=self.schema, **kw)

    # -- inverted lists ---------------------------------------------------
    def build_ivf(self, nlist: int, iters: int = 20, seed: int = 1234, sample: int = ivf.SAMPLE) -> None:
        self._flush()
        self._index = ivf.train(self._rows, nlist, iters, seed, sample, self.metric)
        self._lists = written(ivf.assign(self._rows, self._index), "lists")

    def search_ivf(self, query: Sequence[float], k: int = 10, nprobe: int = 8, **kw) -> DataFrame:
        self._flush()
        if self._index is None:
            raise RuntimeError("build_ivf first")
        return ivf.search(self._lists, self._index, query, k, nprobe, schema=self.schema, stored_unit=self.metric == "cosine", **kw)

    def list_sizes(self) -> DataFrame:
        self._flush()
        if self._index is None:
            raise RuntimeError("build_ivf first")
        return ivf.list_sizes(self._lists, self._index)

    def stats(self, chunk_rows: int = 4096) -> DataFrame:
        self._flush()
        return store.store_stats(self._rows.withColumn("deleted", F.lit(False)), self.dim, chunk_rows, self._next)


class PersistentVectorDB:
    """A database over a :class:`SnapshotStore`: changes go to the journal
    first, reads see the latest snapshot with the journal applied."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int, metric: str = "cosine", chunk_rows: int = 4096):
        self.store = SnapshotStore(spark, path, dimensions, chunk_rows)
        self.spark, self.metric = spark, metric

    def upsert(self, id: str, vector: Sequence[float], metadata: Mapping | None = None) -> int:
        row = [("upsert", id, [float(x) for x in vector], None if metadata is None else json.dumps(metadata))]
        return self.store.append(self.spark.createDataFrame(row, "op string, id string, vec array<float>, meta string"))

    def upsert_batch(self, rows: DataFrame) -> int:
        return self.store.append(rows.withColumn("op", F.lit("upsert")))

    def delete(self, id: str) -> bool:
        """Whether there was such an id; if not, nothing is noted."""
        there = self.get(id).limit(1).count() > 0
        if there:
            self.store.append(self.spark.createDataFrame([("delete", id, None, None)], "op string, id string, vec array<float>, meta string"))
        return there

    def get(self, id: str) -> DataFrame:
        return self.store.get(id)

    def search(self, query: Sequence[float], k: int = 10, **kw) -> DataFrame:
        return srch.search(self.store.load(), query, k, self.metric, keep=("meta",), dim=self.store.dim, **kw)

    def snapshot_now(self) -> str:
        return self.store.save()

    def compact_now(self) -> str:
        """A snapshot holds no dead rows, so taking one compacts."""
        return self.store.save()

    def stats(self, ivf_stats: Mapping | None = None) -> dict:
        """Counts, dead ratios, the dead tail, header and list figures. Ids that
        the snapshot has and the view hasn't any more are dead."""
        base, _, next_id = self.store._base()
        view = self.store.load()
        rows = view.select("id", "internal_id", F.lit(False).alias("deleted"))
        lost = base.select("internal_id").join(rows, "internal_id", "left_anti").select(F.lit(None).cast("string").alias("id"), "internal_id", F.lit(True).alias("deleted"))
        both = rows.unionByName(lost)
        top = both.agg(F.coalesce(F.max("internal_id") + 1, F.lit(0)).alias("n")).first()["n"]
        out = store.store_stats(both, self.store.dim, self.store.chunk_rows, max(next_id, top)).first().asDict()
        m = self.store.latest()
        head = {"journal_seq": self.store.meta_state()["last_seq"], "last_snapshot_at": m and m["created_at"]}
        return {k: out.get(k, v) for k, v in maintenance.EMPTY.items()} | head | maintenance.list_report(view, ivf_stats)

    def maintain(self, policy: maintenance.Policy, now_ms: int | None = None) -> dict:
        """Acts on the policy: ``{"stats": ..., "actions": ...}``, the figures
        as they are afterwards. A trim gives the dead tail's ids and chunks
        back; it lasts if a snapshot is taken in the same run. An index is never
        rebuilt here, only called for."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        before = self.stats()
        kinds = "dead_ratio double, tail_dead_count bigint, last_snapshot_at bigint"
        row = [(before["dead_ratio"], before["tail_dead_count"], before["last_snapshot_at"])]
        do = maintenance.evaluate(self.spark.createDataFrame(row, kinds), policy, now_ms).first()
        actions: dict = {}
        tail = before["tail_dead_count"]
        if do["do_trim"]:
            new = before["next_id"] - tail
            chunks = lambda n: -(-n // self.store.chunk_rows)
            actions |= {"trimmed_chunks": chunks(before["next_id"]) - chunks(new), "new_next_id": new}
        if do["do_snapshot"]:
            actions["snapshot_id"] = self.store.save(trim=do["do_trim"])
        if do["do_ivf_rebuild"]:
            actions["ivf_rebuild"] = True
        after = self.stats(policy.ivf_stats)
        if do["do_trim"] and not do["do_snapshot"]:
            new, total = actions["new_next_id"], after["live_count"] + after["deleted_count"] - tail
            dead = after["deleted_count"] - tail
            after |= {"next_id": new, "deleted_count": dead, "dead_ratio": round(dead / total, 6) if total else 0.0, "tail_dead_count": 0, "tail_dead_ratio": 0.0, "chunks": -(-new // self.store.chunk_rows)}
        return {"stats": after, "actions": actions}

    def request(self, kind: str, policy: maintenance.Policy | None = None) -> dict:
        """A maintenance request: ``stats``, ``run`` or ``snapshot``. What fails
        is told in ``error``, with the figures of an empty store."""
        try:
            policy = policy or maintenance.Policy()
            if kind == "stats":
                return {"stats": self.stats(policy.ivf_stats), "actions": {}}
            if kind == "run":
                return self.maintain(policy)
            if kind == "snapshot":
                actions = {"snapshot_id": self.store.save()}
                return {"stats": self.stats(), "actions": actions}
            raise ValueError("kind must be stats, run or snapshot")
        except Exception as e:  # noqa: BLE001
            return {"stats": dict(maintenance.EMPTY), "actions": {}, "error": str(e)}
