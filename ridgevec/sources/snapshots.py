"""A store on a file system: journal, snapshots, and atomic commits.

Layout under one folder: ``journal/`` holds append batches named by their first
and last sequence number, ``snapshots/<id>/rows`` the folded rows, and
``snapshots/<id>/manifest`` one row, written last. A reader takes only snapshots
with a manifest, so one that broke off midway is never seen; the journal is cut
only by whole batches that the snapshot has folded. One writer at a time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.operators import store
from ridgevec.session import Former, written

ENTRY = "seq bigint, ts bigint, op string, id string, vec array<float>, meta string"
ROWS = "id string, internal_id bigint, vec array<float>, meta string"
MANIFEST = "snapshot_id string, format_version int, status string, created_at bigint, dim int, chunk_rows int, next_id bigint, snapshot_seq bigint"
FORMAT = 1


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, dim: int, chunk_rows: int = 4096):
        if not isinstance(dim, int) or dim <= 0:
            raise ValueError("dim must be a positive integer")
        if chunk_rows <= 0 or chunk_rows & (chunk_rows - 1):
            raise ValueError("chunk_rows must be a power of two")
        self.spark, self.path, self.dim, self.chunk_rows = spark, path.rstrip("/"), dim, chunk_rows
        self._view: tuple[object, DataFrame] | None = None
        self._former = Former()

    # -- files ----------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _done(self, path: str) -> bool:
        p, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    # -- journal ----------------------------------------------------------
    def _batches(self) -> list[tuple[int, int, str]]:
        out = []
        for name in self._list(f"{self.path}/journal"):
            if self._done(f"{self.path}/journal/{name}"):
                a, b = name.split("-")
                out.append((int(a), int(b), name))
        return out

    def last_seq(self) -> int:
        return max([b for _, b, _ in self._batches()] + [m["snapshot_seq"] for m in self.manifests()] + [0])

    def append(self, changes: DataFrame) -> int:
        """Appends ``(op, id, vec[, meta])``; upserts are checked before any
        number is given out. Rows get consecutive numbers in the order of the
        column ``ord`` if there is one, else in no particular order. Returns
        the last sequence number."""
        meta = F.col("meta") if "meta" in changes.columns else F.lit(None)
        order = F.col("ord") if "ord" in changes.columns else F.xxhash64("id")
        rows = changes.select(F.lower(F.trim("op")).alias("op"), "id", F.col("vec").cast("array<float>").alias("vec"), meta.cast("string").alias("meta"), order.alias("ord"))
        bad = rows.where("id IS NULL OR id = '' OR op IS NULL OR op NOT IN ('upsert', 'delete')" + f" OR (op = 'upsert' AND (vec IS NULL OR size(vec) <> {self.dim}))")
        if bad.limit(1).count():
            raise ValueError(f"entries need an id, a known operation and, for upserts, {self.dim} elements")
        first = self.last_seq() + 1
        numbered = store.dense_ids(rows, "ord", first).withColumnRenamed("internal_id", "seq")
        last = first - 1 + numbered.count()
        if last >= first:
            now = int(time.time() * 1000)
            out = numbered.select("seq", F.lit(now).cast("bigint").alias("ts"), "op", "id", "vec", "meta")
            out.write.parquet(f"{self.path}/journal/{first:020d}-{last:020d}")
        return last

    def journal(self) -> DataFrame:
        paths = [f"{self.path}/journal/{name}" for _, _, name in self._batches()]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def truncate(self, upto: int) -> int:
        """Drops whole batches up to a sequence number; returns how many."""
        gone = [name for _, b, name in self._batches() if b <= upto]
        for name in gone:
            self._delete(f"{self.path}/journal/{name}")
        return len(gone)

    # -- snapshots ----------------------------------------------------------
    def manifests(self) -> list[dict]:
        out = []
        for name in self._list(f"{self.path}/snapshots"):
            where = f"{self.path}/snapshots/{name}/manifest"
            if self._done(where):
                out += [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(where).collect()]
        return out

    def latest(self) -> dict | None:
        """The complete snapshot with the greatest sequence number."""
        done = [m for m in self.manifests() if m["status"] == "complete"]
        return max(done, key=lambda m: (m["snapshot_seq"], m["created_at"], m["snapshot_id"])) if done else None

    def _base(self) -> tuple[DataFrame, int, int]:
        m = self.latest()
        if m is None:
            return self.spark.createDataFrame([], ROWS), 0, 0
        if m["dim"] != self.dim or m["chunk_rows"] != self.chunk_rows:
            raise ValueError("the snapshot's dim and chunk_rows differ from the store's")
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/snapshots/{m['snapshot_id']}/rows"), m["snapshot_seq"], m["next_id"]

    def _now(self) -> tuple:
        """What a folded view depends on: the snapshot and the batches."""
        m = self.latest()
        return m and m["snapshot_id"], tuple(self._batches())

    def load(self) -> DataFrame:
        """Live rows ``(id, internal_id, vec, meta)``: the latest snapshot with
        the later journal applied. Ids keep their internal id; new ones get the
        next, in order of their last change. Folded once and kept until the
        journal or the snapshot moves; without a later journal the snapshot's
        rows are the view."""
        base, seq, next_id = self._base()
        now = self._now()
        if self._view and self._view[0] == now:
            return self._view[1]
        if not any(b > seq for _, b, _ in now[1]):
            view = base
        else:
            folded = store.replay(base.select("id", "vec", "meta"), self.journal(), seq, dim=self.dim)
            named = folded.join(base.select("id", "internal_id"), "id", "left")
            old = named.where("internal_id IS NOT NULL").select("id", F.col("internal_id").cast("bigint").alias("internal_id"), "vec", "meta")
            fresh = store.dense_ids(named.where("internal_id IS NULL").drop("internal_id"), "seq", next_id).select("id", "internal_id", "vec", "meta")
            view = written(old.unionByName(fresh), "view")
        if self._view:
            self._former.add(self._view[1])
        self._view = now, view
        return view

    def get(self, external_id: str) -> DataFrame:
        """One id. It is looked for in the snapshot and the journal before the
        fold; only an id that the snapshot hasn't, whose internal id depends on
        the others, needs the whole view."""
        base, seq, _ = self._base()
        mine = F.col("id") == external_id
        row = base.where(mine).select("internal_id").first()
        if row is None:
            return self.load().where(mine)
        folded = store.replay(base.where(mine).select("id", "vec", "meta"), self.journal().where(mine), seq, dim=self.dim)
        return folded.select("id", F.lit(row["internal_id"]).cast("bigint").alias("internal_id"), "vec", "meta")

    def meta_state(self) -> dict:
        """The header: snapshot in use and last sequence number."""
        m = self.latest()
        return {"active_snapshot_id": m and m["snapshot_id"], "last_seq": self.last_seq()}

    def save(self, break_before_manifest: bool = False, trim: bool = False) -> str:
        """Folds, writes rows, then the manifest, then cuts the journal. The
        sequence number is that of what was folded, not of a later head. With
        ``trim`` the next internal id follows the last live one, so those of a
        dead tail are given out again."""
        _, base_seq, base_next = self._base()
        upto = max([b for _, b, _ in self._batches()] + [base_seq])
        sid = f"{int(time.time() * 1000)}_{uuid.uuid4().hex[:12]}"
        where = f"{self.path}/snapshots/{sid}"
        self.load().write.parquet(f"{where}/rows")
        if break_before_manifest:
            return sid
        rows = self.spark.read.schema(ROWS).parquet(f"{where}/rows")
        top = rows.agg(F.max("internal_id").alias("m")).first()["m"]
        next_id = max(0 if trim else base_next, (top + 1) if top is not None else 0)
        row = (sid, FORMAT, "complete", int(time.time() * 1000), self.dim, self.chunk_rows, next_id, upto)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{where}/manifest")
        self.truncate(upto)
        return sid

    def prune(self, keep: int = 2) -> int:
        """Deletes all but the latest ``keep`` complete snapshots."""
        done = sorted(self.manifests(), key=lambda m: (m["snapshot_seq"], m["created_at"]), reverse=True)
        for m in done[keep:]:
            self._delete(f"{self.path}/snapshots/{m['snapshot_id']}")
        return len(done[keep:])
