"""Usable vectors out of packed chunks and live batches.

A usable vector sits at a position with ``tomb`` 0 of a chunk (whatever its
snapshot) or in a live batch, has all ``dim`` elements, all finite and not all
zero. Null arrays, short arrays and null elements make only the positions they
touch unusable; extra columns are ignored. Each internal id counts once: copies
of an id hold the same content by contract, and where they don't the copy with
the smallest content hash is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgevec.session import written

DIM, CHUNK_ROWS = 64, 16


def _pack(ids: list, vecs: list, width: int) -> pa.RecordBatch:
    i = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    v = np.concatenate(vecs).astype("<f4") if vecs else np.zeros((0, width), "<f4")
    offsets = (np.arange(len(i) + 1, dtype=np.int64) * width * 4).astype(np.int32)
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v))])
    return pa.record_batch([pa.array(i, pa.int64()), raw], names=["id", "vec"])


def _floats(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Elements (null as NaN) and offsets of a list column; a null list is empty."""
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat, np.asarray(col.offsets)


def _good(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(1) & (x != 0).any(1)


def _chunk_batches(dim: int, per: int):
    def run(batches):
        for b in batches:
            at, vecs, tomb = (b.column(k) for k in range(3))
            flat, off = _floats(vecs)
            dead, toff = tomb.values.to_numpy(zero_copy_only=False), np.asarray(tomb.offsets)
            index = at.to_numpy(zero_copy_only=False)
            usable = at.is_valid().to_numpy(zero_copy_only=False) & vecs.is_valid().to_numpy(zero_copy_only=False) & tomb.is_valid().to_numpy(zero_copy_only=False)
            ids, out = [], []
            for r in np.flatnonzero(usable):
                n = min(per, (off[r + 1] - off[r]) // dim, toff[r + 1] - toff[r])
                x = flat[off[r] : off[r] + n * dim].reshape(n, dim)
                ok = np.flatnonzero(_good(x) & (dead[toff[r] : toff[r] + n] == 0))
                if len(ok):
                    ids.append(int(index[r]) * per + ok)
                    out.append(x[ok])
            yield _pack(ids, out, dim)

    return run


def _live_batches(dim: int):
    def run(batches):
        for b in batches:
            ids_col, vecs = b.column(0), b.column(1)
            flat, off = _floats(vecs)
            names, noff = ids_col.values.to_numpy(zero_copy_only=False), np.asarray(ids_col.offsets)
            usable = ids_col.is_valid().to_numpy(zero_copy_only=False) & vecs.is_valid().to_numpy(zero_copy_only=False)
            ids, out = [], []
            for r in np.flatnonzero(usable):
                n = min((off[r + 1] - off[r]) // dim, noff[r + 1] - noff[r])
                x, name = flat[off[r] : off[r] + n * dim].reshape(n, dim), names[noff[r] : noff[r] + n].astype(np.float64)
                ok = np.flatnonzero(_good(x) & np.isfinite(name))
                if len(ok):
                    ids.append(name[ok].astype(np.int64))
                    out.append(x[ok])
            yield _pack(ids, out, dim)

    return run


def stored_vectors(chunks: DataFrame, batches: DataFrame, dim: int = DIM, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(id, vec)`` of every usable position, repeats included; ``vec`` is the
    vector as packed little-endian 32-bit floats."""
    schema = "id bigint, vec binary"
    a = chunks.select(F.col("chunk_index").cast("int"), F.col("vecs").cast("array<float>"), F.col("tomb").cast("array<tinyint>"))
    b = batches.select(F.col("ids").cast("array<int>"), F.col("vectors").cast("array<float>"))
    return a.mapInArrow(_chunk_batches(dim, chunk_rows), schema).unionByName(b.mapInArrow(_live_batches(dim), schema))


def vector_classes(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapses exact copies so that no later stage meets a hot group of them.

    Returns ``(classes, copies)``: one row ``(rep, n, vec)`` per distinct
    content, ``rep`` being its smallest id, and ``(id, rep)`` for the ids that
    are not their own representative. Only ids and 128-bit content hashes are
    grouped twice; vectors are shuffled once, after map-side combining.
    """
    hashed = stored.withColumn("h", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(17), "vec").alias("b")))
    ids = hashed.groupBy("id").agg(F.min("h").alias("h"))
    sizes = ids.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    vecs = hashed.groupBy("h").agg(F.first("vec").alias("vec"))
    classes = written(sizes.join(vecs, "h").select("h", "rep", "n", "vec"), "classes")
    several = classes.where("n > 1").select("h", "rep")
    copies = ids.join(several, "h").where("id <> rep").select("id", "rep")
    return classes.select("rep", "n", "vec"), copies
