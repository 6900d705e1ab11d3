"""Deterministic vectors from the linear congruential generator.

The generator can jump: n steps are one multiplication and one addition modulo
2^32. Every row jumps to its own place, so rows are made in any number of tasks
and equal those of one sequential run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgevec.operators.kmeans import INCREMENT, MODULUS, MULTIPLIER

MASK = np.uint64(MODULUS - 1)


def jump(state: int, steps: np.ndarray) -> np.ndarray:
    """State after each number of steps, by repeated squaring of the map."""
    left = steps.astype(np.uint64).copy()
    mul, add = np.ones(len(left), np.uint64), np.zeros(len(left), np.uint64)
    m, a = MULTIPLIER, INCREMENT
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        mul[odd] = (mul[odd] * np.uint64(m)) & MASK
        add[odd] = (add[odd] * np.uint64(m) + np.uint64(a)) & MASK
        m, a = m * m % MODULUS, (a * m + a) % MODULUS
        left >>= np.uint64(1)
    return (mul * np.uint64(state % MODULUS) + add) & MASK


def lcg_vectors(spark: SparkSession, seed: int, n: int, dim: int, scale: float = 0.5, prefix: str = "id_", first: int = 0) -> DataFrame:
    """``(id, internal_id, vec)``: elements ``(u * 2 - 1) * scale`` in 32 bits."""

    def run(batches):
        steps = np.arange(1, dim + 1, dtype=np.uint64)
        for b in batches:
            i = b.column(0).to_numpy().astype(np.uint64)
            states = jump(seed, (i[:, None] * np.uint64(dim) + steps[None, :]).ravel())
            x = ((states.astype(np.float64) / MODULUS * 2 - 1) * scale).astype(np.float32)
            off = pa.array((np.arange(len(i) + 1) * dim).astype(np.int32))
            ids = (i + np.uint64(first)).astype(np.int64)
            yield pa.record_batch([pa.array([f"{prefix}{k}" for k in ids]), pa.array(ids), pa.ListArray.from_arrays(off, pa.array(x))], names=["id", "internal_id", "vec"])

    return spark.range(n).mapInArrow(run, "id string, internal_id bigint, vec array<float>")
