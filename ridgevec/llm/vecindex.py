"""Links between similar vectors found in the leaves of space-partition trees.

Trees are fitted on bounded samples; two of them, fitted apart, lose far less
than one that is searched twice as far. A cell that has come to hold more than
its share, as the number of leaves ends with the sample, is split on in its
task, so work grows with the rows.

Vectors travel as 8-bit codes with a proven error bound: one scale a vector,
and the exact norm of what the rounding lost. A pair whose coded similarity
clears the threshold by more than the bound is linked, one that misses it by
more is not. Vectors of pairs in between, if they aren't joined otherwise, are
met again in their cell with the stored floats, so a link is never a matter of
the codes, and what travels grows with the vectors, not with the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgevec.llm.trees import SplitTree
from ridgevec.session import rows_in, written

#: Vectors a leaf should hold, and the bounded sample that trees are fitted on.
CELL_ROWS, SAMPLE_ROWS = 512, 32768
#: Least number of sample points a leaf is fitted on.
LEAF_SAMPLE = 8
#: Rounding of similarities to 6 decimals moves the threshold by half a unit.
HALF_UNIT = 5e-7
BLOCK = 1024
#: Rows of a cell that are compared at once, and leaves that a row goes to when a
#: cell of more rows is split.
PART_ROWS, PART_PROBES = 4096, 4


def unpack(col: pa.Array, dtype="<f4", dim: int = 64) -> np.ndarray:
    """Rows of a binary column of equally long values as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if not n:
        return np.zeros((0, dim), dtype)
    off = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data.view(dtype).reshape(n, -1)


def pack(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    off = (np.arange(len(x) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms in double precision; scaled first so that the
    squares of very large or small elements neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.maximum(x.max(1), -x.min(1))[:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, their scales, and the norms of the rounding errors."""
    scale = (np.abs(u).max(1) / 127).astype(np.float32)
    code = np.rint(u / scale[:, None]).astype(np.int8)
    err = np.sqrt(((u - code * scale[:, None].astype(np.float64)) ** 2).sum(1)).astype(np.float32)
    return code, scale, err * np.float32(1.001)


def sample_units(classes: DataFrame, total: int, size: int = SAMPLE_ROWS) -> np.ndarray:
    """At most about ``size`` unit vectors, picked by a hash of the id; the
    bound holds whatever the table's size, and the pick doesn't depend on
    partitioning."""
    share = min(1.0, size / max(1, total))
    cut = int(share * (1 << 30))
    picked = classes if share >= 1 else classes.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 30)) < cut)
    rows = picked.select("rep", "vec").limit(2 * size).toArrow().sort_by("rep")
    return unit(unpack(rows["vec"])).astype(np.float32)


def leaf_count(total: int, cell_rows: int = CELL_ROWS, sample: int = SAMPLE_ROWS) -> int:
    """Leaves so that a leaf is home to ``cell_rows`` vectors, but fitted on
    no fewer than ``LEAF_SAMPLE`` sample points."""
    return int(max(1, min(total // cell_rows, min(total, sample) // LEAF_SAMPLE)))


@dataclass
class Router:
    """What a task needs to route a block of vectors to leaves."""

    tree: SplitTree
    projection: np.ndarray | None  # None: the tree cuts the vectors themselves
    probes: int
    stop: object = None  # callable on margins

    def leaves(self, u: np.ndarray):
        feats = u.astype(np.float32)
        return self.tree.probe(feats if self.projection is None else feats @ self.projection, self.probes, self.stop)


def routed(classes: DataFrame, routers: list[Router]) -> DataFrame:
    """``(cell, rep, code, scale, err)``, a row for each leaf of a vector in
    each tree."""
    # the routers travel with the task: at most SAMPLE_ROWS / LEAF_SAMPLE planes each, 1 MB
    first = np.cumsum([0] + [r.tree.leaves for r in routers])

    def run(batches):
        for b in batches:
            rep = b.column(0).to_numpy()
            u = unit(unpack(b.column(1)))
            code, scale, err = encode(u)
            for s in range(0, len(rep), 8192):
                for r, router in enumerate(routers):
                    row, leaf, _ = router.leaves(u[s : s + 8192])
                    row = row + s
                    yield pa.record_batch([pa.array((leaf + first[r]).astype(np.int32)), pa.array(rep[row]), pack(code[row]), pa.array(scale[row]), pa.array(err[row])], names=["cell", "rep", "code", "scale", "err"])

    return classes.select("rep", "vec").mapInArrow(run, "cell int, rep bigint, code binary, scale float, err float")


def lowest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Closes labels (smallest row of a component) under the links ``i, j``."""
    while len(i):
        open_ = label[i] != label[j]
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        low = np.minimum(label[i], label[j])
        high = np.maximum(label[i], label[j])
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def closed(x: np.ndarray, least: float) -> np.ndarray:
    """Single linkage of all rows at ``least``: label (smallest row) of each.
    Works in blocks of ``BLOCK`` rows."""
    label = np.arange(len(x))
    for s in range(0, len(x), BLOCK):
        i, j = np.nonzero(x[s : s + BLOCK] @ x[s:].T >= least)
        label = lowest(label, i + s, j + s)
    return label


def by_parts(x: np.ndarray, most: int, split):
    """Row sets of a crowded cell, so that no set has many more than ``most``
    rows: ``split(x, leaves)`` gives a tree and features to route by. Rows go
    to their ``PART_PROBES`` nearest leaves of it."""
    if len(x) <= most:
        return [np.arange(len(x))]
    tree, feats = split(x, -(-len(x) * PART_PROBES // (most // 2)))
    row, leaf, _ = tree.probe(feats, PART_PROBES)
    order = np.argsort(leaf, kind="stable")
    return np.split(row[order], np.flatnonzero(np.diff(leaf[order])) + 1)


def cell_links(cells: DataFrame, link) -> DataFrame:
    """``(a, b, doubt)``: in every cell, each vector's link to the smallest id
    of its local component; with ``doubt`` set, a vector ``b`` of the cell
    ``a`` that only the stored floats can decide about. ``link(x, slack)``
    gives labels and such rows for similarities that are off by up to
    ``slack``."""

    def run(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        x = (unpack(t["code"], np.int8).astype(np.float32) * t["scale"].to_numpy()[:, None])[order]
        emax = float(t["err"].to_numpy().max())
        label, doubt = link(x, 2 * emax + emax * emax + 1e-5)
        far = np.flatnonzero(label != np.arange(len(label)))
        cell = np.full(int(doubt.sum()), t["cell"][0].as_py(), np.int64)
        a = np.concatenate([rep[far], cell])
        b = np.concatenate([rep[label[far]], rep[doubt]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "doubt": pa.array(np.arange(len(a)) >= len(far))})

    return cells.groupBy("cell").applyInArrow(run, "a bigint, b bigint, doubt boolean")


def exact_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` links of the vectors ``(cell, rep, vec)``, cell by cell, on
    the stored floats."""

    def run(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        label = closed(unit(unpack(t["vec"])[order]), threshold - HALF_UNIT)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(rep[far], pa.int64()), "b": pa.array(rep[label[far]], pa.int64())})

    return rows.groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def similar_links(classes: DataFrame, routers: list[Router], link, threshold: float) -> DataFrame:
    """``(a, b)`` links whose closure joins all classes that are at least
    ``threshold`` similar and meet in a leaf of one of the trees."""
    links = written(cell_links(routed(classes, routers), link).distinct(), "links")
    sure = links.where("NOT doubt").select("a", "b")
    doubt = links.where("doubt").select(F.col("a").alias("cell"), F.col("b").alias("rep"))
    if not rows_in(doubt):
        return sure
    return sure.unionByName(exact_links(doubt.join(classes.select("rep", "vec"), "rep"), threshold))
