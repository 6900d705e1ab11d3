"""Problem 1: clusters of mutually similar vectors by bisecting k-means.

Two trees, fitted on bounded samples, split the node of largest dispersion by
2-means until there is a leaf for every ``CELL_ROWS`` vectors. Each vector goes
to the nearest leaves of both, so a group that a plane cuts still meets. From
there the tasks split on, by all of a leaf's vectors, until every node is
compact: each member at least as similar to the node's medoid as the clusters
ask, so that a node is connected by proof, however many it holds. Nodes are
joined by their medoids, where those are similar; where the radii say that no
two members can be, the pair of nodes is pruned; only what is left is checked
member by member. The joined nodes are the clusters. Exact copies are one class
throughout and counted at the end.

Empty tables, no usable vector or no cluster of ``least`` members give no rows;
ties don't arise, as a cluster is named by its smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.llm import vecindex as vx
from ridgevec.llm.components import components
from ridgevec.llm.trees import compact_leaves, fit_bisecting
from ridgevec.session import rows_in, table, written
from ridgevec.sources.vectors import stored_vectors, vector_classes

#: Similarity of members, least members of a cluster, leaves of a tree that a
#: vector goes to, and seeds of the trees.
SIMILARITY, LEAST, PROBES, TREES = 0.92, 5, 3, (11, 12)
#: Rows of a node that isn't compact but needn't be split on to be linked.
FLOOR = 8


def roots(classes: DataFrame, similarity: float = SIMILARITY, probes: int = PROBES, trees: tuple = TREES) -> DataFrame:
    """``(id, root)`` of the classes that have a similar class."""
    routers = [vx.Router(tree, None, probes) for tree in fitted(classes, rows_in(classes), trees)]
    return components(vx.similar_links(classes, routers, linker(similarity), similarity))


def fitted(classes: DataFrame, total: int, trees: tuple = TREES) -> list:
    """Trees of as many leaves as ``total`` vectors need, from a bounded sample."""
    sample, leaves = vx.sample_units(classes, total), vx.leaf_count(total)
    most = max(2, 2 * len(sample) // leaves) if len(sample) else 1
    return [fit_bisecting(sample if len(sample) else np.zeros((0, 64)), leaves, most, seed) for seed in trees]


def _split(x: np.ndarray, leaves: int):
    return fit_bisecting(x, leaves, max(2, 2 * len(x) // leaves)), x


def linker(similarity: float):
    def link(x: np.ndarray, slack: float):
        return leaf_links(x, slack, similarity)

    return link


def leaf_links(x: np.ndarray, slack: float, similarity: float, most: int = vx.PART_ROWS):
    """``(label, doubt)`` of the rows of a cell whose similarities are off by up
    to ``slack``: the smallest row that each is surely linked with, by way of
    others too, and the rows that only exact similarities can decide about."""
    sure, maybe = similarity + slack, similarity - slack
    leaf, medoid, low = compact_leaves(x, sure, FLOOR)
    size = np.bincount(leaf, minlength=len(medoid))
    rows = np.split(np.argsort(leaf, kind="stable"), np.cumsum(size)[:-1])
    radius = np.where(size > 1, np.arccos(np.clip(low - slack, -1, 1)), 0.0)
    apart = np.arccos(similarity - vx.HALF_UNIT)
    joined = np.arange(len(medoid))
    doubt = np.zeros(len(x), bool)
    for part in vx.by_parts(x[medoid], most, _split):
        part = np.sort(part)
        r, rad = x[medoid[part]], radius[part]
        left = [np.zeros((2, 0), np.int64)]
        for s in range(0, len(part), vx.BLOCK):
            sim = r[s : s + vx.BLOCK] @ r[s:].T
            # least similarity at which members may be linked, by the largest radius there
            least = np.cos(np.minimum(np.pi, apart + rad[s : s + vx.BLOCK] + rad.max())) - slack
            i, j = np.nonzero(sim >= least[:, None])
            i, j, sim = i[j > i], j[j > i], sim[i[j > i], j[j > i]]
            i, j = i + s, j + s
            hit = sim >= sure
            joined = vx.lowest(joined, part[i[hit]], part[j[hit]])
            near = ~hit & (sim >= np.cos(np.minimum(np.pi, apart + rad[i] + rad[j])) - slack)
            left.append(part[np.stack([i[near], j[near]])])
        left = np.concatenate(left, axis=1)
        left = left[:, joined[left[0]] != joined[left[1]]]
        alone = (size[left] == 1).all(0)
        doubt[medoid[left[:, alone]].ravel()] = True
        left = left[:, ~alone]
        while left.shape[1]:
            now, left = left[:, :256], left[:, 256:]
            found = []
            for a, b in now.T:
                hit, da, db = _between(x, rows[a], rows[b], sure, maybe)
                if hit:
                    found.append((a, b))
                else:
                    doubt[da] = doubt[db] = True
            if found:
                joined = vx.lowest(joined, *np.array(found).T)
                left = left[:, joined[left[0]] != joined[left[1]]]
    # rows of a joined leaf, by its smallest row
    head = np.full(len(medoid), len(x))
    np.minimum.at(head, joined[leaf], np.arange(len(x)))
    return head[joined[leaf]], doubt


def _between(x: np.ndarray, a: np.ndarray, b: np.ndarray, sure: float, maybe: float):
    """Whether a row of ``a`` is surely linked with one of ``b``; if not, those
    of both that may be."""
    of_a, of_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for s in range(0, len(a), vx.BLOCK):
        for t in range(0, len(b), vx.BLOCK):
            sim = x[a[s : s + vx.BLOCK]] @ x[b[t : t + vx.BLOCK]].T
            if sim.max() >= sure:
                return True, a[:0], b[:0]
            may = sim >= maybe
            of_a[s : s + vx.BLOCK] |= may.any(1)
            of_b[t : t + vx.BLOCK] |= may.any(0)
    return False, a[of_a], b[of_b]


def clusters(classes: DataFrame, copies: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """``(internal_id, cluster_id)`` of every member of a cluster."""
    found = roots(classes, similarity)
    sized = classes.select("rep", "n").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("root"))
    big = sized.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    reps = sized.join(big, "root").select("rep", "n", "root")
    of_reps = reps.select(F.col("rep").alias("id"), "root")
    of_copies = copies.join(reps.where("n > 1"), "rep").select("id", "root")
    return of_reps.unionByName(of_copies).select(F.col("id").cast("int").alias("internal_id"), F.col("root").cast("int").alias("cluster_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, copies = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    return clusters(classes, copies)


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, mean similarity to its centre, and the three
    members nearest to the centre (ties: smaller id first)."""
    classes, copies = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    return describe(classes, copies)


def describe(classes: DataFrame, copies: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, typical: int = 3) -> DataFrame:
    found = roots(classes, similarity)
    sized = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", "vec", F.coalesce("root", "rep").alias("root"))
    return report(sized, least, typical).withColumnRenamed("group_id", "cluster_id")


def p1_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the bisecting tree, which hold every usable vector once:
    size, mean similarity to the centre, least similarity to the medoid, and the
    three members nearest to the centre."""
    classes, _ = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    return leaves(classes)


def leaves(classes: DataFrame, similarity: float = SIMILARITY, typical: int = 3) -> DataFrame:
    """``(leaf_id, size, mean_near, least_near, typical)``; a leaf is named by
    its medoid. Ties for typical members: the smaller id."""
    tree = fitted(classes, rows_in(classes), TREES[:1])[0]

    def home(batches):
        for b in batches:
            if b.num_rows:
                u = vx.unit(vx.unpack(b.column(2))).astype(np.float32)
                leaf = tree.descend(u, np.zeros(len(u), np.int32)) if tree.depth else np.zeros(len(u))
                yield pa.record_batch([*b.columns, pa.array(leaf.astype(np.int32))], names=["rep", "n", "vec", "cell"])

    def split(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep, n = rep[order], t["n"].to_numpy()[order]
        u = vx.unit(vx.unpack(t["vec"])[order])
        leaf, medoid, low = compact_leaves(u, similarity)
        start = np.flatnonzero(np.diff(np.sort(leaf), prepend=-1))
        by = np.argsort(leaf, kind="stable")
        centre = vx.unit(np.add.reduceat(u[by] * n[by, None], start, axis=0))
        near = np.round(np.einsum("ij,ij->i", u, centre[leaf]), 6)
        best = np.lexsort((rep, -near, leaf))
        size = np.add.reduceat(n[by], start)
        mean = np.add.reduceat((near * n)[by], start) / size
        end = np.append(start[1:], len(rep))
        few = [rep[best[s : min(e, s + typical)]].tolist() for s, e in zip(start, end)]
        return pa.table({"leaf_id": pa.array(rep[medoid], pa.int32()), "size": pa.array(size, pa.int64()), "mean_near": np.round(mean, 6), "least_near": np.round(low, 6), "typical": pa.array(few, pa.list_(pa.int32()))})

    placed = classes.select("rep", "n", "vec").mapInArrow(home, "rep bigint, n bigint, vec binary, cell int")
    return placed.groupBy("cell").applyInArrow(split, "leaf_id int, size bigint, mean_near double, least_near double, typical array<int>")


def report(sized: DataFrame, least: int, typical: int) -> DataFrame:
    """``(group_id, size, mean_near, typical)`` of the groups ``root`` of
    classes ``(rep, n, vec, root)`` with ``least`` members."""
    sized = written(sized, "members")
    big = sized.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    members = sized.join(big, "root")

    def sums(batches):  # one row per cluster and batch, so a hot cluster's vectors never meet in a task
        for b in batches:
            root, n, u = b.column(0).to_numpy(), b.column(1).to_numpy(), vx.unit(vx.unpack(b.column(2)))
            keys, at = np.unique(root, return_inverse=True)
            acc = np.zeros((len(keys), u.shape[1]))
            np.add.at(acc, at, u * n[:, None])
            yield pa.record_batch([pa.array(keys), pa.array(list(acc), pa.list_(pa.float64()))], names=["root", "s"])

    part = members.select("root", "n", "vec").mapInArrow(sums, "root bigint, s array<double>")
    dims = [F.sum(F.get("s", i)).alias(f"s{i}") for i in range(64)]
    centre = part.groupBy("root").agg(*dims).select("root", F.array(*[f"s{i}" for i in range(64)]).alias("centre"))

    def nearness(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u = vx.unit(vx.unpack(b.column(4)))
            c = vx.unit(b.column(5).flatten().to_numpy().reshape(len(u), -1))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.round((u * c).sum(1), 6))], names=["root", "rep", "n", "size", "near"])

    scored = members.join(centre, "root").select("root", "rep", "n", "size", "vec", "centre")
    scored = scored.mapInArrow(nearness, "root bigint, rep bigint, n bigint, size bigint, near double")
    # min/max of structs combine map-side; three rounds of "best so far" need no window over a hot cluster
    key = F.struct((-F.col("near")).alias("far"), F.col("rep").alias("id"))
    out = scored.groupBy("root").agg(
        F.first("size").alias("size"),
        F.round(F.sum(F.col("near") * F.col("n")) / F.sum("n"), 6).alias("mean_near"),
        *[F.min_by("rep", key).alias("t0")],
    )
    best = out
    for i in range(1, typical):
        rest = scored.join(best.select("root", *[f"t{j}" for j in range(i)]), "root")
        for j in range(i):
            rest = rest.where(F.col("rep") != F.col(f"t{j}"))
        nxt = rest.groupBy("root").agg(F.min_by("rep", key).alias(f"t{i}"))
        best = best.join(nxt, "root", "left")
    members_of = F.array_compact(F.array(*[F.col(f"t{i}").cast("int") for i in range(typical)]))
    return best.select(F.col("root").cast("int").alias("group_id"), "size", "mean_near", members_of.alias("typical"))
