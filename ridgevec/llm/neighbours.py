"""Problem 3: the k most similar vectors of every vector.

Vectors are projected onto a few Gaussian directions (a 2-stable family): the
squared projected distance of two vectors, over their squared distance, is
chi-square distributed. Two kd-trees over such projections, fitted on a bounded
sample, are the index. A vector visits its home leaf and then the nearest other
leaves, by the margins of the planes in between, which add up, until the
chi-square test says that a neighbour within the search radius isn't beyond
them, or the probes are used up (``probes=None``: the test alone decides). In a
leaf, projected neighbours are verified as far out as the test doesn't rule out
a neighbour in the radius.

The links found there close into neighbourhoods. Inside one, projected
neighbours are verified in double precision on the stored floats, nearest
first, until the chi-square test holds for the k-th best; the same at all sizes.
The queries of a large neighbourhood are spread over several tasks, each against
all its rows; beyond ``LARGEST`` classes the rows are cut into blocks too, every
block of queries meets every block of rows, and the best of all blocks count.
That is quadratic work, but nothing is left out.

:func:`nearest_of` finds the k most similar whatever their similarity, for a
stated set of queries against all rows.

Exact copies are one class: its candidates are its own smallest ids and those
of other classes, so no group of copies is ever expanded into pairs. Ties go to
the smaller id. Fewer than k similar vectors give fewer rows; none give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgevec.llm import vecindex as vx
from ridgevec.llm.components import components
from ridgevec.llm.trees import fit_kd
from ridgevec.session import rows_in, table, written
from ridgevec.sources.vectors import stored_vectors, vector_classes

SIMILARITY, K = 0.92, 3
#: Projections, leaves of a tree that a vector visits, the certainty of the
#: stopping test, and seeds of the trees.
PROJECTIONS, PROBES, CERTAINTY, TREES = 12, 4, 0.9995, (29, 31)
#: Certainty of the test inside a neighbourhood, where every answer depends on it.
SETTLED = 0.999999
#: Seed of the projections that neighbours are verified by. They are others than
#: the trees', as by those all vectors of a leaf are near.
VERIFY = 37
#: Classes of a neighbourhood that a task may hold, queries of one that a task
#: answers, and rows aimed at in a task of small ones.
LARGEST, QUERIES, BIN_ROWS = 200_000, 16_384, 4096
#: Projected neighbours of a query that are verified before the test is asked.
FIRST = 48
#: The part of all pairs beyond which those left are verified by a matrix product.
DENSE = 0.05
#: Queries of the complete search: ids divisible by it.
EVERY = 50


def chi_square_cdf(x: float, m: int = PROJECTIONS) -> float:
    """For ``m`` degrees of freedom, by steps of two from one or two."""
    h = max(0.0, x) / 2
    total = math.erf(math.sqrt(h)) if m % 2 else 1 - math.exp(-h)
    for k in range(2 - m % 2, m, 2):
        total -= math.exp(k / 2 * math.log(h) - h - math.lgamma(k / 2 + 1)) if h else 0.0
    return total


def chi_square_quantile(p: float, m: int = PROJECTIONS) -> float:
    lo, hi = 0.0, 400.0 + 4 * m
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dim: int, m: int = PROJECTIONS, seed: int = VERIFY) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m)).astype(np.float32)


def radius(similarity: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * similarity))


def _kd(x: np.ndarray, leaves: int, seed: int):
    p = x @ projection(x.shape[1], seed=seed)
    return fit_kd(p, max(1, len(x) // leaves)), p


def _routers(classes: DataFrame, total: int, similarity: float, cell_rows: int, probes: int | None) -> list[vx.Router]:
    sample = vx.sample_units(classes, total)
    sample = sample if len(sample) else np.zeros((1, 64), np.float32)
    leaves = vx.leaf_count(total, cell_rows)
    # a plane is one projection: beyond f of them a neighbour at the radius is chi-square with f degrees
    bounds = np.array([0.0] + [chi_square_quantile(CERTAINTY, f) for f in range(1, 65)]) * radius(similarity) ** 2

    def stop(bound, crossed):
        return bound >= bounds[np.minimum(crossed, len(bounds) - 1)]

    return [vx.Router(_kd(sample, leaves, seed)[0], projection(sample.shape[1], seed=seed), probes, stop) for seed in TREES]


def linker(similarity: float):
    def link(x: np.ndarray, slack: float):
        return projected_links(x, slack, similarity)

    return link


def projected_links(x: np.ndarray, slack: float, similarity: float, most: int = vx.PART_ROWS):
    """``(label, doubt)`` of the rows of a cell whose similarities are off by up
    to ``slack``: the smallest row that each is surely linked with, by way of
    others too, and the rows that only exact similarities can decide about.
    Rows are verified out to the projected distance at which the chi-square
    test rules out a neighbour in the radius."""
    sure, maybe = similarity + slack, similarity - slack
    far = chi_square_quantile(CERTAINTY) * radius(maybe) ** 2
    label, doubt = np.arange(len(x)), np.zeros(len(x), bool)
    for part in vx.by_parts(x, most, lambda y, leaves: _kd(y, leaves, VERIFY)):
        part = np.sort(part)
        y = x[part]
        p = y @ projection(x.shape[1])
        half = (p * p).sum(1) / 2
        open_ = [np.zeros((2, 0), np.int64)]
        for s in range(0, len(part), vx.BLOCK):
            near = p[s : s + vx.BLOCK] @ p[s:].T - half[s : s + vx.BLOCK, None] - half[s:] >= -far / 2
            if np.count_nonzero(near) > DENSE * near.size:
                sim = y[s : s + vx.BLOCK] @ y[s:].T
                i, j = np.nonzero(near & (sim >= maybe))
                sim = sim[i, j]
            else:
                i, j = np.nonzero(near)
                sim = np.einsum("ij,ij->i", y[i + s], y[j + s])
            i, j, sim = (v[j > i] for v in (i + s, j + s, sim))
            hit = sim >= sure
            label = vx.lowest(label, part[i[hit]], part[j[hit]])
            may = ~hit & (sim >= maybe)
            open_.append(part[np.stack([i[may], j[may]])])
        open_ = np.concatenate(open_, axis=1)
        doubt[open_[:, label[open_[0]] != label[open_[1]]].ravel()] = True
    return label, doubt


def rank(u: np.ndarray, ids: list, query: np.ndarray, similarity: float, k: int):
    """For the rows of one neighbourhood marked in ``query``: up to ``k + 1``
    ``(row, candidate id, similarity)`` in order of similarity and id. ``ids``
    has each class's smallest ids; a class is a candidate of its own.

    The ``FIRST`` nearest projected neighbours of a query are verified, which
    gives a k-th best; then all others that the chi-square test doesn't rule
    out for it, pair by pair or, where they are many, by a matrix product."""
    n, want = len(u), k + 1
    p = u @ projection(u.shape[1]).astype(np.float64)
    pp = (p * p).sum(1)
    low = u.astype(np.float32)
    quant = chi_square_quantile(SETTLED)
    copies = np.array([len(x) for x in ids])
    first = np.array([x[0] for x in ids])
    out_row, out_id, out_sim = [], [], []
    rows = np.flatnonzero(query)
    step = max(1, min(256, (1 << 23) // max(1, n)))
    for s in range(0, len(rows), step):
        q = rows[s : s + step]
        if n <= FIRST:  # the first neighbours are all there are
            sim = np.round(u[q] @ u.T, 6)
        else:
            far = pp[q][:, None] + pp[None, :] - 2 * p[q] @ p.T
            near = np.argpartition(far, FIRST - 1, axis=1)[:, :FIRST]
            some = np.round(np.einsum("ij,ikj->ik", u[q], u[near]), 6)
            kth = np.maximum(np.partition(some, FIRST - want, axis=1)[:, FIRST - want], similarity)
            todo = far <= (quant * np.maximum(0, 2 - 2 * kth + 2e-6))[:, None] + 1e-9
            own = np.arange(len(q))[:, None]
            todo[own, near] = False
            if np.count_nonzero(todo) > DENSE * todo.size:
                sim = np.where(todo, _exact_best(u, low, u[q], want), -2.0)
            else:
                sim = np.full((len(q), n), -2.0)
                i, j = np.nonzero(todo)
                sim[i, j] = np.round(np.einsum("ij,ij->i", u[q[i]], u[j]), 6)
            sim[own, near] = some
        # candidates at least as good as the (k+1)-th class; ties all kept
        if n > want:
            cut = np.maximum(np.partition(sim, n - want, axis=1)[:, n - want], similarity)
        else:
            cut = np.full(len(q), similarity)
        i, j = np.nonzero(sim >= cut[:, None])
        v = sim[i, j]
        # own class and other classes alike offer their smallest ids
        if (copies[j] > 1).any():
            rep = np.repeat(np.arange(len(j)), copies[j])
            names = np.concatenate([ids[c] for c in j])
            i, v = i[rep], v[rep]
        else:
            names = first[j]
        order = np.lexsort((names, -v, i))
        i, v, names = i[order], v[order], names[order]
        start = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - start[i] < want
        out_row.append(q[i[keep]])
        out_id.append(names[keep])
        out_sim.append(v[keep])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_row, np.int64), cat(out_id, np.int64), cat(out_sim, np.float64)


def _exact_best(u: np.ndarray, low: np.ndarray, q: np.ndarray, want: int) -> np.ndarray:
    """Similarities of some vectors to all rows; those that can't be among the best
    ``want`` by the 32-bit product are left at that product, less a margin."""
    n = len(u)
    if n <= 2048:
        return np.round(q @ u.T, 6)
    rough = q.astype(np.float32) @ low.T
    cut = np.partition(rough, n - want, axis=1)[:, n - want] - 3e-6
    i, j = np.nonzero(rough >= cut[:, None])
    if len(i) > 0.02 * rough.size:
        return np.round(q @ u.T, 6)
    sim = rough - np.float32(1e-5)
    sim = sim.astype(np.float64)
    sim[i, j] = np.round(np.einsum("ij,ij->i", q[i], u[j]), 6)
    return sim


def _rank_task(similarity: float, k: int):
    def run(t: pa.Table) -> pa.Table:
        root, rep = t["root"].to_numpy(), t["rep"].to_numpy()
        order = np.lexsort((rep, root))
        root, rep = root[order], rep[order]
        home, ask = (t[c].to_numpy(zero_copy_only=False)[order].astype(bool) for c in ("home", "ask"))
        u = vx.unit(vx.unpack(t["vec"])[order])
        few = t["ids"].combine_chunks()
        off, flat = np.asarray(few.offsets), few.values.to_numpy(zero_copy_only=False)
        ids = [flat[off[i] : off[i + 1]] for i in order]
        cuts = np.flatnonzero(np.diff(root)) + 1
        a, b, v = [], [], []
        for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(root)]])):
            # rows that are at home answer; a row's own class is met where it is at home
            r, c, sim = rank(u[s:e], ids[s:e], ask[s:e], similarity, k) if home[s:e].all() else rank_block(u[s:e], ids[s:e], ask[s:e], home[s:e], similarity, k)
            a.append(rep[s:e][r])
            b.append(c)
            v.append(sim)
        return pa.table({"rep": pa.array(np.concatenate(a), pa.int64()), "other": pa.array(np.concatenate(b), pa.int64()), "score": pa.array(np.concatenate(v), pa.float64())})

    return run


def rank_block(u: np.ndarray, ids: list, query: np.ndarray, home: np.ndarray, similarity: float, k: int):
    """As :func:`rank`, but only the rows in ``home`` are candidates; exact."""
    rows, asks = np.flatnonzero(home), np.flatnonzero(query)
    v, want = u[rows], k + 1
    low, names = v.astype(np.float32), [ids[i] for i in rows]
    copies = np.array([len(x) for x in names], np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, min(256, (1 << 23) // max(1, len(rows))))
    for s in range(0, len(asks) if len(rows) else 0, step):
        q = asks[s : s + step]
        sim = _exact_best(v, low, u[q], want)
        cut = np.maximum(np.partition(sim, len(rows) - want, axis=1)[:, len(rows) - want], similarity) if len(rows) > want else np.full(len(q), similarity)
        i, j = np.nonzero(sim >= cut[:, None])
        rep = np.repeat(np.arange(len(j)), copies[j])
        other = np.concatenate([names[c] for c in j]) if len(j) else np.zeros(0, np.int64)
        i, near = i[rep], sim[i, j][rep]
        order = np.lexsort((other, -near, i))
        i, near, other = i[order], near[order], other[order]
        keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < want
        out.append((q[i[keep]], other[keep], near[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(classes: DataFrame, copies: DataFrame, similarity: float = SIMILARITY, k: int = K, cell_rows: int = vx.CELL_ROWS, probes: int | None = PROBES, largest: int = LARGEST, queries: int = QUERIES) -> DataFrame:
    """``(id, other, score, rank)``: for every id its up to ``k`` most similar
    others among those at least ``similarity`` similar."""
    total = rows_in(classes)
    links = vx.similar_links(classes, _routers(classes, total, similarity, cell_rows, probes), linker(similarity), similarity)
    found = components(links).withColumnRenamed("id", "rep")
    w = Window.partitionBy("rep").orderBy("id")
    # row_number below a bound is pushed ahead of the shuffle: a hot class sends k ids a task
    more = copies.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("rep").agg(F.collect_list("id").alias("few"))
    asked = classes.join(found, "rep", "left").where("root IS NOT NULL OR n > 1")
    asked = asked.join(more, "rep", "left").select("rep", "vec", F.coalesce("root", "rep").alias("root"), F.array_sort(F.concat(F.array("rep"), F.coalesce("few", F.array().cast("array<bigint>")))).alias("ids"))
    sizes = written(found.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > queries), "sizes")
    task, schema = _rank_task(similarity, k), "rep bigint, other bigint, score double"
    bin_of = F.pmod(F.xxhash64("root"), F.lit(max(1, total // BIN_ROWS)))
    cols = ["bin", "home", "ask", "rep", "root", "vec", "ids"]
    if not rows_in(sizes):
        ranked = asked.withColumns({"bin": bin_of, "home": F.lit(True), "ask": F.lit(True)}).select(*cols).groupBy("bin").applyInArrow(task, schema)
    else:
        asked = written(asked.join(sizes, "root", "left"), "asked")
        small = asked.where("size IS NULL").withColumns({"bin": bin_of, "home": F.lit(True), "ask": F.lit(True)})
        parts = F.ceil(F.col("size") / F.lit(queries)).cast("int")
        mid = asked.where(F.col("size") <= largest).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        far_bin = F.lit(1 << 40) + F.pmod(F.xxhash64("root"), F.lit(1 << 20)) * 4096 + F.col("part")
        mid = mid.withColumns({"bin": far_bin, "home": F.lit(True), "ask": F.pmod(F.xxhash64("rep"), F.col("parts")) == F.col("part")})
        ranked = small.select(*cols).unionByName(mid.select(*cols)).groupBy("bin").applyInArrow(task, schema)
        if sizes.where(F.col("size") > largest).limit(1).count():
            top = Window.partitionBy("rep").orderBy(F.col("score").desc(), "other")
            split = _blocks(asked.where(F.col("size") > largest), largest).groupBy("bin").applyInArrow(task, schema)
            ranked = ranked.unionByName(split.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r"))
    lists = written(_lists(ranked), "lists")
    return _own(lists.select(F.col("rep").alias("id"), "best").unionByName(copies.join(lists, "rep").select("id", "best")), k)


def _lists(ranked: DataFrame) -> DataFrame:
    """``(rep, best)``: the candidates of each class in order."""
    return ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("other").alias("id")))).alias("best"))


def _own(lists: DataFrame, k: int) -> DataFrame:
    """``(id, other, score, rank)`` from ``(id, best)``, without an id itself."""
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    return lists.select("id", F.posexplode(others).alias("pos", "x")).select("id", F.col("x.id").alias("other"), (-F.col("x.far")).alias("score"), (F.col("pos") + 1).alias("rank"))


def nearest_of(classes: DataFrame, copies: DataFrame, wanted, k: int = K, leaf_rows: int = 16_384, most: int = 65_536, certainty: float = CERTAINTY) -> DataFrame:
    """``(id, other, score, rank)``: the ``k`` most similar others, however
    similar, of every id that ``wanted`` (a condition on ``id``) holds for.

    Queries are verified against all rows of their home leaf of the kd-tree,
    which gives a k-th best, and then against those of every other leaf that
    the chi-square test doesn't rule out for it. A leaf's queries are cut into
    parts of about ``most``, each of which meets the leaf's rows: a search of a
    stated set against all rows, in blocks. Copies of one content are asked for
    once."""
    total = rows_in(classes)
    leaves = max(1, min(64, total // leaf_rows), total // (8 * leaf_rows))
    sample = vx.sample_units(classes, total)
    dim = sample.shape[1] if len(sample) else 64
    tree, _ = _kd(sample if len(sample) else np.zeros((1, 64), np.float32), leaves, TREES[0])
    g = projection(dim, seed=TREES[0])
    bounds = np.array([0.0] + [chi_square_quantile(certainty, f) for f in range(1, 65)])
    asking = classes.select(F.col("rep").alias("id"), "rep").unionByName(copies.select("id", "rep")).where(wanted)
    queries = written(asking.select("rep").distinct().join(classes.select("rep", "vec"), "rep"), "queries")
    asking = written(asking, "asking")
    parts = max(1, -(-rows_in(queries) // most))

    def visits(first: bool):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                feats = vx.unit(vx.unpack(b.column(1))).astype(np.float32) @ g
                if first:
                    row, leaf = np.arange(b.num_rows), tree.probe(feats, 1)[1]
                else:
                    room = b.column(2).to_numpy()
                    row, leaf = _reached(tree, feats, room, bounds)
                yield pa.record_batch([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(leaf.astype(np.int32))], names=["rep", "vec", "leaf"])

        return run

    few = copies.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k).groupBy("rep").agg(F.collect_list("id").alias("few"))
    placed = "rep bigint, vec binary, leaf int"
    rows = classes.select("rep", "vec").mapInArrow(visits(True), placed).join(few, "rep", "left")
    rows = rows.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rep", "vec", F.array_sort(F.concat(F.array("rep"), F.coalesce("few", F.array().cast("array<bigint>")))).alias("ids"), F.lit(False).alias("ask"))
    nothing = F.array().cast("array<bigint>")

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.select("leaf", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"), "rep", "vec", nothing.alias("ids"), F.lit(True).alias("ask"))
        return rows.unionByName(asked).groupBy("leaf", "part").applyInArrow(_meet_task(k), "rep bigint, other bigint, score double")

    home = written(meet(queries.mapInArrow(visits(True), placed)), "home")
    # squared distance of the k-th best so far; a query with fewer goes everywhere
    kth = home.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low")).select("rep", F.when(F.col("c") > k, 2 - 2 * F.col("low")).otherwise(F.lit(1e9)).alias("room"))
    onward = queries.join(kth, "rep", "left").select("rep", "vec", F.coalesce("room", F.lit(1e9)).alias("room"))
    ranked = home.unionByName(meet(onward.mapInArrow(visits(False), placed)))
    best = Window.partitionBy("rep").orderBy(F.col("score").desc(), "other")
    ranked = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    return _own(asking.join(_lists(ranked), "rep").select("id", "best"), k)


def _reached(tree, feats: np.ndarray, room: np.ndarray, bounds: np.ndarray):
    """``(row, leaf)`` of all leaves but the home that the test doesn't rule out
    for a row whose k-th best is ``room`` away."""
    rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for scale in np.unique(np.ceil(np.log2(np.maximum(room, 1e-9)) * 2)):
        at = np.flatnonzero(np.ceil(np.log2(np.maximum(room, 1e-9)) * 2) == scale)
        most = float(room[at].max())
        row, leaf, order = tree.probe(feats[at], None, lambda bound, crossed: bound >= bounds[np.minimum(crossed, len(bounds) - 1)] * most)  # noqa: B023
        rows.append(at[row[order > 0]])
        leaves.append(leaf[order > 0])
    return np.concatenate(rows), np.concatenate(leaves)


def _meet_task(k: int):
    def run(t: pa.Table) -> pa.Table:
        ask = t["ask"].to_numpy(zero_copy_only=False).astype(bool)
        rep, u = t["rep"].to_numpy(), vx.unit(vx.unpack(t["vec"]))
        few = t["ids"].combine_chunks()
        off, flat = np.asarray(few.offsets), few.values.to_numpy(zero_copy_only=False)
        ids = [flat[off[i] : off[i + 1]] for i in range(len(rep))]
        r, other, sim = rank_block(u, ids, ask, ~ask, -1.0, k)
        return pa.table({"rep": pa.array(rep[r], pa.int64()), "other": pa.array(other, pa.int64()), "score": pa.array(sim, pa.float64())})

    return run


def _blocks(large: DataFrame, largest: int) -> DataFrame:
    """Rows of large neighbourhoods, cut into blocks of half of ``largest``:
    each pair of blocks is a bin, where the first asks and the second is home."""
    blocks = F.ceil(2 * F.col("size") / F.lit(largest)).cast("bigint")
    first = F.lit(1 << 41) + F.pmod(F.xxhash64("root"), F.lit(1 << 20)) * (1 << 20)
    cut = large.withColumns({"blocks": blocks, "first": first}).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    yes, no, same = F.lit(True), F.lit(False), F.col("own") == F.col("block")
    asks = F.struct((F.col("first") + F.col("own") * F.col("blocks") + F.col("block")).alias("bin"), same.alias("home"), yes.alias("ask"))
    answers = F.struct((F.col("first") + F.col("block") * F.col("blocks") + F.col("own")).alias("bin"), yes.alias("home"), no.alias("ask"))
    cut = cut.withColumn("x", F.explode(F.when(same, F.array(asks)).otherwise(F.array(asks, answers))))
    return cut.select("x.bin", "x.home", "x.ask", "rep", "root", "vec", "ids")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, copies = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    near = nearest(classes, copies)
    return near.select(F.least("id", "other").cast("int").alias("id_a"), F.greatest("id", "other").cast("int").alias("id_b")).distinct()


def p3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's neighbours in the search radius, with rank and score."""
    classes, copies = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    return _named(nearest(classes, copies))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k most similar of all vectors, however similar, for every id
    divisible by ``EVERY``."""
    classes, copies = vector_classes(stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches")))
    return _named(nearest_of(classes, copies, F.col("id") % EVERY == 0))


def _named(near: DataFrame) -> DataFrame:
    return near.select(F.col("id").cast("int").alias("internal_id"), F.col("other").cast("int").alias("neighbour_id"), F.col("rank").cast("int").alias("rank"), "score")
