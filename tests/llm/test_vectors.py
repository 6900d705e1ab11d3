"""Clusters and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgevec.llm import clusters, neighbours, trees
from ridgevec.llm import vecindex as vx
from ridgevec.llm.components import components
from ridgevec.sources.vectors import stored_vectors, vector_classes

CHUNK = "snapshot_id string, chunk_index int, vecs array<float>, tomb array<tinyint>, rep int, id string"
LIVE = "batch_id bigint, db_name string, ids array<int>, vectors array<float>, vec string"


def usable(chunks, live):
    out = {}
    for _, at, v, t, *_ in chunks:
        if v is None or t is None:
            continue
        for p in range(min(16, len(v) // 64, len(t))):
            out.setdefault(at * 16 + p, (v[p * 64 : p * 64 + 64], t[p] == 0))
    got = {i: v for i, (v, ok) in out.items() if ok}
    for _, _, ids, v, *_ in live:
        for p, i in enumerate(ids or []):
            if i is not None and v is not None and len(v) >= p * 64 + 64:
                got[i] = v[p * 64 : p * 64 + 64]
    clean = {}
    for i, v in got.items():
        x = np.array([np.nan if e is None else e for e in v], np.float32)
        if np.isfinite(x).all() and (x != 0).any():
            clean[i] = x
    return clean


def truth(vectors, similarity=0.92, k=3, least=5):
    ids = np.array(sorted(vectors))
    if not len(ids):
        return {}, set()
    x = np.stack([vectors[i] for i in ids]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    label = np.arange(len(ids))
    for i, j in zip(*np.nonzero(s >= similarity)):
        a, b = label[i], label[j]
        if a != b:
            label[label == max(a, b)] = min(a, b)
    found = {int(ids[i]): int(ids[label[i]]) for i in range(len(ids)) if (label == label[i]).sum() >= least}
    pairs = set()
    for i in range(len(ids)):
        near = [j for j in np.lexsort((ids, -s[i])) if s[i, j] >= similarity][:k]
        pairs |= {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in near}
    return found, pairs


def synthetic(seed, groups=12, singles=150, copies=0):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=64) for _ in range(singles)]
    for g in range(groups):
        centre = rng.normal(size=64)
        rows += [(centre + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.2])) * rng.uniform(0.2, 5) for _ in range(rng.integers(2, 12))]
    # a chain whose ends are far from each other
    a, b = rng.normal(size=64), rng.normal(size=64)
    rows += [a * np.cos(t) + b * np.sin(t) for t in np.arange(0, 1.6, 0.2)]
    rows += [rows[0]] * copies
    rows = [np.asarray(r, np.float32) for r in rows]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    chunks, live = [], []
    half = len(rows) // 2 // 16 * 16
    for c in range(half // 16):
        v = np.concatenate(rows[c * 16 : c * 16 + 16]).tolist()
        chunks.append((None, c, v, [int(rng.random() < 0.1) for _ in range(16)], 1, "x"))
    chunks += chunks[:2]
    dirty = rows[0].tolist() * 16
    dirty[5], dirty[64 + 3], dirty[128 + 1] = float("nan"), float("inf"), None
    dirty[192:256] = [0.0] * 64
    chunks += [("s", 5000, dirty, [0] * 16, 1, "x"), ("s", 5001, dirty[:300], [0] * 16, 1, "x"), ("s", 5002, None, [0] * 16, 1, "x"), ("s", 5003, rows[1].tolist() * 16, None, 1, "x"), ("s", 5004, [], [], 1, "x")]
    ids = list(range(100000, 100000 + len(rows) - half))
    live.append((1, None, ids, np.concatenate(rows[half:]).tolist(), "x"))
    live += [live[0], (2, "d", None, [1.0] * 64, "x"), (3, "d", [7_000_000, None], [1.0] * 100, "x"), (4, "d", [7_000_001], None, "x")]
    return chunks, live


def classes_of(spark, chunks, live):
    stored = stored_vectors(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(live, LIVE))
    return vector_classes(stored.repartition(5))


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 130)])
def test_clusters_and_neighbours(spark, seed, copies):
    chunks, live = synthetic(seed, copies=copies)
    found, pairs = truth(usable(chunks, live))
    classes, dup = classes_of(spark, chunks, live)
    assert {r[0]: r[1] for r in clusters.clusters(classes, dup).collect()} == found
    near = neighbours.nearest(classes, dup, cell_rows=64).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in near} == pairs
    assert max(r["rank"] for r in near) <= 3
    told = clusters.describe(classes, dup).collect()
    sizes = {c: sum(v == c for v in found.values()) for c in set(found.values())}
    assert {r["cluster_id"]: r["size"] for r in told} == sizes
    assert all(found[m] == r["cluster_id"] for r in told for m in r["typical"])


def test_large_neighbourhoods_are_split(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    live = [(1, "d", list(range(400)), np.concatenate([centre + rng.normal(size=64) * 0.15 for _ in range(400)]).astype(np.float32).tolist(), "x")]
    _, pairs = truth(usable([], live))
    classes, dup = classes_of(spark, [], live)
    take = lambda **kw: {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in neighbours.nearest(classes, dup, **kw).collect()}
    assert take(queries=90) == pairs
    assert len(take(largest=300, queries=200) & pairs) >= 0.9 * len(pairs)


def test_large_neighbourhoods_are_searched_whole(spark):
    rng = np.random.default_rng(14)
    centre = rng.normal(size=64)
    rows = [centre + rng.normal(size=64) * 0.15 for _ in range(3000)]
    rows += [rows[i] for i in range(5)] * 2 + [rng.normal(size=64) for _ in range(30)]
    live = [(1, "d", list(range(len(rows))), np.concatenate(rows).astype(np.float32).tolist(), "x")]
    _, pairs = truth(usable([], live))
    classes, dup = classes_of(spark, [], live)
    for largest in (1000, 250):
        got = [(r["id"], r["other"]) for r in neighbours.nearest(classes, dup, largest=largest, queries=120).collect()]
        assert len(got) == len(set(got))
        assert {(min(p), max(p)) for p in got} == pairs


def test_nothing(spark):
    classes, dup = classes_of(spark, [], [])
    assert clusters.clusters(classes, dup).count() == 0
    assert neighbours.nearest(classes, dup).count() == 0
    assert clusters.describe(classes, dup).count() == 0


def test_borderline_pairs_are_decided_on_stored_floats(spark):
    """Similarities on either side of the threshold by far less than the
    codes can tell."""
    rng = np.random.default_rng(8)
    rows = []
    for cos in (0.9199985, 0.9199996, 0.92, 0.9200015, 0.919, 0.921):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [a, a * cos + b * np.sqrt(1 - cos * cos)]
    live = [(1, "d", list(range(len(rows))), np.concatenate(rows).astype(np.float32).tolist(), "x")]
    found, pairs = truth(usable([], live), least=2)
    classes, dup = classes_of(spark, [], live)
    assert {r[0]: r[1] for r in clusters.clusters(classes, dup, least=2).collect()} == found
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in neighbours.nearest(classes, dup).collect()} == pairs


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 900, size=(400, 2))] + [(5000, i) for i in range(5001, 5300)] + [(i, i + 1) for i in range(7000, 7040)] + [(1, 1)]
    df = spark.createDataFrame([*links, *links[:50], (None, 3), (4, None)], "a bigint, b bigint")
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["id"]: r["root"] for r in components(df).collect()} == {i: label[i] for i in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def coded(x):
    u = vx.unit(x.astype(np.float32))
    code, scale, err = vx.encode(u)
    e = float(err.max())
    return u, code.astype(np.float32) * scale[:, None], 2 * e + e * e + 1e-5


@pytest.mark.parametrize("link", [clusters.leaf_links, neighbours.projected_links])
def test_links_of_a_cell(monkeypatch, link):
    rng = np.random.default_rng(5)
    # tight groups, wide ones that are chains of leaves, and rows on their own
    near = [c + rng.normal(size=(n, 64)) * s for c, n, s in zip(rng.normal(size=(60, 64)), rng.integers(1, 30, 60), rng.choice([0.02, 0.1, 0.27, 0.3], 60))]
    u, y, slack = coded(np.concatenate([*near, rng.normal(size=(300, 64))]))
    assert (np.abs(u - y) ** 2).sum(1).max() <= slack
    want = vx.closed(u, 0.92 - vx.HALF_UNIT)
    for block, most in ((1024, 4096), (7, 4096), (64, 200)):
        monkeypatch.setattr(vx, "BLOCK", block)
        label, doubt = link(y, slack, 0.92, most)
        assert (want[label] == want).all()  # nothing is joined that isn't
        at = np.flatnonzero(doubt)
        again = vx.closed(u[at], 0.92 - vx.HALF_UNIT)
        label = vx.lowest(label, at, at[again])
        assert (label == want).mean() >= (1 if most == 4096 else 0.99)


@pytest.mark.parametrize("link", [clusters.leaf_links, neighbours.projected_links])
def test_a_cell_of_borderline_vectors_stays_small(link):
    import tracemalloc

    rng = np.random.default_rng(1)
    _, y, slack = coded(rng.normal(size=64) + rng.normal(size=(8192, 64)) * 0.295)
    tracemalloc.start()
    label, doubt = link(y, slack, 0.92)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert len(label) == len(doubt) == 8192


def test_compact_leaves():
    rng = np.random.default_rng(15)
    x = vx.unit(np.concatenate([c + rng.normal(size=(n, 64)) * 0.1 for c, n in zip(rng.normal(size=(20, 64)), rng.integers(1, 60, 20))] + [np.ones((40, 64))]).astype(np.float32))
    leaf, medoid, low = trees.compact_leaves(x, 0.92)
    assert len(leaf) == len(x) and sorted(set(leaf)) == list(range(len(medoid)))
    assert (leaf[medoid] == np.arange(len(medoid))).all()
    for i, m in enumerate(medoid):
        s = x[leaf == i] @ x[m]
        assert abs(s.min() - low[i]) < 1e-6 and s.min() >= 0.92 - 1e-6
    assert len(medoid) == 21
    assert len(trees.compact_leaves(x[:0], 0.92)[0]) == 0
    assert trees.compact_leaves(np.ones((9, 4)) / 2, 0.9)[0].max() == 0
    # pulled apart by peeling: an end is reached
    line = vx.unit(np.stack([np.cos(np.geomspace(1e-6, 1.5, 3000)), np.sin(np.geomspace(1e-6, 1.5, 3000))], 1).astype(np.float32))
    assert trees.compact_leaves(line, 0.9999999)[2].min() >= 0.9999998


def test_leaves_of_the_tree(spark):
    chunks, live = synthetic(3, copies=20)
    classes, dup = classes_of(spark, chunks, live)
    got = clusters.leaves(classes).collect()
    vec = usable(chunks, live)
    assert sum(r["size"] for r in got) == len(vec)
    assert len({r["leaf_id"] for r in got}) == len(got)
    for r in got:
        assert r["least_near"] >= 0.92 and 1 <= len(r["typical"]) <= min(3, r["size"])
        m = vx.unit(np.stack([vec[i] for i in [r["leaf_id"], *r["typical"]]]).astype(np.float32))
        assert (m @ m[0]).min() >= 0.92 - 1e-6
    assert clusters.leaves(classes_of(spark, [], [])[0]).count() == 0


def test_complete_search(spark):
    chunks, live = synthetic(6, copies=40)
    vec = usable(chunks, live)
    ids = np.array(sorted(vec))
    u = vx.unit(np.stack([vec[i] for i in ids]).astype(np.float32))
    classes, dup = classes_of(spark, chunks, live)
    for kw in ({}, {"leaf_rows": 40, "most": 20, "certainty": 0.999999}):
        got = {}
        for r in neighbours.nearest_of(classes, dup, F.col("id") % 3 == 0, **kw).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["other"], r["score"]))
        assert set(got) == {i for i in ids if i % 3 == 0}
        right = 0
        for i, q in enumerate(ids):
            if q % 3 == 0:
                s = np.round(u @ u[i], 6)
                s[i] = -3
                best = np.lexsort((ids, -s))[:3]
                right += [(int(ids[j]), s[j]) for j in best] == [(o, v) for _, o, v in sorted(got[q])]
        assert right >= 0.99 * len(got)
    assert neighbours.nearest_of(*classes_of(spark, [], []), F.col("id") % 3 == 0).count() == 0


def test_trees_route_every_row():
    rng = np.random.default_rng(6)
    x = vx.unit(rng.normal(size=(3000, 64)).astype(np.float32)).astype(np.float32)
    for tree, feats in ((trees.fit_bisecting(x, 40, 150), x), (trees.fit_kd(x @ neighbours.projection(64), 100), x @ neighbours.projection(64))):
        row, leaf, rank = tree.probe(feats, 4)
        assert (row[rank == 0] == np.arange(3000)).all()
        assert leaf.min() >= 0 and leaf.max() < tree.leaves
        assert len(set(zip(row, leaf))) == len(row)
        assert np.bincount(leaf[rank == 0], minlength=tree.leaves).max() <= 400
        row, leaf, rank = tree.probe(feats[:50], None)
        assert len(set(zip(row, leaf))) == len(row) == 50 * tree.leaves
    same = trees.fit_bisecting(np.ones((50, 64), np.float32), 8, 4)
    assert same.leaves == 1 and same.probe(np.ones((3, 64), np.float32), 3)[1].tolist() == [0, 0, 0]


def test_chi_square():
    assert abs(neighbours.chi_square_cdf(21.026, 12) - 0.95) < 1e-4
    assert abs(neighbours.chi_square_quantile(0.95, 12) - 21.026) < 1e-2
    assert abs(neighbours.chi_square_cdf(7.815, 3) - 0.95) < 1e-4 and abs(neighbours.chi_square_cdf(3.841, 1) - 0.95) < 1e-4
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 64))
    ratio = ((v @ neighbours.projection(64)) ** 2).sum(1) / (v * v).sum(1)
    assert abs((ratio <= 21.026).mean() - 0.95) < 0.02


def test_projected_search_of_a_large_group():
    rng = np.random.default_rng(9)
    u = vx.unit((rng.normal(size=64) + rng.normal(size=(900, 64)) * 0.2).astype(np.float32))
    ids = [np.array([i]) for i in range(900)]
    s = np.round(u @ u.T, 6)
    r, c, v = neighbours.rank(u, ids, np.ones(900, bool), 0.5, 3)
    hit = sum(set(c[r == i]) == set(np.lexsort((np.arange(900), -s[i]))[:4]) for i in range(900))
    assert hit >= 0.98 * 900


def test_usable_counts_match_sql(spark, data):
    classes, dup = vector_classes(stored_vectors(spark.read.parquet(f"{data}/vector_chunks.parquet"), spark.read.parquet(f"{data}/live_batches.parquet")))
    total = classes.agg(F.sum("n").alias("n")).first()["n"]
    assert total == classes.count() + dup.count() > 0
