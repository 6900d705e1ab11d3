"""The vector engine: generators, predicates, search, lists, store, streams, facades."""

import itertools
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgevec import api
from ridgevec.functions import generators, scores
from ridgevec.functions.predicates import compile_where
from ridgevec.operators import evaluation, ivf, kmeans, maintenance, store
from ridgevec.operators import search as srch
from ridgevec.sources.snapshots import SnapshotStore
from ridgevec.streaming import feed

ROWS = "id string, internal_id bigint, vec array<float>"
ENTRY = "seq bigint, ts bigint, op string, id string, vec array<float>, meta string"


def vectors(n, dim, seed):
    g = kmeans.Mulberry32(seed)
    return np.array([[(g.uniform() * 2 - 1) * 0.5 for _ in range(dim)] for _ in range(n)], np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(f"id_{i + first}", i + first, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4)


def best(x, q, k, metric, ids=None):
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "cosine":
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)).astype(np.float32).astype(np.float64)
        q = (q / np.linalg.norm(q)).astype(np.float32).astype(np.float64)
    s = x @ q if metric != "l2" else -((x - q) ** 2).sum(1)
    return np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:k].tolist()


# -- generators --------------------------------------------------------------


def test_generators():
    a, b = kmeans.Lcg(123), kmeans.Lcg(1234)
    assert [a.next_state() for _ in range(3)] == [1218640798, 1868869221, 166005888]
    assert [b.next_state() for _ in range(3)] == [3067928073, 889114580, 3219257635]
    m = kmeans.Mulberry32(12345)
    assert [m.next_value() for _ in range(3)] == [4207900869, 1317490944, 2079646450]
    assert generators.jump(123, np.array([1, 2, 3])).tolist() == [1218640798, 1868869221, 166005888]


def test_generated_rows_equal_one_sequential_run(spark):
    rng = kmeans.Lcg(7)
    want = [[np.float32(rng.symmetric() * 0.5).item() for _ in range(5)] for _ in range(40)]
    rows = generators.lcg_vectors(spark, 7, 40, 5, first=10).orderBy("internal_id").collect()
    assert [r["vec"] for r in rows] == want
    assert rows[0]["id"] == "id_10" and rows[-1]["internal_id"] == 49


# -- predicates ---------------------------------------------------------------

HOT = {"n": "number", "b": "boolean", "e": ["en", "fr"]}
CASES = [
    ({"n": 5}, [0]), ({"n": "5"}, []), ({"n": True}, []), ({"n": {"in": [5, 6]}}, [0]), ({"n": {"in": ["5"]}}, []),
    ({"n": {"gt": 4, "lt": 6}}, [0]), ({"n": {"gte": 5, "lte": 5}}, [0]), ({"n": {"gt": 5}}, []), ({"n": {"gt": "x"}}, [0, 3]),
    ({"n": {"gte": 5, "in": [99]}}, [0]), ({"n": 0.1}, []), ({"n": {"gt": 0.09, "lt": 0.11}}, [3]),
    ({"b": True}, [0]), ({"b": False}, [1]), ({"b": {"in": [False]}}, [1]), ({"b": {"gt": 0}}, []), ({"b": 1}, []),
    ({"e": "en"}, [0]), ({"e": "de"}, []), ({"e": {"in": ["en", "fr", 3]}}, [0, 1]), ({"e": {"gt": "a"}}, []),
    ({"c": "87"}, [0]), ({"c": 87}, [1]), ({"c": True}, [2]), ({"c": {"in": ["87", 87]}}, [0, 1]), ({"c": {"gt": 80}}, [1]),
    ({"c": {"in": [1], "gt": 80}}, []), ({"c": None}, [4]), ({"x": 1}, []), ({}, [0, 1, 2, 3, 4, 5]), ({"n": 5, "e": "en"}, [0]), ({"n": 5, "e": "fr"}, []),
]


def test_predicate_truth_table(spark):
    rows = [(0, 5.0, True, "en", '{"c":"87"}'), (1, None, False, "fr", '{"c":87}'), (2, math.nan, None, "de", '{"c":true}'), (3, 0.1, None, None, "{broken"), (4, math.inf, None, "en ", '{"c":null}'), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, n float, b boolean, e string, meta string")
    got = df.select("id", *[compile_where(w, HOT).alias(f"c{i}") for i, (w, _) in enumerate(CASES)]).orderBy("id").collect()
    for i, (where, want) in enumerate(CASES):
        assert [r["id"] for r in got if r[f"c{i}"]] == want, where
    quirk = df.where(compile_where({"b": {"in": [False]}}, HOT, missing_is_false_in_lists=True)).select("id").collect()
    assert sorted(r["id"] for r in quirk) == [1, 2, 3, 4, 5]


# -- search -------------------------------------------------------------------


@pytest.mark.parametrize("metric", scores.METRICS)
def test_exact_search(spark, metric):
    x = vectors(400, 16, 5) * np.arange(1, 401)[:, None].astype(np.float32) ** 0.2
    x[7] = 0
    q = vectors(1, 16, 9)[0]
    df = frame(spark, x)
    assert [r["internal_id"] for r in srch.search(df, q, 10, metric).collect()] == best(x, q, 10, metric)
    many = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(5, 16, 11))], "qid int, q array<float>")
    hits = srch.batch_search(df, many, 7, metric).orderBy("qid", "rank").collect()
    assert [r["internal_id"] for r in hits] == list(itertools.chain(*[best(x, v, 7, metric) for v in vectors(5, 16, 11)]))


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 3, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("z", 2, [0.0, 0.0]), ("n", 4, [nan, 1.0]), ("i", 5, [inf, 1.0]), ("s", 6, [1.0]), (None, 7, [1.0, 0.0]), ("v", 8, None), ("e", 9, [1.0, None])]
    df = spark.createDataFrame(rows, ROWS)
    assert [(r["id"], r["score"]) for r in srch.search(df, [2.0, 0.0], 10).collect()] == [("b", 1.0), ("a", 1.0), ("z", 0.0)]
    assert [r["id"] for r in srch.search(df, [1.0, 0.0], 10, "dot", threshold=0.5).collect()] == ["b", "a"]
    assert srch.search(df, [1.0, 0.0], 0).count() == srch.search(df, [1.0, 0.0], -3).count() == 0
    with pytest.raises(ValueError):
        srch.search(df, [1.0], 3, dim=2)
    many = frame(spark, vectors(300, 4, 1))
    assert srch.search(many, [1.0, 0, 0, 0], 1000).count() == 256
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid int, q array<float>")
    assert [r["id"] for r in srch.batch_search(df, q, 2).orderBy("rank").collect()] == ["b", "a"]
    assert srch.batch_search(df, q.limit(0), 2).count() == 0


# -- inverted lists -----------------------------------------------------------


def test_lists_probed_whole_equal_exact(spark):
    x = vectors(600, 16, 12345)
    df = frame(spark, x)
    i = ivf.train(df, 16, iters=6, metric="dot")
    assigned = ivf.assign(df, i).cache()
    assert (i.centroids == ivf.train(df, 16, iters=6, metric="dot").centroids).all()
    sizes = ivf.list_sizes(assigned, i).collect()
    assert sum(r["size"] for r in sizes) == 600 and len(sizes) == 16
    queries = vectors(12, 16, 77)
    for q in queries[:3]:
        assert [r["internal_id"] for r in ivf.search(assigned, i, q, 10, 16).collect()] == best(x, q, 10, "dot")
    qdf = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "qid int, q array<float>")
    exact = srch.batch_search(df, qdf, 10, "dot").cache()
    recall = [evaluation.mean_recall(exact, ivf.batch(assigned, i, qdf, 10, n), 10).first()["recall"] for n in (1, 4, 16)]
    assert recall == sorted(recall) and recall[-1] == 1.0
    with pytest.raises(ValueError):
        ivf.train(df.limit(0), 4)


def test_lists_follow_changes(spark, tmp_path):
    x = vectors(200, 8, 3)
    df = frame(spark, x)
    i = ivf.given(x[:8], "dot")
    delta = df.where("internal_id < 30").withColumn("op", F.when(F.col("internal_id") < 10, "delete").otherwise("upsert")).withColumn("vec", F.transform("vec", lambda v: (-v).cast("float")))
    now = {r["internal_id"]: r["list_id"] for r in ivf.apply_delta(ivf.assign(df, i), delta, i).collect()}
    y = x.copy()
    y[:30] *= -1
    assert now == {n: int(c) for n, c in enumerate(kmeans.nearest_centroid(y, x[:8])) if n >= 10}
    ivf.write_lists(ivf.assign(df, i), str(tmp_path / "lists"))
    back = spark.read.parquet(str(tmp_path / "lists"))
    assert [r["internal_id"] for r in ivf.search(back, i, x[3], 3, 2).collect()][0] is not None
    assert len(os.listdir(tmp_path / "lists")) > 2
    plan = ivf.search(back, i, x[3], 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_metrics_of_32_bits(spark):
    f = np.float32
    rows = [([0.1, 0.2, 3e7], [0.3, -0.7, 1.1]), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    v, q = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<float>, b array<float>").select(scores.dot32(v, q), scores.l2sq32(v, q), scores.norm32(v), scores.cosine32(v, q)).collect()

    def total(xs):
        s = f(0)
        for x in xs:
            s = f(s + x)
        return float(s)

    a, b = (np.array(x, f) for x in rows[0])
    dot, n, m = total(a * b), np.sqrt(total(a * a)), np.sqrt(total(b * b))
    assert tuple(got[0]) == (dot, total((a - b) * (a - b)), n, dot / (n * m))
    assert tuple(got[1]) == (0.0, 14.0, 0.0, float("-inf"))
    assert tuple(got[2])[:3] == (None, None, None)


def test_kmeans_rules():
    x = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1]], np.float32)
    c = kmeans.train(x, 2, 5)
    assert np.allclose(sorted(c.sum(1).tolist()), [0.05, 10.05])
    for bad in (0, 5):
        with pytest.raises(ValueError):
            kmeans.train(x, bad)
    same = np.ones((6, 2), np.float32)
    assert (kmeans.train(same, 3, 2) == 1).all()
    assert kmeans.nearest_centroid(x[:1], np.array([[1, 0], [1, 0]], np.float32))[0] == 0


# -- store --------------------------------------------------------------------


def entries(spark, rows):
    return spark.createDataFrame([(s, 0, op, i, v, m) for s, op, i, v, m in rows], ENTRY)


def test_fold_and_metadata(spark):
    rows = [(1, "upsert", "a", [1.0], '{"x":1}'), (3, "upsert", "a", [3.0], None), (2, "delete", "b", None, None), (1, "upsert", "b", [1.0], '{"y":1}'), (4, "upsert", "b", [4.0], None), (5, "delete", "c", None, None), (6, " UPSERT ", "d", [6.0], None), (6, "upsert", "d", [6.0], None), (7, "noop", "a", None, None), (None, "upsert", "a", [9.0], None), (8, "upsert", "", [1.0], None), (9, "upsert", None, [1.0], None), (10, "upsert", "a", None, None), (11, "upsert", "a", [1.0, 2.0], None)]
    j = entries(spark, rows)
    got = {r["id"]: (r["seq"], r["vec"], r["meta"]) for r in store.live(j, dim=1).collect()}
    assert got == {"a": (3, [3.0], '{"x":1}'), "b": (4, [4.0], "{}"), "d": (6, [6.0], "{}")}
    half = store.live(j, upto=3, dim=1).select("id", "vec", "meta")
    again = {r["id"]: (r["vec"], r["meta"]) for r in store.replay(half, j, 3, dim=1).collect()}
    assert again == {k: v[1:] for k, v in got.items()}
    assert store.live(j.limit(0)).count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    got = store.dense_ids(df, "k", 50).orderBy("k").collect()
    assert [r["internal_id"] for r in got] == list(range(50, 151))
    assert store.dense_ids(df.limit(0), "k").count() == 0


def test_stats_and_compaction(spark):
    df = spark.createDataFrame([(i, f"x{i}", i in (2, 8, 9)) for i in range(10)], "internal_id bigint, id string, deleted boolean")
    s = store.store_stats(df, 4, 4).first()
    assert (s["live_count"], s["deleted_count"], s["tail_dead_count"], s["next_id"], s["chunks"], s["tail_dead_ratio"]) == (7, 3, 2, 10, 3, 0.2)
    assert store.compact(df).count() == 8
    assert tuple(store.compaction_report(df, 4).first()) == (10, 8, 1)
    e = store.store_stats(df.limit(0), 4, 4).first()
    assert (e["live_count"], e["next_id"], e["dead_ratio"], e["tail_dead_count"]) == (0, 0, 0.0, 0)
    gone = df.withColumn("deleted", F.lit(True))
    assert store.store_stats(gone, 4, 4).first()["tail_dead_count"] == 10 and store.compact(gone).count() == 0


def test_policy(spark):
    df = spark.createDataFrame([(0.5, 1, 100), (None, None, None), (0.0, 0, 900)], "dead_ratio double, tail_dead_count int, last_snapshot_at bigint")
    p = maintenance.Policy(snapshot_if_dead_ratio=0.4, snapshot_min_interval_ms=500, ivf_rebuild_if_dead_ratio=0.4)
    assert [tuple(r)[3:] for r in maintenance.evaluate(df, p, 1000).collect()] == [(True, True, True), (False, True, False), (False, False, False)]
    off = maintenance.Policy(trim_tail=False)
    assert [tuple(r)[3:] for r in maintenance.evaluate(df, off, 1000).collect()] == [(False, False, False)] * 3


def test_gates_and_percentiles(spark):
    f = spark.createDataFrame([("search_p95_ms", 81.0), ("ivf_recall_at_10", 0.9), ("ivf_speedup", None)], "name string, value double")
    got = {r["gate"]: r["status"] for r in evaluation.gates(f).collect()}
    assert got == {"search_p95_ms_max": "fail", "ivf_recall_at_10_min": "pass", "ivf_speedup_min": "skip", "ingest_p95_ms_max": "skip", "warm_start_ms_max": "skip", "frame_p95_ms_max": "skip"}
    odd = evaluation.gates(f, {"search_p95_ms_about": 5.0, "ivf_recall_at_10_max": 0.5})
    assert {r["gate"]: r["status"] for r in odd.collect()} == {"search_p95_ms_about": "skip", "ivf_recall_at_10_max": "fail"}
    ms = lambda *x: spark.createDataFrame([(float(v),) for v in x], "ms double")
    assert evaluation.speedup(ms(10, 20, 30), ms(5, 10, 15)).first()["speedup"] == 2.0
    v = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 3, 9, 7, 7, 2, 4, 8]] + [(None,)], "v double")
    xs = sorted([5, 1, 1, 3, 9, 7, 7, 2, 4, 8])
    r = evaluation.percentiles(v, "v", {"a": 0.5, "b": 0.95}).first()
    assert (r["a"], r["b"]) == (xs[4], xs[8])
    r = evaluation.percentiles(v, "v", {"a": 0.5, "b": 1.0}, rule="floor_n").first()
    assert (r["a"], r["b"]) == (xs[5], xs[9])


def test_snapshot_store(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/db", 2, 16)
    assert s.load().count() == 0 and s.last_seq() == 0
    put = lambda *r: spark.createDataFrame([("upsert", i, v, m, o) for o, (i, v, m) in enumerate(r)], "op string, id string, vec array<float>, meta string, ord int")
    assert s.append(put(("a", [1.0, 0.0], '{"t":1}'), ("b", [0.0, 1.0], None))) == 2
    sid = s.save()
    assert s.latest()["snapshot_id"] == sid and s.journal().count() == 0 and s.last_seq() == 2
    s.append(put(("b", [0.5, 0.5], None), ("c", [1.0, 1.0], None)))
    s.append(spark.createDataFrame([("delete", "a", None)], "op string, id string, vec array<float>"))
    s.save(break_before_manifest=True)
    assert s.latest()["snapshot_id"] == sid
    now = {r["id"]: (r["internal_id"], r["vec"], r["meta"]) for r in s.load().collect()}
    assert now == {"b": (1, [0.5, 0.5], "{}"), "c": (2, [1.0, 1.0], "{}")}
    s.save()
    assert {r["id"]: (r["internal_id"], r["vec"], r["meta"]) for r in s.load().collect()} == now
    assert s.prune(1) == 1 and len(s.manifests()) == 1
    for bad in (put(("", [1.0, 0.0], None)), put(("x", [1.0], None)), put(("x", None, None))):
        with pytest.raises(ValueError):
            s.append(bad)
    with pytest.raises(ValueError):
        SnapshotStore(spark, s.path, 3, 16).load()
    with pytest.raises(ValueError):
        SnapshotStore(spark, s.path, 2, 10)


# -- streams ------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = vectors(30, 8, 4)
    rows = [(int(s), "delete" if rng.random() < 0.2 else "upsert", f"k{rng.integers(12)}", x[rng.integers(30)].tolist(), None) for s in rng.permutation(300)]
    j = entries(spark, rows + rows[:20])
    j.repartition(6).write.parquet(str(tmp_path / "j"))
    stream = lambda: feed.read_journal(spark, str(tmp_path / "j"), ENTRY, files_per_batch=1)
    want = {(r["id"], r["seq"]) for r in store.live(j).collect()}
    assert {(r["id"], r["seq"]) for r in feed.stream_fold(stream()).collect()} == want
    i = ivf.given(x[:6], "dot")
    lists = {(r["id"], r["list_id"]) for r in ivf.assign(store.live(j).select("id", "vec"), i).collect()}
    assert {(r["id"], r["list_id"]) for r in feed.stream_lists(stream(), i).collect()} == lists


@pytest.mark.parametrize("compact", [2, 50])
def test_streams_go_on_from_a_checkpoint(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(feed, "COMPACT", compact)
    rng = np.random.default_rng(3)
    x = vectors(30, 8, 4)
    rows = [(int(s), "delete" if rng.random() < 0.2 else "upsert", f"k{rng.integers(12)}", x[rng.integers(30)].tolist(), None) for s in rng.permutation(200)]
    i = ivf.given(x[:6], "dot")
    for part in range(3):
        entries(spark, rows[part::3]).repartition(3).write.mode("append").parquet(str(tmp_path / "j"))
        stream = feed.read_journal(spark, str(tmp_path / "j"), ENTRY, files_per_batch=1)
        live = store.live(entries(spark, [r for p in range(part + 1) for r in rows[p::3]]))
        got = {(r["id"], r["seq"]) for r in feed.stream_fold(stream, f"file://{tmp_path}/f").collect()}
        assert got == {(r["id"], r["seq"]) for r in live.collect()}
        got = {(r["id"], r["list_id"]) for r in feed.stream_lists(stream, i, f"file://{tmp_path}/l").collect()}
        assert got == {(r["id"], r["list_id"]) for r in ivf.assign(live.select("id", "vec"), i).collect()}


# -- facades ------------------------------------------------------------------


def test_facade(spark):
    db = api.VectorDB.open(spark, 3)
    db.upsert("one", [1, 0, 0], {"name": "First"})
    db.upsert("two", [0, 1, 0])
    hit = db.search([1, 0, 0], 1).collect()
    assert [(h["id"], h["score"], h["metadata"]) for h in hit] == [("one", 1.0, '{"name": "First"}')]
    db.upsert("one", [0, 0, 2])
    assert db.size() == 2 and db.search([0, 0, 1], 1).first()["metadata"] == '{"name": "First"}'
    assert db.delete("one") and not db.delete("nobody") and db.size() == 1
    for bad in (lambda: db.upsert("", [1, 0, 0]), lambda: db.upsert("x", [1, 0]), lambda: db.search([1, 0], 1), lambda: db.search([1, 0, 0], 0), lambda: api.VectorDB(spark, 0), lambda: api.VectorDB(spark, 2, "max")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        db.search_ivf([1, 0, 0])


def test_facade_lists_and_filters(spark):
    db = api.VectorDB(spark, 8, "dot", schema={"year": "number", "lang": ["en", "de"]})
    db.generate(123, 300)
    db.upsert("id_5", [0.9] * 8, {"year": 2001, "lang": "en", "note": "x"})
    db.upsert("id_6", [0.8] * 8, {"year": "2001", "lang": "xx"})
    assert [h["id"] for h in db.search([1] * 8, 2, where={"year": 2001, "lang": "en", "note": "x"}).collect()] == ["id_5"]
    assert db.search([1] * 8, 2, where={"lang": "xx"}).count() == 0
    db.build_ivf(8, iters=3)
    assert [h["internal_id"] for h in db.search_ivf([1] * 8, 5, nprobe=8).collect()] == [h["internal_id"] for h in db.search([1] * 8, 5).collect()]
    assert sum(r["size"] for r in db.list_sizes().collect()) == 300
    db.delete("id_5")
    assert sum(r["size"] for r in db.list_sizes().collect()) == 299
    assert db.stats().first()["live_count"] == 299


def test_persistent_facade(spark, tmp_path):
    db = api.PersistentVectorDB(spark, f"file://{tmp_path}/p", 2)
    db.upsert("a", [1, 0], {"k": 1})
    db.upsert("b", [0, 1])
    assert db.search([1, 0.1], 1).first()["id"] == "a"
    db.snapshot_now()
    db.delete("a")
    assert db.get("a").count() == 0 and db.search([1, 0.1], 1).first()["id"] == "b"
    done = db.maintain(maintenance.Policy(snapshot_if_dead_ratio=0.3), 0)
    assert done["actions"]["snapshot_id"] and db.search([1, 0.1], 5).count() == 1


def test_maintenance_run(spark, tmp_path):
    db = api.PersistentVectorDB(spark, f"file://{tmp_path}/m", 2, chunk_rows=4)
    assert db.stats()["next_id"] == 0 and db.stats(ivf_stats={"nlist": 2})["last_snapshot_at"] is None
    rows = [(f"k{i}", [float(i), 1.0], i) for i in range(10)]
    db.upsert_batch(spark.createDataFrame(rows, "id string, vec array<float>, ord int"))
    db.snapshot_now()
    assert not db.delete("nobody")
    assert all(db.delete(k) for k in ("k8", "k9", "k3"))
    s = db.stats(ivf_stats={"nlist": 3, "iters": 2})
    assert (s["live_count"], s["deleted_count"], s["tail_dead_count"], s["next_id"], s["chunks"], s["journal_seq"]) == (7, 3, 2, 10, 3, 13)
    assert sum(s["list_sizes"]) == 7 and len(s["list_sizes"]) == 3 and s["list_imbalance"] >= 1
    assert db.stats(ivf_stats={"nlist": 0}).get("list_sizes") is None
    # a trim without a snapshot is told, but doesn't last
    done = db.maintain(maintenance.Policy())
    assert done["actions"] == {"trimmed_chunks": 1, "new_next_id": 8}
    assert (done["stats"]["next_id"], done["stats"]["tail_dead_count"], done["stats"]["deleted_count"]) == (8, 0, 1)
    assert db.stats()["next_id"] == 10
    assert db.maintain(maintenance.Policy(trim_tail=False, ivf_rebuild_if_dead_ratio=0.1))["actions"] == {"ivf_rebuild": True}
    done = db.maintain(maintenance.Policy(snapshot=True, ivf_stats={"nlist": 2}))
    assert done["actions"]["trimmed_chunks"] == 1 and done["stats"]["next_id"] == 8 and sum(done["stats"]["list_sizes"]) == 7
    db.upsert("new", [5, 5])
    assert db.get("new").first()["internal_id"] == 8 and db.get("k7").first()["internal_id"] == 7
    assert db.request("snapshot")["actions"]["snapshot_id"] == db.store.meta_state()["active_snapshot_id"]
    assert db.request("stats")["stats"]["live_count"] == 8 and db.request("run")["actions"] == {}
    told = db.request("what")
    assert told["error"] and told["stats"] == maintenance.EMPTY


def test_view_is_kept_until_the_journal_moves(spark, tmp_path):
    db = api.PersistentVectorDB(spark, f"file://{tmp_path}/v", 2)
    db.upsert("a", [1, 0])
    first = db.store.load()
    assert db.store.load() is first
    db.snapshot_now()
    db.upsert("a", [0, 1], {"k": 2})
    assert db.store.load() is not first
    got = db.get("a")
    assert got.first()["vec"] == [0.0, 1.0] and got.first()["internal_id"] == 0 and got.first()["meta"] == '{"k": 2}'


def test_export_and_restore(spark):
    db = api.VectorDB(spark, 4)
    assert db.export_rows().count() == 0
    db.generate(5, 20)
    db.delete("id_4")
    state = db.snapshot()
    db.delete("id_5")
    other = api.VectorDB(spark, 4)
    other.upsert("old", [1, 2, 3, 4])
    other.restore(state)
    rows = other.export_rows().collect()
    assert [r["internal_id"] for r in rows] == sorted(r["internal_id"] for r in rows) and len(rows) == 19
    assert other.size() == 19 and other.get("old").count() == 0 and other.get("id_5").count() == 1
    other.upsert("next", [1, 0, 0, 0])
    assert other.get("next").first()["internal_id"] == 20
    for bad in (api.VectorDB(spark, 3), api.VectorDB(spark, 4, "dot")):
        with pytest.raises(ValueError):
            bad.restore(state)


def test_core_stands_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/ridgevec", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "ridgevec/llm")], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
