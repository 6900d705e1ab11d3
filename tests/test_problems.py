"""The general problems: nulls, ties, repeats, hot keys, empty tables, extra columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgevec.operators import changefeed, orphans, skew

T = lambda d, h=0: dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d, hours=h)
ASSIGN = "internal_id int, list_id int, assigned_at timestamp"
SNAP = "db_name string, snapshot_id string, status string, created_at bigint, snapshot_seq int, recorded_at timestamp"
CHUNK = "snapshot_id string, chunk_index int, written_at timestamp, n int"
MAPS = "snapshot_id string, base_id int, int_to_ext array<string>, written_at timestamp"
JOURNAL = "db_name string, seq int, op string, id string, received_at timestamp"
META = "db_name string, last_seq int, updated_at timestamp"


def test_current_lists(spark):
    rows = [(1, 5, T(1)), (1, 7, T(2)), (1, 7, T(2)), (2, 5, T(3)), (2, None, T(4)), (3, -1, T(1)), (4, 9, None), (4, 8, None), (None, 5, T(1)), (5, 3, T(1)), (5, 4, T(1))]
    got = {tuple(r) for r in skew.current_lists(spark.createDataFrame(rows, ASSIGN)).collect()}
    assert got == {(1, 7), (4, 9), (5, 4)}


def test_heavy_lists_hold_a_third(spark):
    rows = [(i, 17 if i % 3 == 0 else 100 + i % 60, T(1)) for i in range(3000)]
    df = spark.createDataFrame(rows, ASSIGN).withColumn("n", F.lit(1)).withColumn("total", F.lit(2))
    assert [r["list_id"] for r in skew.heavy_lists(df).collect()] == [17]
    # exactly 4 percent counts
    rows = [(i, 1 if i < 4 else 2 + i, T(1)) for i in range(100)]
    assert [r["list_id"] for r in skew.heavy_lists(spark.createDataFrame(rows, ASSIGN)).collect()] == [1]


def test_skew_on_nothing(spark):
    empty = spark.createDataFrame([], ASSIGN)
    assert skew.heavy_lists(empty).count() == 0
    r = skew.list_report(empty).first()
    assert (r["vectors"], r["lists_used"], r["largest"], r["list_imbalance"], r["list_std"]) == (0, 0, 0, 0.0, 0.0)


def snapshots(spark):
    rows = [
        ("a", "s1", "writing", 1, 10, T(1)),
        ("a", "s1", "complete", 1, 10, T(2)),
        ("a", "s1", "complete", 1, 10, T(2)),
        ("a", "s2", "writing", 2, 20, T(3)),
        ("a", "s3", "complete", 3, 30, T(4)),
        ("a", "s3", "deleted", 3, 30, T(5)),
        ("a", "s4", "complete", 4, 15, T(40)),
        ("a", None, "complete", 9, 99, T(1)),
        ("a", "  ", "complete", 9, 99, T(1)),
        ("b", "s9", "writing", 1, 5, T(1)),
    ]
    return spark.createDataFrame(rows, SNAP)


def orphan_rows(spark, chunks, maps, states):
    refs = orphans.references({"vector_chunks": (chunks, F.col("chunk_index")), "id_maps": (maps, F.lit(-1))})
    return sorted((tuple(r) for r in orphans.orphans(refs, states).collect()), key=str)


def test_orphans(spark):
    chunks = spark.createDataFrame(
        [(" S1 ", 1, T(10), 0), ("s1", 2, T(10), 0), ("s2", 3, T(10), 0), ("S3", 4, T(10), 0), ("s4", 5, T(10), 0), ("s4", 6, T(41), 0), ("gone", 7, T(10), 0), ("gone", 7, T(11), 0), ("gone", 7, T(40), 0), (None, 8, T(10), 0), ("  ", 9, T(10), 0), ("gone", 8, None, 0)],
        CHUNK,
    )
    maps = spark.createDataFrame([("s2", 0, ["x"], T(10)), ("s2", 0, ["x"], T(12)), ("s1", 0, None, T(9))], MAPS)
    got = orphan_rows(spark, chunks, maps, orphans.snapshot_states(snapshots(spark)))
    want = [
        ("id_maps", "2025-01", "s2", -1, "unfinished"),
        ("vector_chunks", None, "gone", 8, "missing"),
        ("vector_chunks", "2025-01", "gone", 7, "missing"),
        ("vector_chunks", "2025-01", "s2", 3, "unfinished"),
        ("vector_chunks", "2025-01", "s3", 4, "deleted"),
        ("vector_chunks", "2025-01", "s4", 5, "late"),
        ("vector_chunks", "2025-02", "gone", 7, "missing"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_orphans_hot_key_and_empty_side(spark):
    chunks = spark.createDataFrame([("gone" if i % 3 == 0 else f"k{i}", i, T(1), 0) for i in range(600)], CHUNK)
    none = spark.createDataFrame([], MAPS)
    states = orphans.snapshot_states(spark.createDataFrame([], SNAP))
    assert len(orphan_rows(spark, chunks, none, states)) == 600
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the other keys by shuffle
    try:
        assert len(orphan_rows(spark, chunks, none, states)) == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert orphan_rows(spark, spark.createDataFrame([], CHUNK), none, states) == []


def feed(spark, tmp_path, journal, snaps, maps, meta):
    out = []
    for name, rows, schema in (("j", journal, JOURNAL), ("s", snaps, SNAP), ("m", maps, MAPS), ("h", meta, META)):
        df = spark.createDataFrame(rows, schema).repartition(3)
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    got = {tuple(r) for r in changefeed.current_ids(*out).collect()}
    assert {tuple(r) for r in changefeed.current_ids(*out, batches=3).collect()} == got
    return got


def test_stored_delete_vectors(spark, tmp_path):
    change = "db_name string, id string, seq int, dead boolean"
    rows = changefeed.DeleteVectorTable(spark, f"file://{tmp_path}/t")
    assert rows.read().count() == 0
    take = lambda t: {tuple(r) for r in t.read().collect()}
    give = lambda *c: rows.apply(spark.createDataFrame(list(c), change))
    give(("a", "x", 1, False), ("a", "y", 1, False), ("a", "z", None, False), ("b", "x", 7, False), (None, "x", 1, False), ("a", None, 1, False))
    assert take(rows) == {("a", "x", 1), ("a", "y", 1), ("a", "z", None), ("b", "x", 7)}
    give(("a", "x", 3, False), ("a", "x", 2, True), ("a", "y", 4, True), ("a", "n", 5, False), ("a", "n", 5, True), *[("b", "x", i, False) for i in range(300)])
    want = {("a", "x", 3), ("a", "z", None), ("b", "x", 299)}
    assert take(rows) == want
    give(("a", "x", 2, False), ("a", "y", 3, False), ("a", "n", 5, False), ("b", "x", 299, False))  # late or known
    give()
    assert take(rows) == want
    again = changefeed.DeleteVectorTable(spark, f"file://{tmp_path}/t")
    assert again.batches == 4 and take(again) == want
    again.apply(spark.createDataFrame([("a", "y", 9, False), ("a", "x", 8, True)], change))
    assert take(again) == {("a", "y", 9), ("a", "z", None), ("b", "x", 299)}
    # the superseded images have their bits set, and nothing was rewritten
    bits = sum(bin(int.from_bytes(r["bits"], "big")).count("1") for r in again.vectors().collect())
    assert bits == 4 and again._images().count() == 7


def brute(journal, snaps, maps, meta):
    status, base, out = {}, {}, set()
    for r in sorted((r for r in snaps if r[1] and r[1].strip()), key=lambda r: r[5]):
        status[r[1].strip().lower()] = r[2]
    for r in snaps:
        if r[1] and status.get(r[1].strip().lower()) == "complete":
            base[r[0]] = max(base.get(r[0], (-1, 0, "")), (r[3], r[4], r[1].strip().lower()))
    for db in {r[0] for r in journal} | set(base):
        live = {}
        seq = base[db][1] if db in base else None
        for m in maps:
            if db in base and m[0] and m[0].strip().lower() == base[db][2]:
                live |= {x: seq for x in m[2] or [] if x is not None}
        ends = [m for m in meta if m[0] == db]
        upto = max(ends, key=lambda m: m[2])[1] if ends else None
        upto = -1 if upto is None else upto
        for _, s, op, i, _ in sorted((r for r in journal if r[0] == db and r[1] is not None), key=lambda r: r[1]):
            op = (op or "").strip().lower()
            if not i or op not in ("upsert", "delete") or s > upto or seq is not None and s <= seq:
                continue
            live.pop(i, None)
            if op == "upsert":
                live[i] = s
        out |= {(db, i, s) for i, s in live.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_change_feed(spark, tmp_path, seed):
    rng = random.Random(seed)
    snaps = [("a", "s1", "complete", 1, 10, T(1)), ("a", "s2", "complete", 2, 20, T(2)), ("a", "s3", "writing", 3, 30, T(3)), ("b", "s5", "complete", 1, 5, T(1)), ("b", "s6", "complete", 4, 9, T(1)), ("b", "s6", "deleted", 4, 9, T(2))]
    maps = [("S2 ", 0, ["x", None, "y", "hot"], T(2)), ("S2 ", 0, ["x", None, "y", "hot"], T(2)), ("s2", 9, ["z"], T(2)), ("s5", 0, None, T(1)), (None, 0, ["q"], T(1))]
    meta = [("a", 400, T(9)), ("a", 300, T(8)), ("b", 250, T(5)), ("c", None, T(1))]
    ops = ["upsert", " UPSERT", "delete", "Delete ", "noop", None, ""]
    journal = []
    for db in "abcd":
        for s in rng.sample(range(1, 500), 220):
            row = (db, s if rng.random() > 0.03 else None, rng.choice(ops), rng.choice(["hot"] * 9 + ["x", "y", "z", "X", " x", "", None, "n1", "n2", "n3"]), T(rng.randrange(90)))
            journal += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(journal)
    args = (journal, snaps, maps, meta)
    assert feed(spark, tmp_path, *args) == brute(*args)


def test_change_feed_on_nothing(spark, tmp_path):
    assert feed(spark, tmp_path, [], [], [], []) == set()
