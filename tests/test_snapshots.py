from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestack.errors import CatalogueInUse
from lodestack.operators import snapshots as s
from lodestack.session import shared_path
from lodestack.sources.snapshots import SnapshotStore

SNAP = "scan_id bigint, volume_id bigint, relative_path string, size_bytes bigint, modified_at timestamp_ntz, missing int, scanned_at timestamp_ntz"
HIST = "id bigint, volume_id bigint, started_at timestamp_ntz, status string"
T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def changes(spark, rows, history, **options):
    got = s.scan_changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(history, HIST), **options)
    return sorted((r.scan_id, r.relative_path or "", r.change_type) for r in got.collect())


def brute(rows, history):
    out = []
    for volume in {h[1] for h in history}:
        done = sorted((h[2], h[0]) for h in history if h[1] == volume and h[3] == "completed")
        before = None
        for _, scan in done:
            state = {}
            for r in sorted((r for r in rows if r[0] == scan), key=lambda r: (r[6] or datetime.min, r[5], -1 if r[3] is None else r[3], r[4] or datetime.min)):
                state[r[2]] = r
            state = {p: (r[3], r[4]) for p, r in state.items() if r[5] != 1}
            if before is not None:
                out += [(scan, p or "", "added") for p in state.keys() - before.keys()]
                out += [(scan, p or "", "removed") for p in before.keys() - state.keys()]
                out += [(scan, p or "", "changed") for p in state.keys() & before.keys() if state[p] != before[p]]
            before = state
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(s, "OFTEN", 3)
    rng = random.Random(seed)
    history = [(i, rng.choice([1, 2]), at(rng.randrange(99) + i / 100), rng.choice(["completed", "completed", "failed", "running"])) for i in range(1, 13)]
    volume = {h[0]: h[1] for h in history}
    rows = []
    for _ in range(400):
        scan = rng.randrange(1, 13)
        path = rng.choice(["a", "A", "a/b", "é", "é", "", None, "x y", "z" * 50])
        rows.append((scan, volume[scan], path, rng.choice([1, 2, None]), at(rng.choice([1, 2, None])), rng.choice([0, 0, 0, 1]), at(rng.randrange(200))))
    rows += rows[:50]
    assert changes(spark, rows, history) == brute(rows, history)


def test_null_equals_only_null_and_types_of_change(spark):
    history = [(1, 1, at(0), "completed"), (2, 1, at(10), "completed")]
    rows = [
        (1, 1, "same", None, None, 0, at(1)), (2, 1, "same", None, None, 0, at(11)), (1, 1, "size", 1, None, 0, at(1)), (2, 1, "size", None, None, 0, at(11)),
        (1, 1, "time", 1, at(1), 0, at(1)), (2, 1, "time", 1, None, 0, at(11)), (1, 1, "gone", 1, None, 0, at(1)), (2, 1, "gone", 1, None, 1, at(12)), (2, 1, "new", 1, None, 0, at(500)),
    ]
    assert changes(spark, rows, history) == [(2, "gone", "removed"), (2, "new", "added"), (2, "size", "changed"), (2, "time", "changed")]


def test_an_empty_completed_scan_removes_everything_and_the_next_adds_it_again(spark):
    history = [(1, 1, at(0), "completed"), (2, 1, at(10), "completed"), (3, 1, at(20), "completed"), (4, 1, at(15), "cancelled")]
    rows = [(1, 1, "a", 1, None, 0, at(1)), (3, 1, "a", 1, None, 0, at(21)), (4, 1, "b", 1, None, 0, at(16))]
    assert changes(spark, rows, history) == [(2, "a", "removed"), (3, "a", "added")]


def test_values_before_and_after(spark):
    history = [(1, 1, at(0), "completed"), (2, 1, at(10), "completed")]
    rows = [(1, 1, "a", 1, None, 0, at(1)), (2, 1, "a", 5, at(3), 0, at(11)), (2, 1, "b", 7, None, 0, at(11)), (1, 1, "c", 9, None, 0, at(1))]
    got = s.scan_changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(history, HIST)).orderBy("relative_path").collect()
    assert [(r.old_size_bytes, r.new_size_bytes, r.new_modified_at) for r in got] == [(1, 5, at(3)), (None, 7, None), (9, None, None)]


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [], [(1, 1, at(0), "completed"), (2, 1, at(1), "completed")]) == []
    assert changes(spark, [(1, 1, "a", 1, None, 0, at(1))], []) == []


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(2, 1, "a", 1, None, 0, at(1))], SNAP).withColumns({"position": F.lit(1), "change_type": F.lit("x"), "__at": F.lit(3), "at": F.lit(1)})
    history = spark.createDataFrame([(1, 1, at(0), "completed"), (2, 1, at(1), "completed")], HIST).withColumn("relative_path", F.lit("q"))
    assert [(r.scan_id, r.change_type) for r in s.scan_changes(rows, history).collect()] == [(2, "added")]


def test_a_hot_volume_is_cut_into_ranges_and_sorted_once(spark):
    rows = spark.createDataFrame([(1 + i % 2, 1, f"p{i:05}", 1, None, 0, at(1)) for i in range(4000)], SNAP)
    history = spark.createDataFrame([(1, 1, at(0), "completed"), (2, 1, at(1), "completed")], HIST)
    df = s.scan_changes(rows, history, ranges=4)
    assert df.count() == 4000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1, plan
    assert plan.split("REPARTITION_BY_NUM")[0].count("Sort [") == 1 and plan.split("REPARTITION_BY_NUM")[0].count("Exchange ") == 1, plan
    assert df.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 300").count() >= 3


def test_ranges_are_even_and_in_order(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("s"), (F.col("id") % 3).alias("g"), F.format_string("p%05d", "id").alias("k"))
    ranges, hot = s.survey(rows, "s", "g", "k", 7, 1)
    labels = s.range_labels(7)
    at = F.pmod(F.hash(ranges.of(F.col("g"), F.col("k"), labels)), F.lit(7))
    found = rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("g", "k")).alias("low"), F.max(F.struct("g", "k")).alias("high")).orderBy("at").collect()
    assert hot == [] and [r["at"] for r in found] == list(range(7)) and max(r["n"] for r in found) < 2 * 20_000 / 7
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:], strict=False))


def test_very_long_keys(spark):
    history = [(1, 1, at(0), "completed"), (2, 1, at(1), "completed")]
    rows = [(1, 1, "x" * 400_000 + "a", 1, None, 0, at(1)), (2, 1, "x" * 400_000 + "b", 1, None, 0, at(2)), (1, 1, "y" * 300, 1, None, 0, at(1)), (2, 1, "y" * 300, 2, None, 0, at(2))]
    got = changes(spark, rows * 20, history, ranges=4)
    assert [(len(p), kind) for _, p, kind in got] == [(400_001, "removed"), (400_001, "added"), (300, "changed")]


def test_a_key_with_most_rows_is_collapsed_before_the_shuffle(spark):
    history = spark.createDataFrame([(1, 1, at(0), "completed"), (2, 1, at(1), "completed")], HIST)
    one = spark.createDataFrame([(2, 1, "hot", 1, None, 0, at(1))], SNAP)
    rows = one.crossJoin(spark.range(20_000).select()).unionByName(spark.createDataFrame([(1, 1, "cold", 1, None, 0, at(1))], SNAP))
    df = s.scan_changes(rows, history)
    assert "partial_max" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.relative_path, r.change_type) for r in df.collect()) == [("cold", "removed"), ("hot", "added")]


def store(spark, **options):
    return SnapshotStore(spark, shared_path(spark, "s"), snapshot="scan_id", group="volume_id", key="relative_path", compare=["size_bytes", "modified_at"], newest_by="scanned_at", absent="missing", **options)


@pytest.mark.parametrize("seed", range(3))
def test_increments_give_what_the_whole_history_gives(spark, seed):
    rng = random.Random(seed)
    history = [(i, 1 + i % 3, at(i), "completed") for i in range(1, 13)]
    rows = [(h[0], h[1], rng.choice(["a", "b", "a/b", "", None, "é", "z" * 30]), rng.choice([1, 2, None]), at(rng.choice([1, None])), rng.choice([0, 0, 1]), at(rng.randrange(99))) for h in history for _ in range(9)]
    rows = [r for r in rows if r[0] != 5]  # a scan that found nothing
    df = spark.createDataFrame(rows, SNAP).withColumns({"__range": F.lit(9), "__at": F.lit("x")})
    sequence = s.completed_sequence(spark.createDataFrame(history, HIST))
    kept, got = store(spark, ranges=3), []
    for upto in (4, 5, 8, 12, 12):
        kept = store(spark, ranges=5) if not got and upto == 4 else kept
        got += [(r.scan_id, r.relative_path or "", r.change_type) for r in kept.add(df, sequence.where(F.col("scan_id") <= upto)).collect()]
        kept.reload()
    assert sorted(got) == brute(rows, history) and kept.version == 5
    last = {r[0] for r in brute_state(rows, history)}
    assert {(r.volume_id, r.relative_path) for r in kept.state().collect()} == last


def brute_state(rows, history):
    newest = {v: max(h[0] for h in history if h[1] == v) for v in (1, 2, 3)}
    best = {}
    for r in sorted((r for r in rows if r[0] == newest[r[1]]), key=lambda r: (r[6] or datetime.min, r[5], -1 if r[3] is None else r[3], r[4] or datetime.min)):
        best[r[1], r[2]] = r
    return {((v, p), r[3]) for (v, p), r in best.items() if r[5] != 1}


def test_a_merge_reads_sorted_ranges_and_shuffles_nothing(spark, monkeypatch):
    from lodestack.sources import snapshots as module

    plans = []
    real = module.neighbour_changes
    monkeypatch.setattr(module, "neighbour_changes", lambda *given: plans.append(real(*given)) or plans[-1])
    history = spark.createDataFrame([(i, 1, at(i), "completed") for i in (1, 2, 3)], HIST)
    rows = spark.range(3000).select((1 + F.col("id") % 3).alias("scan_id"), F.lit(1).cast("bigint").alias("volume_id"), F.format_string("p%04d", F.floor(F.col("id") / 3)).alias("relative_path"), F.lit(1).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("modified_at"), F.lit(0).alias("missing"), F.lit(at(1)).alias("scanned_at"))
    sequence, kept = s.completed_sequence(history), store(spark, ranges=4)
    kept.add(rows, sequence.where("position <= 2"))
    assert kept.add(rows, sequence).count() == 0
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert kept.state().count() == 1000 and len(kept.ranges.cuts) == 3
    kept.close()
    assert kept.vacuum(0) >= 2 and kept.state().count() == 1000


def test_two_writers_of_one_store(spark):
    history = spark.createDataFrame([(1, 1, at(1), "completed"), (2, 1, at(2), "completed")], HIST)
    rows = spark.createDataFrame([(1, 1, "a", 1, None, 0, at(1)), (2, 1, "b", 1, None, 0, at(2))], SNAP)
    sequence, one = s.completed_sequence(history), store(spark)
    other = SnapshotStore(spark, one.path, snapshot="scan_id", group="volume_id", key="relative_path", compare=["size_bytes", "modified_at"], newest_by="scanned_at", absent="missing")
    one.add(rows, sequence.where("position = 1"))
    with pytest.raises(CatalogueInUse):
        other.add(rows, sequence)
    other.reload()
    assert sorted(r.change_type for r in other.add(rows, sequence).collect()) == ["added", "removed"]
