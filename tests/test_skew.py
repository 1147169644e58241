from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.operators import skew as s

FILES = "id bigint, volume_id bigint, folder_id bigint, size_bytes bigint"


def rows_of(seed, n=800):
    rng = random.Random(seed)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randrange(5), rng.choice([None, 7, 8, i]), rng.choice([None, -1, 0, 5, 5, int(rng.paretovariate(0.4)) % 2**40])) for i in range(n)]
    return rows + rows[:60]


@pytest.mark.parametrize("seed", range(3))
def test_totals_against_brute_force(spark, seed):
    rows = rows_of(seed)
    want = defaultdict(list)
    for _, volume, folder, size in set(rows):
        for key in (("volume_id", volume), ("folder_id", folder), ("all", None)):
            want[key].append(size)
    got = {(r.key_field, r.key_id): r for r in s.file_totals(spark.createDataFrame(rows, FILES)).collect()}
    assert got.keys() == want.keys()
    for key, sizes in want.items():
        known = [x for x in sizes if x is not None and x >= 0]
        common = min(Counter(known).items(), key=lambda c: (-c[1], c[0]))[0] if known else None
        r = got[key]
        assert (r.files, r.total_bytes, r.sized_files, r.distinct_sizes, r.common_size) == (len(sizes), sum(known), len(known), len(set(known)), common)


@pytest.mark.parametrize("most", [1_000_000, 2])
@pytest.mark.parametrize("seed", range(3))
def test_exact_percentiles_against_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(s, "MOST_VALUES", most)
    rng = random.Random(seed)
    special = [0, 1, 2, 7, 8, 9, 15, 16, 17, 2**29 - 1, 2**29, 2**53, 2**53 + 1, 2**62, 2**63 - 1]
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([*special, rng.randrange(2**40), None])) for _ in range(700)]
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    weighted = s.weighted_values(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v")
    got = {(r.k, r.share): r.value for r in s.exact_percentiles(weighted, ["k"], "v", shares).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        want |= {(k, q): values[max(math.ceil(q * len(values)), 1) - 1] for q in shares}
    assert got == want


@pytest.mark.parametrize("level", [0, 1, 3, 6])
def test_classes_keep_the_order(spark, level):
    values = sorted({*range(300), *(2**k + d for k in range(3, 62) for d in (-1, 0, 1)), 2**63 - 1})
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", s.size_class(F.col("v"), level).alias("c")).orderBy("v").collect()
    classes = [tuple(r.c) for r in df]
    assert classes == sorted(classes) and (level or len(set(classes)) < 512) and (level < 6 or len(set(classes)) == len(values))


def test_heavy_keys(spark):
    rows = [(i, 1 if i < 50 else 2 + i, None if i < 90 else 9, 1) for i in range(100)] + [(0, 1, None, 1)] * 500
    got = s.heavy_keys(s.file_totals(spark.createDataFrame(rows, FILES)), {"volume_id": 0.04, "folder_id": 0.01}).collect()
    assert sorted((r.key_field, r.key_id, r.files) for r in got) == [("folder_id", 9, 10), ("volume_id", 1, 50)]
    limit = [(i, i % 25, None, 1) for i in range(100)]  # 4 % each is not more than 4 %
    assert s.heavy_keys(s.file_totals(spark.createDataFrame(limit, FILES)), {"volume_id": 0.04, "folder_id": 0.01}).collect() == []


def test_empty_table_and_extra_columns(spark):
    assert s.file_totals(spark.createDataFrame([], FILES)).collect() == []
    assert s.heavy_keys(s.file_totals(spark.createDataFrame([], FILES)), {"volume_id": 0.04}).collect() == []
    one = spark.createDataFrame([(1, 2, 3, 4)], FILES).withColumns({"weight": F.lit(9), "key_id": F.lit(9), "rows": F.lit(9), "r": F.lit(9)})
    assert {(r.key_field, r.key_id, r.files) for r in s.file_totals(one).collect()} == {("volume_id", 2, 1), ("folder_id", 3, 1), ("all", None, 1)}


def test_a_hot_key_is_counted_by_value_before_key(spark):
    df = s.file_totals(spark.createDataFrame(rows_of(0), FILES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key_field") == 2
