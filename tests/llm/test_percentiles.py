from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.llm import percentiles as p

ROWS = "g string, h int, size bigint, id bigint"
SHARES = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def table(spark, n, seed=0, groups="ab"):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.randrange(3), int(rng.paretovariate(0.5) * 100) % 10**9, i) for i in range(n)]


def values_of(rows, key):
    out = defaultdict(list)
    for r in {x for x in rows if x[2] is not None}:
        out[key(r)].append(r[2])
    return {k: sorted(v) for k, v in out.items()}


def check(got, truth, key):
    seen = 0
    for r in got:
        values = truth[key(r)]
        rank = max(1, math.ceil(r.share * len(values)))
        low, high = sum(v < r.value for v in values) + 1, sum(v <= r.value for v in values)
        off = max(0, low - rank, rank - high)
        assert r.rows == len(values) and off <= r.rank_error, (r, off)
        seen += 1
    assert seen == len(truth) * len(SHARES)


@pytest.mark.parametrize("capacity,leaves", [(16, 4), (64, 9), (100_000, 4)])
def test_ranks_stay_within_the_stated_error(spark, capacity, leaves):
    rows = table(spark, 6000)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    buffers = p.sketch(df, ["g"], F.col("size"), ["id"], capacity, leaves)
    got = p.percentiles(buffers, ["g"], SHARES).collect()
    truth = values_of(rows, lambda r: r[0])
    check(got, truth, lambda r: r.g)
    for r in got:
        assert r.rank_error <= 3 * r.rows / capacity + 3 * leaves + 3
        assert capacity < 1000 or r.rank_error == 0
    assert max(r["count"] for r in buffers.groupBy("g").count().collect()) <= max(capacity, 1) or capacity > 1000


def test_buffers_of_parts_and_days_combine(spark):
    rows = table(spark, 5000, 3)
    df = spark.createDataFrame(rows, ROWS)
    early, late = (p.sketch(df.where(F.col("id") % 2 == k), ["g", "h"], F.col("size"), ["id"], 32, 4) for k in (0, 1))
    whole = p.combine(early.unionByName(late).drop("h"), ["g"], 32)
    check(p.percentiles(whole, ["g"], SHARES).collect(), values_of(rows, lambda r: r[0]), lambda r: r.g)


def test_the_same_input_gives_the_same_summary(spark):
    rows = table(spark, 3000, 5)
    a, b = (sorted(p.percentiles(p.sketch(spark.createDataFrame(x, ROWS).repartition(n), ["g"], F.col("size"), ["id"], 32, 4), ["g"], SHARES).collect()) for x, n in ((rows, 2), (rows[::-1], 7)))
    assert a == b


def test_copies_nulls_ties_and_a_hot_group(spark):
    rows = [("a", 1, 7, i) for i in range(500)] + [("a", 1, 7, 0)] * 300 + [("b", 1, None, 9000), (None, 1, 3, 9001), (None, 1, 3, None), ("c", 1, 5, 9002)]
    buffers = p.sketch(spark.createDataFrame(rows, ROWS), ["g"], F.col("size"), ["id"], 16, 4)
    got = {(r.g, r.share): (r.value, r.rows) for r in p.percentiles(buffers, ["g"], [0.5]).collect()}
    assert got == {("a", 0.5): (7, 500), (None, 0.5): (3, 2), ("c", 0.5): (5, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert p.percentiles(p.sketch(df, ["g"], F.col("size"), ["id"]), ["g"], SHARES).collect() == []
    assert p.outlying_groups(df, ["h", "g"], "g", F.col("size"), ["id"]).collect() == []


def test_outlying_pairs(spark):
    rows = [("x", 1, 10, i) for i in range(100)] + [("x", 2, 800, 1000 + i) for i in range(25)] + [("x", 3, 800, 2000 + i) for i in range(19)] + [("y", 2, 5, 3000)]
    got = p.outlying_groups(spark.createDataFrame(rows, ROWS), ["h", "g"], "g", F.col("size"), ["id"]).select("h", "g").collect()
    assert [tuple(r) for r in got] == [(2, "x")]
