from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import clean_extension
from lodestack.llm import terms
from lodestack.session import shared_path

ROWS = "record string, term string"


def brute(rows):
    """Rows and records per term of what is there."""
    occurrences = Counter(t for _, t in rows if t is not None)
    records = defaultdict(set)
    for r, t in rows:
        records[t].add(r)
    out = {("term", t): (n, len(records[t])) for t, n in occurrences.items()}
    return out | ({("all", None): (len(rows), len({r for r, _ in rows}))} if rows else {})


def counted(df):
    return {(r.level, r.term): (r.occurrences, r.records) for r in df.collect()}


def apply(spark, store, delivery, before, after):
    side = lambda rows: None if rows is None else spark.createDataFrame(rows, ROWS)
    return store.apply(delivery, side(before), side(after), F.col("record"), F.col("term"))


@pytest.mark.parametrize("seed", range(2))
def test_counts_follow_deliveries_that_add_change_and_delete(spark, seed):
    rng = random.Random(seed)
    store = terms.TermCounts(spark, shared_path(spark, "t"), 4)
    held = {}
    for step in range(4):
        moved = rng.sample(["a", "b", "c", "d", "e", None], 3)
        before = [(r, t) for r in moved for t in held.get(r, [])]
        for r in moved:
            held[r] = [rng.choice(["x", "y", "z", None]) for _ in range(rng.randrange(4))]
        after = [(r, t) for r in moved for t in held[r]]
        apply(spark, store, str(step), before, after)
        assert counted(store.counts()) == brute([(r, t) for r, ts in held.items() for t in ts])
    version = store.version
    assert apply(spark, store, "2", None, [("q", "x")]).version == version
    again = terms.TermCounts(spark, store.path)
    assert counted(again.counts()) == counted(store.counts()) and again.merged == set("0123") and again.buckets == 4


def test_changes_of_a_delivery_are_signed(spark):
    before, after = [("a", "x"), ("a", "x"), ("b", "x"), ("c", "y")], [("a", "x"), ("b", "z"), ("d", None)]
    got = terms.signed_changes(spark.createDataFrame(before, ROWS), spark.createDataFrame(after, ROWS), F.col("record"), F.col("term"))
    assert {(r.level, r.term): (r.d_occurrences, r.d_records) for r in got.collect()} == {("term", "x"): (-2, -1), ("term", "y"): (-1, -1), ("term", "z"): (1, 1), ("all", None): (-1, 0)}


def test_the_number_of_partitions_belongs_to_the_store(spark):
    store = apply(spark, terms.TermCounts(spark, shared_path(spark, "t"), 16), "1", None, [(str(i), t) for i, t in enumerate(["jpg", "md", "png"] * 3)])
    with pytest.raises(ValueError):
        terms.TermCounts(spark, store.path, 32)
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        apply(spark, terms.TermCounts(spark, store.path), "2", None, [("n", "jpg")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    rows = terms.TermCounts(spark, store.path).counts().where("level = 'term'").collect()
    assert sorted((r.term, r.records) for r in rows) == [("jpg", 4), ("md", 3), ("png", 3)]


def test_two_writers_lose_nothing(spark):
    one = apply(spark, terms.TermCounts(spark, shared_path(spark, "t"), 4), "0", None, [("a", "x")])
    other = terms.TermCounts(spark, one.path)
    apply(spark, one, "1", None, [("b", "x"), ("c", "y")])
    apply(spark, other, "2", [("a", "x")], [("a", "y")])
    assert counted(terms.TermCounts(spark, one.path).counts()) == brute([("a", "y"), ("b", "x"), ("c", "y")])
    apply(spark, one, "2", [("a", "x")], [("a", "y")])  # the other merged it; seen when publishing fails
    assert one.merged == {"0", "1", "2"} and counted(one.counts()) == brute([("a", "y"), ("b", "x"), ("c", "y")])


def test_only_touched_partitions_are_rewritten_and_old_folders_go(spark):
    store = terms.TermCounts(spark, shared_path(spark, "t"), 64)
    apply(spark, store, "1", None, [(str(i), f"t{i}") for i in range(40)])
    first = dict(store.folders)
    apply(spark, store, "2", None, [("new", "t1")])
    moved = [b for b in first if store.folders[b] != first[b]]
    assert 1 <= len(moved) <= 2 and counted(store.counts())["term", "t1"] == (2, 2)
    apply(spark, store, "3", None, [("new", "t1")])
    apply(spark, store, "4", [("new", "t1")], None)
    assert set(store._names("counts")) == {f.rpartition("/")[2] for v in (store.version, store.version - 1) for f in store._read(v)["folders"].values()}
    spark.range(1).write.parquet(f"{store.path}/counts/left")
    assert store.vacuum() == 0 and store.vacuum(0) == 1 and counted(store.counts())["term", "t1"] == (2, 2)


def test_a_load_and_an_increment_that_replaces_records(spark):
    rows = [("a", "x", 1), ("a", "y", 1), ("b", "x", None), ("a", "z", 5), ("c", "x", 6)]
    df = spark.createDataFrame(rows, "record string, term string, day int").withColumns({"n": F.lit(1), "level": F.lit("q"), "sign": F.lit(2)})
    got = terms.load_and_increment(df, F.col("record"), F.col("term"), "day", 5)
    assert counted(got) == brute([("a", "z"), ("b", "x"), ("c", "x")])


def test_marks(spark):
    rows = [(str(i), "big", 1) for i in range(30)] + [(f"s{i}", "small", 1) for i in range(4)] + [(f"m{i}", "mid", 1) for i in range(5)] + [(f"n{i}", None, 1) for i in range(70)]
    df = spark.createDataFrame([r[:2] for r in rows], ROWS)
    store = terms.TermCounts(spark, shared_path(spark, "t")).apply("1", None, df, F.col("record"), F.col("term"))
    assert {r.term: r.mark for r in terms.mark_terms(store.counts()).collect()} == {"big": "common", "small": "rare", "mid": None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "record string, term string, day int")
    counts = terms.load_and_increment(df, F.col("record"), F.col("term"), "day", 1)
    assert counts.collect() == [] and terms.mark_terms(counts).collect() == []
    assert terms.load_and_increment(df, F.col("record"), F.col("term"), "day", None).collect() == []


def test_extensions_in_one_spelling(spark):
    cases = [("JPG", "jpg"), (" .Jpg ", "jpg"), ("..tar", "tar"), ("", None), (" ", None), (None, None), (".", None), ("a.b", "a.b"), ("\tpdf\n", "pdf")]
    df = spark.createDataFrame(cases, "e string, want string").withColumn("got", clean_extension(F.col("e")))
    assert [(r.e, r.got) for r in df.collect()] == cases
