from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing as m


def best(lengths, counts, budget):
    return min(abs(budget - sum(a * b for a, b in zip(lengths, t, strict=True))) for t in itertools.product(*[range(c + 1) for c in counts]))


@pytest.mark.parametrize("seed", range(12))
def test_the_nearest_sum_is_found(seed):
    rng = random.Random(seed)
    lengths = np.array(rng.sample(range(3, 60), 5))
    counts = np.array([rng.randrange(0, 4) for _ in lengths])
    total = int((lengths * counts).sum())
    for budget in {0, total, total + 5, *(rng.randrange(total + 1) for _ in range(10))}:
        taken = m.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(budget - int((lengths * taken).sum())) == best(lengths, counts, budget)


def test_a_budget_beyond_the_table_is_met():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 400)
    counts = rng.integers(0, 500, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = m.fit_budget(lengths, counts, budget, table=1 << 14)
    assert (taken >= 0).all() and (taken <= counts).all() and int((lengths * taken).sum()) == budget


def test_no_length_or_none_to_take():
    assert m.fit_budget(np.array([]), np.array([]), 10).tolist() == []
    assert m.fit_budget(np.array([0, 5]), np.array([3, 2]), 3).tolist() in ([0, 1], [0, 0])


def plan_of(spark, docs, targets):
    lengths = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")
    return lengths, m.mixing_plan(lengths, goal)


def test_shares_caps_and_selection(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big", " BIG", "small", "tiny", None, "other"]), rng.randrange(1, 40)) for i in range(600)] + [(1000 + i, "tiny", 0) for i in range(3)]
    lengths, plan = plan_of(spark, docs, [("Big", 0.5, 3), ("small", 0.45, 9), ("tiny", 0.05, 1), ("absent", 0.0, 2)])
    report = {r.source_name: r for r in m.mixing_report(plan).collect()}
    own = lambda s: sum(n for _, x, n in docs if x and x.strip().lower() == s)
    total = own("big") + own("small") + own("tiny")
    chosen = m.chosen_documents(lengths, plan, "doc_id", buckets=3).collect()
    for name, share, cap in (("Big", 0.5, 3), ("small", 0.45, 9), ("tiny", 0.05, 1)):
        r = report[name]
        assert r.source_tokens == own(name.lower()) and r.unreachable == (share * total > cap * own(name.lower()))
        assert r.chosen_tokens == (cap * own(name.lower()) if r.unreachable else int(share * total + 0.5))
        picked = [c for c in chosen if c.source_name == name]
        assert sum(c.n_tokens * c.times for c in picked) == r.chosen_tokens and max(c.times for c in picked) <= cap
    assert report["absent"].documents == 0 and not report["absent"].unreachable
    assert len({c.doc_id for c in chosen}) == len(chosen)
    again = m.chosen_documents(lengths.repartition(7), plan, "doc_id", buckets=3).collect()
    assert sorted(again) == sorted(chosen)
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9


def test_one_length_holds_most_documents(spark):
    docs = [(i, "a", 10) for i in range(3000)] + [(9000 + i, "b", 7) for i in range(100)]
    lengths, plan = plan_of(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    chosen = m.chosen_documents(lengths, plan, "doc_id", seed=3, buckets=5)
    assert {r.source_name: r["count"] for r in chosen.groupBy("source_name").count().collect()} == {"a": 1535, "b": 100}
    other = m.chosen_documents(lengths, plan, "doc_id", seed=4, buckets=5)
    assert chosen.join(other, "doc_id", "left_anti").count() > 0


def test_empty_tables_and_nulls(spark):
    lengths, plan = plan_of(spark, [], [("a", 0.5, 2), (None, None, None)])
    assert {r.source_name: (r.chosen_tokens, r.unreachable) for r in m.mixing_report(plan).collect()} == {"a": (0, False), None: (0, False)}
    assert m.chosen_documents(lengths, plan, "doc_id").collect() == []
    lengths, plan = plan_of(spark, [(1, None, 4), (None, "a", 4)], [])
    assert plan.collect() == []


def test_a_listed_source_without_documents_cannot_be_reached(spark):
    _, plan = plan_of(spark, [(1, "a", 100)], [("a", 0.9, 1), ("gone", 0.1, 5)])
    assert [r.source_name for r in m.mixing_report(plan).where("unreachable").collect()] == ["gone"]


def test_token_counts(spark):
    texts = [None, "", "hello world", "naïve café 日本語", "word " * 120_000, "x" * 3_000_000, "日本語の文章" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"source": F.lit("s"), "n_tokens": F.lit(1)})
    got = {r.doc_id: r.n_tokens for r in m.stored_lengths(df, "doc_id", "source", "text").collect()}
    encode = m.encoding(m.tokenizer_path()).encode_ordinary
    assert [got[i] for i in range(len(texts))] == [0, 0, *(len(encode(t)) for t in texts[2:])]


@pytest.mark.parametrize("seed", range(20))
def test_counts_of_parts_add_up_to_the_whole(seed, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 5)
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "word", "'s", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\u00a0", "\u3000", "12", "!?", "日本", "é", "́"]) for _ in range(200))
    assert m.count_tokens(m.tokenizer_path(), text) == len(m.encoding(m.tokenizer_path()).encode_ordinary(text))


def test_what_is_proven_to_be_nearest():
    lengths, counts = np.array([6, 10]), np.array([50, 50])
    for budget, known in ((401, True), (400, True), (798, False), (900, True), (5, True)):
        taken = m.fit_budget(lengths, counts, budget, 64, 64)
        assert m.proven_nearest(lengths, counts, budget, taken, 4, 4) == known
    assert m.proven_nearest(lengths, counts, 5, m.fit_budget(lengths, counts, 5))
