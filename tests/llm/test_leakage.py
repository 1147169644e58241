from __future__ import annotations

import random
import re

import pytest

from lodestack.llm import leakage as k

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
SHORT = "Where did the old tram go?"
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, item_text string"


def found(spark, docs, items, n=12):
    got = k.leaked_items(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "item_text", n)
    return sorted((tuple(r) for r in got.collect()), key=str)


DRESSED = {
    "plain": f"before {LONG} after",
    "case": LONG.upper(),
    "punctuation": LONG.replace(" ", ", -- "),
    "lines": LONG.replace(" ", "\r\n> "),
    "blanks": LONG.replace(" ", "  "),
    "invisible": LONG.replace("e", "e​").replace("t", "­t"),
    "emphasis": LONG.replace("three", "**three**").replace("five", "_five_"),
    "tags": LONG.replace(" ", "</b> <i class='x'>"),
    "entities": LONG.replace(" ", "&nbsp;"),
    "comparisons": LONG.replace("three", "< three").replace("five", "> five"),
    "twelve of them": " ".join(LONG.split()[1:13]) + " else",
}


@pytest.mark.parametrize("name", DRESSED)
def test_a_passage_is_found_however_dressed(spark, name):
    assert found(spark, [(1, DRESSED[name])], [(7, LONG)]) == [(1, 7)]


def test_eleven_words_are_too_few_and_words_must_follow(spark):
    words = LONG.split()
    assert k.words("a <b and c> d <i k='x y'>e</i> &amp; f") == ["a", "b", "and", "c", "d", "e", "f"]
    docs = [(1, " ".join(words[:11])), (2, " ".join(words[:6] + ["x"] + words[6:])), (3, SHORT), (4, "where did the old tram"), (5, "where did the old tramway go")]
    assert found(spark, docs, [(7, LONG), (8, SHORT)]) == [(3, 8)]


def test_nulls_empties_repeats_and_shared_passages(spark):
    docs = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "..."), (None, LONG), (5, LONG + " and " + LONG)]
    items = [(7, LONG), (7, LONG), (8, None), (9, ""), (10, "?!"), (11, LONG + " more"), (None, SHORT)]
    assert found(spark, docs, items) == sorted([(3, 7), (3, 11), (5, 7), (5, 11), (None, 7), (None, 11)], key=str)


def test_empty_tables(spark):
    assert found(spark, [], [(7, LONG)]) == [] and found(spark, [(1, LONG)], []) == []


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.randrange(0, 9))) for i in range(12)]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(40)] + [(99, some(5000))]
    monkeypatch.setattr(k, "BLOCK_CHARS", 40)  # several blocks
    want = set()
    for i, item in items:
        words = re.findall(r"\w+", item)
        m = min(5, len(words))
        grams = {" ".join(words[j : j + m]) for j in range(len(words) - m + 1)} if m else set()
        want |= {(d, i) for d, text in docs if any(f" {g} " in f" {text} " for g in grams)}
    assert set(found(spark, docs, items, 5)) == want


@pytest.mark.parametrize("block", [8_000_000, 50])
def test_spans_and_what_is_left_without_them(spark, block, monkeypatch):
    monkeypatch.setattr(k, "BLOCK_CHARS", block)
    text = f"Intro: {LONG}. Middle; {' '.join(LONG.split()[2:])}! End"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None), (4, SHORT)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, LONG), (8, SHORT)], ITEMS)
    args = (docs, "doc_id", "text", items, "item_id", "item_text")
    spans = sorted(tuple(r) for r in k.leaked_spans(*args).collect())
    assert spans == [(1, 7, 1, 14), (1, 7, 16, 12), (4, 8, 0, 6)]
    cleaned = {r.doc_id: (r.text, r.removed_words) for r in k.without_leaks(*args).collect()}
    assert cleaned == {1: ("Intro:  . Middle;  ! End", 26), 2: ("clean", 0), 3: (None, 0), 4: (" ?", 6)}
    report = {r.item_id: r.documents for r in k.leak_report(k.leaked_items(*args), items, "item_id").collect()}
    assert report == {7: 1, 8: 1}


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, LONG, 5, 6)], "doc_id bigint, text string, item_id int, words int")
    items = spark.createDataFrame([(7, LONG, 3)], "item_id bigint, item_text string, doc_id int")
    assert [tuple(r) for r in k.leaked_items(docs, "doc_id", "text", items, "item_id", "item_text").collect()] == [(1, 7)]
