from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import lookalikes as look

SAME = [
    ("copy", "сору"), ("IMG_1", "ІΜG_1"), ("Depot", "Ｄｅｐｏｔ"), ("café", "café"), ("café", "саfе́"), ("a b", "a b"), ("a b", "a　b"),
    ("note", "no​te"), ("note", "﻿note"), ("note", "no­te"), ("Отчёт", "Отчёт"), ("Музыка", "Mузыкa"), ("Αρχείο", "Aρχείo"), ("パ", "ﾊﾟ"), ("#1", "＃１"),
    ("a\tb", "a b"), ("Ýa", "Ύa"), ("é", "е́"), ("ẋ", "х̇"),
    ("Quest", "Ԛuest"), ("Wave", "Ԝave"), ("Iris", "Ӏris"), ("lamp", "ӏamp"), ("Yes", "Үes"), ("yes", "үes"), ("vote", "ѵote"), ("Vote", "Ѵote"), ("Grid", "Ԍrid"), ("Jack", "Ϳack"), ("Case", "Ϲase"), ("cj", "ϲϳ"),
]
DIFFERENT = [
    ("cafe", "café"), ("Copy", "copy"), ("O", "0"), ("l", "1"), ("a b", "a  b"), ("ﬁ", "fi"), ("½", "1/2"), ("²", "2"), ("①", "1"), ("в", "b"), ("к", "k"), ("н", "h"), ("и", "u"),
    ("a-b", "a_b"), ("Отчет", "Отчёт"), ("ñ", "n"), ("x", "χ"), ("П", "Π"), ("a", "α"), ("", " "),
]


@pytest.mark.parametrize("a,b", SAME)
def test_what_looks_the_same_has_one_form(a, b):
    assert look.one_form_path(a) == look.one_form_path(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_what_looks_different_stays_different(a, b):
    assert look.one_form_path(a) != look.one_form_path(b)


@pytest.mark.parametrize("text", ["Снимок", "Отчёт", "Αρχείο", "Señal Übersicht", "naïve/Festival.jpg", "й", "日本語", "שלום", "한국어", "ελληνικά και Русский"])
def test_proper_spelling_is_its_own_form(text):
    assert look.one_form_path(text) == text


def test_the_script_that_all_letters_share_is_chosen():
    assert look.one_form("Cнимoк") == "Снимок" and look.one_form("ѕhооt").isascii() and look.one_form("Σχέδιo") == "Σχέδιο"
    assert look.one_form("Мuзыкa") == look.one_form("Muзыка")  # no script spells it: Latin wherever there is a Latin letter


def test_tokens_that_mislead():
    kinds = look.token_kinds("сору of Mузыкa, Снимок plain Ελλάδα ОС-Αb cafе́")
    assert kinds == [("сору", "whole", "copy"), ("Mузыкa", "mixed", "Музыка"), ("ОС", "whole", "OC"), ("Αb", "mixed", "Ab"), ("cafе́", "mixed", "café")]
    assert look.token_kinds("") == look.token_kinds("plain 日本語 7") == []


def test_misleading_tokens_of_rows(spark):
    df = spark.createDataFrame([(1, "сору сору"), (1, "сору сору"), (2, None), (3, ""), (4, "copy"), (None, "сору")], "id bigint, name string").withColumns({"token": F.lit(1), "r": F.lit(2)})
    got = look.misleading_tokens(df, "name", "id").collect()
    assert sorted((r.id or 0, r.token, r.kind, r.spelling) for r in got) == [(0, "сору", "whole", "copy"), (1, "сору", "whole", "copy")]


@pytest.mark.parametrize("code,shown", [(0x600, True), (0x200B, False), (0xAD, False), (0xE0101, False), (0x09, True), (0x00, False)])
def test_what_shows_nothing_is_one_list(code, shown):
    from lodestack.llm.leakage import words

    assert (look.one_form(f"a{chr(code)}b") != "ab") == shown and (words(f"a{chr(code)}b") != ["ab"]) == shown


ALPHABET = st.sampled_from("abcoeHTxyz АВеосхиня ΑΒονΣχ 019 éñ́̈​ ｅＡ０/_-.")


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=14))
def test_the_form_is_stable_and_keeps_what_can_be_seen(text):
    form = look.one_form_path(text)
    assert look.one_form_path(form) == form
    assert unicodedata.is_normalized("NFC", form)
    shown = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", t.translate(look.PLAIN)).translate(look.TO_LATIN))
    assert shown(form) == shown(text)


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=10), st.text(ALPHABET, max_size=10))
def test_equal_forms_are_equal_looks(a, b):
    shown = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", t.translate(look.PLAIN)).translate(look.TO_LATIN))
    assert (look.one_form_path(a) == look.one_form_path(b)) == (shown(a) == shown(b))


@pytest.mark.parametrize("groups", [0, 1_000_000])
def test_pairs_only_within_and_once(spark, groups, monkeypatch):
    monkeypatch.setattr(look, "BROADCAST_GROUPS", groups)
    rows = [
        (1, 10, "copy"), (2, 10, "сору"), (3, 10, "ｃopy"), (4, 11, "copy"), (5, 11, "Copy"), (2, 10, "сору"), (6, None, "copy"), (7, None, "сору"), (8, 10, None), (9, 12, ""), (None, 10, "cоpy"),
        (9, 13, "x" * 300_000 + "é"), (10, 13, "x" * 300_000 + "é"), (11, 14, "same"), (12, 14, "same"),
    ]
    df = spark.createDataFrame(rows, "id bigint, v bigint, path string").withColumns({"w": F.lit(1), "h": F.lit(2), "t": F.lit("x")})
    got = sorted(tuple(r) for r in look.lookalike_pairs(df, "v", "path", "id").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (9, 10)]
    assert sorted(tuple(r) for r in look.lookalike_classes(df, "v", "path", "id").collect()) == [(1, 1), (2, 1), (3, 1), (9, 9), (10, 9)]


def test_a_large_class_is_one_row_per_record(spark):
    df = spark.range(3000).select(F.col("id"), F.lit(1).cast("bigint").alias("v"), F.when(F.col("id") % 2 == 0, "copy").otherwise("сору").alias("path"))
    got = look.lookalike_classes(df, "v", "path", "id")
    assert got.count() == 3000 and [r.class_id for r in got.select("class_id").distinct().collect()] == [0]


def test_empty_table_and_null_text(spark):
    df = spark.createDataFrame([], "id bigint, v bigint, path string")
    assert look.lookalike_pairs(df, "v", "path", "id").collect() == [] == look.lookalike_classes(df, "v", "path", "id").collect()
    assert look.misleading_tokens(df, "path", "id").collect() == []
    one = spark.createDataFrame([(None,), ("",), ("ok",), ("е",)], "t string").select(look.canonical(F.col("t")).alias("f"))
    assert [r.f for r in one.collect()] == [None, "", "ok", "e"]


def test_a_hot_volume_of_copies(spark):
    copies = spark.range(20_000).select(F.lit(1).cast("bigint").alias("id"), F.lit(5).cast("bigint").alias("v"), F.lit("а.txt").alias("path"))
    other = spark.createDataFrame([(2, 5, "a.txt")], "id bigint, v bigint, path string")
    assert [tuple(r) for r in look.lookalike_pairs(copies.unionByName(other), "v", "path", "id").collect()] == [(1, 2)]
