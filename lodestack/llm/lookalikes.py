"""One form for text that looks the same but differs in its characters.

Characters of full or half width become ordinary ones, characters that show nothing disappear, every kind of blank
becomes a space, and accents are composed. Letters that look alike in several scripts are settled per token: each
character stands for the set of scripts that have a letter of its shape, the sets are intersected over the token, and
the token is spelled in the script that remains, Latin first. A token whose characters agree on no script (a mix that
no script can spell) takes the Latin letter wherever there is one. Case, accents, digits, the number of blanks and
all other signs stay as they are, so what looks different stays different.

Letters count as alike where common type draws the same shape. Small Greek letters that only resemble a Latin one
(alpha, iota, kappa, rho, upsilon and the like) and Cyrillic ones drawn smaller (ve, ka, en) do not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.characters import BLANK, INVISIBLE
from lodestack.session import write_once

# Letters with the same shape as the Latin letter over them. Of two letters with one shape in a script the
# first is the one that tokens are spelled with.
LATIN_1 = "ABCEHIJKMOPSTXYaceijopsxyhqdwQWGVvIlYy"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԛԁԝԚԜԌѴѵӀӏҮү"
LATIN_2 = "ABEZHIKMNOPTYXovCcJj"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϹϲͿϳ"

SHAPE = dict(zip(CYRILLIC, LATIN_1, strict=True)) | dict(zip(GREEK, LATIN_2, strict=True))
SPELLING = {"cyrillic": dict(zip(reversed(LATIN_1), reversed(CYRILLIC), strict=True)), "greek": dict(zip(LATIN_2, GREEK, strict=True))}
TO_LATIN = str.maketrans(SHAPE)
TO_SCRIPT = {script: str.maketrans(letters) for script, letters in SPELLING.items()}

#: Groups of equal-looking texts up to which their hashes are broadcast (24 bytes each); beyond, they are joined.
BROADCAST_GROUPS = 200_000


def _plain() -> dict[int, str | None]:
    """Width, blanks and invisible characters as one table, built from the properties of the characters."""
    table: dict[int, str | None] = {}
    for code in [*range(0x3000, 0x3001), *range(0xFF00, 0xFFF0)]:
        kind, _, target = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            table[code] = "".join(chr(int(x, 16)) for x in target.split())
    return table | dict.fromkeys(BLANK, " ") | dict.fromkeys(INVISIBLE)


PLAIN = _plain()
TOKEN = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
FOREIGN = re.compile(r"[Ͱ-ԯᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟ]")


def script_of(letter: str) -> str:
    code = ord(letter)
    if 0x0370 <= code < 0x0400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x0400 <= code < 0x0530 or 0x1C80 <= code < 0x1C90 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return "cyrillic"
    return "other"


@lru_cache(maxsize=1 << 18)
def scripts_with(letter: str) -> frozenset[str]:
    """The scripts that have a letter of this shape, by the letter's Latin form if it has one."""
    if letter in SPELLING["cyrillic"] or letter in SPELLING["greek"] or (letter.isascii() and letter.isalpha()):
        return frozenset(["latin", *(s for s, letters in SPELLING.items() if letter in letters)])
    if unicodedata.name(letter, "").startswith("LATIN"):
        return frozenset(["latin"])
    return frozenset([script_of(letter)])


def spell(token: str) -> str:
    """A decomposed token in the script that all its letters share; letters of the same shape give the same result."""
    token = token.translate(TO_LATIN)
    shared: frozenset[str] | None = None
    for letter in set(token):
        if not unicodedata.combining(letter):
            own = scripts_with(letter)
            shared = own if shared is None else shared & own
    if not shared or "latin" in shared or len(shared) > 1:
        return token
    return token.translate(TO_SCRIPT[script]) if (script := next(iter(shared))) in TO_SCRIPT else token


def one_form(text: str) -> str:
    """The one form of a text."""
    if text.isascii() and text.isprintable():
        return text
    text = text.translate(PLAIN)
    if FOREIGN.search(text):
        text = TOKEN.sub(lambda m: spell(m.group()), unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


_known = lru_cache(maxsize=1 << 15)(one_form)


def one_form_path(path: str) -> str:
    """As ``one_form``; segments between slashes repeat from path to path and the short ones are kept."""
    return "/".join(_known(x) if len(x) < 256 else one_form(x) for x in path.split("/"))


@F.pandas_udf(T.StringType())
def _one_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(one_form_path, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _same_form(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, other in batches:
        yield one.map(one_form_path) == other.map(one_form_path)


def canonical(c: Column) -> Column:
    """The one form of a text column; null stays null. Printable ASCII is its own form and never leaves the JVM."""
    odd = F.when(c.rlike(r"[^\x20-\x7e]"), c)
    return F.coalesce(_one_form(odd), c)


def token_kinds(text: str) -> list[tuple[str, str, str]]:
    """(token, kind, spelling) of the tokens that mislead, each once in order.

    ``mixed``: letters of more than one of the scripts Latin, Cyrillic and Greek, so no script is common to all.
    ``whole``: all letters of one other script, but each with the shape of a Latin letter, so the whole can be read as
    Latin. The spelling is that of ``one_form``.
    """
    found: dict[str, tuple[str, str]] = {}
    for m in TOKEN.finditer(unicodedata.normalize("NFD", text.translate(PLAIN))):
        letters = {c for c in m.group() if not unicodedata.combining(c)}
        scripts = {"latin" if unicodedata.name(c, "").startswith("LATIN") else script_of(c) for c in letters} - {"other"}
        if len(scripts) > 1:
            kind = "mixed"
        elif scripts - {"latin"} and letters <= SHAPE.keys():
            kind = "whole"
        else:
            continue
        found.setdefault(unicodedata.normalize("NFC", m.group()), (kind, unicodedata.normalize("NFC", spell(m.group()))))
    return [(token, *rest) for token, rest in found.items()]


KIND = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("token", "kind", "spelling")]))


@F.pandas_udf(KIND)
def _token_kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(token_kinds, na_action="ignore")


def misleading_tokens(rows: DataFrame, text: str, record: str) -> DataFrame:
    """``record, token, kind, spelling`` of every token that mixes scripts or can be read as another script's.

    Only texts with a Greek or Cyrillic letter leave the JVM. A null text has no tokens; copies of a row count once.
    """
    foreign = F.col(text).rlike(r"[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")
    found = rows.where(foreign).select(F.col(record).alias("r"), F.explode(_token_kinds(F.col(text))).alias("k"))
    return found.select(F.col("r").alias(record), "k.token", "k.kind", "k.spelling").distinct()


def _alike(rows: DataFrame, within: str, text: str, record: str) -> DataFrame:
    """``w, h, g, t, r``: the rows of groups (a ``within`` and the form's two hashes) that hold more than one text.

    The forms are worked out once, into a table in the shared folder. Groups are found by the extremes of a hash of the
    text, which combine on the map side; only the rows of groups with several texts are brought together.
    """
    held = rows.select(F.col(within).alias("w"), F.col(text).alias("t"), F.col(record).alias("r")).dropna()
    form = held.withColumn("form", canonical(F.col("t")))
    keyed = write_once(form.select("w", F.xxhash64("form").alias("h"), F.xxhash64(F.lit(1), "form").alias("g"), "t", "r"), "forms")
    own = F.xxhash64("t")
    groups = keyed.groupBy("w", "h", "g").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least <> most").select("w", "h", "g")
    groups = write_once(groups, "groups")
    small = groups.count() <= BROADCAST_GROUPS
    return keyed.join(F.broadcast(groups) if small else groups, ["w", "h", "g"], "left_semi").distinct()


def lookalike_pairs(rows: DataFrame, within: str, text: str, record: str) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b: records with the same ``within`` whose texts differ but look the same.

    Rows with a null ``within``, text or record pair with nothing; copies of a row count once. A group holds only texts
    that look the same, however many rows ``within`` has. Of several records with the very same text in one ``within``,
    each pairs with the records of the other texts. For classes in place of pairs see ``lookalike_classes``.
    """
    alike = write_once(_alike(rows, within, text, record), "alike")
    a, b = alike.alias("a"), alike.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("w", "h", "g")]
    found = a.join(b, [*same, F.col("a.t") < F.col("b.t"), F.col("a.r") != F.col("b.r")])
    found = found.select(F.col("a.t").alias("ta"), F.col("b.t").alias("tb"), F.col("a.r").alias("ra"), F.col("b.r").alias("rb"))
    # One function of both texts, so that it runs on what the join found and not on either side of it.
    sure = found.where(_same_form("ta", "tb"))
    return sure.select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b")).distinct()


def lookalike_classes(rows: DataFrame, within: str, text: str, record: str) -> DataFrame:
    """``record, class_id``: every record that looks like another of its ``within`` but is spelled otherwise, with the
    smallest record of its class. One row per record and class, however large a class is; rules as in ``lookalike_pairs``.
    """
    alike = _alike(rows, within, text, record)
    least = alike.groupBy("w", "h", "g").agg(F.min("r").alias("class_id"))
    return alike.join(least, ["w", "h", "g"]).select(F.col("r").alias(record), "class_id").distinct()
