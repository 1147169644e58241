"""Evaluation texts that leaked into a corpus.

The test items' word windows (n words, or the whole item where it is shorter) are hashed once and broadcast; every
document is scanned window by window against that set, and each hit is verified word by word, so no hash collision
counts. The items are a stated query set: they are broadcast in blocks of bounded size, one pass over the corpus each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.characters import INVISIBLE, as_class
from lodestack.session import write_once

#: Characters of item text in one broadcast block.
BLOCK_CHARS = 4_000_000

NOTHING = as_class(INVISIBLE)
WORD = re.compile(rf"(?:[^\W_]|[\u0300-\u036f{NOTHING}])+")
UNSEEN = re.compile(rf"[{NOTHING}]+")
#: Markup as it is read: tags with a name of up to 16 letters and digits, entities of up to 8 letters. Longer ones are words.
MARKUP = re.compile(
    r"""</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*\s*/?>"""
    r"|&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _open(text: str) -> str:
    """The text with markup replaced by as many blanks, so places stay what they are."""
    return MARKUP.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text


def _word(raw: str) -> str:
    """The word as it is compared; empty where a run shows nothing."""
    if raw.isascii():
        return UNSEEN.sub("", raw).lower()
    return unicodedata.normalize("NFC", UNSEEN.sub("", raw)).lower()


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, without case and invisible characters."""
    if not text:
        return []
    text = _open(text)
    if text.isascii() and not UNSEEN.search(text):
        return WORD.findall(text.lower())
    return [w for w in map(_word, WORD.findall(text)) if w]


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end of each of ``words(text)`` in the text."""
    return [m.span() for m in WORD.finditer(_open(text)) if _word(m.group())]


class WindowSet:
    """The windows of a block of items: per window length their hashes in order, with item and place beside them."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for key, text in items:
            codes = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.int64)
            if not len(codes):
                continue
            length = min(n, len(codes))
            places = np.arange(len(codes) - length + 1)
            parts[length].append((self.hashes(codes, places, length), np.full(len(places), len(self.items)), places))
            self.items.append((key, codes))
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for length, own in parts.items():
            h, item, place = map(np.concatenate, zip(*own, strict=True))
            order = np.argsort(h, kind="stable")
            self.windows[length] = h[order], item[order], place[order]

    @staticmethod
    def hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                h = h * FACTOR + codes[starts + k].astype(np.uint64)
        return h

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, length) of every verified window in a sequence of codes; 0 is a word of no item."""
        known = np.concatenate([[0], np.cumsum(codes == 0)])
        for length, (hashes, items, places) in self.windows.items():
            if len(codes) < length:
                continue
            starts = np.flatnonzero(known[length:] == known[:-length])
            h = self.hashes(codes, starts, length)
            low, high = (np.searchsorted(hashes, h, side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low):
                window = codes[starts[i] : starts[i] + length]
                for j in range(low[i], high[i]):
                    item, place = int(items[j]), int(places[j])
                    if np.array_equal(self.items[item][1][place : place + length], window):
                        yield item, int(starts[i]), length

    def spans(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(index of text, item, first word, words): windows of an item that touch or overlap in a text are one span."""
        per_text = [words(t) for t in texts]
        get = self.ids.get
        flat = np.fromiter((get(w, 0) for w in chain.from_iterable((*ws, "") for ws in per_text)), np.int64)
        ends = np.cumsum([len(ws) + 1 for ws in per_text])
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for item, start, length in self.hits(flat):
            index = int(np.searchsorted(ends, start, side="right"))
            first = start - (int(ends[index - 1]) if index else 0)
            found[index, item].append((first, first + length))
        for (index, item), windows in sorted(found.items()):
            windows.sort()
            first, last = windows[0]
            for a, b in windows[1:]:
                if a > last:
                    yield index, item, first, last - first
                    first, last = a, b
                else:
                    last = max(last, b)
            yield index, item, first, last - first


def _block_count(items: DataFrame, text: str) -> int:
    return max(1, -(-(items.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS))


def _blocks(items: DataFrame, item: str, text: str, n: int, count: int) -> Iterator[WindowSet]:
    for b in range(count):
        block = items.where(F.pmod(F.xxhash64(item, text), F.lit(count)) == b) if count > 1 else items
        yield WindowSet([(r[0], r[1]) for r in block.select(item, text).collect()], n)


def leaked_spans(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 12) -> DataFrame:
    """``doc, item, first_word, words``: where n consecutive words of an item, or a whole shorter item, occur.

    ``first_word`` counts from 0. A null or empty text holds nothing and an item without words occurs nowhere. Several
    rows of one item id are parts of one item. Only the two named columns of ``docs`` are read.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [T.StructField(doc, docs.schema[doc].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())]
    )
    item_type = pa.int64() if isinstance(items.schema[item].dataType, T.LongType) else None

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                found = list(known.spans(batch.column(1).to_pylist()))
                if found:
                    rows, which, first, length = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([known.items[i][0] for i in which], item_type), pa.array(first, pa.int64()), pa.array(length, pa.int64())],
                        names=schema.names,
                    )

        return run

    narrow = docs.where(F.col(text).isNotNull()).select(doc, text)
    count, parts = _block_count(items, item_text), []
    for block in _blocks(items, item, item_text, n, count):
        sent = spark.sparkContext.broadcast(block)
        found = narrow.mapInArrow(scan(sent), schema)
        if count > 1:
            # One block at a time is on the driver and the executors; what it found is written before the next is made.
            found = write_once(found, "spans")
            sent.destroy()
        parts.append(found)
    return reduce(DataFrame.unionByName, parts).distinct()


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 12) -> DataFrame:
    """``doc, item``: each item that occurs in each document, once."""
    return leaked_spans(docs, doc, text, items, item, item_text, n).select(doc, item).distinct()


def without_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 12) -> DataFrame:
    """The documents with every leaked span cut out, as ``doc, text, removed_words``.

    Spans are removed from the first to the last character of their words and replaced by one blank; a text without spans
    stays as it is, and removed_words is 0. Null stays null.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField(text, T.StringType()), T.StructField("removed_words", T.LongType())])
    if _block_count(items, item_text) == 1:
        block = spark.sparkContext.broadcast(next(_blocks(items, item, item_text, n, 1)))

        def cut(batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
            return ((index, first, length) for index, _, first, length in block.value.spans(texts))

        source = docs.select(doc, text)
    else:
        # Several blocks are not held at once: their spans are found block by block and brought to their document.
        found = leaked_spans(docs, doc, text, items, item, item_text, n)
        spans = found.groupBy(F.col(doc).alias("__d")).agg(F.collect_set(F.struct("first_word", "words")).alias("__spans"))

        def cut(batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
            return ((i, s["first_word"], s["words"]) for i, own in enumerate(batch.column(2).to_pylist()) for s in own or ())

        source = docs.select(doc, text).join(spans, F.col(doc).eqNullSafe(F.col("__d")), "left").select(doc, text, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            gone: dict[int, set[int]] = defaultdict(set)
            for index, first, length in cut(batch, texts):
                gone[index].update(range(first, first + length))
            for index, words_of in gone.items():
                if texts[index] is not None:
                    texts[index] = _without(texts[index], words_of)
            removed = [len(gone[i]) if i in gone else 0 for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _without(text: str, gone: set[int]) -> str:
    places, kept, at = word_places(text), [], 0
    order = sorted(gone)
    for i, w in enumerate(order):
        if not i or order[i - 1] != w - 1:
            kept.append(text[at : places[w][0]])
        at = places[w][1]
    return " ".join([*kept, text[at:]]) if order else text


def leak_report(leaks: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Every item with the number of documents that it occurs in, 0 included."""
    counted: Column = F.count("__doc").alias("documents")
    named = leaks.select(F.col(item), F.lit(1).alias("__doc"))
    return items.select(item).distinct().join(named, item, "left").groupBy(item).agg(counted)
