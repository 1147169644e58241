"""Mixing sources to target weights.

Every source has a budget: its share of the tokens of all documents of the listed sources, each counted once. Whole
passes over the source fill the budget as far as they go; what remains is filled with a subset of its documents, found
as a bounded knapsack over the numbers of documents by exact token length; which documents of a length are taken is
decided by a seeded hash. No source is taken more often than its cap allows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import strip
from lodestack.session import parallelism, write_once

#: Tokens that the knapsack's table reaches; a larger budget is filled in proportion to the lengths up to half of it.
TABLE = 1 << 17
#: The largest table that is tried where a smaller one misses the budget.
MOST_TABLE = 1 << 23
#: Characters after which a longer text is cut for the tokenizer, to bound its memory.
PIECE = 200_000
#: Where a text may be cut: before a blank or line break after something else. The tokenizers' pattern starts a new piece
#: there in any text, so the numbers of tokens of the parts add up to that of the whole.
CUT = re.compile(r"(?<=\S)[ \n]")


def tokenizer_path() -> str:
    """The vocabulary used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str, text: str | None) -> int:
    """Tokens of the whole text; null has none. A long text is handed over in parts, a stretch without a CUT in one."""
    if not text:
        return 0
    encode, total, at = encoding(path).encode_ordinary, 0, 0
    while at < len(text):
        found = CUT.search(text, at + PIECE)
        end = found.start() if found else len(text)
        total += len(encode(text[at:end]))
        at = end
    return total


def token_lengths(docs: DataFrame, keep: list[str], text: str, tokenizer: str | None = None) -> DataFrame:
    """``keep`` and ``n_tokens``."""
    path = tokenizer or tokenizer_path()
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(path, t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def source_key(c: Column) -> Column:
    return F.lower(strip(c))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE, most: int = MOST_TABLE) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to the budget as they can.

    Within the table the sum is the nearest that any subset has, the smaller one of two equally near. A budget beyond the
    table is first filled, up to half of a table, with the same share of every length, and the table settles the rest; if
    that misses the budget, tables up to ``most`` are tried, and the nearest sum of all is taken. ``proven_nearest`` says
    whether it is known that no other sum is nearer.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if budget >= int((lengths * counts).sum()):
        return np.where(lengths > 0, counts, 0)
    best = np.zeros(len(lengths), np.int64)
    missed = max(0, budget)
    while missed:
        taken = _fit(lengths, counts, budget, table)
        off = abs(budget - int((lengths * taken).sum()))
        best, missed = (taken, off) if off < missed else (best, missed)
        if budget <= table or table >= most:
            break
        table *= 4
    return best


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int) -> np.ndarray:
    taken, rest = np.zeros(len(lengths), np.int64), budget
    if budget > table:
        taken = np.floor(counts * ((budget - table // 2) / int((lengths * counts).sum()))).astype(np.int64)
        rest = budget - int((lengths * taken).sum())
        for i in np.argsort(-lengths):
            more = min(int(counts[i] - taken[i]), max(0, (rest - table // 2) // max(1, int(lengths[i])))) if lengths[i] else 0
            taken[i] += more
            rest -= more * int(lengths[i])
    reach, top = 1, min(2 * rest, int((lengths * (counts - taken)).sum())) + 1
    mask, via, chunks = (1 << top) - 1, np.zeros(top, np.int32), []
    for i in np.argsort(-lengths):
        left, size = int(min(counts[i] - taken[i], top // max(1, lengths[i]))), 1
        while left > 0 and lengths[i] > 0 and not (reach >> rest) & 1:
            k = min(size, left)
            fresh = (reach << (k * int(lengths[i]))) & mask & ~reach
            if fresh:
                chunks.append((i, k))
                bits = np.frombuffer(fresh.to_bytes((top + 7) // 8, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(bits, bitorder="little")[:top])] = len(chunks)
                reach |= fresh
            left, size = left - k, size * 2
    sums = np.concatenate([[0], np.flatnonzero(via)])
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, k = chunks[via[at] - 1]
        taken[i] += k
        at -= k * int(lengths[i])
    return taken


def proven_nearest(lengths: np.ndarray, counts: np.ndarray, budget: int, taken: np.ndarray, table: int = TABLE, most: int = MOST_TABLE) -> bool:
    """Whether no subset comes nearer to the budget: it is met, it lies beyond or within what was searched whole, or the
    greatest common divisor of the lengths allows no sum that is nearer."""
    reached, whole = int((lengths * taken).sum()), int((lengths * counts).sum())
    off = abs(budget - reached)
    if not off or budget >= whole or budget <= max(table, most):
        return True
    step = int(np.gcd.reduce(lengths[counts > 0]))
    return off == min(budget % step, -budget % step)


PLAN = "source_key string, source_name string, target_share double, max_repeats int, target_tokens double, budget bigint, source_tokens bigint, n_tokens bigint, documents bigint, passes int, extra bigint, exact boolean"


def mixing_plan(lengths: DataFrame, targets: DataFrame, table: int = TABLE, most: int = MOST_TABLE) -> DataFrame:
    """Per listed source and token length: whole ``passes`` and how many documents are taken once more (``extra``).

    ``lengths`` has ``source`` and ``n_tokens`` of every document. Names are compared without case and surrounding blanks;
    target rows of one name add up (the largest cap holds, a null cap is 1, a null share 0). A source without documents
    has one row with 0 documents. ``exact`` says that no choice within the cap comes nearer to the target. One task per
    source works on its numbers by length, not on documents: at most as many rows as there are different lengths.
    """
    named = targets.select(source_key(F.col("source_name")).alias("source_key"), "source_name", "target_share", "max_repeats")
    named = named.groupBy("source_key").agg(
        F.min("source_name").alias("source_name"), F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    by_length = lengths.groupBy(source_key(F.col("source")).alias("source_key"), "n_tokens").agg(F.count(F.lit(1)).alias("documents"))
    held = named.join(by_length, "source_key", "left").na.fill(0, ["n_tokens", "documents"])
    total = held.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("documents")), F.lit(0)).alias("t")).first()["t"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        share, cap = float(group["target_share"].iloc[0]), int(group["max_repeats"].iloc[0])
        lengths, counts = group["n_tokens"].to_numpy(np.int64), group["documents"].to_numpy(np.int64)
        own = int((lengths * counts).sum())
        budget = int(share * total + 0.5)
        passes = min(cap, budget // own) if own else 0
        extra, exact = np.zeros(len(group), np.int64), True
        if passes < cap and own:
            extra = fit_budget(lengths, counts, budget - passes * own, table, most)
            exact = proven_nearest(lengths, counts, budget - passes * own, extra, table, most)
        return group.assign(target_tokens=share * total, budget=budget, source_tokens=own, passes=passes, extra=extra, exact=exact)[[f.split()[0] for f in PLAN.split(", ")]]

    return held.groupBy("source_key").applyInPandas(fit, PLAN)


def mixing_report(plan: DataFrame) -> DataFrame:
    """Per source: target, tokens there, tokens chosen and the share of all chosen tokens that they are (null if none are).

    ``unreachable`` says that the choice, although it takes every document as often as the cap allows, stays below the target.
    """
    chosen = F.col("n_tokens") * (F.col("documents") * F.col("passes") + F.col("extra"))
    per = plan.groupBy("source_key", "source_name", "target_share", "max_repeats", "target_tokens", "budget", "source_tokens").agg(
        F.sum("documents").alias("documents"), F.sum(chosen).alias("chosen_tokens"), F.bool_and("exact").alias("exact")
    )
    all_chosen = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    spent = F.col("chosen_tokens") == F.col("max_repeats") * F.col("source_tokens")
    beyond = spent & (F.col("target_tokens") > F.col("chosen_tokens"))
    return per.drop("source_key").withColumns({"reached_share": F.try_divide(F.col("chosen_tokens"), all_chosen), "unreachable": beyond})


def chosen_documents(lengths: DataFrame, plan: DataFrame, doc: str, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``doc, source_name, n_tokens, times`` of the documents taken at least once.

    Of a length's documents, those with the smallest seeded hash are taken once more. They are not ranked in one task:
    they are counted by ranges of the hash, whole ranges are taken, and only the range in which the number ends is ordered.
    """
    n = buckets or max(16, parallelism(lengths.sparkSession))
    h = F.xxhash64(F.lit(seed), F.col(doc))
    docs = lengths.select(doc, source_key(F.col("source")).alias("source_key"), "n_tokens", h.alias("h")).withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(n)))
    key = ["source_key", "n_tokens", "part"]
    upto = Window.partitionBy("source_key", "n_tokens").orderBy("part")
    parts = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(upto) - F.col("c"))
    quota = F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("c"))
    parts = parts.join(plan.select("source_key", "source_name", "n_tokens", "passes", "extra"), ["source_key", "n_tokens"])
    placed = docs.join(parts.select(*key, "source_name", "passes", "c", quota.alias("quota")), key)
    cut = (F.col("quota") > 0) & (F.col("quota") < F.col("c"))
    whole = placed.where(~cut).withColumn("once_more", (F.col("quota") > 0).cast("int"))
    order = Window.partitionBy(*key).orderBy("h", doc)
    split = placed.where(cut).withColumn("once_more", (F.row_number().over(order) <= F.col("quota")).cast("int"))
    both = whole.unionByName(split).withColumn("times", F.col("passes") + F.col("once_more"))
    return both.where("times > 0").select(doc, "source_name", "n_tokens", "times")


def stored_lengths(docs: DataFrame, doc: str, source: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """``doc, source, n_tokens`` of every document, tokenized once and kept in the shared folder."""
    return write_once(token_lengths(docs.select(doc, F.col(source).alias("source"), text), [doc, "source"], text, tokenizer), "lengths")
