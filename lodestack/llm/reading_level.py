"""Reading level of every document from human grades of a few.

Documents and what they are written with form a graph: a document is linked to each of its distinct words and to
nodes for its sentence length, its share of long words and their sum. A link weighs what its node weighs (rare nodes
and nodes for shape more), and GRADED times that if its document is graded. Every node also holds a link to the mean of
all grades, which weighs PRIOR times its other links together. Graded documents are clamped to their grade; every other
document and every node takes the weighted mean of what it is linked to. The levels are the harmonic function of this
graph, the one point at which that holds everywhere.

It is reached in rounds, documents and nodes in turn, with the steps of Chebyshev's iteration, which needs only that a
round pulls two sets of scores together by 1 / (1 + PRIOR) or more. For the same reason the distance of any level from
its value at that point is at most (1 + PRIOR) / PRIOR times the largest change that one more plain round would make.
Rounds go on until this bound is as small as was asked, so their number follows from PRIOR and the precision alone, not
from the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import strip
from lodestack.session import write_once

#: Nodes up to which their scores are sent to every executor (8 bytes each); beyond, scores are joined.
BROADCAST_NODES = 1_000_000
#: Where scores are joined, those of so many of the most linked nodes are broadcast, and no other node has more than one
#: in so many of all links.
HOT_NODES = 10_000
#: How far a level may be from the fixed point.
WITHIN = 0.01
#: What the link of a node to the mean of all grades weighs against its other links.
PRIOR = 0.05
#: How many times the links of a graded document weigh those of another. Few documents are graded; with equal links their
#: grades would drown in the mean of all others.
GRADED = 100.0
#: How many times a node for the shape of a text weighs a word that is as frequent.
SHAPE = 100.0
#: Links in one packed row (a document with more has a row of its own), and for one task of a round.
PACK = 4_000_000

#: A letter; naming the common ones first is faster.
LETTER = r"[a-zA-Z\p{L}]"
#: A sentence from its first letter up to its end; stretches without a letter have none. Possessive, so that it neither
#: turns back nor nests however long a text is. Patterns count in the JVM's compiled code, unlike functions over arrays.
SENTENCE = LETTER + r"[^.!?]*+(?:[.!?](?![\s\u0085\p{Z}]|\z)[^.!?]*+)*+"


def text_words(text: Column) -> Column:
    """The words of a text (runs of letters) in lower case, in order; none of null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\p{L}]+"), "")


def readability(text: Column, words: Column) -> dict[str, Column]:
    """Words, sentences and words of more than six letters of a text with its ``text_words``; null has none."""
    held = F.coalesce(text, F.lit(""))
    # In lower case this one letter becomes a letter and a mark, which would end the word.
    counted = F.when(F.contains(held, F.lit("\u0130")), F.regexp_count(held, F.lit(LETTER + "+"))).otherwise(F.size(words))
    return {"n_words": counted, "n_sentences": F.regexp_count(held, F.lit(SENTENCE)), "n_long": F.regexp_count(held, F.lit(LETTER + "{7,}"))}


def lix() -> Column:
    """Words per sentence plus the percentage of long words; null without words."""
    return F.when(F.col("n_words") > 0, F.col("n_words") / F.greatest(F.col("n_sentences"), F.lit(1)) + F.lit(100.0) * F.col("n_long") / F.col("n_words"))


def document_nodes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, n_words, n_sentences, n_long, nodes``. A text without words has no nodes."""
    split = docs.select(doc, F.col(text).alias("__text"), text_words(F.col(text)).alias("__words"))
    counted = split.select(doc, *[c.alias(n) for n, c in readability(F.col("__text"), F.col("__words")).items()], F.array_distinct("__words").alias("nodes"))
    per_sentence = F.col("n_words") / F.greatest(F.col("n_sentences"), F.lit(1))
    long_share = F.lit(100) * F.col("n_long") / F.col("n_words")
    shape = [F.concat(F.lit(m), F.floor(c / w).cast("string")) for m, c, w in (("#sentence ", per_sentence, 3), ("#long ", long_share, 4), ("#both ", lix(), 4))]
    return counted.withColumn("nodes", F.when(F.col("n_words") > 0, F.concat("nodes", F.array(*shape))).otherwise(F.col("nodes")))


def mean_grades(grades: DataFrame, doc: str, rater: str, grade: str) -> DataFrame:
    """``doc, grade``: the mean over raters of each rater's mean; null grades count for nothing, names without case and blanks."""
    given = grades.where(F.col(grade).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc), F.lower(strip(F.col(rater))).alias("__r"), F.col(grade).cast("double").alias("grade"))
    return given.groupBy(doc, "__r").agg(F.avg("grade").alias("grade")).groupBy(doc).agg(F.avg("grade").alias("grade"))


def node_weights(linked: DataFrame, documents: int, shape: float = SHAPE, times: float = GRADED) -> DataFrame:
    """``node, n, weight, total, given`` of nodes with at least two of the documents (columns ``nodes, grade``).

    ``weight`` is log(documents / n) squared, SHAPE times that for shape; ``total`` is what the node's documents weigh and
    ``given`` the weighted sum of their grades. A node of one document only hands that document's own level back to it;
    it is left out, like a word that every document has, whose weight is 0.
    """
    each = linked.select(F.explode("nodes").alias("node"), "grade")
    graded = F.count("grade")
    counted = each.groupBy("node").agg(F.count(F.lit(1)).alias("n"), graded.alias("g"), F.coalesce(F.sum("grade"), F.lit(0.0)).alias("s")).where("n >= 2")
    idf = F.pow(F.log(F.lit(float(documents)) / F.col("n")), 2)
    weight = F.when(F.col("node").startswith("#"), F.lit(float(shape)) * idf).otherwise(idf)
    total = F.col("n") - F.col("g") + F.lit(float(times)) * F.col("g")
    return counted.select("node", "n", weight.alias("weight"), total.alias("total"), (F.lit(float(times)) * F.col("s")).alias("given")).where("weight > 0")


class Steps:
    """Chebyshev's iteration for scores whose plain round has its eigenvalues between 0 and 1 / (1 + PRIOR)."""

    def __init__(self, prior: float):
        rho = 1 / (1 + prior)
        self.gamma, self.sigma, self.omega, self.done = 2 / (2 - rho), rho / (2 - rho), 1.0, 0
        self.worst = (1 + prior) / prior

    def next(self) -> float:
        """The factor of the coming step: new = factor * (gamma * (round - score) + score - before) + before."""
        if self.done:
            self.omega = 1 / (1 - self.sigma**2 * (1 / 2 if self.done == 1 else self.omega / 4))
        self.done += 1
        return self.omega


def reading_levels(
    docs: DataFrame, doc: str, text: str, grades: DataFrame, rater: str, grade: str, *, within: float = WITHIN, prior: float = PRIOR, shape: float = SHAPE, times: float = GRADED,
    broadcast_nodes: int = BROADCAST_NODES, hot_nodes: int = HOT_NODES, most_rounds: int | None = None,
) -> DataFrame:
    """``doc, level, graded, n_words, n_sentences, n_long, lix, error_bound, converged`` of every document.

    ``level`` is the grade's scale, continuous; a graded document keeps its mean grade. It is null for a text without
    words, for one that shares no node with others, and for all where nothing is graded. Documents that no chain of links
    joins to a graded one get the mean grade. ``docs`` holds a document once. ``error_bound`` is a proven bound on the
    distance of every level of this run from the fixed point, and ``converged`` says that it is at most ``within``, which
    it is unless ``most_rounds`` ends the run early.
    """
    given = mean_grades(grades, doc, rater, grade)
    held = write_once(document_nodes(docs, doc, text).join(given, doc, "left"), "nodes")  # every text is split once
    known = held.agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean")).first()
    if known["mean"] is None:
        levels, bound = held.withColumn("level", F.lit(None).cast("double")), None
    else:
        weights = write_once(node_weights(held, max(known["n"], 1), shape, times), "weights")
        small = weights.count() <= broadcast_nodes
        run = _levels_broadcast if small else _levels_joined
        levels, bound = run(held, doc, weights, known["mean"], Steps(prior), prior, within, most_rounds, hot_nodes)
    ends = [F.lit(bound).cast("double").alias("error_bound"), F.lit(None if bound is None else bound <= within).cast("boolean").alias("converged")]
    return levels.select(doc, "level", F.col("grade").isNotNull().alias("graded"), "n_words", "n_sentences", "n_long", lix().alias("lix"), *ends)


def _levels_broadcast(held, doc, weights, mean, steps, prior, within, most_rounds, _) -> tuple[DataFrame, float]:
    """Scores lie in one array, whose length has been checked; every round is one pass over the packed links."""
    context = held.sparkSession.sparkContext
    table = weights.orderBy("node").toArrow()
    weight, total, given = (table[c].to_numpy() for c in ("weight", "total", "given"))
    names = context.broadcast((table["node"].combine_chunks(), weight))
    kept = [f for f in held.schema.fields if f.name != "nodes"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ids = pc.index_in(lists.flatten(), names.value[0])
            found = np.concatenate([[0], np.cumsum(pc.is_valid(ids).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            own = pa.ListArray.from_arrays(pa.array(found[ends], pa.int32()), ids.drop_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], own], names=[*[f.name for f in kept], "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), sizes[sizes > 0]
            if not len(sizes):
                continue
            weigh = np.add.reduceat(names.value[1][flat], np.cumsum(sizes) - sizes)
            ends = np.cumsum(sizes)
            cuts = np.unique(np.searchsorted(ends, np.arange(PACK, ends[-1] + PACK, PACK), side="left").clip(max=len(sizes) - 1) + 1)
            rows, at, link = [], 0, 0
            for cut in cuts:
                rows.append((flat[link : ends[cut - 1]].astype(np.int32).tobytes(), sizes[at:cut].tobytes(), weigh[at:cut].tobytes()))
                at, link = int(cut), int(ends[cut - 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["ids", "sizes", "weigh"])

    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    linked = write_once(held.select(*[f.name for f in kept], "nodes").mapInArrow(number, schema), "linked")
    packed = write_once(linked.where("grade IS NULL").select("ids").mapInArrow(pack, "ids binary, sizes binary, weigh binary"), "packed")
    packed = packed.coalesce(-(-int(table["n"].to_numpy().sum()) // PACK) or 1)  # a round over few links is few tasks

    def sums(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = sent.value
            out = np.zeros(len(scores))
            for batch in batches:
                for row in batch.to_pylist():
                    ids, sizes, weigh = (np.frombuffer(row[c], k) for c, k in (("ids", np.int32), ("sizes", np.int32), ("weigh", np.float64)))
                    level = np.add.reduceat(scores[ids], np.cumsum(sizes) - sizes) / weigh
                    out += np.bincount(ids, np.repeat(level, sizes), len(out))
            there = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(out[there])], names=["id", "part"])

        return run

    scores = before = np.full(len(weight), mean)
    bound = 0.0
    while len(scores):
        sent = context.broadcast(weight * scores)
        new = packed.mapInArrow(sums(sent), "id bigint, part double").groupBy("id").agg(F.sum("part").alias("part")).toArrow()
        sent.unpersist()
        plain = given + prior * mean * total
        plain[new["id"].to_numpy()] += new["part"].to_numpy()
        plain /= (1 + prior) * total
        bound = float(steps.worst * np.abs(plain - scores).max())
        if bound <= within or steps.done == most_rounds:
            break
        scores, before = steps.next() * (steps.gamma * (plain - scores) + scores - before) + before, scores
    sent = context.broadcast((weight * scores, weight))
    names_out = [f.name for f in kept]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(invalid="ignore", divide="ignore"):
                level = np.bincount(owner, sent.value[0][flat], len(sizes)) / np.bincount(owner, sent.value[1][flat], len(sizes))
            grade = batch.column("grade").to_numpy(zero_copy_only=False)
            level = pa.array(np.where(np.isnan(grade), level, grade), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], level], names=[*names_out, "level"])

    return linked.mapInArrow(last, T.StructType([*kept, T.StructField("level", T.DoubleType())])), bound


def _levels_joined(held, doc, weights, mean, steps, prior, within, most_rounds, hot_nodes) -> tuple[DataFrame, float]:
    """The same rounds as joins, for more nodes than are broadcast.

    Links lie in a written table. The scores of the most linked nodes are broadcast to their links, so that a word which
    all documents have is not brought into one task; the other scores are joined, and none of them has many links. Sums
    per node combine on the map side.
    """
    by_links = weights.orderBy(F.col("n").desc(), "node").select("node").limit(hot_nodes)
    weights = write_once(weights.join(F.broadcast(by_links.withColumn("hot", F.lit(True))), "node", "left").na.fill(False, ["hot"]), "weights")
    links = held.select(F.col(doc).alias("__doc"), "grade", F.explode("nodes").alias("node"))
    rare, often = (weights.where(F.col("hot") == h).select("node", "weight", "hot") for h in (False, True))
    links = write_once(links.join(F.broadcast(often), "node").unionByName(links.join(rare, "node")), "links")

    def level(links: DataFrame, scores: DataFrame) -> DataFrame:
        rare, often = (scores.where(F.col("hot") == h).select("node", "score") for h in (False, True))
        scored = links.where("hot").join(F.broadcast(often), "node").unionByName(links.where("NOT hot").join(rare, "node"))
        return scored.groupBy("__doc").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("level"))

    open_links = links.where("grade IS NULL")
    scores = weights.select("node", "hot", "total", "given", F.lit(float(mean)).alias("score"), F.lit(float(mean)).alias("before"))
    bound = 0.0
    while True:
        part = open_links.select("__doc", "node").join(level(open_links, scores), "__doc").groupBy("node").agg(F.sum("level").alias("part"))
        plain = (F.coalesce("part", F.lit(0.0)) + F.col("given") + F.lit(prior * mean) * F.col("total")) / (F.lit(1 + prior) * F.col("total"))
        stepped = write_once(scores.join(part, "node", "left").withColumn("plain", plain).drop("part"), "scores")
        moved = stepped.agg(F.max(F.abs(F.col("plain") - F.col("score")))).first()[0]
        bound = steps.worst * (moved or 0.0)
        if bound <= within or steps.done == most_rounds:
            break
        step = F.lit(steps.next()) * (F.lit(steps.gamma) * (F.col("plain") - F.col("score")) + F.col("score") - F.col("before")) + F.col("before")
        scores = stepped.select("node", "hot", "total", "given", step.alias("score"), F.col("score").alias("before"))
    final = level(links, scores)
    joined = held.drop("nodes").join(final, F.col(doc) == F.col("__doc"), "left").drop("__doc")
    return joined.withColumn("level", F.coalesce("grade", "level")), bound
