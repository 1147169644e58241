"""Percentiles of very large numeric columns with a stated error, combinable over partitions, volumes and days.

The summary of a group is a buffer: sorted values with weights that add up to the group's row count. Buffers of several
parts are merged in order and collapsed to at most ``capacity`` elements of equal weight by selecting evenly spaced
positions. Nothing is random, so the same input gives the same summary. The merges form a tree of fixed height: leaves
(a group's rows are dealt to many of them by a hash of the row), their parents, and the root. A collapse to spacing w
moves a rank by less than w, and a node's error is the sum of its children's errors plus its own. Spacing is the total
divided by the capacity, rounded up, so each of the three levels adds at most twice n / capacity, about once where
nodes are much larger than the capacity. The exact bound reached comes with every percentile. A group with at most
``capacity`` rows is never collapsed and its percentiles are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import parallelism

#: Elements of a buffer.
CAPACITY = 8192


def collapse(buffers: DataFrame, node: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Merge the buffers of each node and collapse the result: ``node, value, weight, error``.

    Input and output have one row per element; ``error`` is a share of the rank error that adds up over a node's
    elements. A node of total weight W keeps, if W > capacity, the elements that cover the positions w, 2 w, 3 w, ... of
    the merged sequence and its last one, with w = ceil(W / capacity); each takes the weight of the positions since the
    one before it, so the total stays W. An element that covers several such positions is kept once for all of them.
    """
    run = Window.partitionBy(*node).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*node).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = buffers.select(
        *node, "value", "weight", F.sum("weight").over(run).alias("upto"), F.sum("weight").over(whole).alias("all"), F.sum("error").over(whole).alias("inner_error")
    )
    spacing = F.ceil(F.col("all") / F.lit(capacity))
    before = F.col("upto") - F.col("weight")
    last = F.col("upto") == F.col("all")
    step = lambda position: F.floor(position / spacing)
    taken = F.when(last, F.col("all")).otherwise(step(F.col("upto")) * spacing) - step(before) * spacing
    kept = placed.where(last | (step(F.col("upto")) > step(before)))
    own = F.when(spacing > 1, spacing).otherwise(0)
    error = F.when(last, F.col("inner_error") + own).otherwise(F.lit(0))
    return kept.select(*node, "value", taken.cast("bigint").alias("weight"), error.cast("double").alias("error"))


def leaf_buffers(rows: DataFrame, groups: list[str], value: Column, record: list[str], leaves: int, capacity: int) -> DataFrame:
    """The root buffer of every group, through leaves and their parents. Rows with a null value are left out.

    ``record`` names the columns that tell rows apart; exact copies, which agree in groups, value and record, count once.
    Copies meet on the map side. A hot group is spread over ``leaves`` tasks.
    """
    leaf = F.pmod(F.xxhash64(*record), F.lit(leaves)).cast("int")
    known = rows.select(*groups, value.alias("value"), leaf.alias("leaf"), *[F.col(c).alias(f"r_{i}") for i, c in enumerate(record)])
    once = known.where("value IS NOT NULL").groupBy(*groups, "leaf", "value", *[f"r_{i}" for i in range(len(record))]).agg(F.lit(1).cast("bigint").alias("weight"))
    low = collapse(once.withColumn("error", F.lit(0.0)), [*groups, "leaf"], capacity)
    fan = max(2, math.isqrt(leaves))
    middle = collapse(low.withColumn("leaf", F.pmod(F.col("leaf"), F.lit(fan))), [*groups, "leaf"], capacity)
    return collapse(middle, groups, capacity)


def sketch(rows: DataFrame, groups: list[str], value: Column, record: list[str], capacity: int = CAPACITY, leaves: int | None = None) -> DataFrame:
    """One buffer per group as rows ``groups, value, weight, error``; at most capacity rows a group. Store or merge it."""
    return leaf_buffers(rows, groups, value, record, leaves or max(16, 8 * parallelism(rows.sparkSession)), capacity)


def combine(buffers: DataFrame, groups: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Merge buffers into coarser groups: of volumes into the whole, of days into a month, of two deliveries into one.

    A group with very many buffers is merged through intermediate nodes, by a hash of the buffer's own value order.
    """
    leaves = max(4, parallelism(buffers.sparkSession))
    dealt = buffers.withColumn("leaf", F.pmod(F.xxhash64(*[c for c in buffers.columns if c != "error"]), F.lit(leaves)).cast("int"))
    summed = dealt.groupBy(*groups, "leaf", "value").agg(F.sum("weight").alias("weight"), F.sum("error").alias("error"))
    return collapse(collapse(summed, [*groups, "leaf"], capacity), groups, capacity)


def percentiles(buffers: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """``groups, share, value, rows, rank_error``: the value at rank ceil(share * rows), off by at most ``rank_error`` ranks."""
    run = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = buffers.select(
        *groups, "value", F.sum("weight").over(run).alias("upto"), F.col("weight"), F.sum("weight").over(whole).alias("rows"), F.sum("error").over(whole).alias("rank_error")
    )
    rank = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("rows")), F.lit(1))
    hits = F.filter(
        F.array(*[F.when((rank(q) <= F.col("upto")) & (rank(q) > F.col("upto") - F.col("weight")), F.lit(float(q))) for q in shares]), lambda q: q.isNotNull()
    )
    return placed.select(*groups, F.explode(hits).alias("share"), "value", "rows", F.ceil("rank_error").alias("rank_error"))


def outlying_groups(rows: DataFrame, pair: list[str], within: str, value: Column, record: list[str], least_rows: int = 20, times: float = 8.0, capacity: int = CAPACITY) -> DataFrame:
    """Pairs whose median is at least ``times`` the median of all rows with their ``within``.

    The pairs' buffers are the only pass over the rows; those of ``within`` are combined from them.
    """
    buffers = sketch(rows, pair, value, record, capacity)
    own = percentiles(buffers, pair, [0.5]).where(F.col("rows") >= least_rows)
    general = percentiles(combine(buffers.drop(*[c for c in pair if c != within]), [within], capacity), [within], [0.5])
    general = general.select(F.col(within).alias("w"), F.col("value").alias("general"))
    return own.join(general, own[within].eqNullSafe(general["w"])).where(F.col("value") >= F.lit(times) * F.col("general"))
