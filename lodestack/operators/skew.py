"""Per-key results although a few keys hold most rows.

Value-frequency compression: rows are first counted per (key, value), which spreads a hot key over all tasks and
shrinks on the map side whatever repeats, and only the weighted values are brought together per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import cut_lineage


def weighted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, weight``: how often each value occurs with each key. Null keys and values count as values."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))


def key_summary(weighted: DataFrame, keys: list[str], value: str, known: Column) -> DataFrame:
    """Exact per-key rows, total, number of distinct values and mode from weighted values.

    ``known`` tells which values enter total, distinct count and mode; the others count as rows only. The mode is the
    most frequent known value, the smallest of several. All aggregates combine partially, so no task sees a whole key.
    A total over no known value is 0, distinct 0 and the mode null.
    """
    v, w = F.col(value), F.col("weight")
    rank = F.when(known, F.struct(w.alias("w"), (-v).alias("v")))
    return weighted.groupBy(*keys).agg(
        F.sum(w).alias("rows"),
        F.coalesce(F.sum(F.when(known, v * w)), F.lit(0)).cast("bigint").alias("total"),
        F.sum(F.when(known, w).otherwise(0)).alias("known_rows"),
        F.sum(F.when(known, 1).otherwise(0)).alias("distinct_values"),
        (-F.max(rank)["v"]).alias("mode"),
    )


#: Different values of a key in a class up to which they are ordered in one task; larger classes are divided further.
MOST_VALUES = 1_000_000
FIRST_BITS, MORE_BITS = 3, 10


def size_class(value: Column, level: int = 0) -> Column:
    """An order-preserving class of a non-negative 64-bit value: its power of two and the bits after the first.

    Level 0 looks at the next 3 bits (at most 512 classes), each further level at 10 more.
    """
    top = F.length(F.bin(F.greatest(value, F.lit(1).cast("bigint")))) - 1
    shift = F.greatest(top - (FIRST_BITS + MORE_BITS * level), F.lit(0))
    return F.struct(top.cast("int").alias("top"), F.call_function("shiftright", value, shift).alias("bits"))


def exact_percentiles(weighted: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact lower percentiles per key from weighted non-negative integer values: ``keys, share, value``.

    The value at share q is the smallest one with at least ``ceil(q * n)`` rows at or below it (the first for q = 0). Null
    values don't count. A key's values are not brought into one task: they are counted by class, the running count of
    the classes finds the class that holds each asked rank, and classes with many different values are divided further,
    until those of a class are few enough to be ordered.
    """
    v = F.col(value).cast("bigint")
    held = weighted.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v"), F.col("weight").alias("w"))
    named = [f"k{i}" for i in range(len(keys))]
    level, asked = 0, None
    while True:
        asked = cut_lineage(_place(held, named, level, asked, shares))  # one row per key, class and share
        most = asked.agg(F.max("values")).first()[0]
        if most is None or most <= MOST_VALUES or FIRST_BITS + MORE_BITS * level >= 62:
            break
        level += 1
    inside = _within(held, named, level, asked)
    run = F.sum("w").over(Window.partitionBy(*named, "c").orderBy("v"))
    hit = F.filter("ranks", lambda r: (r["rank"] <= F.col("run")) & (r["rank"] > F.col("run") - F.col("w")))
    found = inside.withColumn("run", run).select(*named, F.explode(hit).alias("hit"), "v")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("hit.share").alias("share"), F.col("v").cast(weighted.schema[value].dataType).alias("value"))


def _within(held: DataFrame, named: list[str], level: int, asked: DataFrame) -> DataFrame:
    """Values whose class holds an asked rank, with the ranks counted within the class."""
    ranks = asked.groupBy(*named, "c").agg(F.collect_list(F.struct("share", "rank")).alias("ranks")).alias("r")
    left = held.withColumn("c", size_class(F.col("v"), level)).alias("l")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in named] + [F.col("l.c") == F.col("r.c")]
    return left.join(ranks, same).select(*[F.col(f"l.{c}") for c in (*named, "v", "w", "c")], F.col("r.ranks"))


def _place(held: DataFrame, named: list[str], level: int, asked: DataFrame | None, shares: list[float]) -> DataFrame:
    """``key, c, share, rank, values``: the class of each asked rank, the rank within it and its number of different values."""
    if asked is None:
        part, whole, source = named, Window.partitionBy(*named), held.withColumn("outer", F.lit(0))
        wanted = lambda: F.array(*[F.struct(F.lit(float(q)).alias("share"), F.greatest(F.ceil(F.lit(q) * F.col("all")), F.lit(1)).cast("bigint").alias("rank")) for q in shares])
    else:
        source = _within(held, named, level - 1, asked).withColumnRenamed("c", "outer")
        part, whole = [*named, "outer"], Window.partitionBy(*named, "outer")
        wanted = lambda: F.col("ranks")
    counts = [F.sum("w").alias("n"), F.count(F.lit(1)).alias("values")]
    counts += [] if asked is None else [F.first("ranks").alias("ranks")]
    classes = source.groupBy(*named, "outer", size_class(F.col("v"), level).alias("c")).agg(*counts)
    classes = classes.select("*", F.sum("n").over(Window.partitionBy(*part).orderBy("c")).alias("upto"), F.sum("n").over(whole).alias("all"))
    before = F.col("upto") - F.col("n")
    inside = classes.select(*named, "c", before.alias("before"), "upto", "values", F.explode(wanted()).alias("a")).where("a.rank > before AND a.rank <= upto")
    return inside.select(*named, "c", F.col("a.share").alias("share"), (F.col("a.rank") - F.col("before")).alias("rank"), "values")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per file id; exact copies of rows collapse, on the map side where they meet.

    Rows of one id that aren't exact copies are settled to the smallest of them, so the result is defined and is a row
    that was there. A null id is one file.
    """
    smallest = F.min(F.struct("volume_id", "folder_id", "size_bytes")).alias("r")
    return files.groupBy("id").agg(smallest).select("id", "r.*")


def keyed_sizes(files: DataFrame) -> DataFrame:
    """``key_field, key_id, size_bytes`` for volume and folder of every file, and for ``all`` with a null key."""
    keys = F.array(
        *[F.struct(F.lit(k).alias("key_field"), F.col(k).cast("bigint").alias("key_id")) for k in ("volume_id", "folder_id")],
        F.struct(F.lit("all").alias("key_field"), F.lit(None).cast("bigint").alias("key_id")),
    )
    spread = distinct_files(files).select(F.explode(keys).alias("k"), "size_bytes")
    return spread.select("k.key_field", "k.key_id", "size_bytes")


def file_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per volume and per folder, with distinct sizes and the most common size.

    A null or negative size is unknown and adds nothing to the total. Files without the key stand under a null
    ``key_id``; ``key_field`` ``all`` holds the whole table.
    """
    known = F.col("size_bytes").isNotNull() & (F.col("size_bytes") >= 0)
    weighted = weighted_values(keyed_sizes(files), ["key_field", "key_id"], "size_bytes")
    return key_summary(weighted, ["key_field", "key_id"], "size_bytes", known).select(
        "key_field",
        "key_id",
        F.col("rows").alias("files"),
        F.col("total").alias("total_bytes"),
        F.col("known_rows").alias("sized_files"),
        F.col("distinct_values").alias("distinct_sizes"),
        F.col("mode").alias("common_size"),
    )


def heavy_keys(totals: DataFrame, least_share: dict[str, float]) -> DataFrame:
    """Keys holding more than their field's share of all files. A null key is none, but its files are in the total."""
    share = F.create_map(*[F.lit(x) for pair in least_share.items() for x in pair])
    fields = F.explode(F.array(*[F.lit(k) for k in least_share]))
    total = totals.where("key_field = 'all'").select(fields.alias("key_field"), F.col("files").alias("__all"))
    return (
        totals.where(F.col("key_id").isNotNull())
        .join(total, "key_field")
        .where(F.col("files") > share[F.col("key_field")] * F.col("__all"))
        .select("key_field", "key_id", "files", "total_bytes")
    )
