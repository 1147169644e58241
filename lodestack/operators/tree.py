"""Folder trees: ancestors, and recursive statistics with hard links counted once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.catalogue import utc
from lodestack.session import cut_lineage


def unknown_as_zero(size: str = "size_bytes"):
    return F.when(F.col(size) > 0, F.col(size)).otherwise(F.lit(0)).cast("bigint")


def ancestor_closure(folders: DataFrame) -> DataFrame:
    """``descendant, ancestor, steps`` for every present folder and each folder above it, itself included (steps 0).

    The chain follows ``parent_id`` and ends at a folder that is missing, unknown, or met again (a cycle). The reach is
    doubled each time: pairs of exactly that many steps are joined with all pairs so far, so a tree of depth d takes
    log2(d) joins. What each join adds is written to the shared folder, so no join is worked out twice.
    """
    present = folders.where("missing = 0").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).dropDuplicates(["child"])
    own = present.select(F.col("child").alias("descendant"), F.col("child").alias("ancestor"), F.lit(0).alias("steps"))
    known = present.select(F.col("child").alias("known"))
    edges = present.join(known, present["parent"] == known["known"], "left_semi").where("child <> parent")
    pairs = cut_lineage(edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    parts, reach = [pairs], 1
    while True:
        far = parts[-1].where(F.col("steps") == reach).select("descendant", F.col("ancestor").alias("__via"))
        if far.isEmpty():
            break
        pairs = reduce(DataFrame.unionByName, parts)
        on = pairs.select(F.col("descendant").alias("__via"), "ancestor", (F.col("steps") + reach).alias("steps"))
        # Only in a cycle is an ancestor met again; its first place counts, and everything after it has been met too.
        further = far.join(on, "__via").groupBy("descendant", "ancestor").agg(F.min("steps").alias("steps")).where("descendant <> ancestor")
        parts.append(cut_lineage(further.join(pairs.select("descendant", "ancestor"), ["descendant", "ancestor"], "left_anti")))
        reach *= 2
    return reduce(DataFrame.unionByName, [own, *parts])


def direct_statistics(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``folder_id, direct_file_count, direct_size, direct_subfolder_count`` of present folders. Unknown sizes add 0."""
    present = folders.where("missing = 0").select(F.col("id").alias("folder_id"), "parent_id").dropDuplicates(["folder_id"])
    held = present_files(files).where("folder_id IS NOT NULL").groupBy("folder_id").agg(
        F.count(F.lit(1)).alias("direct_file_count"), F.sum(unknown_as_zero()).alias("direct_size")
    )
    below = present.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("folder_id")).agg(F.count(F.lit(1)).alias("direct_subfolder_count"))
    joined = present.select("folder_id").join(held, "folder_id", "left").join(below, "folder_id", "left")
    return joined.na.fill(0, ["direct_file_count", "direct_size", "direct_subfolder_count"])


def present_files(files: DataFrame) -> DataFrame:
    """Present files, copies of a row once, with the columns that statistics use."""
    used = ["id", "volume_id", "folder_id", "size_bytes", "identity_device", "identity_inode"]
    return files.where("missing = 0").select(*used).dropDuplicates(["id"])


def linked_excess(files: DataFrame, closure: DataFrame) -> DataFrame:
    """``folder_id, excess``: bytes that recursive sizes hold too much because hard links were counted each.

    Per folder and identity (volume, device, inode) with n > 1 links below it: (n - 1) times the identity's largest size.
    Links are counted per folder before they meet per identity, so a file linked very often stays small.
    """
    identity = ["volume_id", "identity_device", "identity_inode"]
    linked = present_files(files).where("folder_id IS NOT NULL AND identity_device IS NOT NULL AND identity_inode IS NOT NULL")
    per_folder = linked.groupBy(*identity, "folder_id").agg(F.count(F.lit(1)).alias("n"), F.max(unknown_as_zero()).alias("size"))
    per_identity = Window.partitionBy(*identity)
    several = per_folder.select("*", F.sum("n").over(per_identity).alias("links"), F.max("size").over(per_identity).alias("largest")).where("links > 1")
    above = several.join(closure, several["folder_id"] == closure["descendant"]).groupBy("ancestor", *identity).agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
    excess = F.sum((F.col("n") - 1) * F.col("largest"))
    return above.where("n > 1").groupBy(F.col("ancestor").alias("folder_id")).agg(excess.cast("bigint").alias("excess"))


def folder_statistics(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Direct and recursive counts and sizes of every present folder; recursive sizes count hard links once."""
    closure = ancestor_closure(folders)
    direct = direct_statistics(folders, files)
    summed = closure.join(direct, closure["descendant"] == direct["folder_id"]).groupBy("ancestor").agg(
        F.sum("direct_size").alias("size"), F.sum("direct_file_count").alias("recursive_file_count"), F.sum("direct_subfolder_count").alias("recursive_subfolder_count")
    )
    excess = linked_excess(files, closure)
    out = direct.join(summed, direct["folder_id"] == summed["ancestor"]).join(excess, "folder_id", "left")
    size = (F.col("size") - F.coalesce("excess", F.lit(0))).cast("bigint")
    return out.select("folder_id", size.alias("recursive_size_bytes"), "recursive_file_count", "recursive_subfolder_count", "direct_file_count", "direct_subfolder_count", "direct_size")


def with_statistics(folders: DataFrame, files: DataFrame, updated_at) -> DataFrame:
    """The folders table with its statistics rebuilt; those of missing folders become unknown."""
    names = ["recursive_size_bytes", "recursive_file_count", "recursive_subfolder_count", "direct_file_count", "direct_subfolder_count"]
    fresh = folder_statistics(folders, files).select(F.col("folder_id").alias("id"), *names)
    kept = folders.drop(*names, "stats_updated_at")
    at = F.when(F.col("direct_file_count").isNotNull(), utc(updated_at))
    return kept.join(fresh, "id", "left").withColumn("stats_updated_at", at)
