"""Browsing the tree: children, files, listings, navigation and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.catalogue import property_label, type_label
from lodestack.functions.text import ascii_lower


def by_name(name: str = "name") -> list[Column]:
    """Name without ASCII case, nulls first, then id so that equal names have an order."""
    return [ascii_lower(F.col(name)).asc_nulls_first(), F.col("id")]


def by_id(df: DataFrame, id: int) -> DataFrame:
    """The row with an id, copies once; the filter is pushed to the scan."""
    return df.where(F.col("id") == id).dropDuplicates(["id"])


def child_folders(folders: DataFrame, volume_id: int, parent_id: int | None) -> DataFrame:
    """The folders right below one; a null parent gives the volume's roots. Missing ones are listed too."""
    return folders.where((F.col("volume_id") == volume_id) & F.col("parent_id").eqNullSafe(F.lit(parent_id))).orderBy(*by_name())


def folder_files(files: DataFrame, volume_id: int, folder_id: int | None) -> DataFrame:
    """The files of a folder, copies of a row once."""
    own = files.where((F.col("volume_id") == volume_id) & F.col("folder_id").eqNullSafe(F.lit(folder_id)))
    return own.dropDuplicates(["id"]).orderBy(*by_name())


def root_folder(folders: DataFrame, volume_id: int) -> DataFrame:
    return folders.where((F.col("volume_id") == volume_id) & (F.col("relative_path") == ""))


def folder_by_path(folders: DataFrame, volume_id: int, path: str) -> DataFrame:
    return folders.where((F.col("volume_id") == volume_id) & (F.col("relative_path") == path.strip("/")))


def navigate(folders: DataFrame, volume_id: int, path: str) -> DataFrame:
    """The folders on the way from the root to ``path``, with their level; a way that breaks off ends there."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    wanted = ["/".join(parts[:i]) for i in range(len(parts) + 1)]
    level = F.array_position(F.array(*map(F.lit, wanted)), F.col("relative_path")) - 1
    found = folders.where((F.col("volume_id") == volume_id) & F.col("relative_path").isin(wanted))
    return found.select("id", "name", "relative_path", level.cast("int").alias("level")).orderBy("level", "id")


LISTING = ["position", "item_type", "item_id", "name", "relative_path", "type_label", "extension", "size_bytes", "modified_at", "missing"]


def directory_listing(folders: DataFrame, files: DataFrame, folder_id: int, sort: str = "name", descending: bool = False) -> DataFrame:
    """``..`` (where there is a parent), then folders, then files, each group in the order of one column.

    Names and labels sort without case, an unknown size as -1, an unknown time first. Missing items are listed.
    """
    here = folders.where(F.col("id") == folder_id)
    up = here.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("__p")).join(folders, F.col("__p") == F.col("id"))
    item = lambda kind, group, label, ext, size, name=F.col("name"): [
        F.lit(group).alias("position"), F.lit(kind).alias("item_type"), F.col("id").alias("item_id"), name.alias("name"), F.col("relative_path"),
        label.alias("type_label"), ext.alias("extension"), size.alias("size_bytes"), F.col("modified_at"), F.col("missing"),
    ]
    nothing = F.lit(None).cast("bigint")
    parent = up.select(*item("folder", 0, F.lit("Folder"), F.lit(""), nothing, F.lit("..")))
    below = folders.where(F.col("parent_id") == folder_id).select(*item("folder", 1, F.lit("Folder"), F.lit(""), F.col("recursive_size_bytes")))
    held = files.where(F.col("folder_id") == folder_id).dropDuplicates(["id"])
    held = held.select(*item("file", 2, type_label(F.col("extension")), F.coalesce("extension", F.lit("")), F.col("size_bytes")))
    key = {"size_bytes": F.coalesce("size_bytes", F.lit(-1)), "modified_at": F.col("modified_at")}.get(sort, F.lower(F.coalesce(F.col(sort), F.lit(""))))
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return parent.unionByName(below).unionByName(held).orderBy("position", order, "item_id").select(*LISTING)


def item_properties(item_type: str, files: DataFrame, folders: DataFrame, volumes: DataFrame, item_id: int | None = None) -> DataFrame | None:
    """Every property of files or folders with their volume's and parent folder's; of one item, or of all.

    Any other item type gives None.
    """
    if item_type not in ("file", "folder"):
        return None
    items = files.dropDuplicates(["id"]) if item_type == "file" else folders
    if item_id is not None:
        items = items.where(F.col("id") == item_id)
    unknown = lambda kind: F.lit(None).cast(kind)
    own = [F.lit(item_type).alias("item_type"), F.col("id").alias("item_id"), "volume_id"]
    stats = ["recursive_file_count", "recursive_subfolder_count", "direct_file_count", "direct_subfolder_count"]
    if item_type == "file":
        rest = [F.col("folder_id").alias("parent_id"), "name", "relative_path", "extension", "size_bytes", "modified_at", "missing", "scanned_at", "identity_device", "identity_inode"]
        rest += [unknown("bigint").alias(c) for c in stats] + [unknown("timestamp_ntz").alias("stats_updated_at")]
    else:
        have = [F.col(c) if c in items.columns else unknown("bigint").alias(c) for c in stats]
        rest = ["parent_id", "name", "relative_path", F.lit("").alias("extension"), F.col("recursive_size_bytes").alias("size_bytes"), "modified_at", "missing", "scanned_at"]
        rest += [unknown("bigint").alias(c) for c in ("identity_device", "identity_inode")] + have + ["stats_updated_at"]
    about = volumes.select(F.col("id").alias("volume_id"), F.col("name").alias("volume_name"), "source_path")
    parent = folders.select(F.col("id").alias("parent_folder_id"), F.col("name").alias("parent_folder_name"), F.col("relative_path").alias("parent_relative_path"))
    joined = items.select(*own, *rest).join(about, "volume_id")
    return joined.join(parent, joined["parent_id"] == parent["parent_folder_id"], "left").withColumn("type", property_label(F.col("extension")) if item_type == "file" else F.lit("Folder"))


def sort_items(items: DataFrame, column: str, descending: bool = False, group: str | None = None, tie: str = "id") -> DataFrame:
    """A table in the order of one column, text without case and null as empty, an unknown number (a size, a count) as -1,
    an unknown time first, optionally within groups that keep their order."""
    kind = items.schema[column].dataType.simpleString()
    unknown = {"string": F.lower(F.coalesce(F.col(column), F.lit(""))), "bigint": F.coalesce(column, F.lit(-1)), "int": F.coalesce(column, F.lit(-1))}
    key = unknown.get(kind, F.col(column))
    order = [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col(tie)]
    return items.orderBy(*([F.col(group)] if group else []), *order)
