"""Ranked substring search over files and folders of all volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import ascii_lower

RESULT = ["item_type", "item_id", "name", "volume_id", "drive_id", "volume_name", "relative_path", "size_bytes", "modified_at", "missing", "source_path", "identity_kind", "identity_token", "source_relative_path", "missing_rank", "match_rank"]


def search(files: DataFrame, folders: DataFrame, volumes: DataFrame, text: str, *, include_paths: bool = False, limit: int | None = None) -> DataFrame:
    """Files and folders whose name (a file's extension, and the path if asked) holds the text, without ASCII case.

    A text that starts with a dot finds files by exact extension instead. Blank finds nothing. Wildcards have no meaning.
    ``volumes`` is the small table of volumes with their drive ids (of ``volumes.volume_view``). Copies of a row count
    once; a null name or path holds nothing. Ordered by match, missing, folders first, name, then type and id.
    """
    text = text.strip()
    dotted = text.startswith(".")
    found_files = _matches(files, "file", text, include_paths, dotted)
    found_folders = _matches(folders, "folder", text, include_paths, False)
    if not text:
        found_files, found_folders = found_files.where(F.lit(False)), found_folders.where(F.lit(False))
    about = volumes.select(F.col("id").alias("volume_id"), "drive_id", F.col("name").alias("volume_name"), "source_path", "identity_kind", "identity_token", "source_relative_path")
    hits = found_files.unionByName(found_folders).dropDuplicates(["item_type", "item_id"]).join(about, "volume_id")
    missing_rank = F.when(F.col("missing") == 0, 0).otherwise(1)
    ranked = hits.withColumn("missing_rank", missing_rank).select(*RESULT)
    folder_first = F.when(F.col("item_type") == "folder", 0).otherwise(1)
    ordered = ranked.orderBy("match_rank", "missing_rank", folder_first, ascii_lower(F.col("name")).asc_nulls_first(), "item_id")
    return ordered if limit is None else ordered.limit(max(int(limit), 0))


def _matches(items: DataFrame, kind: str, text: str, include_paths: bool, dotted: bool) -> DataFrame:
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holds = lambda c: F.coalesce(F.contains(ascii_lower(F.col(c)), F.lit(low)), F.lit(False))
    columns = ["name"] + (["extension"] if kind == "file" else []) + (["relative_path"] if include_paths else [])
    if dotted:
        test: Column = F.coalesce(F.col("extension"), F.lit("")) == text[1:].lower()
        rank = F.lit(0)
    else:
        test = F.lit(False)
        for c in columns:
            test = test | holds(c)
        exact = ascii_lower(F.col("name")) == low
        part, other = (2, 4) if kind == "file" else (1, 3)
        rank = F.when(exact, 0).when(holds("name"), part).otherwise(other)
    size = "size_bytes" if kind == "file" else "recursive_size_bytes"
    return items.where(test).select(
        F.lit(kind).alias("item_type"), F.col("id").alias("item_id"), "name", "volume_id", "relative_path", F.col(size).alias("size_bytes"), "modified_at", "missing", rank.alias("match_rank")
    )


def with_connection(hits: DataFrame, connected: DataFrame) -> DataFrame:
    """Hits with whether their volume is connected and where (of ``volumes.connected_volumes``: one small row a volume)."""
    about = connected.select(F.col("id").alias("volume_id"), "connected", "found_path")
    return hits.join(about, "volume_id", "left").withColumn("connected", F.coalesce("connected", F.lit(False)))
