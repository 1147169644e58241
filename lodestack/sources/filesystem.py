"""A directory tree as a data source: one row per folder, file, or entry that could not be read.

Executors read the tree themselves, so it must be mounted at the same place on each of them.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestack.functions.catalogue import extension_of, parent_path, wrap_uint64
from lodestack.functions.catalogue import utc as instant

SCHEMA = "kind string, relative_path string, name string, size_bytes bigint, modified_at timestamp, device decimal(20,0), inode decimal(20,0), error string"


def modified(seconds: float) -> datetime | None:
    """A time that can't be represented is unknown."""
    try:
        return datetime.fromtimestamp(seconds, UTC)
    except (ValueError, OverflowError, OSError):
        return None


class Subtree(InputPartition):
    def __init__(self, start: str, deep: bool):
        self.start, self.deep = start, deep


class TreeReader(DataSourceReader):
    """Folders are divided until there are ``parts`` subtrees to read, so that a drive whose content lies in one folder is
    not one task. Only as many folders as are divided are listed for that; a folder that was divided is a part of its own."""

    def __init__(self, root: str, parts: int = 64):
        self.root, self.parts = root, parts

    def partitions(self) -> list[Subtree]:
        divided, whole = [], [""]
        while whole and len(whole) < self.parts and len(divided) < self.parts:
            path = whole.pop(0)
            divided.append(path)
            try:
                with os.scandir(os.path.join(self.root, path) if path else self.root) as entries:
                    below = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and not e.is_junction())
            except OSError:
                continue  # the part of the folder itself reports it
            whole += [f"{path}/{name}" if path else name for name in below]
        return [*[Subtree(p, False) for p in divided], *[Subtree(p, True) for p in whole]]

    def _row(self, kind: str, path: str, entry: os.stat_result) -> tuple:
        from decimal import Decimal

        size = entry.st_size if kind == "file" else None
        name = path.rpartition("/")[2] or os.path.basename(self.root.rstrip("/")) or self.root
        return kind, path, name, size, modified(entry.st_mtime), Decimal(entry.st_dev), Decimal(entry.st_ino), None

    def _failed(self, path: str, error: OSError) -> tuple:
        return "error", path, path.rpartition("/")[2], None, None, None, None, str(error)

    def read(self, partition: Subtree) -> Iterator[tuple]:
        waiting = [partition.start]
        while waiting:
            path = waiting.pop()
            place = os.path.join(self.root, path) if path else self.root
            try:
                # The root itself may be a link to the mounted tree; nothing below it is followed.
                here = os.lstat(place) if path else os.stat(place)
                if path and not stat.S_ISDIR(here.st_mode):
                    continue
                yield self._row("folder", path, here)
                with os.scandir(place) as found:
                    names = [e.name for e in found]
            except OSError as error:
                yield self._failed(path, error)
                continue
            for name in names:
                child = f"{path}/{name}" if path else name
                try:
                    entry = os.lstat(os.path.join(place, name))
                except OSError as error:
                    yield self._failed(child, error)
                    continue
                if getattr(entry, "st_file_attributes", 0) & stat.FILE_ATTRIBUTE_REPARSE_POINT:
                    continue  # a junction or the like, where there are such
                if stat.S_ISREG(entry.st_mode):
                    yield self._row("file", child, entry)
                elif stat.S_ISDIR(entry.st_mode) and partition.deep:
                    waiting.append(child)


class FileTree(DataSource):
    """``spark.read.format("file_tree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("parts", 64)))


def captured_identities(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source_path, identity_kind, identity_token`` of those of a few paths that exist on this machine: the device that
    each lies on, by its number, links resolved. What ``connected_volumes`` takes as ``captured``."""
    found = []
    for path in dict.fromkeys(paths):
        try:
            found.append((path, "filesystem-device", str(os.stat(os.path.realpath(os.path.expanduser(path), strict=True)).st_dev)))
        except OSError:
            continue
    return spark.createDataFrame(found, "source_path string, identity_kind string, identity_token string")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("parts", str(max(64, 4 * spark.sparkContext.defaultParallelism))).load(root)


def scanned_items(tree: DataFrame, volume_id: int, scanned_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders, files and errors of a tree as rows of a volume. ``parent_path`` names the folder that holds an item."""
    seen = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("modified_at").cast("timestamp_ntz")).alias("modified_at")
    own = [F.lit(volume_id).cast("bigint").alias("volume_id"), "name", "relative_path", parent_path(F.col("relative_path")).alias("parent_path")]
    rest = [seen, F.lit(0).alias("missing"), instant(scanned_at).alias("scanned_at")]
    folders = tree.where("kind = 'folder'").select(*own, *rest)
    identity = [wrap_uint64(F.col(c)).alias(f"identity_{c}") for c in ("device", "inode")]
    files = tree.where("kind = 'file'").select(*own, extension_of(F.col("name")).alias("extension"), "size_bytes", *rest, *identity)
    errors = tree.where("kind = 'error'").select(own[0], F.col("relative_path").alias("path"), F.col("error").alias("message"))
    return folders, files, errors
