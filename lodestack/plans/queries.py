"""The catalogue's queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import skew, snapshots
from lodestack.plans import catalogue
from lodestack.session import shared_path
from lodestack.sources.snapshots import SnapshotStore
from lodestack.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshots.scan_changes(table(spark, d, "file_snapshots"), table(spark, d, "scan_history"))
    return changes.select("scan_id", "relative_path", "change_type")


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes and bytes per scan, from the same stream of changes."""
    changes = snapshots.scan_changes(table(spark, d, "file_snapshots"), table(spark, d, "scan_history"))
    count = lambda kind: F.sum(F.when(F.col("change_type") == kind, 1).otherwise(0)).alias(f"files_{kind}")
    return changes.groupBy("scan_id").agg(
        *map(count, ("added", "removed", "changed")),
        F.sum(F.coalesce("new_size_bytes", F.lit(0)) - F.coalesce("old_size_bytes", F.lit(0))).alias("bytes_delta"),
    )


def p4_increment(spark: SparkSession, d: str) -> DataFrame:
    """What each volume's last completed scan changed, as an increment to a store that keeps the scans before it sorted."""
    rows, sequence = table(spark, d, "file_snapshots"), snapshots.completed_sequence(table(spark, d, "scan_history"))
    last = sequence.groupBy("volume_id").agg(F.max("position").alias("last"))
    before = sequence.join(last, "volume_id").where("position < last").drop("last")
    store = SnapshotStore(spark, shared_path(spark, "snapshots"), snapshot="scan_id", group="volume_id", key="relative_path", compare=["size_bytes", "modified_at"], newest_by="scanned_at", absent="missing")
    store.add(rows, before)
    return store.add(rows, sequence).select("scan_id", "relative_path", "change_type")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    totals = skew.file_totals(table(spark, d, "files"))
    return skew.heavy_keys(totals, {"volume_id": 0.04, "folder_id": 0.01}).select("key_field", "key_id")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.file_totals(table(spark, d, "files"))


def p5_medians(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of known sizes per volume and per folder."""
    known = skew.keyed_sizes(table(spark, d, "files")).where("size_bytes >= 0")
    weighted = skew.weighted_values(known, ["key_field", "key_id"], "size_bytes")
    found = skew.exact_percentiles(weighted, ["key_field", "key_id"], "size_bytes", [0.25, 0.5, 0.75])
    return found.select("key_field", "key_id", "share", F.col("value").alias("size_bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_summary, p4_increment, p5_found, p5_totals, p5_medians)} | catalogue.queries()
