"""Statistics of the catalogue, its volumes and its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.catalogue import category, display_count, display_time, format_size, size_delta, type_label
from lodestack.operators.tree import unknown_as_zero


def one_of_each(df: DataFrame) -> DataFrame:
    """Rows by id; copies of a row count once."""
    return df.dropDuplicates(["id"])


def catalogue_info(volumes: DataFrame, folders: DataFrame, files: DataFrame, history: DataFrame) -> DataFrame:
    """One row of totals. Sums over nothing are 0; the latest scan is null where there is none.

    Sizes count hard links each. The four parts are one row each before they are put side by side.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    present = F.col("missing") == 0
    v = volumes.agg(
        F.count(F.lit(1)).alias("volume_count"), total("capacity_bytes").alias("capacity_bytes"), total("used_bytes").alias("used_bytes"),
        total("free_bytes").alias("free_bytes"), F.max("last_scan_at").alias("latest_scan_at"),
    )
    f = one_of_each(files.select("id", "missing", "size_bytes")).agg(
        F.count_if(present).alias("file_count"), total(F.when(present, unknown_as_zero())).alias("indexed_size_bytes"), F.count_if(~present).alias("missing_file_count")
    )
    d = one_of_each(folders.select("id", "missing")).agg(F.count_if(present).alias("folder_count"), F.count_if(~present).alias("missing_folder_count"))
    s = history.agg(F.count(F.lit(1)).alias("scan_count"))
    return v.crossJoin(f).crossJoin(d).crossJoin(s)  # one row each


def info_shown(info: DataFrame, zone: str = "UTC") -> DataFrame:
    """The totals of ``catalogue_info`` as they are shown: sizes with their unit, counts in groups of three digits."""
    sizes = ["used_bytes", "capacity_bytes", "free_bytes", "indexed_size_bytes"]
    counts = ["volume_count", "file_count", "folder_count", "missing_file_count", "missing_folder_count", "scan_count"]
    shown = [display_count(F.col(c)).alias(c.removesuffix("_count")) for c in counts] + [format_size(F.col(c)).alias(c.removesuffix("_bytes")) for c in sizes]
    return info.select(*shown, display_time(F.col("latest_scan_at"), zone).alias("latest_scan"))


def content_dates(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``volume_id, earliest, latest``: UTC dates of the present items' modification times."""
    dated = [x.where("missing = 0 AND modified_at IS NOT NULL").select("volume_id", F.to_date("modified_at").alias("day")) for x in (files, folders)]
    return dated[0].unionAll(dated[1]).groupBy("volume_id").agg(F.min("day").alias("earliest"), F.max("day").alias("latest"))


def volume_counts(volumes: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """``id, indexed_file_count, indexed_folder_count`` of present items; the root folder counts. 0 where there are none."""
    count = lambda x, name: one_of_each(x.where("missing = 0").select("id", "volume_id")).groupBy(F.col("volume_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    joined = volumes.select("id").join(count(files, "indexed_file_count"), "id", "left").join(count(folders, "indexed_folder_count"), "id", "left")
    return joined.na.fill(0)


def duplicate_identities(files: DataFrame) -> DataFrame:
    """Present files that share volume, device and inode: the identity, its links and its largest size."""
    known = files.where("missing = 0 AND folder_id IS NOT NULL AND identity_device IS NOT NULL AND identity_inode IS NOT NULL")
    each = one_of_each(known.select("id", "volume_id", "identity_device", "identity_inode", "size_bytes"))
    return each.groupBy("volume_id", "identity_device", "identity_inode").agg(F.count(F.lit(1)).alias("links"), F.max(unknown_as_zero()).alias("size_bytes")).where("links > 1")


def type_counts(files: DataFrame) -> DataFrame:
    """Files and bytes by type label and category."""
    each = one_of_each(files.select("id", "extension", "size_bytes")).select(type_label(F.col("extension")).alias("type_label"), category(F.col("extension")).alias("category"), "size_bytes")
    return each.groupBy("type_label", "category").agg(F.count(F.lit(1)).alias("file_count"), F.sum(unknown_as_zero()).alias("total_bytes"))


def prune_history(history: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` scans of each volume. A volume's scans are few; its newest are those with the greatest ids."""
    newest = Window.partitionBy("volume_id").orderBy(F.col("id").desc())
    return history.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max(keep, 0)).drop("__n")


def prune_errors(errors: DataFrame, history: DataFrame, kept: DataFrame) -> DataFrame:
    """Errors without those of scans that were pruned. An error without a scan stays."""
    gone = history.select("id").join(kept.select("id"), "id", "left_anti").withColumnRenamed("id", "scan_id")
    return errors.join(gone, "scan_id", "left_anti")


def recent_history(history: DataFrame, volume_id: int | None = None, limit: int = 50) -> DataFrame:
    own = history if volume_id is None else history.where(F.col("volume_id") == volume_id)
    return own.orderBy(F.col("id").desc()).limit(limit)


def recent_errors(errors: DataFrame, history: DataFrame, volume_id: int | None = None, limit: int = 200) -> DataFrame:
    """The newest errors with the start of their scan, copies of a row once."""
    own = errors if volume_id is None else errors.where(F.col("volume_id") == volume_id)
    newest = one_of_each(own).orderBy(F.col("id").desc()).limit(limit)
    starts = history.select(F.col("id").alias("scan_id"), "started_at")
    return newest.join(starts, "scan_id", "left").orderBy(F.col("id").desc())


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors by volume, copies of a row once."""
    return one_of_each(errors).groupBy("volume_id").agg(F.count(F.lit(1)).alias("errors"), F.max("created_at").alias("latest"))


CHANGES = ["files_before", "files_after", "files_added", "files_removed", "files_changed", "bytes_before", "bytes_after", "bytes_added", "bytes_removed", "changed_bytes_before", "changed_bytes_after"]


def change_summary(before: DataFrame, after: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts and bytes before and after, added, removed and changed, in one pass over the matched items.

    Items match on ``keys``; changed means another size or another modification time, null equal to null. ``by`` (some of
    the keys) gives one row per group, else one row for all, zeros where both sides are empty. Unknown sizes count as 0.
    """
    side = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}_{k}") for k in keys], unknown_as_zero().alias(f"{mark}_size"), F.col("modified_at").alias(f"{mark}_at"), F.lit(True).alias(mark))
    old, new = side(before, "p"), side(after, "n")
    same = [old[f"p_{k}"] == new[f"n_{k}"] for k in keys]
    both = old.join(new, same, "full_outer").select("*", *[F.coalesce(f"n_{k}", f"p_{k}").alias(f"k_{k}") for k in (by or [])])
    was, now = F.col("p").isNotNull(), F.col("n").isNotNull()
    changed = was & now & (~F.col("p_size").eqNullSafe(F.col("n_size")) | ~F.col("p_at").eqNullSafe(F.col("n_at")))
    count = lambda test: F.count_if(test)
    size = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("bigint")
    values = [
        count(was), count(now), count(now & ~was), count(was & ~now), count(changed), size(was, "p_size"), size(now, "n_size"),
        size(now & ~was, "n_size"), size(was & ~now, "p_size"), size(changed, "p_size"), size(changed, "n_size"),
    ]
    grouped = both.groupBy(*[F.col(f"k_{k}").alias(k) for k in (by or [])])
    return grouped.agg(*[v.alias(n) for v, n in zip(values, CHANGES, strict=True)])


def folder_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Folders before, after, added and removed; their times don't matter."""
    side = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}_{k}") for k in keys], F.lit(True).alias(mark)).distinct()
    old, new = side(before, "p"), side(after, "n")
    both = old.join(new, [old[f"p_{k}"] == new[f"n_{k}"] for k in keys], "full_outer")
    was, now = F.col("p").isNotNull(), F.col("n").isNotNull()
    return both.agg(F.count_if(was).alias("folders_before"), F.count_if(now).alias("folders_after"), F.count_if(now & ~was).alias("folders_added"), F.count_if(was & ~now).alias("folders_removed"))


def has_changes(summary: DataFrame) -> DataFrame:
    """The summary with whether anything was there before and whether any item changed; bytes don't matter."""
    folders = [c for c in ("folders_added", "folders_removed") if c in summary.columns]
    moved = sum((F.col(c) for c in ["files_added", "files_removed", "files_changed", *folders]), F.lit(0)) > 0
    earlier = [F.col(c) for c in ("files_before", "folders_before") if c in summary.columns]
    return summary.withColumns({"has_previous": sum(earlier, F.lit(0)) > 0, "has_changes": moved})


def scan_log(history: DataFrame, errors: DataFrame, zone: str = "UTC") -> DataFrame:
    """``volume_id, section, id, line_number, line``: scans and errors as lines of text; newest id first makes the log.

    A scan has a line of totals, if it was compared two of changes, and one of its message if there is one. Unknown
    folder counts are shown as 0.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in history.columns else F.lit(0)
    compared = F.col("files_added").isNotNull()
    lines = F.array(
        F.concat(display_time(F.col("started_at"), zone), F.lit(" - "), "status", F.lit(" - "), "files_seen", F.lit(" files, "), "folders_seen", F.lit(" folders, "), "errors_count", F.lit(" errors")),
        F.when(
            compared,
            F.concat(
                F.lit("  Changes: +"), "files_added", F.lit(" files, -"), count("files_removed"), F.lit(" files, "), count("files_changed"), F.lit(" changed; +"),
                count("folders_added"), F.lit(" folders, -"), count("folders_removed"), F.lit(" folders"),
            ),
        ),
        F.when(
            compared,
            F.concat(F.lit("  Indexed size: "), format_size(F.col("bytes_before")), F.lit(" -> "), format_size(F.col("bytes_after")), F.lit(" ("), size_delta(count("bytes_before"), count("bytes_after")), F.lit(")")),
        ),
        F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit("  "), "message")),
    )
    scans = history.select("volume_id", F.lit("scan").alias("section"), "id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_number", "line"))
    text = F.concat(display_time(F.col("created_at"), zone), F.lit(" - "), "path", F.lit(": "), F.coalesce("message", F.lit("")))
    failed = one_of_each(errors).select("volume_id", F.lit("error").alias("section"), "id", F.lit(0).alias("line_number"), text.alias("line"))
    return scans.unionByName(failed)
