"""Queries of the catalogue's own operators over the Parquet tables.

The tables hold no register of volumes, so one is derived from the ids: drive ids count up, every fifth volume mirrors
the one before it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import catalogue as fn
from lodestack.functions.text import strip
from lodestack.operators import browse, changes, search, snapshots, stats, tree, volumes
from lodestack.operators import register as entries
from lodestack.sources.tables import table

SEEN = datetime(2024, 5, 1)


def register(spark: SparkSession, d: str) -> DataFrame:
    mirror = F.col("id") % 5 == 4
    nothing = F.lit(None).cast("date")
    return table(spark, d, "volumes").select(
        F.col("id").alias("volume_id"), F.format_string("AID-%03d", "id").alias("drive_id"), mirror.cast("int").alias("is_mirror"),
        F.lit("Active").alias("status"), F.lit("Good").alias("condition"), F.lit("").alias("description"), nothing.alias("earliest_content_date"),
        nothing.alias("latest_content_date"), F.lit("USB").alias("connector"), F.to_date("created_at").alias("date_added"), nothing.alias("retired_date"),
        nothing.alias("mirror_date"), F.when(mirror, F.col("id") - 1).alias("master_volume_id"), "created_at", "updated_at",
    )


def view(spark: SparkSession, d: str) -> DataFrame:
    return volumes.volume_view(table(spark, d, "volumes"), register(spark, d))


def _search(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: search.search(table(spark, d, "files"), table(spark, d, "folders"), view(spark, d), text, **options)


def list_volumes(spark, d):
    return view(spark, d).select("id", "name", "drive_id", "is_mirror", "register_status", F.col("date_added").cast("string").alias("date_added"), "master_volume_id", "master_name", "master_drive_id", "percent_full")


def master_options(spark, d):
    return volumes.master_options(view(spark, d), 1).select("id", "drive_id", "name")


def mirror_dependents(spark, d):
    return volumes.mirror_dependents(view(spark, d)).select("id", "drive_id", "name", "master_volume_id")


def mirror_violations(spark, d):
    """Some entries are bent first, so that there is something to find."""
    v = F.col("volume_id")
    bent = register(spark, d).withColumn(
        "master_volume_id", F.when(v % 25 == 4, v).when(v % 25 == 9, 999).when(v % 25 == 14, v - 5).when(v % 25 == 19, None).otherwise(F.col("master_volume_id"))
    )
    return volumes.mirror_violations(table(spark, d, "volumes"), bent)


def next_drive_id(spark, d):
    return volumes.next_drive_id(register(spark, d))


def drive_natural_order(spark, d):
    """Drives with their place in the natural order; every seventh has a name instead of a number."""
    odd = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Shelf "), "id")).otherwise(F.col("drive_id"))
    named = view(spark, d).select("id", odd.alias("drive_id"))
    place = F.row_number().over(Window.orderBy(fn.drive_sort_key(F.col("drive_id"))))  # one row per volume
    return named.select("id", "drive_id", place.alias("place"))


def volume_filter(spark, d):
    return volumes.filter_volumes(view(spark, d), "vault usb mirror").select("id", "name", "drive_id")


def connected_volumes(spark, d):
    """Mounts are the identities of every third volume, in capitals, and one of them twice."""
    known = table(spark, d, "volumes").where("id % 3 = 0 AND identity_token <> ''")
    mounts = known.select(F.col("id").alias("ordinal"), F.concat(F.lit("/mnt/"), "id").alias("mount_root"), "identity_kind", F.upper("identity_token").alias("identity_token"))
    again = mounts.where("ordinal = 3").withColumns({"ordinal": F.lit(1000).cast("bigint"), "mount_root": F.lit("/mnt/again")})
    return volumes.connected_volumes(table(spark, d, "volumes"), mounts.unionByName(again))


def unique_names(spark, d):
    return volumes.duplicate_names(table(spark, d, "folders").select("id", "name"), "name").select("folded", "n", "first_id")


def catalogue_info(spark, d):
    return stats.catalogue_info(*[table(spark, d, n) for n in ("volumes", "folders", "files", "scan_history")])


def info_shown(spark, d):
    return stats.info_shown(catalogue_info(spark, d))


def filled_dates(spark, d):
    """Content dates found in the files, where the register has none; every third entry has a first date."""
    known = register(spark, d).withColumn("earliest_content_date", F.when(F.col("volume_id") % 3 == 0, F.lit("2001-01-01").cast("date")))
    filled = entries.fill_content_dates(known, stats.content_dates(table(spark, d, "files"), table(spark, d, "folders")))
    return filled.select("volume_id", *[F.col(c).cast("string").alias(c) for c in ("earliest_content_date", "latest_content_date")])


def content_dates(spark, d):
    dates = stats.content_dates(table(spark, d, "files"), table(spark, d, "folders"))
    return dates.select("volume_id", *[F.col(c).cast("string").alias(c) for c in ("earliest", "latest")])


def volume_counts(spark, d):
    return stats.volume_counts(table(spark, d, "volumes"), table(spark, d, "folders"), table(spark, d, "files"))


def duplicate_identities(spark, d):
    return stats.duplicate_identities(table(spark, d, "files"))


def file_type_counts(spark, d):
    return stats.type_counts(table(spark, d, "files"))


def ancestor_closure(spark, d):
    return tree.ancestor_closure(table(spark, d, "folders"))


def direct_folder_stats(spark, d):
    return tree.direct_statistics(table(spark, d, "folders"), table(spark, d, "files"))


def recursive_folder_stats(spark, d):
    return tree.folder_statistics(table(spark, d, "folders"), table(spark, d, "files"))


def prune_history(spark, d):
    return stats.prune_history(table(spark, d, "scan_history"), 3).select("id", "volume_id", "status")


def prune_errors(spark, d):
    history = table(spark, d, "scan_history")
    return stats.prune_errors(table(spark, d, "scan_errors"), history, stats.prune_history(history, 3)).select("id", "scan_id", "volume_id", "path")


def recent_history(spark, d):
    return stats.recent_history(table(spark, d, "scan_history")).select("id", "volume_id", "started_at", "status")


def recent_errors(spark, d):
    return stats.recent_errors(table(spark, d, "scan_errors"), table(spark, d, "scan_history")).select("id", "scan_id", "volume_id", "path", "started_at")


def error_counts(spark, d):
    return stats.error_counts(table(spark, d, "scan_errors"))


def last_scans(spark, d, back: int) -> DataFrame:
    """What each volume's last completed scan, or the one before it, found."""
    sequence = snapshots.completed_sequence(table(spark, d, "scan_history"))
    last = sequence.groupBy("volume_id").agg(F.max("position").alias("last"))
    wanted = sequence.join(last, "volume_id").where(F.col("position") == F.col("last") - back).select("scan_id")
    rows = table(spark, d, "file_snapshots").join(wanted, "scan_id")
    latest = snapshots.latest_reading(rows, ["scan_id", "relative_path"], "scanned_at", ["missing", "size_bytes", "modified_at"])
    return latest.where("missing <> 1")


def diff_summary(spark, d):
    return stats.has_changes(stats.change_summary(last_scans(spark, d, 1), last_scans(spark, d, 0), ["volume_id", "relative_path"], ["volume_id"]))


def folder_diff(spark, d):
    """Folders before and after a change that drops every tenth and brings every eleventh."""
    all_folders = table(spark, d, "folders")
    return stats.folder_changes(all_folders.where("id % 11 <> 0"), all_folders.where("id % 10 <> 0"), ["volume_id", "relative_path"])


def upsert_files(spark, d):
    """The files table overlaid with what the last completed scans found."""
    current = stats.one_of_each(table(spark, d, "files")).select("id", "volume_id", "relative_path", "size_bytes", "modified_at")
    return changes.upsert(current, last_scans(spark, d, 0).select("volume_id", "relative_path", "size_bytes", "modified_at"))


def finalize_files(spark, d):
    files = table(spark, d, "files")
    seen = F.when(F.col("id") % 3 == 0, fn.utc(SEEN)).otherwise(F.col("scanned_at"))
    return changes.finalize(files.withColumn("scanned_at", seen), 29, SEEN).select("id", "volume_id", "relative_path").distinct()


def delete_volume(spark, d):
    names = ("volumes", "folders", "files", "scan_history", "scan_errors")
    left = changes.delete_volume({n: table(spark, d, n) for n in names}, 29)
    counts = [left[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def update_volume(spark, d):
    return changes.update_volume(table(spark, d, "volumes"), 7, name="Seven", used_bytes=5, last_scan_at=None).select("id", "name", "used_bytes", "last_scan_at")


def list_children(spark, d):
    folders = table(spark, d, "folders")
    return browse.child_folders(folders, 29, folders.where("volume_id = 29 AND relative_path = ''").first()["id"]).select("id", "name", "relative_path", "missing")


def list_files(spark, d):
    return browse.folder_files(table(spark, d, "files"), 29, 449).select("id", "name", "relative_path")


def directory_listing(spark, d):
    return browse.directory_listing(table(spark, d, "folders"), table(spark, d, "files"), 449, "size_bytes", True)


def navigate_path(spark, d):
    folders = table(spark, d, "folders")
    deepest = folders.where("volume_id = 29").orderBy(F.length("relative_path").desc(), "id").first()
    return browse.navigate(folders, 29, deepest["relative_path"])


def file_properties(spark, d):
    names = ["item_id", "volume_id", "volume_name", "parent_id", "name", "relative_path", "extension", "size_bytes", "parent_folder_id", "parent_folder_name", "parent_relative_path"]
    return browse.item_properties("file", table(spark, d, "files"), table(spark, d, "folders"), table(spark, d, "volumes")).select(*names, "type")


def folder_properties(spark, d):
    names = ["item_id", "volume_id", "volume_name", "parent_id", "name", "relative_path", "size_bytes", "recursive_file_count", "direct_file_count", "parent_folder_name", "type"]
    return browse.item_properties("folder", table(spark, d, "files"), table(spark, d, "folders"), table(spark, d, "volumes")).select(*names)


def sizes_shown(spark, d):
    s = F.col("size_bytes")
    return table(spark, d, "files").select("id", fn.format_size(s).alias("size_text"), fn.display_size(s).alias("shown")).distinct()


def volume_shown(spark, d):
    v = view(spark, d)
    used = fn.percentage_full(F.col("used_bytes"), F.col("capacity_bytes"))
    return v.select(
        "id", used.alias("percent_full"), fn.drive_reference(F.col("drive_id"), F.col("name")).alias("reference"), fn.display_count(F.col("indexed_file_count")).alias("files"),
        fn.join_path(F.col("source_path"), F.col("source_relative_path")).alias("place"), fn.display_time(F.col("last_scan_at")).alias("last_scan"),
        fn.size_delta(F.col("free_bytes"), F.col("used_bytes")).alias("delta"),
    )


def extension_extract(spark, d):
    return table(spark, d, "files").select("id", fn.extension_of(F.col("name")).alias("ext"), fn.property_label(F.col("extension")).alias("type")).distinct()


def path_parts(spark, d):
    p = F.col("relative_path")
    shown = [fn.display_path(p).alias("shown"), fn.parent_path(p).alias("parent"), fn.last_segment(p).alias("segment"), fn.depth(p).cast("int").alias("depth")]
    return table(spark, d, "folders").select("id", *shown).distinct()


def uint64_wrap(spark, d):
    raw = (F.col("identity_inode").cast("decimal(38,0)") * 2).cast("decimal(38,0)")
    return table(spark, d, "files").select("id", fn.wrap_uint64(raw).cast("string").alias("wrapped")).distinct()


def timestamp_text(spark, d):
    return table(spark, d, "files").select("id", fn.time_text(F.col("modified_at")).alias("stored"), F.to_date("modified_at").cast("string").alias("day")).distinct()


def scan_log(spark, d):
    return stats.scan_log(table(spark, d, "scan_history"), table(spark, d, "scan_errors"))


def search_connected(spark, d):
    """Hits of a search with whether their volume is connected."""
    return search.with_connection(_search("minutes")(spark, d), connected_volumes(spark, d)).select("item_type", "item_id", "volume_id", "connected", "found_path")


def connected_checked(spark, d):
    """As ``connected_volumes``, where half of the paths exist, with what saved paths lie on: every fourth on its own drive."""
    vols = table(spark, d, "volumes")
    mounts = vols.where("id % 3 = 0").select(F.col("id").alias("ordinal"), F.concat(F.lit("/mnt/"), "id").alias("mount_root"), "identity_kind", "identity_token")
    existing = volumes.connected_volumes(vols, mounts).where("id % 2 = 0").select(F.col("found_path").alias("path"))
    captured = vols.where("id % 4 < 2").select("source_path", "identity_kind", F.when(F.col("id") % 4 == 0, F.upper("identity_token")).otherwise("other").alias("identity_token"))
    return volumes.connected_volumes(vols, mounts, existing, captured)


def item_paths(spark, d):
    """Where every file is now, if its volume is connected."""
    files = stats.one_of_each(table(spark, d, "files").select("id", "volume_id", "relative_path"))
    return volumes.physical_paths(files, connected_volumes(spark, d)).select("id", "physical_path", "available")


def volume_table(spark, d):
    return volumes.volume_table(view(spark, d), connected_volumes(spark, d))


def mount_signature(spark, d):
    """The signature of what is plugged in, as one text."""
    mounts = table(spark, d, "volumes").where("id % 3 = 0").select(F.upper("identity_kind").alias("identity_kind"), "identity_token", F.concat(F.lit("/Mnt/"), "id").alias("mount_root"))
    each = F.transform("signature", lambda m: F.concat_ws(":", m["identity_kind"], m["identity_token"], m["mount_root"]))
    return volumes.connection_signature(mounts).select(F.array_join(each, ";").alias("signature"))


def backfill_register(spark, d):
    """Every third volume had no entry."""
    filled = volumes.backfill_register(table(spark, d, "volumes"), register(spark, d).where("volume_id % 3 <> 0"))
    return filled.select("volume_id", "drive_id", "status", "is_mirror")


def create_volumes(spark, d):
    """Three volumes more, the third with a drive id of its own."""
    new = spark.createDataFrame([("  ", " /a ", " k ", "", None), ("Zed", "/z", " k ", " t ", None), ("Beta", "/b", None, None, "SHELF-1")], "name string, source_path string, identity_kind string, identity_token string, drive_id string")
    vols, reg = entries.create_volumes(table(spark, d, "volumes"), register(spark, d), new, SEEN)
    chosen = vols.select("id", "name", "source_path", "identity_kind", "identity_token", "capacity_bytes", F.col("created_at").alias("made"))
    return chosen.join(reg.select(F.col("volume_id").alias("id"), "drive_id", "is_mirror", F.col("date_added").cast("string").alias("date_added")), "id")


def upsert_register(spark, d):
    """Entries for every fourth volume, some of them mirrors, and for one that had none."""
    given = register(spark, d).where("volume_id % 4 = 0").select("volume_id", F.when(F.col("volume_id") % 8 == 0, F.col("drive_id")).alias("drive_id"), (F.col("volume_id") % 8 == 0).cast("int").alias("is_mirror"), F.lit(1).cast("bigint").alias("master_volume_id"), F.lit(" ").alias("condition"), F.lit("2020-02-02").cast("date").alias("date_added"))
    known = register(spark, d).where("volume_id <> 12")
    out = entries.upsert_register(known, given, SEEN)
    return out.select("volume_id", "drive_id", "is_mirror", "master_volume_id", "condition", F.col("date_added").cast("string").alias("date_added"), "updated_at")


def register_violations(spark, d):
    """What is wrong after dates, drive ids and masters of some entries have been bent; names that repeat are found too."""
    v, day = F.col("volume_id"), F.lit("2001-01-01").cast("date")
    bent = register(spark, d).where("volume_id <> 3").withColumns(
        {
            "drive_id": F.when(v % 10 == 1, "aid-050").when(v % 10 == 2, " ").otherwise(F.col("drive_id")),
            "retired_date": F.when(v % 7 == 0, day),
            "mirror_date": F.when(v % 9 == 0, day),
            "earliest_content_date": F.when(v % 11 == 0, F.date_add(day, 1)),
            "latest_content_date": day,
            "master_volume_id": F.when(v == 9, v).otherwise(F.col("master_volume_id")),
        }
    )
    return entries.register_violations(table(spark, d, "volumes").withColumn("name", F.when(F.col("id") < 4, "Same").otherwise(F.col("name"))), bent)


def update_location(spark, d):
    vols = changes.update_location(table(spark, d, "volumes"), 5, "  /new/place ", {"identity_kind": " uuid ", "identity_token": " ", "source_relative_path": "sub"}, SEEN)
    vols = changes.update_location(vols, 6, None, {"identity_kind": " uuid ", "identity_token": " q "}, SEEN)
    vols = changes.update_storage(vols, 7, 10, 4, 6, SEEN)
    return vols.select("id", "source_path", "identity_kind", "identity_token", "source_relative_path", "capacity_bytes", "last_scan_at", "updated_at")


def item_lookup(spark, d):
    """A file and a folder by id, a folder by its path, and a volume's root."""
    files, folders = table(spark, d, "files"), table(spark, d, "folders")
    found = {"file": browse.by_id(files, 1000), "folder": browse.by_id(folders, 449), "path": browse.folder_by_path(folders, 29, f"/{folders.where('id = 449').first()['relative_path']}/"), "root": browse.root_folder(folders, 29)}
    parts = [df.select(F.lit(kind).alias("found_by"), "id", "volume_id", "name", "relative_path") for kind, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def stats_rewrite(spark, d):
    """The folders with their statistics rebuilt."""
    names = ["recursive_size_bytes", "recursive_file_count", "recursive_subfolder_count", "direct_file_count", "direct_subfolder_count"]
    return tree.with_statistics(table(spark, d, "folders"), table(spark, d, "files"), SEEN).select("id", "missing", *names, "stats_updated_at").distinct()


def prune_history_limit(spark, d):
    """Retention with its own limit, over a history in which every scan stands fifty times."""
    many = table(spark, d, "scan_history").select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n")).withColumn("id", F.col("id") * 50 + F.col("n"))
    return stats.prune_history(many).select("id", "volume_id")


def suggested_ids(spark, d):
    label = F.when(F.col("id") % 3 == 0, F.format_string(" aid-%03d ", "id")).when(F.col("id") % 3 == 1, F.format_string("AID-%d", "id")).otherwise(F.col("name"))
    return table(spark, d, "volumes").select("id", fn.suggested_drive_id(label).alias("suggested"))


def iso_dates(spark, d):
    """Days of files written in several ways, read again."""
    at, kind = F.col("modified_at"), F.col("id") % 6
    text = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd")).when(kind == 1, F.date_format(at, " yyyyMMdd ")).when(kind == 2, F.date_format(at, "yyyy-M-d")).when(kind == 3, F.concat(F.date_format(at, "yyyy-MM"), F.lit("-31"))).when(kind == 4, " ")
    return table(spark, d, "files").select("id", fn.iso_date(text).cast("string").alias("day")).distinct()


def parsed_times(spark, d):
    """Times written as they are stored and read again; every fifth is damaged."""
    text = F.when(F.col("id") % 5 == 0, F.lit("2020-13-01T00:00:00.000000+0000")).otherwise(fn.time_text(F.col("modified_at")))
    back = F.convert_timezone(F.current_timezone(), F.lit("UTC"), fn.parse_time(text).cast("timestamp_ntz"))
    return table(spark, d, "files").select("id", back.alias("parsed")).distinct()


def in_order(df: DataFrame) -> DataFrame:
    """The rows with their ``place`` in the order that they come in: a listing's, which is shown whole."""
    return df.withColumn("__n", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("__n"))).drop("__n")


def volumes_in_order(spark, d):
    return in_order(view(spark, d)).select("place", "id")


def masters_in_order(spark, d):
    return in_order(volumes.master_options(view(spark, d))).select("place", "id")


def children_in_order(spark, d):
    folders = table(spark, d, "folders")
    return in_order(browse.child_folders(folders, 29, folders.where("volume_id = 29 AND relative_path = ''").first()["id"])).select("place", "id")


def listing_in_order(spark, d):
    """A folder's listing by size, largest first, and by name."""
    parts = [in_order(browse.directory_listing(table(spark, d, "folders"), table(spark, d, "files"), 449, c, c == "size_bytes")).select(F.lit(c).alias("sorted_by"), "place", "item_type", "item_id") for c in ("size_bytes", "name")]
    return parts[0].unionByName(parts[1])


def hits_in_order(spark, d):
    return in_order(_search("Harbour")(spark, d)).select("place", "item_type", "item_id")


def largest_items(spark, d):
    """The first of the files by size, largest first, in the order of a table's column."""
    return browse.sort_items(stats.one_of_each(table(spark, d, "files").select("id", "name", "size_bytes")), "size_bytes", True).limit(500)


def smallest_items(spark, d):
    """The first by size upwards: unknown sizes come before known ones."""
    return browse.sort_items(stats.one_of_each(table(spark, d, "files").select("id", "name", "size_bytes")), "size_bytes").limit(700)


def message_counts(spark, d):
    """Scan errors by message without case, surrounding blanks and code."""
    text = F.regexp_replace(F.lower(strip(F.col("message"))), r"\s*\(code \d+\)$", "")
    return stats.one_of_each(table(spark, d, "scan_errors")).groupBy(text.alias("message")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        list_volumes, master_options, mirror_dependents, mirror_violations, next_drive_id, drive_natural_order, volume_filter, connected_volumes, unique_names,
        catalogue_info, info_shown, filled_dates, content_dates, volume_counts, duplicate_identities, file_type_counts, ancestor_closure, direct_folder_stats, recursive_folder_stats,
        prune_history, prune_errors, recent_history, recent_errors, error_counts, diff_summary, folder_diff, upsert_files, finalize_files, delete_volume, update_volume,
        list_children, list_files, directory_listing, navigate_path, file_properties, folder_properties, sizes_shown, volume_shown, extension_extract, path_parts,
        uint64_wrap, timestamp_text, message_counts, scan_log, search_connected, connected_checked, item_paths, volume_table, mount_signature, backfill_register,
        create_volumes, upsert_register, register_violations, update_location, item_lookup, stats_rewrite, prune_history_limit, suggested_ids, iso_dates, parsed_times,
        largest_items, smallest_items, volumes_in_order, masters_in_order, children_in_order, listing_in_order, hits_in_order,
    )
    searches = {
        "search_name": _search("Harbour"),
        "search_paths": _search("camera roll", include_paths=True),
        "search_extension": _search(".jpg"),
        "search_no_extension": _search("."),
        "search_short": _search("v1"),
        "search_wildcards": _search("100%_"),
        "search_blank": _search("  "),
        "search_top": _search("report", limit=100),
    }
    return searches | {f.__name__: f for f in named}
