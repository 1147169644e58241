"""Volumes with their register entries: view, filter, numbering, checks and which are connected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.catalogue import display_count, display_time, drive_reference, drive_sequence, drive_sort_key, format_size, join_path, percentage_full
from lodestack.functions.text import ascii_lower, strip

#: Fields that the volume filter looks at.
HAYSTACK = ["drive_id", "name", "source_path", "register_status", "condition", "description", "connector", "date_added", "earliest_content_date", "latest_content_date", "retired_date", "mirror_date", "indexed_file_count", "indexed_folder_count"]


def numbered(ids: DataFrame, start: int = 0) -> DataFrame:
    """``volume_id, drive_id``: AID numbers in the order of ids after ``start``. A register of volumes is small."""
    number = F.row_number().over(Window.orderBy("volume_id")) + start
    return ids.select("volume_id", F.format_string("AID-%03d", number).alias("drive_id"))


def default_register(volumes: DataFrame, start: int = 0) -> DataFrame:
    """Register entries with the defaults for volumes (column ``id``) that have none."""
    entries = numbered(volumes.select(F.col("id").alias("volume_id")), start)
    nothing = lambda kind: F.lit(None).cast(kind)
    now = F.current_timestamp().cast("timestamp_ntz")
    return entries.select(
        "volume_id", "drive_id", F.lit(0).alias("is_mirror"), F.lit("Active").alias("status"), F.lit("Unknown").alias("condition"), F.lit("").alias("description"),
        nothing("date").alias("earliest_content_date"), nothing("date").alias("latest_content_date"), F.lit("Unknown").alias("connector"), F.current_date().alias("date_added"),
        nothing("date").alias("retired_date"), nothing("date").alias("mirror_date"), nothing("bigint").alias("master_volume_id"), now.alias("created_at"), now.alias("updated_at"),
    )


def backfill_register(volumes: DataFrame, register: DataFrame | None) -> DataFrame:
    """The register with a default entry for every volume that had none, numbered after the highest number there is."""
    if register is None:
        return default_register(volumes)
    bare = volumes.join(register.select(F.col("volume_id").alias("id")), "id", "left_anti")
    highest = next_number(register) - 1
    return register.unionByName(default_register(bare, highest))


def next_number(register: DataFrame) -> int:
    return (register.agg(F.max(drive_sequence(F.col("drive_id")))).first()[0] or 0) + 1


def next_drive_id(register: DataFrame) -> DataFrame:
    """One row with the drive id after the highest numbered one; other ids don't count."""
    return register.agg(F.format_string("AID-%03d", F.coalesce(F.max(drive_sequence(F.col("drive_id"))), F.lit(0)) + 1).alias("drive_id"))


def volume_view(volumes: DataFrame, register: DataFrame) -> DataFrame:
    """Volumes with their register entry and their master's name and drive id, by name without ASCII case, null first."""
    entry = register.withColumnRenamed("status", "register_status").drop("created_at", "updated_at")
    master = volumes.select(F.col("id").alias("master_volume_id"), F.col("name").alias("master_name"))
    master_entry = register.select(F.col("volume_id").alias("master_volume_id"), F.col("drive_id").alias("master_drive_id"))
    joined = volumes.join(entry, volumes["id"] == entry["volume_id"]).drop("volume_id")
    joined = joined.join(master, "master_volume_id", "left").join(master_entry, "master_volume_id", "left")
    return joined.withColumn("percent_full", percentage_full(F.col("used_bytes"), F.col("capacity_bytes"))).orderBy(ascii_lower(F.col("name")).asc_nulls_first(), "id")


def natural_order(view: DataFrame) -> DataFrame:
    """Numbered drives by number, then the others by letters."""
    return view.orderBy(drive_sort_key(F.col("drive_id")), "drive_id")


def mirror_dependents(view: DataFrame, volume_id: int | None = None) -> DataFrame:
    own = view.where("is_mirror = 1 AND master_volume_id IS NOT NULL")
    own = own if volume_id is None else own.where(F.col("master_volume_id") == volume_id)
    return own.orderBy(ascii_lower(F.col("drive_id")), ascii_lower(F.col("name")).asc_nulls_first())


def master_options(view: DataFrame, exclude: int | None = None) -> DataFrame:
    own = view.where("is_mirror = 0")
    own = own if exclude is None else own.where(F.col("id") != exclude)
    return own.orderBy(ascii_lower(F.col("drive_id")), ascii_lower(F.col("name")).asc_nulls_first())


def mirror_violations(volumes: DataFrame, register: DataFrame) -> DataFrame:
    """``volume_id, violation`` of mirrors whose master is none, themselves, unknown or a mirror. Chains are one step long
    by these rules, so a cycle always shows as a master that is a mirror."""
    mirrors = register.where("is_mirror = 1").select("volume_id", "master_volume_id")
    masters = volumes.select(F.col("id").alias("m")).join(register.select(F.col("volume_id").alias("m"), F.col("is_mirror").alias("master_is_mirror")), "m")
    joined = mirrors.join(masters, mirrors["master_volume_id"] == masters["m"], "left")
    wrong = (
        F.when(F.col("master_volume_id").isNull(), "no master")
        .when(F.col("master_volume_id") == F.col("volume_id"), "own master")
        .when(F.col("m").isNull(), "unknown master")
        .when(F.col("master_is_mirror") == 1, "master is a mirror")
    )
    return joined.select("volume_id", wrong.alias("violation")).where("violation IS NOT NULL")


def duplicate_names(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once without ASCII case; null never does."""
    folded = ascii_lower(F.col(column))
    return df.where(F.col(column).isNotNull()).groupBy(folded.alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def filter_volumes(view: DataFrame, text: str) -> DataFrame:
    """Volumes whose fields, the word ``mirror`` and the master's reference hold every word of the text, without case."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HAYSTACK if c in view.columns]
    fields.append(F.when(F.col("is_mirror") == 1, "mirror").otherwise(""))
    fields.append(F.when(F.col("master_volume_id").isNotNull(), drive_reference(F.col("master_drive_id"), F.col("master_name"))).otherwise(""))
    haystack = F.lower(F.concat_ws(" ", *fields))
    for term in text.lower().split():
        view = view.where(F.contains(haystack, F.lit(term)))
    return view


def connected_volumes(volumes: DataFrame, mounts: DataFrame, existing: DataFrame | None = None, captured: DataFrame | None = None) -> DataFrame:
    """Every volume with the mount it is found at and its source path there; null where it is not connected.

    Mounts (columns ``ordinal, mount_root, identity_kind, identity_token``: what is plugged in, a handful) match by kind
    and by token without case; the first in order counts. A volume without identity is found nowhere. With ``existing``
    (column ``path``: the paths that were looked for and are there) a volume whose path is not among them is not
    connected. With ``captured`` (``source_path, identity_kind, identity_token``: what saved source paths that exist lie
    on now) a volume that no mount matches is connected at its saved path if that still lies on its drive.
    """
    first = Window.partitionBy("k", "t").orderBy("ordinal")
    known = mounts.select(F.col("identity_kind").alias("k"), F.lower("identity_token").alias("t"), "mount_root", "ordinal").where("k <> '' AND t <> ''")
    known = known.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "ordinal")
    on = (volumes["identity_kind"] == known["k"]) & (F.lower(volumes["identity_token"]) == known["t"])
    path = join_path(F.col("mount_root"), F.col("source_relative_path"))
    joined = volumes.join(known, on, "left").withColumn("found_path", F.when(F.col("mount_root").isNotNull(), path))
    if existing is not None:
        there = existing.select(F.col("path").alias("found_path"), F.lit(True).alias("__there")).distinct()
        joined = joined.join(there, "found_path", "left").withColumn("found_path", F.when(F.col("__there"), F.col("found_path")))
    if captured is not None:
        saved = captured.select(F.col("source_path").alias("__saved"), F.col("identity_kind").alias("__k"), F.lower("identity_token").alias("__t")).dropDuplicates(["__saved"])
        same = (F.col("source_path") == F.col("__saved")) & (F.col("identity_kind") == F.col("__k")) & (F.lower("identity_token") == F.col("__t")) & (F.col("__k") != "") & (F.col("__t") != "")
        joined = joined.join(saved, same & F.col("mount_root").isNull(), "left").withColumn("found_path", F.coalesce("found_path", "__saved"))
    connected = F.col("found_path").isNotNull()
    return joined.select("id", F.when(connected, F.col("mount_root")).alias("mount_root"), "found_path", connected.alias("connected"))


def physical_paths(items: DataFrame, connected: DataFrame) -> DataFrame:
    """Items (``volume_id, relative_path`` and any others) with where they are now: ``physical_path, available``.

    The path is the volume's source path with the item's segments, null while the volume is not connected (``connected``
    of ``connected_volumes``, one small row a volume). Whether the item itself is there is not looked at.
    """
    about = connected.select(F.col("id").alias("volume_id"), F.col("found_path").alias("__at"))
    joined = items.join(about, "volume_id", "left")
    there = F.col("__at").isNotNull()
    return joined.withColumns({"physical_path": F.when(there, join_path(F.col("__at"), F.col("relative_path"))), "available": there}).drop("__at")


def volume_table(view: DataFrame, connected: DataFrame, zone: str = "UTC") -> DataFrame:
    """``id`` and the 22 columns of the table of volumes as text, ``-`` where there is nothing to show."""
    shown = view.join(connected.select("id", "connected"), "id", "left")
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-"))
    columns = {
        "drive_id": dash("drive_id"), "name": dash("name"), "source_path": dash("source_path"), "status": F.col("register_status"), "condition": F.col("condition"),
        "description": dash("description"), "connector": F.col("connector"), "connection": F.when(F.coalesce("connected", F.lit(False)), "Connected").otherwise("Offline"),
        "mirror": F.when(F.col("is_mirror") == 1, "Yes").otherwise("No"),
        "master_drive": F.when(F.col("master_volume_id").isNotNull(), drive_reference(F.col("master_drive_id"), F.col("master_name"))).otherwise("-"),
        "date_added": day("date_added"), "earliest_content": day("earliest_content_date"), "latest_content": day("latest_content_date"), "retired_date": day("retired_date"),
        "mirror_date": day("mirror_date"), "capacity": format_size(F.col("capacity_bytes")), "used": format_size(F.col("used_bytes")), "free": format_size(F.col("free_bytes")),
        "full": F.concat(F.col("percent_full"), F.lit("%")), "files": display_count(F.col("indexed_file_count")), "folders": display_count(F.col("indexed_folder_count")),
        "last_scan": display_time(F.col("last_scan_at"), zone),
    }
    return shown.select("id", *[c.alias(n) for n, c in columns.items()])


def connection_signature(mounts: DataFrame) -> DataFrame:
    """One row: the sorted identities that are connected, in lower case; it changes when a drive comes or goes."""
    low = [F.lower(strip(F.col(c))).alias(c) for c in ("identity_kind", "identity_token", "mount_root")]
    known = mounts.select(*low).where("identity_kind <> '' AND identity_token <> ''")
    return known.agg(F.sort_array(F.collect_list(F.struct("identity_kind", "identity_token", "mount_root"))).alias("signature"))
