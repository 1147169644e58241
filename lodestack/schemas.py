"""Schemas of the catalogue's tables, their check, and migrations of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.errors import InvalidCatalogue, UnsupportedCatalogue

VERSION = 9

# The tables' columns and types; a star marks those that hold no null.
COLUMNS = {
    "volumes": "id* bigint, name string, source_path* string, identity_kind* string, identity_token* string, identity_label* string, identity_serial* string, identity_filesystem* string, source_relative_path* string, capacity_bytes* bigint, used_bytes* bigint, free_bytes* bigint, indexed_file_count* bigint, indexed_folder_count* bigint, last_scan_at timestamp_ntz, created_at* timestamp_ntz, updated_at* timestamp_ntz",
    "volume_register": "volume_id* bigint, drive_id* string, is_mirror* int, status* string, condition* string, description* string, earliest_content_date date, latest_content_date date, connector* string, date_added* date, retired_date date, mirror_date date, master_volume_id bigint, created_at* timestamp_ntz, updated_at* timestamp_ntz",
    "folders": "id* bigint, volume_id* bigint, parent_id bigint, name* string, relative_path* string, missing* int, scanned_at timestamp_ntz, modified_at timestamp_ntz, recursive_size_bytes bigint, recursive_file_count bigint, recursive_subfolder_count bigint, direct_file_count bigint, direct_subfolder_count bigint, stats_updated_at timestamp_ntz",
    "files": "id* bigint, volume_id* bigint, folder_id bigint, name* string, relative_path* string, extension* string, size_bytes* bigint, modified_at timestamp_ntz, missing* int, scanned_at timestamp_ntz, identity_device bigint, identity_inode bigint",
    "scan_history": "id* bigint, volume_id* bigint, started_at* timestamp_ntz, finished_at timestamp_ntz, status* string, files_seen* bigint, folders_seen* bigint, errors_count* bigint, message string, files_added bigint, files_removed bigint, files_changed bigint, folders_added bigint, folders_removed bigint, bytes_before bigint, bytes_after bigint",
    "scan_errors": "id* bigint, scan_id bigint, volume_id* bigint, path* string, message* string, created_at* timestamp_ntz",
}


def schema(name: str) -> T.StructType:
    """The table's schema; every column is nullable as Parquet reads it."""
    return T.StructType.fromDDL(COLUMNS[name].replace("*", ""))


def required(name: str) -> list[str]:
    """Columns that hold no null."""
    return [c.split()[0][:-1] for c in COLUMNS[name].split(", ") if c.split()[0].endswith("*")]


def validate_schema(tables: dict[str, DataFrame]) -> None:
    """All tables are there with all their columns; more columns are allowed. Types must be the same."""
    absent = sorted(set(COLUMNS) - set(tables))
    if absent:
        raise InvalidCatalogue(f"tables missing: {', '.join(absent)}")
    for name, df in tables.items():
        if name not in COLUMNS:
            continue
        have = {f.name: f.dataType for f in df.schema}
        lost = [f.name for f in schema(name) if f.name not in have]
        if lost:
            raise InvalidCatalogue(f"{name}: columns missing: {', '.join(lost)}")
        other = [f.name for f in schema(name) if have[f.name] != f.dataType]
        if other:
            raise InvalidCatalogue(f"{name}: other types: {', '.join(other)}")


def null_violations(name: str, df: DataFrame) -> DataFrame:
    """``column, violations`` of the columns that must hold no null, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required(name)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in required(name)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*").where("violations > 0")


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version in the present schema.

    Columns that came later are null, which means unknown (folder statistics stay unknown until they are rebuilt), or
    their default where null isn't allowed. Blank volume names become null, and volumes without a register entry get the
    next drive numbers in the order of their ids.
    """
    if version > VERSION:
        raise UnsupportedCatalogue(f"catalogue version {version} is newer than {VERSION}")
    defaults = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint"), "int": F.lit(0)}
    out = {}
    for name in COLUMNS:
        df = tables.get(name)
        if df is None:
            if name != "volume_register":
                raise InvalidCatalogue(f"tables missing: {name}")
            continue
        for f in schema(name):
            if f.name not in df.columns:
                kind = f.dataType.simpleString()
                fill = defaults.get(kind, F.lit(None)) if f.name in required(name) else F.lit(None)
                df = df.withColumn(f.name, fill.cast(f.dataType))
        out[name] = df.select(*[F.col(f.name) for f in schema(name)])
    if version < 4:
        out["volumes"] = out["volumes"].withColumn("name", F.nullif("name", F.lit("")))
    if version < 3 or "volume_register" not in out:
        from lodestack.operators.volumes import backfill_register

        out["volume_register"] = backfill_register(out["volumes"], out.get("volume_register"))
    return out
