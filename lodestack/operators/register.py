"""The register of volumes: new volumes, entries that are added or changed, and what must hold of them.

A register has one small row per volume. States and conditions are free text; only what relates rows or dates is checked.
"""

from __future__ import annotations

import os
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.errors import InvalidCatalogue
from lodestack.functions.catalogue import utc
from lodestack.functions.text import ascii_lower, strip
from lodestack.operators.volumes import mirror_violations, next_number

LOCATION = ["identity_kind", "identity_token", "identity_label", "identity_serial", "identity_filesystem", "source_relative_path"]


def clean_path(path: str | None) -> str:
    """A source path without surrounding blanks, the home folder spelled out."""
    text = (path or "").strip()
    return os.path.expanduser(text) if text else ""


def clean_location(df: DataFrame) -> DataFrame:
    """Identity columns as they are stored: missing ones blank, kind and token without surrounding blanks, and both blank
    unless there are both."""
    for c in LOCATION:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""))
    kind, token = strip(F.col("identity_kind")), strip(F.col("identity_token"))
    whole = (kind != "") & (token != "")
    return df.withColumns({"identity_kind": F.when(whole, kind).otherwise(""), "identity_token": F.when(whole, token).otherwise("")})


def create_volumes(volumes: DataFrame, register: DataFrame, new: DataFrame, now: datetime, highest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Volumes and register with new volumes, numbered in the order of name and source path.

    ``new`` has ``name`` and ``source_path`` and may have the columns of a location or of a register entry. A blank name
    is null. ``highest`` is the highest id ever given, by default that of the table.
    """
    start = highest if highest is not None else volumes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = Window.orderBy(F.col("name").asc_nulls_first(), "source_path")  # a handful of rows
    named = clean_location(new).withColumns({"name": F.nullif(strip(F.col("name")), F.lit("")), "source_path": strip(F.coalesce("source_path", F.lit("")))})
    named = named.withColumn("id", (F.row_number().over(order) + F.lit(start)).cast("bigint"))
    nothing = {"bigint": F.lit(0), "string": F.lit("")}
    own = {"created_at": utc(now), "updated_at": utc(now)}
    values = []
    for f in schemas.schema("volumes"):
        kind = f.dataType.simpleString()
        given = f.name in ("id", "name", "source_path", *LOCATION)
        fill = own.get(f.name, nothing.get(kind, F.lit(None)) if f.name in schemas.required("volumes") else F.lit(None))
        values.append((F.col(f.name) if given else fill).cast(f.dataType).alias(f.name))
    entries = named.select(F.col("id").alias("volume_id"), *[c for c in named.columns if c in register.columns and c not in ("volume_id", "created_at", "updated_at")])
    # A volume's columns are those of the table; more columns of it are null.
    return volumes.unionByName(named.select(*values), allowMissingColumns=True), upsert_register(register, entries, now)


def upsert_register(register: DataFrame, entries: DataFrame, now: datetime) -> DataFrame:
    """The register with entries (``volume_id`` and any other columns) in place of the volumes' former ones.

    An entry is given whole: a column that is missing or null takes its default, not its former value (the next free drive
    id, ``Active``, ``Unknown``, the day of ``now``); only ``created_at`` stays. An entry that is no mirror has no master
    and no mirror date. Of several entries for a volume the greatest row counts.
    """
    columns = [c for c in register.columns if c not in ("volume_id", "created_at", "updated_at")]
    have = [c for c in columns if c in entries.columns]
    one = entries.groupBy("volume_id").agg(F.max(F.struct(F.lit(0).alias("__"), *have)).alias("r")).select("volume_id", *[F.col(f"r.{c}").alias(c) for c in have])
    one = one.select("volume_id", *[(F.col(c) if c in have else F.lit(None)).cast(register.schema[c].dataType).alias(c) for c in columns])
    unnumbered = F.nullif(strip(F.coalesce("drive_id", F.lit(""))), F.lit("")).isNull()
    place = F.sum(unnumbered.cast("int")).over(Window.orderBy("volume_id")) + F.lit(next_number(register) - 1)  # entries are few
    blank = lambda c, text: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit(text))
    mirror = F.coalesce(F.col("is_mirror"), F.lit(0)) != 0
    one = one.withColumns(
        {
            "drive_id": F.when(unnumbered, F.format_string("AID-%03d", place)).otherwise(strip(F.col("drive_id"))),
            "status": blank("status", "Active"),
            "condition": blank("condition", "Unknown"),
            "connector": blank("connector", "Unknown"),
            "description": F.coalesce("description", F.lit("")),
            "date_added": F.coalesce("date_added", F.lit(now.date() if isinstance(now, datetime) else date.today())),
            "is_mirror": mirror.cast("int"),
            "master_volume_id": F.when(mirror, F.col("master_volume_id")),
            "mirror_date": F.when(mirror, F.col("mirror_date")),
        }
    )
    known = register.select("volume_id", F.col("created_at").alias("__created"))
    fresh = one.join(known, "volume_id", "left").withColumns({"created_at": F.coalesce("__created", utc(now)), "updated_at": utc(now)})
    return register.join(one.select("volume_id"), "volume_id", "left_anti").select(*register.columns).unionByName(fresh.select(*register.columns))


def fill_content_dates(register: DataFrame, dates: DataFrame) -> DataFrame:
    """The register with content dates that were found (``volume_id, earliest, latest``) where an entry has none; dates
    that it has stay."""
    found = dates.select("volume_id", F.col("earliest").alias("__e"), F.col("latest").alias("__l"))
    joined = register.join(found, "volume_id", "left")
    filled = {"earliest_content_date": F.coalesce("earliest_content_date", "__e"), "latest_content_date": F.coalesce("latest_content_date", "__l")}
    return joined.withColumns(filled).select(*register.columns)


def register_violations(volumes: DataFrame, register: DataFrame) -> DataFrame:
    """``volume_id, violation``: entries whose dates are out of order, whose drive id is blank or not the only one, whose
    volume is unknown or has no entry, volumes with the name of another (without ASCII case), and what mirrors break.
    """

    def repeated(df: DataFrame, key: str, column: str, text: str) -> DataFrame:
        same = F.count(F.lit(1)).over(Window.partitionBy(ascii_lower(F.col(column))))
        return df.where(F.col(column).isNotNull()).select(F.col(key).alias("volume_id"), same.alias("n")).where("n > 1").select("volume_id", F.lit(text).alias("violation"))

    tests = {
        "content dates reversed": F.col("earliest_content_date") > F.col("latest_content_date"),
        "retired before it was added": F.col("retired_date") < F.col("date_added"),
        "mirrored before it was added": F.col("mirror_date") < F.col("date_added"),
        "no drive id": strip(F.coalesce("drive_id", F.lit(""))) == "",
    }
    wrong = F.array(*[F.when(test, F.lit(text)) for text, test in tests.items()])
    own = register.select("volume_id", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("violation"))
    ids = volumes.select(F.col("id").alias("volume_id"))
    lost = register.select("volume_id").join(ids, "volume_id", "left_anti").withColumn("violation", F.lit("unknown volume"))
    bare = ids.join(register.select("volume_id"), "volume_id", "left_anti").withColumn("violation", F.lit("no entry"))
    parts = [repeated(register, "volume_id", "drive_id", "drive id taken"), repeated(volumes, "id", "name", "name taken"), lost, bare, mirror_violations(volumes, register)]
    for part in parts:
        own = own.unionByName(part)
    return own


def check_register(volumes: DataFrame, register: DataFrame) -> None:
    """An error that names some violations, if there are any."""
    found = register_violations(volumes, register).orderBy("volume_id", "violation").limit(20).collect()
    if found:
        raise InvalidCatalogue("; ".join(f"volume {r['volume_id']}: {r['violation']}" for r in found))
