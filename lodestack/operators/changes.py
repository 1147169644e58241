"""Changes to immutable tables: keyed upserts that keep ids, removals, and defaults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.catalogue import utc
from lodestack.operators.register import LOCATION, clean_path
from lodestack.session import cut_lineage

KEY = ["volume_id", "relative_path"]


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Current rows overlaid with the incoming ones that have the same key; ids stay with their key.

    New keys get the ids after the highest one, without gaps. They are numbered by partition: rows are ordered within
    ranges of the key and each range continues where the ones before it end, so no task sees all new rows. Several
    incoming rows of one key are settled to the greatest row. A null key matches a null key.
    """
    columns = [c for c in current.columns if c != "id"]
    fresh = incoming.groupBy(*keys).agg(F.max(F.struct(*[c for c in columns if c not in keys])).alias("r")).select(*keys, "r.*")
    known = current.select("id", *[F.col(k).alias(f"__{k}") for k in keys])
    same = [known[f"__{k}"].eqNullSafe(fresh[k]) for k in keys]
    joined = fresh.join(known, same, "left").select("id", *columns)
    replaced = joined.where("id IS NOT NULL")
    untouched = current.join(replaced.select("id"), "id", "left_anti")
    highest = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    added = number_rows(joined.where("id IS NULL").drop("id"), order or keys, highest).select("id", *columns)
    return untouched.select("id", *columns).unionByName(replaced).unionByName(added)


def number_rows(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """``id`` = start + 1, 2, ... in the order of columns that tell all rows apart, ranges numbered in parallel."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    placed = cut_lineage(ranged)  # the ranges must not move between the two uses below
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part").orderBy(*order)
    numbered = placed.join(F.broadcast(offsets), "__part")
    return numbered.withColumn("id", F.row_number().over(own) + F.col("__before") + F.lit(start)).drop("__part", "__before")


def finalize(items: DataFrame, volume_id: int, scanned_at, keep_root: bool = False) -> DataFrame:
    """Without the volume's items that a scan did not see again; the root folder stays if asked."""
    stale = F.col("scanned_at").isNull() | (F.col("scanned_at") != utc(scanned_at))
    if keep_root:
        stale = stale & (F.col("relative_path") != "")
    return items.where(~((F.col("volume_id") == volume_id) & stale))


def delete_volume(tables: dict[str, DataFrame], volume_id: int) -> dict[str, DataFrame]:
    """All tables without the volume. A master that mirrors depend on cannot go."""
    register = tables.get("volume_register")
    if register is not None and not register.where(F.col("master_volume_id") == volume_id).isEmpty():
        raise ValueError("mirrors depend on this volume")
    return {name: df.where(F.col("id" if name == "volumes" else "volume_id") != volume_id) for name, df in tables.items()}


def update_volume(volumes: DataFrame, volume_id: int, **values) -> DataFrame:
    """The volumes with some columns of one of them set; ``last_scan_at`` = None keeps the time there is."""
    ours = F.col("id") == volume_id
    sets = {}
    for name, value in values.items():
        new = utc(value) if isinstance(value, datetime) else F.lit(value).cast(volumes.schema[name].dataType)
        sets[name] = F.when(ours, F.coalesce(new, F.col(name)) if name == "last_scan_at" else new).otherwise(F.col(name))
    return volumes.withColumns(sets)


def update_location(volumes: DataFrame, volume_id: int, source_path: str | None, location: dict[str, str] | None, now: datetime) -> DataFrame:
    """The volumes with one of them at another place; an identity without both its parts is none."""
    given = {c: str((location or {}).get(c) or "") for c in LOCATION}
    kind, token = normalized_location(given["identity_kind"], given["identity_token"])
    return update_volume(volumes, volume_id, source_path=clean_path(source_path), updated_at=now, **given | {"identity_kind": kind, "identity_token": token})


def update_storage(volumes: DataFrame, volume_id: int, capacity: int, used: int, free: int, now: datetime, scanned_at: datetime | None = None) -> DataFrame:
    """The volumes with the sizes of one of them; without ``scanned_at`` its last scan stays."""
    return update_volume(volumes, volume_id, capacity_bytes=capacity, used_bytes=used, free_bytes=free, last_scan_at=scanned_at, updated_at=now)


def normalized_location(kind: str | None, token: str | None) -> tuple[str, str]:
    """An identity counts only with both its parts."""
    kind, token = (kind or "").strip(), (token or "").strip()
    return (kind, token) if kind and token else ("", "")
