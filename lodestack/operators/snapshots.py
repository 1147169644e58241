"""What changed between full snapshots of a table.

All snapshots lie in one stream that is range-partitioned and sorted by key, so each range is merged on its own: the
rows of a key stand next to each other in snapshot order and every row is compared with its neighbour only. That is a
two-pointer merge of sorted snapshots for any number of snapshots at once. A key prefix that holds a third of all rows
is cut into as many ranges as its rows need.

``snapshot_changes`` works on a whole history. Where snapshots arrive one after another, ``sources.snapshots`` keeps
them in ranges and sorted, and a new one is merged with the one before it only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.session import parallelism

#: Snapshots listed in a sequence up to which it is sent to every executor (about 40 bytes each); beyond, it is joined.
BROADCAST_SNAPSHOTS = 200_000
#: Rows that are sampled to place the cuts between ranges, and how often a key must be among them to be collapsed on the
#: map side. Both decide how the work is divided and nothing else; a key that is missed holds few rows.
SAMPLE, OFTEN = 4096, 8
#: Characters of a text key that place a cut.
PREFIX = 256


@dataclass(frozen=True)
class Ranges:
    """Ranges of (group, key). ``cuts`` are the greatest pairs of all ranges but the last, in order; nulls come first."""

    cuts: tuple[tuple, ...]

    def number(self) -> int:
        return len(self.cuts) + 1

    def of(self, group: Column, key: Column, labels: Sequence[int]) -> Column:
        """The label of a pair's range, by halving."""

        def upto(cut: tuple) -> Column:
            same = group == F.lit(cut[0]) if cut[0] is not None else group.isNull()
            less = group < F.lit(cut[0]) if cut[0] is not None else F.lit(False)
            low = key <= F.lit(cut[1]) if cut[1] is not None else key.isNull()
            return F.coalesce(less | (same & low), F.lit(True))

        def halve(first: int, last: int) -> Column:
            if first == last:
                return F.lit(labels[first])
            middle = (first + last) // 2
            return F.when(upto(self.cuts[middle]), halve(first, middle)).otherwise(halve(middle + 1, last))

        return halve(0, len(self.cuts))


@lru_cache(maxsize=32)
def _labels(n: int) -> tuple[int, ...]:
    label = F.col("id").cast("int")
    placed = SparkSession.active().range(64 * n).select(label.alias("label"), F.pmod(F.hash(label), F.lit(n)).alias("at"))
    first = {}
    for r in placed.collect():
        first.setdefault(r["at"], r["label"])
    return tuple(first[i] for i in range(n))


def range_labels(n: int) -> tuple[int, ...]:
    """Numbers for n ranges that hash partitioning (of a shuffle or of buckets) puts into the partitions 0 to n - 1 in turn."""
    return _labels(n)


def survey(rows: DataFrame, snapshot: str, group: str, key: str, n: int, size: int) -> tuple[Ranges, list[int]]:
    """Cuts for about n even ranges, and hashes of the (snapshot, key) that occur so often that they are collapsed first.

    One pass over three columns keeps SAMPLE random rows, of a text the first PREFIX characters: a prefix cuts as well.
    ``size`` is the table's size in bytes as far as it is known; it only thins out the rows that compete.
    """
    start = F.substring(key, 1, PREFIX) if isinstance(rows.schema[key].dataType, T.StringType) else F.col(key)
    drawn = rows.select(F.xxhash64(snapshot, key).alias("h"), F.col(group).alias("g"), start.alias("k"), F.rand(11).alias("u"))
    keep = lambda df: [(r["h"], r["g"], r["k"]) for r in df.orderBy("u").limit(SAMPLE).orderBy("g", "k").collect()]
    rate = min(1.0, 32 * SAMPLE * 40 / max(size, 1))
    found = keep(drawn.where(F.col("u") < rate)) if rate < 1 else []
    if len(found) < SAMPLE // 8:  # a small table, or one whose size is not known
        found = keep(drawn)
    cuts = [found[len(found) * i // n][1:] for i in range(1, n)] if found else []
    seen = Counter(h for h, *_ in found)
    return Ranges(tuple(dict.fromkeys(cuts))), [h for h, times in seen.items() if times >= OFTEN]


def bytes_of(df: DataFrame) -> int:
    """The size of a DataFrame by the optimizer's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def latest_reading(df: DataFrame, keys: Sequence[str], newest_by: str, tie_by: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``newest_by``.

    Nulls in ``newest_by`` are oldest. Rows that tie there are ordered by ``tie_by``, greatest first and
    nulls last, so the choice doesn't depend on the order of the input; exact copies collapse to one row.
    """
    order = [F.col(c).desc_nulls_last() for c in (newest_by, *tie_by)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__reading", F.row_number().over(w)).where("__reading = 1").drop("__reading")


def collapse_hot(df: DataFrame, hot: list[int], snapshot: str, key: str, same: Sequence[str], newest_by: str, tie_by: Sequence[str]) -> DataFrame:
    """The rows with those of much repeated (snapshot, key) already settled as ``latest_reading`` would, on the map side.

    A pair that holds a third of all rows would otherwise be one task's work. ``hot`` are the pairs' hashes; whatever else
    has such a hash is settled too, which changes nothing. ``same`` names columns that follow from the snapshot.
    """
    if not hot:
        return df
    often = F.xxhash64(snapshot, key).isin(hot)
    newest = F.max(F.struct(newest_by, *tie_by)).alias("__newest")
    settled = df.where(often).groupBy(snapshot, key, *same).agg(newest).select(snapshot, key, *same, "__newest.*")
    return df.where(~often).unionByName(settled.select(*df.columns))


def differs(left: str, right: str, columns: Sequence[str]) -> Column:
    """True if any column differs; null equals only null."""
    tests = [~F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in columns]
    return reduce(Column.__or__, tests, F.lit(False))


def snapshot_changes(
    snapshots: DataFrame,
    sequence: DataFrame,
    *,
    snapshot: str,
    group: str,
    key: str,
    compare: Sequence[str],
    newest_by: str,
    absent: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Typed changes of every snapshot against the one before it in its group.

    ``sequence`` (columns ``snapshot``, ``group``, ``position`` 1, 2, ... within the group) lists the snapshots that
    count; rows of other snapshots are ignored, a listed snapshot without rows is an empty one, and the first of a
    group has no changes. It holds one row per snapshot, not per record. ``absent`` names a column whose value 1 says
    that the record was not there. Several rows of a snapshot for one key are settled by ``latest_reading``. A row
    with a null key is a record like any other whose key is null; null equals null.

    Result: ``snapshot``, ``group``, ``key``, ``change_type`` (``added``, ``removed``, ``changed``), and the compared
    columns before and after as ``old_<column>`` and ``new_<column>``. Columns of the input beyond the named ones are
    not read.
    """
    order = sequence.select(F.col(snapshot).alias("__s"), F.col(group).alias("__g"), F.col("position").alias("__at"))
    follow = order.select("__g", (F.col("__at") - 1).alias("__at"), F.col("__s").alias("__next"))
    order = order.join(follow, ["__g", "__at"], "left").withColumn("__first", F.col("__at") == 1)
    if sequence.count() <= BROADCAST_SNAPSHOTS:
        order = F.broadcast(order)
    rows, _ = settled_rows(snapshots, order, snapshot, key, compare, newest_by, absent, ranges or parallelism(snapshots.sparkSession))
    return neighbour_changes(rows, snapshot, group, key, compare)


def settled_rows(snapshots: DataFrame, order: DataFrame, snapshot: str, key: str, compare: Sequence[str], newest_by: str, absent: str | None, n: int, ranges: Ranges | None = None) -> tuple[DataFrame, Ranges]:
    """The rows of the listed snapshots in ranges, one per snapshot and key, without those that were not there.

    ``order`` has ``__s, __g`` and what else is to stand beside each row. The result has ``__range``, by which it is
    partitioned, the columns of ``order``, the key and the compared columns (as ``c_<column>``).
    """
    used = list(dict.fromkeys([key, *compare, newest_by, *([absent] if absent else [])]))
    rows = snapshots.select(F.col(snapshot).alias("__s"), *[F.col(c).alias(f"c_{c}") for c in used]).join(order, "__s")
    ties = [f"c_{c}" for c in ([absent] if absent else []) + list(compare)]
    cut, hot = survey(rows, "__s", "__g", f"c_{key}", n, bytes_of(snapshots))
    ranges = ranges or cut
    rows = collapse_hot(rows, hot, "__s", f"c_{key}", [c for c in order.columns if c != "__s"], f"c_{newest_by}", ties)
    placed = rows.withColumn("__range", ranges.of(F.col("__g"), F.col(f"c_{key}"), range_labels(ranges.number())))
    placed = placed.repartition(ranges.number(), "__range")
    # By place where there is one, so that the order serves the comparison of neighbours too.
    placed = latest_reading(placed, [f"c_{key}", "__g", "__range", "__at" if "__at" in order.columns else "__s"], f"c_{newest_by}", ties)
    if absent:
        placed = placed.where(F.coalesce(F.col(f"c_{absent}"), F.lit(0)) != 1)
    return placed.select("__range", *order.columns, f"c_{key}", *[f"c_{c}" for c in compare if c != key]), ranges


def neighbour_changes(rows: DataFrame, snapshot: str, group: str, key: str, compare: Sequence[str]) -> DataFrame:
    """The changes in settled rows: partitioned by ``__range``, which follows from ``__g`` and the key, with ``__s``, its
    place ``__at`` and its successor ``__next`` in the group, and ``__first`` where nothing is known before it."""
    w = Window.partitionBy(f"c_{key}", "__g", "__range").orderBy("__at")
    before = [F.lag(f"c_{c}").over(w).alias(f"p_{c}") for c in compare]
    rows = rows.select("*", F.lag("__at").over(w).alias("__before"), F.lead("__at").over(w).alias("__after"), *before)
    stayed = F.col("__before").eqNullSafe(F.col("__at") - 1)
    arrival = F.when(F.col("__first"), None).when(~stayed, "added").when(differs("c_", "p_", compare), "changed")
    leaves = F.col("__next").isNotNull() & ~F.col("__after").eqNullSafe(F.col("__at") + 1)

    def event(at: str, kind: Column, old: str | None, new: str | None) -> Column:
        side = lambda mark, c: (F.col(f"{mark}{c}") if mark else F.lit(None)).alias
        return F.struct(
            F.col(at).alias("at"),
            kind.alias("kind"),
            *[side(old, c)(f"old_{c}") for c in compare],
            *[side(new, c)(f"new_{c}") for c in compare],
        )

    def known(struct: Column, kind: str) -> Column:
        return F.when(arrival == kind, struct)

    events = F.array(
        F.coalesce(
            known(event("__s", F.lit("added"), None, "c_"), "added"),
            known(event("__s", F.lit("changed"), "p_", "c_"), "changed"),
        ),
        F.when(leaves, event("__next", F.lit("removed"), "c_", None)),
    )
    changed = rows.where(arrival.isNotNull() | leaves).select(
        "__g", f"c_{key}", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")
    )
    return changed.select(
        F.col("e.at").alias(snapshot),
        F.col("__g").alias(group),
        F.col(f"c_{key}").alias(key),
        F.col("e.kind").alias("change_type"),
        *[F.col(f"e.{side}_{c}").alias(f"{side}_{c}") for c in compare for side in ("old", "new")],
    )


def completed_sequence(history: DataFrame) -> DataFrame:
    """Completed scans numbered within their volume by ``started_at``; ties by id, a null start first.

    One row per scan, so the window runs over the register of scans and not over what they found.
    """
    done = history.where(F.col("status") == "completed").select(F.col("id").alias("scan_id"), "volume_id", "started_at")
    w = Window.partitionBy("volume_id").orderBy(F.col("started_at").asc_nulls_first(), "scan_id")
    return done.dropDuplicates(["scan_id"]).select("scan_id", "volume_id", F.row_number().over(w).alias("position"))


def scan_changes(snapshots: DataFrame, history: DataFrame, ranges: int | None = None) -> DataFrame:
    """Files added, removed or changed by each completed scan since the volume's previous completed scan."""
    return snapshot_changes(
        snapshots,
        completed_sequence(history),
        snapshot="scan_id",
        group="volume_id",
        key="relative_path",
        compare=["size_bytes", "modified_at"],
        newest_by="scanned_at",
        absent="missing",
        ranges=ranges,
    )
