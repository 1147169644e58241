"""Snapshots kept in ranges and sorted by key, so that a new one is merged with the one before it and nothing else.

The cuts between ranges are placed when the first snapshots are added and stay. Rows are stored settled, bucketed by the
number of their range and sorted by group and key, and read back as buckets, so a merge needs no shuffle: every range of
the new snapshots meets the same range of the former ones in one task and is merged there by neighbours. Only what is
new and the last snapshot of each group with news are read.

A version is one small file, created exclusively, that says which snapshot of each group is the last and where it lies.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.errors import CatalogueInUse
from lodestack.operators.snapshots import Ranges, neighbour_changes, settled_rows
from lodestack.session import create_exclusively, delete_unnamed, parallelism

#: Snapshots added at once whose ids are also given to the scan as a filter.
FILTERED = 1000


class SnapshotStore:
    """``snapshot``, ``group``, ``key`` and so on are the columns that ``snapshot_changes`` takes."""

    def __init__(self, spark: SparkSession, path: str, *, snapshot: str, group: str, key: str, compare: Sequence[str], newest_by: str, absent: str | None = None, ranges: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.snapshot, self.group, self.key, self.compare, self.newest_by, self.absent = snapshot, group, key, list(compare), newest_by, absent
        self._wanted, self.names = ranges or parallelism(spark), set()
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.reload()

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def reload(self) -> None:
        folder = self._at(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.version = max([int(n) for n in names if n.isdigit()], default=0)
        held = {"cuts": None, "last": [], "columns": None}
        if self.version:
            stream = self._fs.open(self._at(f"{self.path}/versions/{self.version}"))
            held = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
        self.ranges = None if held["cuts"] is None else Ranges(tuple(map(tuple, held["cuts"])))
        self.last = {group: (position, snapshot, where) for group, position, snapshot, where in held["last"]}
        self.columns = held["columns"]

    def _stored(self, folder: str) -> DataFrame:
        """The rows of a folder as the buckets and in the order that they were written in."""
        name = f"lodestack_{folder}"
        self.names.add(name)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.columns}) USING parquet CLUSTERED BY (__range) SORTED BY (__g, c_{self.key}) INTO {self.ranges.number()} BUCKETS LOCATION '{self.path}/data/{folder}'"
        )
        return self.spark.table(name)

    def close(self) -> None:
        """Forget this store's tables in the session's catalogue; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def _order(self, rows: list[tuple], schema: T.StructType) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def add(self, snapshots: DataFrame, sequence: DataFrame) -> DataFrame:
        """Store the snapshots of ``sequence`` (as for ``snapshot_changes``) that come after each group's last one, and
        return their changes, each against the one before it. Those known already are passed over, so a repeated job
        changes nothing and returns nothing; the first snapshot of a group has no changes. A position that is skipped
        counts as an empty snapshot. ``sequence`` is one row per snapshot and is brought to the driver.
        """
        listed = sorted({(r[0], r[1], r[2]) for r in sequence.select(self.group, "position", self.snapshot).collect()}, key=lambda r: (str(r[0]), r[1]))
        new = [r for r in listed if r[1] > self.last.get(r[0], (0,))[0]]
        types = {c: sequence.schema[c].dataType for c in (self.snapshot, self.group)}
        plan = T.StructType([T.StructField("__s", types[self.snapshot]), T.StructField("__g", types[self.group])])
        groups = {r[0] for r in new}
        ids = [r[2] for r in new]
        rows = snapshots.where(F.col(self.snapshot).isin(ids)) if len(ids) <= FILTERED else snapshots
        wanted = self._order([(s, g) for g, _, s in new], plan)
        settled, ranges = settled_rows(rows, wanted, self.snapshot, self.key, self.compare, self.newest_by, self.absent, self._wanted, self.ranges)
        folder = uuid.uuid4().hex
        n = ranges.number()
        writer = settled.write.bucketBy(n, "__range").sortBy("__g", f"c_{self.key}").option("path", f"{self.path}/data/{folder}")
        writer.saveAsTable(f"lodestack_{folder}")
        self.ranges, self.columns = ranges, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in settled.schema)
        # What is compared: per group its last snapshot so far, where there is one, then the new ones.
        before = {g: self.last[g] for g in groups if g in self.last}
        chain = sorted([(g, at, s, True) for g, (at, s, _) in before.items()] + [(g, at, s, g not in before and at == min(x[1] for x in new if x[0] == g)) for g, at, s in new], key=lambda r: (str(r[0]), r[1]))
        follow = {(g, at): s for g, at, s, _ in chain}
        full = T.StructType([*plan.fields, T.StructField("__at", T.IntegerType()), T.StructField("__next", types[self.snapshot]), T.StructField("__first", T.BooleanType())])
        order = self._order([(s, g, at, follow.get((g, at + 1)), first) for g, at, s, first in chain], full).drop("__g")
        parts = [self._stored(folder)]
        for where in sorted({w for _, _, w in before.values()}):
            kept = [s for _, s, w in before.values() if w == where]
            parts.append(self._stored(where).where(F.col("__s").isin(kept)))
        both = reduce(DataFrame.unionByName, parts).join(order, "__s")
        changes = f"{self.path}/changes/{folder}"
        neighbour_changes(both, self.snapshot, self.group, self.key, self.compare).write.parquet(changes)
        last = self.last | {g: (at, s, folder) for g, at, s in new}
        text = json.dumps({"cuts": ranges.cuts, "columns": self.columns, "last": [[g, *rest] for g, rest in last.items()]})
        if not create_exclusively(self.spark, f"{self.path}/versions/{self.version + 1}", text):
            raise CatalogueInUse(f"version {self.version + 1} of {self.path} was published by another writer")
        self.version, self.last = self.version + 1, last
        return self.spark.read.parquet(changes)

    def state(self) -> DataFrame:
        """``group, snapshot, key`` and the compared columns: every group as its last snapshot found it."""
        parts = []
        for where in sorted({w for _, _, w in self.last.values()}):
            kept = [s for _, s, w in self.last.values() if w == where]
            parts.append(self._stored(where).where(F.col("__s").isin(kept)))
        named = [F.col("__g").alias(self.group), F.col("__s").alias(self.snapshot), *[F.col(f"c_{c}").alias(c) for c in dict.fromkeys([self.key, *self.compare])]]
        return reduce(DataFrame.unionByName, parts).select(*named)

    def vacuum(self, hours: float = 48) -> int:
        """Delete rows that no group's last snapshot lies in any more, changes handed over, and what dead jobs left."""
        return delete_unnamed(self.spark, f"{self.path}/data", {w for _, _, w in self.last.values()}, hours) + delete_unnamed(self.spark, f"{self.path}/changes", set(), hours)
