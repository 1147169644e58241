"""How often every distinct value or term occurs, kept up to date by signed deltas.

A delivery states which records were added, changed or deleted. Only those records are aggregated: what a record held
before counts with a minus, what it holds now with a plus, and the sums per term are merged into a persistent table
that is partitioned by a hash of the term. Deliveries that touch few terms rewrite few partitions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import create_exclusively, delete_unnamed, drop_path, shared_path

#: A count's columns: one row per term, and one with level ``all`` for all records with or without a term.
COUNTS = "level string, term string, occurrences bigint, records bigint"
#: Partitions of a new store.
BUCKETS = 16
#: Versions whose folders are kept, so that whoever reads a former one can finish.
KEPT_VERSIONS = 2


class StoreConflict(RuntimeError):
    """Other writers kept publishing first."""


def signed_changes(before: DataFrame | None, after: DataFrame | None, record: Column, term: Column) -> DataFrame:
    """``level, term, d_occurrences, d_records`` of a delivery, from the changed records only.

    ``before`` holds all rows that the changed and deleted records had, ``after`` those that the changed and added ones
    have; a record held both times contributes the difference. Copies of a row meet on the map side, per record and term
    and then per term, so no record and no term is brought into one task. The level ``all`` counts each record once,
    whatever it holds, and every row. A null term belongs to no term row; a null record is one record.
    """
    sides = [(before, -1), (after, 1)]
    rows = [df.select(record.alias("record"), term.alias("term"), F.lit(sign).alias("sign")) for df, sign in sides if df is not None]
    held = rows[0].unionByName(rows[1]) if len(rows) == 2 else rows[0]
    held = held.groupBy("record", "sign", "term").agg(F.count(F.lit(1)).alias("n"))
    signed = lambda c: F.sum(c).cast("bigint")
    sums = [signed(F.col("n") * F.col("sign")).alias("d_occurrences"), signed(F.col("sign")).alias("d_records")]
    # Null terms are left out after the sums: a filter on the term would be moved down, and both branches would then read the rows.
    terms = held.groupBy("term").agg(*sums, F.count("term").alias("known")).where("known > 0").select(F.lit("term").alias("level"), "term", "d_occurrences", "d_records")
    records = held.groupBy("record", "sign").agg(F.sum("n").alias("n")).groupBy().agg(*sums)
    everything = records.where("d_records IS NOT NULL").select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("term"), "d_occurrences", "d_records")
    return terms.unionByName(everything).where("d_occurrences <> 0 OR d_records <> 0")


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The counts after the deltas. Terms that no record holds any more disappear."""
    moved = deltas.select("level", "term", F.col("d_occurrences").alias("occurrences"), F.col("d_records").alias("records"))
    both = state.select(*moved.columns).unionByName(moved)
    summed = both.groupBy("level", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return summed.where("occurrences <> 0 OR records <> 0")


def _by_bucket(df: DataFrame) -> DataFrame:
    """The rows of a partition together, divided over several tasks and files where they are many."""
    return df.hint("rebalance", F.col("bucket"))


class TermCounts:
    """Persistent counts in a folder, partitioned by a hash of the term.

    A version is one small file that names the folder of every partition, the number of partitions and the deliveries
    merged so far. It is created exclusively, so of two writers who start from the same version one publishes and the
    other merges again from what was published; neither's counts are lost. A job that dies leaves the former version.
    A delivery that was merged before is ignored, so a repeated job does not count twice. The number of partitions
    belongs to the store and not to the session; opening it with another is an error. Folders that no kept version
    names are deleted after a merge.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._asked = buckets
        self.reload()

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        place = self._at(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/versions/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def reload(self) -> None:
        """Look at the last published version."""
        self.version = max([int(n) for n in self._names("versions") if n.isdigit()], default=0)
        held = self._read(self.version) if self.version else {"buckets": self._asked or BUCKETS, "folders": {}, "merged": []}
        self.buckets: int = held["buckets"]
        if self._asked not in (None, self.buckets):
            raise ValueError(f"{self.path} has {self.buckets} partitions, not {self._asked}")
        self.folders: dict[int, str] = {int(b): f for b, f in held["folders"].items()}
        self.merged: set[str] = set(held["merged"])

    def counts(self, only: list[int] | None = None) -> DataFrame:
        """The current counts; of some partitions only, the others are not read."""
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in self.folders.items() if only is None or b in only]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64("level", "term"), F.lit(self.buckets)).cast("int")

    def apply(self, delivery: str, before: DataFrame | None, after: DataFrame | None, record: Column, term: Column) -> "TermCounts":
        """Merge a delivery given as the rows of its records before and after."""
        return self if delivery in self.merged else self.merge(signed_changes(before, after, record, term), delivery)

    def merge(self, deltas: DataFrame, delivery: str, attempts: int = 10) -> "TermCounts":
        """Merge one delivery's deltas (of ``signed_changes``)."""
        if not self.version and not self._publish({}, set()):  # the number of partitions is settled first
            self.reload()
        staged = f"deltas/{uuid.uuid4().hex}"
        _by_bucket(deltas.withColumn("bucket", self.bucket_of())).write.partitionBy("bucket").parquet(f"{self.path}/{staged}")
        touched = sorted(int(n.partition("=")[2]) for n in self._names(staged) if n.startswith("bucket="))
        kind = "level string, term string, d_occurrences bigint, d_records bigint"
        for _ in range(attempts):
            if delivery in self.merged:
                break
            folder = f"counts/{uuid.uuid4().hex}"
            folders = dict(self.folders)
            if touched:
                moved = self.spark.read.schema(kind).parquet(*[f"{self.path}/{staged}/bucket={b}" for b in touched])
                merged = merge_counts(self.counts(touched), moved).withColumn("bucket", self.bucket_of())
                _by_bucket(merged).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
                filled = {int(n.partition("=")[2]) for n in self._names(folder) if n.startswith("bucket=")}
                folders = {b: f for b, f in folders.items() if b not in touched} | dict.fromkeys(filled, folder)
            if self._publish(folders, self.merged | {delivery}):
                drop_path(self.spark, f"{self.path}/{staged}")
                self._drop_versions()
                return self
            drop_path(self.spark, f"{self.path}/{folder}")
            self.reload()
        drop_path(self.spark, f"{self.path}/{staged}")
        if delivery not in self.merged:
            raise StoreConflict(f"{delivery} could not be merged into {self.path}")
        return self

    def _publish(self, folders: dict[int, str], merged: set[str]) -> bool:
        """Whether the next version could be created; another writer may have been first."""
        text = json.dumps({"buckets": self.buckets, "folders": folders, "merged": sorted(merged)})
        if not create_exclusively(self.spark, f"{self.path}/versions/{self.version + 1}", text):
            return False
        self.version, self.folders, self.merged = self.version + 1, folders, merged
        return True

    def _drop_versions(self) -> None:
        """Delete old versions and the count folders that only they named."""
        old = sorted(int(n) for n in self._names("versions") if n.isdigit() and int(n) <= self.version - KEPT_VERSIONS)
        if old:
            kept = set().union(*[set(self._read(v)["folders"].values()) for v in range(old[-1] + 1, self.version + 1)])
            for folder in set().union(*[set(self._read(v)["folders"].values()) for v in old]) - kept:
                drop_path(self.spark, f"{self.path}/{folder}")
            for v in old:
                drop_path(self.spark, f"{self.path}/versions/{v}")

    def vacuum(self, hours: float = 48) -> int:
        """Delete the folders of merges that died: those that no version names and that are older than the hours."""
        named = set().union(*[set(self._read(int(n))["folders"].values()) for n in self._names("versions") if n.isdigit()])
        gone = delete_unnamed(self.spark, f"{self.path}/counts", {f.rpartition("/")[2] for f in named}, hours)
        return gone + delete_unnamed(self.spark, f"{self.path}/deltas", set(), hours)


def mark_terms(counts: DataFrame, least_records: int = 5, most_share: float = 0.1) -> DataFrame:
    """``term, occurrences, records, mark``: ``rare`` below ``least_records`` records, ``common`` above the share of all
    records (those without a term included), else null. A term that is both is ``common``.
    """
    total = counts.where("level = 'all'").select("records").first()
    everything = F.lit(most_share * (total["records"] if total else 0))
    mark = F.when(F.col("records") > everything, "common").when(F.col("records") < least_records, "rare")
    return counts.where("level = 'term'").select("term", "occurrences", "records", mark.alias("mark"))


def load_and_increment(rows: DataFrame, record: Column, term: Column, delivered: str, since) -> DataFrame:
    """Counts of a table through a store: all rows delivered before ``since`` as the first load, the rest as an increment.

    A record in the increment replaces what it held before, all its earlier rows, which are found by its id and count
    with a minus. A null in the column ``delivered`` is before. The store lies in the shared folder.
    """
    spark = rows.sparkSession
    store = TermCounts(spark, shared_path(spark, "terms"))
    late = rows.where(F.col(delivered) >= F.lit(since))
    early = rows.where(F.coalesce(F.col(delivered) < F.lit(since), F.lit(True)))
    replaced = late.select(record.alias("__again")).distinct()
    before = early.join(replaced, record.eqNullSafe(F.col("__again")), "left_semi")
    return store.apply("load", None, early, record, term).apply("increment", before, late, record, term).counts()
