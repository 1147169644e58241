"""Results in batches, for a caller that shows them as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession

#: Rows of a batch.
BATCH = 500


def result_batches(df: DataFrame, size: int = BATCH) -> Iterator[tuple[Row, ...]]:
    """The rows in order, ``size`` at a time; only one partition is on the driver at once."""
    yield from batched(df.toLocalIterator(prefetchPartitions=True), size)


class LatestSearch:
    """Runs searches so that only the newest one goes on: starting one cancels the jobs of the one before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number = spark, 0

    def run(self, make: Callable[[], DataFrame], size: int = BATCH) -> Iterator[tuple[Row, ...]]:
        context = self.spark.sparkContext
        if self.number:
            context.cancelJobsWithTag(f"search-{self.number}")
        self.number += 1
        mine, tag = self.number, f"search-{self.number}"
        context.addJobTag(tag)
        try:
            for batch in result_batches(make(), size):
                if mine != self.number:
                    return
                yield batch
        finally:
            context.removeJobTag(tag)
