"""Runs by buckets that go on where they broke: a ledger says which buckets are done, and for which input and configuration.

The input is a table dealt into folders by bucket. A bucket's fingerprint is taken of its files (names, lengths, times of change)
and of the configuration, so that finding out what is left reads no data. What is missing or stale is an anti join; the run
goes over just those buckets, group by group, publishes each group at once and then enters it in the ledger. If it breaks in
between, the group is done again and replaces itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.sources.published import BUCKET, Published, ranges_of
from glossaria.sources.scratch import _fs

_ENTRY = "run_id string, bucket int, fingerprint string, at long"


def deal(df: DataFrame, path: str, bucket: Column) -> None:
    """Write a table into folders by bucket, one file each (or more where maxRecordsPerFile says so)."""
    df.withColumn(BUCKET, bucket.cast("int")).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def fingerprints(spark: SparkSession, source: str, config: str) -> DataFrame:
    """(bucket, fingerprint) of each bucket of a dealt table; reads the list of its files, not their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    name = F.element_at(F.split("path", "/"), -1)
    each = F.xxhash64(name, F.col("length"), F.col("modificationTime").cast("double")).cast("decimal(38,0)")
    parts = files.groupBy(F.col(BUCKET).cast("int").alias("bucket")).agg(F.sum(each).alias("sum"), F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return parts.select("bucket", F.sha2(F.concat_ws("|", F.lit(config), *[F.col(c).cast("string") for c in ("sum", "n", "bytes")]), 256).alias("fingerprint"))


class Ledger:
    """Entries (run, bucket, fingerprint, time), one small file for each group that ends; the last entry of a bucket counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def done(self, run_id: str) -> DataFrame:
        """(bucket, fingerprint) of the buckets that a run has."""
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], "bucket int, fingerprint string")
        rows = self.spark.read.schema(_ENTRY).parquet(self.path).filter(F.col("run_id") == run_id)
        return rows.groupBy("bucket").agg(F.max_by("fingerprint", "at").alias("fingerprint")).filter("fingerprint is not null")

    def enter(self, run_id: str, entries: Iterable[tuple[int, str | None]]) -> None:
        """A null fingerprint takes a bucket out."""
        now = time.time_ns()
        self.spark.createDataFrame([(run_id, b, f, now) for b, f in entries], _ENTRY).coalesce(1).write.mode("append").parquet(self.path)


def pending(now: DataFrame, done: DataFrame) -> DataFrame:
    """(bucket, fingerprint) of the buckets that are missing or stale."""
    return now.join(done, ["bucket", "fingerprint"], "left_anti")


def vanished(now: DataFrame, done: DataFrame) -> DataFrame:
    """(bucket) of those that are done and have no input any more."""
    return done.select("bucket").join(now.select("bucket"), "bucket", "left_anti")


def resume(spark: SparkSession, source: str, target: Published, ledger: Ledger, run_id: str, config: str, work: Callable[[DataFrame], DataFrame], step: int = 64) -> list[int]:
    """Do what is left of a run, ``step`` buckets at a time, and return the buckets that were done now.

    work: from the rows of some buckets (with channel_hash_bucket) to results that have it too, each bucket by itself. There are as
    many entries on the driver as buckets at most.
    """
    now, done = fingerprints(spark, source, config), ledger.done(run_id)
    todo = sorted(map(tuple, pending(now, done).collect()))
    if gone := [r["bucket"] for r in vanished(now, done).collect()]:
        target.clear(run_id, ranges_of(gone))
        ledger.enter(run_id, [(b, None) for b in gone])
    for k in range(0, len(todo), step):
        some = todo[k : k + step]
        buckets = [b for b, _ in some]
        rows = spark.read.option("basePath", source).parquet(*[f"{source}/{BUCKET}={b}" for b in buckets])  # other folders aren't even listed
        target.replace(work(rows).withColumn("run_id", F.lit(run_id)), run_id, ranges_of(buckets))
        ledger.enter(run_id, some)
    return [b for b, _ in todo]
