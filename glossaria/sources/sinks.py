"""Writing Parquet tables: idempotent for a run and a range of buckets, with checks of schema evolution; JSON line files.

A frame is evaluated once for a write: it goes to a folder beside the table first, so that it may read the table itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.operators.panel import BatchSubmitter


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _parts(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [n for s in fs.listStatus(at) if s.isDirectory() and not (n := s.getPath().getName()).startswith(("_", "."))] if fs.exists(at) else []


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns by which a table's folders are dealt."""
    names, at = [], path
    while parts := _parts(spark, at):
        names.append(parts[0].partition("=")[0])
        at = f"{at}/{parts[0]}"
    return names


def _staged(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    return spark.read.schema(df.schema).parquet(beside), beside


def write_scoped(df: DataFrame, path: str, run_id: str, buckets: tuple[int, int], full: bool) -> None:
    """Replace one run's rows in a range of buckets; partitions that get no row are removed as well.

    df has run_id and channel_hash_bucket; a row of another run or outside the range raises. Other columns must be those of the
    table, unless the range is full: then the run is written anew, and its schema may differ from that of other runs, which
    read_merged() brings together.
    """
    spark = df.sparkSession
    if _parts(spark, path):
        have = set(spark.read.option("mergeSchema", True).parquet(path).columns)
        if have != set(df.columns) and not full:
            raise ValueError(f"columns differ in {sorted(have ^ set(df.columns))} and the range of buckets is partial")
    rows, beside = _staged(df, path)
    try:
        outside = rows.filter(~(F.col("run_id").eqNullSafe(run_id) & F.coalesce(F.col("channel_hash_bucket").between(*buckets), F.lit(False))))
        if not outside.isEmpty():
            raise ValueError(f"rows outside of run {run_id!r} and buckets {buckets[0]} to {buckets[1]}")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "channel_hash_bucket").parquet(path)
        kept = {r["channel_hash_bucket"] for r in rows.select("channel_hash_bucket").distinct().collect()}  # as many as buckets at most
        clear_scope(spark, path, run_id, buckets, kept)
    finally:
        _delete(spark, beside)


def clear_scope(spark: SparkSession, path: str, run_id: str, buckets: tuple[int, int], but: Iterable[int] = ()) -> None:
    """Remove one run's rows in a range of buckets, but for some buckets; a table that isn't there stays so."""
    kept = set(but)
    for name in _parts(spark, f"{path}/run_id={run_id}"):
        b = int(name.rpartition("=")[2])
        if buckets[0] <= b <= buckets[1] and b not in kept:
            _delete(spark, f"{path}/run_id={run_id}/{name}")


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Replace a table and its schema."""
    rows, beside = _staged(df, path)
    try:
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        _delete(df.sparkSession, beside)


def write_run(df: DataFrame, path: str, run_id: str, *by: str) -> None:
    """Replace one run's rows; new columns are added, and those that the table has and df lacks are null.

    The table must be dealt by run_id and ``by``.
    """
    spark = df.sparkSession
    parts = ["run_id", *by]
    if _parts(spark, path):
        if (have := partition_columns(spark, path)) != parts:
            raise ValueError(f"the table is dealt by {have}, not by {parts}")
        for c, t in read_merged(spark, path).dtypes:
            if c not in df.columns and c != "run_id":
                df = df.withColumn(c, F.lit(None).cast(t))
    rows, beside = _staged(df.withColumn("run_id", F.lit(run_id)), path)
    try:
        _delete(spark, f"{path}/run_id={run_id}")
        rows.write.mode("append").partitionBy(*parts).parquet(path)
    finally:
        _delete(spark, beside)


def append(df: DataFrame, path: str) -> None:
    """Add rows; columns may be new or missing, as read_merged() gives the union of all."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table with the columns of all its files; what a file lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_lines(requests: DataFrame, path: str) -> DataFrame:
    """Request lines as text, one file for each provider, model and chunk; returns the registry with requests and bytes of each."""
    keys = ["provider", "model", "chunk_id"]
    lines = requests.select(*keys, "request_id", F.col("batch_line").alias("value")).repartition(*keys).sortWithinPartitions(*keys, "request_id")
    lines.drop("request_id").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy(*keys).text(path)
    return registry(requests).withColumn("path", F.concat(F.lit(path), *[F.concat(F.lit(f"/{k}="), F.col(k).cast("string")) for k in keys]))


def registry(requests: DataFrame) -> DataFrame:
    """Each file of request lines: how many, and how many bytes with line ends."""
    return requests.groupBy("provider", "model", "chunk_id").agg(F.count("*").alias("n_requests"), F.sum(F.octet_length("batch_line") + 1).alias("n_bytes"))


def submit(files: DataFrame, submitter: BatchSubmitter, run_id: str) -> DataFrame:
    """The job table: each file of a registry with the job that a provider has for it, or with the error of its submission.

    One row for each file, of which there are as many as chunks; a file that fails doesn't keep the others from being sent.
    """
    jobs = []
    for r in files.orderBy("provider", "model", "chunk_id").toLocalIterator():
        try:
            jobs.append((run_id, r["provider"], r["model"], r["chunk_id"], r["path"], submitter.submit(r["provider"], r["model"], r["path"]), "submitted", None))
        except Exception as e:  # noqa: BLE001
            jobs.append((run_id, r["provider"], r["model"], r["chunk_id"], r["path"], None, "error", repr(e)[:500]))
    return files.sparkSession.createDataFrame(jobs, "run_id string, provider string, model string, chunk_id int, path string, job_id string, status string, error string")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Frames as temporary views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def stamped(df: DataFrame, run_id: str) -> DataFrame:
    """df with the run and the time of writing; the time is the query's, hence the same in all rows."""
    return df.withColumns({"run_id": F.lit(run_id), "written_at": F.current_timestamp()})
