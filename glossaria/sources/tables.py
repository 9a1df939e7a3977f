"""Reading tables: by name or path, optional ones, current runs, text lines."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossaria.config import Config


#: Conditions of a table or a path that isn't there.
MISSING = ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND")


def read_table(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(where) if "/" in where else spark.table(where)


def read_optional(spark: SparkSession, where: str, schema: StructType) -> DataFrame:
    """The table, or an empty one with typed columns where there is none."""
    try:
        return read_table(spark, where)
    except AnalysisException as e:
        if e.getCondition() not in MISSING:
            raise
        return spark.createDataFrame([], schema)


def current_run(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows of this run and its range of buckets; the conditions are on partition columns."""
    return df.filter((F.col("run_id") == cfg.run_id) & (F.col("inference_hash_buckets") == cfg.buckets) & F.col("channel_hash_bucket").between(cfg.bucket_start, cfg.bucket_end))


def current_scope(df: DataFrame, cfg: Config) -> DataFrame:
    full = cfg.bucket_start == 0 and cfg.bucket_end == cfg.buckets - 1
    df = df.filter((F.col("run_id") == cfg.run_id) & (F.col("is_full_bucket_range") == full))
    return df if full else df.filter((F.col("bucket_start") == cfg.bucket_start) & (F.col("bucket_end") == cfg.bucket_end))


def result_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Lines of result files, without those too short to hold anything."""
    return spark.read.option("recursiveFileLookup", recursive).text(path).filter(F.length(F.trim("value")) > 2)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A small JSON file (a list of records) or CSV file (a header; all columns strings) as a frame."""
    if path.endswith(".json"):
        return spark.createDataFrame(json.loads(Path(path).read_text(encoding="utf-8")))
    if path.endswith(".csv"):
        with open(path, newline="", encoding="utf-8") as f:
            rows = list(csv.reader(f))
        return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
    raise ValueError(f"neither JSON nor CSV: {path}")
