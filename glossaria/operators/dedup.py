"""Deterministic deduplication and top-n by windows with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A hash of a row's values, each with its length before it and nulls as a dash, so that different rows have different texts."""

    def told(c: str) -> Column:
        value = F.col(c).cast("string") if df.schema[c].dataType.typeName() not in ("struct", "array", "map") else F.to_json(F.struct(c))
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(c) for c in columns or df.columns]), 256)


def keep_top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in a total order; Spark limits each task's groups before it shuffles."""
    out = df.withColumn(rank or "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "_rn") <= n)
    return out if rank else out.drop("_rn")


def latest(df: DataFrame, keys: list[str], ts: str | None) -> DataFrame:
    """One row a key: the latest, then the smallest row hash."""
    order = [F.desc_nulls_last(ts)] if ts else []
    return keep_top(df, keys, [*order, row_hash(df).asc()])


def most_recent(df: DataFrame, parent: str, key: str, ts: str, n: int) -> DataFrame:
    """The n latest children of each parent, ties by key, then row hash."""
    return keep_top(df, [parent], [F.desc_nulls_last(ts), F.asc_nulls_last(key), row_hash(df).asc()], n, "recency_rank")


def stable_key(df: DataFrame, key: str) -> Column:
    """The trimmed key, or a key from the row's hash where it is blank."""
    return F.when(F.trim(F.col(key)) != "", F.trim(F.col(key))).otherwise(F.concat(F.lit("rowhash:"), row_hash(df)))


def dedupe_qa(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, and rows that deduplication drops."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.lit(source).alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_dropped"))
