"""Cohorts: the largest channels, and a hash-ordered sample of a band, without a global window over all rows; a run for each
cohort, and what the runs say together."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.functions import text as X
from glossaria.operators.dedup import keep_top, row_hash


def usable(channels: DataFrame, size: str, ts: str | None = None) -> DataFrame:
    """One row for each channel with a size: the latest, then the largest, then the smallest row hash."""
    order = [*([F.desc_nulls_last(ts)] if ts else []), F.desc_nulls_last(size), row_hash(channels).asc()]
    return keep_top(channels.filter(F.col("channel_id").isNotNull() & F.col(size).isNotNull()), ["channel_id"], order)


def top_n(channels: DataFrame, size: str, n: int, cohort: str = "top") -> DataFrame:
    """The n largest, ranked: a distributed top-k first, so that the one-task window sees n rows."""
    best = channels.orderBy(F.desc(size), F.asc("channel_id")).limit(n)
    return best.withColumn("selection_rank", F.row_number().over(Window.orderBy(F.desc(size), F.asc("channel_id")))).withColumn("cohort", F.lit(cohort))


def band_sample(channels: DataFrame, size: str, least: int, taken: DataFrame, n: int, seed: str, strategy: str = "xxhash64", cohort: str = "band") -> DataFrame:
    """n channels of at least a size and at most the smallest one taken, none of them taken already, in hash order."""
    most = taken.agg(F.min(size).alias("_most"))
    pool = channels.filter(F.col(size) >= least).join(F.broadcast(most), F.col(size) <= F.col("_most"), "left_semi")
    pool = pool.join(taken.select("channel_id"), "channel_id", "left_anti").withColumn("sample_hash", X.order_hash("channel_id", F.lit(seed), strategy=strategy))
    drawn = pool.orderBy("sample_hash", "channel_id").limit(n)
    return drawn.withColumn("selection_rank", F.row_number().over(Window.orderBy("sample_hash", "channel_id"))).withColumn("cohort", F.lit(cohort)).drop("sample_hash")


def cohort_stats(cohorts: DataFrame, size: str) -> DataFrame:
    """Each cohort: channels, the smallest size and how many have it, and the median (the smallest size that half of the channels
    don't exceed). Sizes are counted first, and all is said of the counts, so the cohorts are read once."""
    per = cohorts.groupBy("cohort", size).agg(F.count("*").alias("n"))
    upto = per.withColumns({"upto": F.sum("n").over(Window.partitionBy("cohort").orderBy(size)), "total": F.sum("n").over(Window.partitionBy("cohort"))})
    out = upto.groupBy("cohort").agg(F.min(F.struct(size, "n")).alias("low"), F.max("total").alias("channels"), F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col(size))).alias("median"))
    return out.select("cohort", F.col(f"low.{size}").alias("cutoff"), "channels", F.col("low.n").alias("at_cutoff"), "median")


def cutoff(universe: DataFrame, top: DataFrame, size: str) -> DataFrame:
    """One row: the smallest size of the top cohort, and how many channels have just that, in all, in the cohort and beyond it."""
    low = top.agg(F.min(size).alias("cutoff"))
    at = lambda df, name: df.join(F.broadcast(low), F.col(size) == F.col("cutoff")).agg(F.count("*").alias(name))
    return low.crossJoin(at(universe, "at_cutoff")).crossJoin(at(top, "in_top")).withColumn("outside", F.col("at_cutoff") - F.col("in_top"))


def selected(rows: DataFrame, key: str, cohorts: DataFrame) -> DataFrame:
    """The rows of the cohorts' channels, with the cohort; a channel of two cohorts has its rows in both."""
    ids = cohorts.select("cohort", F.col("channel_id").alias("_selected"))
    return rows.join(ids, F.col(key).cast("string") == F.col("_selected")).drop("_selected")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, by column name; a column that a frame lacks is null."""
    if not frames:
        raise ValueError("no frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_cohorts(cohorts: DataFrame, names: list[str], run: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """run(name, ids) for each cohort, a call for each; the results together, with the cohort and its run's id."""
    if len(set(names)) < len(names):
        raise ValueError("cohort names repeat")
    return union_all([run(n, cohorts.filter(F.col("cohort") == n).select("channel_id")).withColumns({"cohort": F.lit(n), "run_id": F.lit(f"run_{n}")}) for n in names])


RUN_LOG = "cohort string, run_id string, pool string, started timestamp, ended timestamp, status string, rows long, error string"


def run_side_by_side(spark: SparkSession, names: list[str], run: Callable[[str], int], at_once: int = 4) -> DataFrame:
    """run(name) for each cohort, several at once, each in a scheduler pool of its name; returns the run log.

    run does the whole work of a cohort, its outputs included, and returns the rows it has written; it must have scratch tables of
    its own. One that fails is logged with its error, and the others go on. With spark.scheduler.mode=FAIR the pools share the
    cluster; otherwise the jobs queue, but a cohort's small stages still fill what another one leaves idle.
    """
    if len(set(names)) < len(names):
        raise ValueError("cohort names repeat")
    now = lambda: datetime.datetime.now(datetime.timezone.utc)

    def one(name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        began = now()
        try:
            return name, f"run_{name}", name, began, run(name), None, now()
        except Exception as e:  # noqa: BLE001
            return name, f"run_{name}", name, began, None, repr(e)[:500], now()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        # each call inherits the caller's local properties, in a copy of its own
        done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), n) for n in names]]
    log = [(n, r, p, began, ended, "failed" if error else "succeeded", rows, error) for n, r, p, began, rows, error, ended in done]
    return spark.createDataFrame(log, RUN_LOG)


def agreement_by_cohort(summaries: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Agreement summaries of all runs (with run_id) with the cohort that each run has; a run without one keeps null."""
    return summaries.join(F.broadcast(cohorts.select("cohort").distinct().withColumn("run_id", F.concat(F.lit("run_"), "cohort"))), "run_id", "left")


def cohort_results(cohorts: DataFrame, results: DataFrame) -> DataFrame:
    """Each selected channel with its run's result, or with nulls where the run has none."""
    return cohorts.withColumn("run_id", F.concat(F.lit("run_"), "cohort")).join(results.drop("cohort"), ["run_id", "channel_id"], "left")


def status_summary(results: DataFrame, size: str) -> DataFrame:
    """By cohort and statuses: channels, mean and median size, and those that need a person."""
    return results.groupBy("cohort", "run_id", "language_status", "consensus_status").agg(
        F.count("*").alias("channels"), F.round(F.avg(size), 6).alias("mean_size"), F.percentile_approx(size, 0.5, 10000).alias("median_size"), F.count_if(F.coalesce("requires_manual", F.lit(False))).alias("manual")
    )


def language_review(results: DataFrame) -> DataFrame:
    """By cohort and consensus: channels, both models' mean shares, credible mixed ones and those with Hindi or Indic signals."""
    signal = F.coalesce(F.col("hindi_indic_status") != "no_hindi_or_indic_signal", F.lit(False))
    return results.groupBy("cohort", "run_id", "consensus_label", "consensus_iso", "consensus_rollup", "requires_manual").agg(
        F.count("*").alias("channels"), *[F.round(F.avg(f"{p}_vote_share"), 6).alias(f"{p}_mean_share") for p in "ab"], F.count_if(F.coalesce("mixed_credible", F.lit(False))).alias("credible"), F.count_if(signal).alias("hindi_indic")
    )


def review_queue(results: DataFrame) -> DataFrame:
    """Channels that a person should look at."""
    return results.filter(F.coalesce("requires_manual", F.lit(False)) | (F.col("language_status") != "classified") | F.coalesce("mixed_credible", F.lit(False)) | (F.col("hindi_indic_status") != "no_hindi_or_indic_signal"))
