"""Summaries, parity checks and acceptance checks; checks return rows (check, ok, detail) instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions import text as X


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("channels"))


def language_summary(final: DataFrame) -> DataFrame:
    """Each consensus label (null is a group): channels, manual, mixed and high-risk ones, mean and median share."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return final.groupBy("consensus_label").agg(F.count("*").alias("channels"), n("requires_manual").alias("manual"), n("mixed_screen").alias("screened"), n("mixed_credible").alias("credible"), F.round(F.avg("a_vote_share"), 6).alias("mean_share"), F.percentile_approx("a_vote_share", 0.5, 10000).alias("median_share"))


def agreement_summary(compared: DataFrame) -> DataFrame:
    """By first model's language and script: agreement rates; the cluster rate counts channels with both clusters only."""
    both = F.col("a_primary_cluster").isNotNull() & F.col("b_primary_cluster").isNotNull()
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return compared.filter("a_primary_label is not null and b_primary_label is not null").groupBy("a_primary_iso", "a_primary_script").agg(
        F.count("*").alias("channels"), rate("agree_exact_primary").alias("exact_rate"), rate("agree_iso_primary").alias("iso_rate"), rate("agree_script_primary").alias("script_rate"),
        F.round(F.avg(F.when(both, F.col("agree_cluster_primary").cast("double"))), 6).alias("within_cluster_rate"), F.sum(both.cast("long")).alias("with_clusters"), F.round(F.avg("a_vote_share"), 6).alias("mean_share"),
    )


def universe_parity(valid: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """Each model: segments in both, missing, unexpected, and equality of order-free checksums."""
    one = valid.select("segment_id").crossJoin(F.broadcast(valid.sparkSession.createDataFrame([(m,) for m in models], "lid_model string")))
    seen = predictions.select("segment_id", "lid_model").distinct()
    both = one.withColumn("v", F.lit(1)).join(seen.withColumn("p", F.lit(1)), ["segment_id", "lid_model"], "full_outer")
    mark = F.conv(F.substring(F.md5("segment_id"), 1, 8), 16, 10).cast("decimal(38,0)")
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    sums = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), mark)), F.lit(0).cast("decimal(38,0)"))
    return both.groupBy("lid_model").agg(n(F.col("v").isNotNull() & F.col("p").isNotNull()).alias("matched"), n(F.col("p").isNull()).alias("missing"), n(F.col("v").isNull()).alias("unexpected"), (sums("v") == sums("p")).alias("checksum_equal"))


def checksum_parity(valid: DataFrame, predictions: DataFrame, bucket: Column, model: str) -> DataFrame:
    """Each bucket: counts and order-free checksums of valid segments and of a model's predictions, and whether they are equal.

    bucket: an expression on channel_id. A bucket that only one side has is not equal.
    """
    mark = F.conv(F.substring(F.md5("segment_id"), 1, 8), 16, 10).cast("decimal(38,0)")

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("channel_id", "segment_id").distinct().groupBy(bucket.alias("bucket")).agg(F.count("*").alias(f"{p}_n"), F.sum(mark).alias(f"{p}_sum"))

    both = side(valid, "valid").join(side(predictions.filter(F.col("lid_model") == model), "predicted"), "bucket", "full_outer")
    equal = F.col("valid_n").eqNullSafe(F.col("predicted_n")) & F.col("valid_sum").eqNullSafe(F.col("predicted_sum"))
    return both.fillna(0, ["valid_n", "predicted_n"]).select("bucket", "valid_n", "predicted_n", equal.alias("equal"))


def _halves(text: Column, strategy: str) -> tuple[Column, Column]:
    """Two 64-bit values of a text: xxhash64 of it and of it with a prefix, or the halves of its md5, which other engines have."""
    if strategy == "xxhash64":
        return F.xxhash64(text).cast("decimal(38,0)"), F.xxhash64(F.concat(F.lit("2|"), text)).cast("decimal(38,0)")
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))


def signatures(df: DataFrame, bucket: Column, strategy: str = "xxhash64") -> DataFrame:
    """(bucket, n, low, high): rows of each bucket and two order-free sums over channel and segment together, in decimal(38,0).

    A segment under the wrong channel changes the sums, and so does a row that is repeated or lost. What is equal in both sums is
    equal but for a chance of about 2 ** -128.
    """
    low, high = _halves(F.concat_ws("|", "channel_id", "segment_id"), strategy)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"))


def signature_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of two signatures(): each bucket with both counts and whether it is equal; a bucket that one side lacks isn't."""
    side = lambda df, p: df.select("bucket", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "low", "high")])
    both = side(left, "left").join(side(right, "right"), "bucket", "full_outer")
    same = [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ("n", "low", "high")]
    return both.select("bucket", *[F.coalesce(f"{p}_n", F.lit(0)).alias(f"{p}_n") for p in ("left", "right")], (same[0] & same[1] & same[2]).alias("equal"))


def drill_down(left: DataFrame, right: DataFrame, parity: DataFrame, bucket: Column) -> DataFrame:
    """(channel_id, segment_id, left_n, right_n): what differs, from the unequal buckets only.

    The numbers of these (as many as buckets at most) become a filter: where ``bucket`` is a column that a table's folders are
    dealt by, the equal buckets are not read again.
    """
    unequal = [r["bucket"] for r in parity.filter("not equal").select("bucket").collect()]
    inside = bucket.isin([b for b in unequal if b is not None]) | (bucket.isNull() if None in unequal else F.lit(False))
    count = lambda df, p: df.filter(inside).groupBy("channel_id", "segment_id").agg(F.count("*").alias(f"{p}_n"))
    x, y = count(left, "left").alias("x"), count(right, "right").alias("y")
    on = F.col("x.channel_id").eqNullSafe(F.col("y.channel_id")) & F.col("x.segment_id").eqNullSafe(F.col("y.segment_id"))
    both = x.join(y, on, "full_outer").select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("channel_id", "segment_id")], *[F.coalesce(f"{p}_n", F.lit(0)).alias(f"{p}_n") for p in ("left", "right")])
    return both.filter("left_n <> right_n")


def distributions(decided: DataFrame) -> DataFrame:
    """(metric, value, channels, manual, mean_share): all distributions of the decided channels from one scan, by grouping sets.

    Statuses, manual flags (also by status), sources, scripts, whether both models' labels have clusters and agree in them,
    which models' second labels were screened or credible, why a screened channel was rejected, and the high-risk
    labels that were kept; metric "all" is the total. A null value is a group of its own, named "none".
    """
    c, false = F.col, F.lit(False)
    both = c("a_primary_cluster").isNotNull() & c("b_primary_cluster").isNotNull()
    labels = c("a_primary_label").isNotNull() & c("b_primary_label").isNotNull()
    coverage = F.when(~labels, "not_both_labels").when(~both, "not_both_clusters").when(c("agree_cluster_primary"), "clusters_agree").otherwise("clusters_differ")
    level = lambda screen, credible: F.when(F.coalesce(c(credible), false), "credible").when(F.coalesce(c(screen), false), "screened").otherwise("none")
    metrics = {
        "consensus_status": c("consensus_status"), "requires_manual": c("requires_manual").cast("string"), "consensus_source": c("consensus_source"), "consensus_script": c("consensus_script"), "cluster_coverage": coverage,
        "a_mixed": level("a_screen", "a_credible"), "b_mixed": level("b_screen", "b_credible"), "mixed": level("mixed_screen", "mixed_credible"),
        "rejection_reason": F.when(c("mixed_screen") & ~c("mixed_credible"), c("mixed_rejection_reason")), "kept_tail_label": F.when(X.high_risk("consensus_label"), c("consensus_label")),
        "agreement": F.when(~labels, "not_both_labels").when(c("agree_exact_primary"), "exact").when(c("agree_iso_primary"), "iso").when(c("agree_script_primary"), "script").otherwise("none"),
    }
    df = decided.select(*[e.alias(n) for n, e in metrics.items()], c("requires_manual").alias("_manual"), c("a_vote_share").alias("_share"))
    names = list(metrics)
    sets = [[], *[[n] for n in names], ["consensus_status", "requires_manual"]]
    grouped = df.groupingSets(sets, *names).agg(F.grouping_id().alias("_set"), F.count("*").alias("channels"), F.count_if(F.coalesce("_manual", false)).alias("manual"), F.round(F.avg("_share"), 6).alias("mean_share"))
    name = lambda s: "_by_".join(s) if s else "all"
    shown = lambda s: F.concat_ws("|", *[F.coalesce(n, F.lit("none")) for n in s]) if s else F.lit("all")
    which = lambda s: sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in s)
    out = F.coalesce(*[F.when(F.col("_set") == which(s), F.struct(F.lit(name(s)).alias("metric"), shown(s).alias("value"))) for s in sets])
    return grouped.select(out.alias("o"), "channels", "manual", "mean_share").select("o.*", "channels", "manual", "mean_share")


def strata_counts(sample: DataFrame, least: int) -> DataFrame:
    """Channels of each stratum of a sample, and whether they are fewer than wanted."""
    return sample.groupBy("primary_stratum").agg(F.count("*").alias("channels"), (F.count("*") < least).alias("below_minimum"))


def model_qa(summary: DataFrame) -> DataFrame:
    """Each model: channels with valid segments, with a first and a second label, and with a high-risk first label."""
    return summary.groupBy("lid_model").agg(F.count("*").alias("channels"), F.count("primary_label").alias("with_primary"), F.count("secondary_label").alias("with_secondary"), F.count_if(X.high_risk("primary_label")).alias("high_risk"))


def unclassified(universe: DataFrame, features: DataFrame, final: DataFrame) -> DataFrame:
    """Channels of the universe without a valid segment or that are left without a label, and the texts they had."""
    df = universe.select("channel_id").join(final.select("channel_id", "language_status", "consensus_label"), "channel_id", "left").join(features.select("channel_id", "segment_count", "valid_segment_count", "letters"), "channel_id", "left")
    return df.fillna(0, ["segment_count", "valid_segment_count", "letters"]).filter("valid_segment_count = 0 or language_status = 'insufficient_text'")


def acceptance(universe: DataFrame, final: DataFrame) -> DataFrame:
    """(check, ok, detail): one row for each channel of the universe, no other, shares within 0..1, credible implies screened."""
    u, f = universe.agg(F.countDistinct("channel_id").alias("u")), final.agg(F.count("*").alias("n"), F.countDistinct("channel_id").alias("d"), F.sum(F.coalesce(~F.col("a_vote_share").between(0, 1), F.lit(False)).cast("long")).alias("s"), F.sum((F.coalesce("mixed_credible", F.lit(False)) & ~F.coalesce("mixed_screen", F.lit(False))).cast("long")).alias("m"))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
    rows = F.array(row("one_row_per_channel", F.col("n") == F.col("d"), F.col("n") - F.col("d")), row("all_channels_present", F.col("u") == F.col("d"), F.col("u") - F.col("d")), row("shares_in_range", F.col("s") == 0, F.col("s")), row("credible_implies_screen", F.col("m") == 0, F.col("m")))
    return u.crossJoin(f).select(F.explode(rows).alias("r")).select("r.*")


def source_confusion(final: DataFrame) -> DataFrame:
    return final.groupBy("source_language", "a_primary_iso", "consensus_iso").agg(F.count("*").alias("channels"))


