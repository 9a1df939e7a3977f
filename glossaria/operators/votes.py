"""Admitted votes, ranked channel votes and the channel summary of each model, both models in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import NOISE_LABEL
from glossaria.functions import text as X
from glossaria.operators.predictions import main_only

#: Ratios of doubles are rounded to so many digits; scores and weighted scores are summed as decimals, whose sums don't depend
#: on the order of addition.
DIGITS = 9
SCORE, WEIGHTED = "decimal(12,6)", "decimal(18,9)"


def total(c: Column) -> Column:
    return F.sum(c.cast(WEIGHTED)).cast("double")


def mean(c: Column) -> Column:
    """The mean of scores of six digits, half a unit rounded up: exact, hence the same in every engine."""
    units, n = F.sum((c * 1_000_000).cast("decimal(18,0)")).cast("long"), F.count(c)
    return F.when(n > 0, F.call_function("div", 2 * units + n, 2 * n) / 1_000_000)


def weight_of(kind: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), kind), F.lit(1.0))


def admitted(long: DataFrame, first_least: Column, second_least: Column, ratio: Column, factor: Column, weight: Column, seconds: Column) -> DataFrame:
    """Votes: first ranks with enough score, second ranks that also hold up against the first, each with its weight."""
    rank, noise = F.col("prediction_rank"), F.lower("label").rlike(NOISE_LABEL)
    second = seconds & (rank == 2) & (F.col("score") >= second_least) & (F.col("score_1") > 0) & (F.try_divide("score", "score_1") >= ratio)
    votes = main_only(long).filter(F.col("label").isNotNull() & ~noise & ((rank == 1) & (F.col("score") >= first_least) | second))
    return votes.withColumn("weighted_score", F.col("score") * weight * F.when(rank == 1, 1.0).otherwise(factor))


def admit(long: DataFrame, cfg: Config) -> DataFrame:
    given = map(F.lit, (cfg.primary_min_score, cfg.secondary_min_score, cfg.secondary_min_ratio, cfg.secondary_weight))
    return admitted(long, *given, weight_of(F.col("segment_type"), cfg.weights), F.lit(True))


def name_flags(votes: DataFrame, least: int = 2, share: float = 0.60) -> DataFrame:
    """(channel_id, lid_model, suppress): whether a Latin channel name speaks against segments that are mostly in other scripts.

    First ranks count, one for each segment; ``least`` distinct segments beside the name must have them.
    """
    name, script = F.col("segment_type") == "channel_name", F.col("dominant_script")
    per = votes.filter("prediction_rank = 1").groupBy("channel_id", "lid_model").agg(
        F.avg(F.when(~name, (~script.isin("latin", "none")).cast("double"))).alias("foreign"), F.countDistinct(F.when(~name, F.col("segment_id"))).alias("others"), F.max(F.coalesce(name & (script == "latin"), F.lit(False))).alias("latin_name")
    )
    return per.select("channel_id", "lid_model", ((F.col("others") >= least) & (F.coalesce("foreign", F.lit(0.0)) >= share) & F.col("latin_name")).alias("suppress"))


def without_latin_names(votes: DataFrame, least: int = 2, share: float = 0.60) -> DataFrame:
    """votes with weight 0 for channel names that name_flags() speaks against; off unless called."""
    flagged = votes.join(name_flags(votes, least, share), ["channel_id", "lid_model"], "left")
    zero = (F.col("segment_type") == "channel_name") & F.coalesce("suppress", F.lit(False))
    return flagged.withColumn("weighted_score", F.when(zero, 0.0).otherwise(F.col("weighted_score"))).drop("suppress")


def channel_votes(votes: DataFrame, by: str = "lid_model") -> DataFrame:
    """One row for each channel, model and label, ranked by weight, segments, best score, label. by: what tells models apart.

    Votes are first brought together by segment, so that segments are counted without a distinct count (which would expand every
    vote); where rows are dealt by channel already, neither step moves them. A segment has one type.
    """
    top1 = F.col("prediction_rank") == 1
    first = lambda c: F.when(top1, F.col(c))
    units = lambda c: F.sum((c * 1_000_000).cast("decimal(18,0)")).cast("long")
    whole = lambda c: F.sum(c.cast(WEIGHTED))
    each = votes.groupBy("channel_id", by, "label", "segment_id").agg(
        F.min("iso639_3").alias("iso639_3"), F.min("script").alias("script"), F.min("segment_type").alias("segment_type"), whole(F.col("weighted_score")).alias("w"), whole(first("weighted_score")).alias("w1"), F.count("*").alias("n"), F.count_if(top1).alias("n1"),
        units(F.col("score")).alias("u"), F.count("score").alias("c"), F.max("score").alias("m"), units(first("score")).alias("u1"), F.count(first("score")).alias("c1"), F.max(first("score")).alias("m1"),
    )
    sums = lambda c: F.sum(F.col(c).cast(WEIGHTED)).cast("double")
    rounded = lambda u, c: F.when(F.sum(c) > 0, F.call_function("div", 2 * F.sum(u) + F.sum(c), 2 * F.sum(c)) / 1_000_000)
    out = each.groupBy("channel_id", by, "label").agg(
        F.min("iso639_3").alias("iso639_3"), F.min("script").alias("script"), sums("w").alias("weighted_score"), sums("w1").alias("top1_weighted_score"),
        F.count("segment_id").alias("segment_count"), F.count(F.when(F.col("n1") > 0, F.col("segment_id"))).alias("top1_segment_count"), F.count(F.when(F.col("n1") < F.col("n"), F.col("segment_id"))).alias("top2_segment_count"),
        F.sum("n").alias("vote_count"), rounded("u", "c").alias("mean_segment_score"), F.max("m").alias("max_segment_score"), rounded("u1", "c1").alias("top1_mean_score"), F.max("m1").alias("top1_max_score"),
        F.array_sort(F.collect_set("segment_type")).alias("segment_types"),
    ).withColumn("segment_type_count", F.size("segment_types"))
    order = Window.partitionBy("channel_id", by).orderBy(F.desc("weighted_score"), F.desc("segment_count"), F.desc("max_segment_score"), F.asc("label"))
    return out.withColumn("language_rank", F.row_number().over(order))


#: Fields of a vote in language_votes_json.
VOTE = ["language_rank", "label", "iso639_3", "script", "weighted_score", "segment_count", "top1_segment_count", "top2_segment_count", "vote_count", "mean_segment_score", "max_segment_score", "segment_type_count", "segment_types"]


def ranks_in_columns(votes: DataFrame, by: str = "lid_model") -> DataFrame:
    """One row for each channel and model: its first two labels, with shares, ratios and the margin to the third."""
    at = lambda r, c: F.max(F.when(F.col("language_rank") == r, F.col(c)))
    df = votes.groupBy("channel_id", by).agg(
        *[at(1, c).alias(f"primary_{n}") for c, n in (("label", "label"), ("iso639_3", "iso"), ("script", "script"), ("weighted_score", "score"), ("segment_count", "segment_count"), ("top1_weighted_score", "top1_score"), ("top1_mean_score", "top1_mean"), ("mean_segment_score", "mean"), ("max_segment_score", "max"), ("top1_segment_count", "top1_segment_count"), ("top2_segment_count", "top2_segment_count"))],
        *[at(2, c).alias(f"secondary_{n}") for c, n in (("label", "label"), ("iso639_3", "iso"), ("script", "script"), ("weighted_score", "score"), ("segment_count", "segment_count"), ("top1_segment_count", "top1_segment_count"), ("segment_type_count", "type_count"), ("mean_segment_score", "mean"), ("max_segment_score", "max"))],
        at(3, "weighted_score").alias("third_score"), total(F.col("weighted_score")).alias("total_score"), total(F.col("top1_weighted_score")).alias("total_top1"),
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("language_rank") <= 10, F.struct(*VOTE))))).alias("language_votes_json"),
    )
    margin = F.col("secondary_score") - F.coalesce("third_score", F.lit(0.0))
    ratio = lambda a, b: F.round(X.safe_ratio(a, b), DIGITS)
    return df.withColumns({
        "vote_share": ratio(F.col("primary_score"), F.col("total_score")), "top1_vote_share": ratio(F.col("primary_top1_score"), F.col("total_top1")),
        "secondary_ratio": ratio(F.col("secondary_score"), F.col("primary_score")), "secondary_margin_ratio": ratio(margin, F.col("secondary_score")),
    })


def channel_summary(votes: DataFrame, valid: DataFrame) -> DataFrame:
    """One row for each channel with valid segments, and model: its first two labels, shares, ratios and margin.

    votes: of channel_votes(); valid: valid segments crossed with the models that saw them (channel_id, lid_model, segment_id,
    segment_type, clean_letter_count).
    """
    each = main_only(valid).groupBy("channel_id", "lid_model", "segment_id").agg(F.min("segment_type").alias("kind"), F.sum("clean_letter_count").alias("letters"))
    totals = each.groupBy("channel_id", "lid_model").agg(F.count("segment_id").alias("valid_segment_count"), F.size(F.collect_set("kind")).cast("long").alias("valid_type_count"), F.sum("letters").alias("total_letters"))
    return totals.join(ranks_in_columns(votes), ["channel_id", "lid_model"], "left")
