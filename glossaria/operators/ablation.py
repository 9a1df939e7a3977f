"""Votes under several configurations in one pass over stored predictions, and how far each departs from the baselines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import LEGACY_WEIGHTS, SEGMENT_WEIGHTS
from glossaria.functions import text as X
from glossaria.operators import mixed, votes

#: Languages whose channels are counted for each variant.
COUNTED = ["srd", "ast", "vec", "gug", "eng", "spa", "ita", "por"]
CONSENSUS = "default_consensus"


@dataclass(frozen=True)
class Variant:
    name: str
    model: str
    weights: dict[str, float] = field(default_factory=lambda: dict(SEGMENT_WEIGHTS))
    primary_min: float = 0.20
    secondary_min: float = 0.35
    ratio: float = 0.50
    secondary_weight: float = 0.20
    use_second: bool = True
    min_letters: int = 0
    rollup: bool = False


def default_variants() -> list[Variant]:
    described = lambda w: {**SEGMENT_WEIGHTS, "channel_description": w}
    return [
        Variant("legacy_a", "a", LEGACY_WEIGHTS, 0.0, 0.0, 0.0, 0.35), Variant("default_a", "a"), Variant("no_second_a", "a", use_second=False), Variant("description_1_a", "a", described(1.0)), Variant("no_description_a", "a", described(0.0)),
        Variant("min_letters_50_a", "a", min_letters=50), Variant("top1_rollup_a", "a", use_second=False, rollup=True), Variant("default_b", "b"), Variant("no_second_b", "b", use_second=False),
    ]


def outcomes(spark: SparkSession, long: DataFrame, variants: list[Variant], cfg: Config) -> DataFrame:
    """(variant, channel_id, label, iso, screen, credible): each channel's first label under each variant, and its mixed flags.

    long: of predictions.long(). Votes without weight don't count, so that a kind of segment that weighs nothing gives no label.
    """
    kinds = sorted({k for v in variants for k in v.weights})
    rows = [(v.name, v.model, [v.weights.get(k, 1.0) for k in kinds], v.primary_min, v.secondary_min, v.ratio, v.secondary_weight, v.use_second, v.min_letters, v.rollup) for v in variants]
    table = spark.createDataFrame(rows, "variant string, lid_model string, w array<double>, p1 double, p2 double, r2 double, w2 double, seconds boolean, letters int, rollup boolean")
    c = F.col
    df = long.join(F.broadcast(table), "lid_model").filter(F.coalesce("clean_letter_count", F.lit(0)) >= c("letters"))
    place = F.array_position(F.array(*map(F.lit, kinds)), c("segment_type")).cast("int")
    admitted = votes.admitted(df, c("p1"), c("p2"), c("r2"), c("w2"), F.coalesce(F.get("w", place - 1), F.lit(1.0)), c("seconds")).filter("weighted_score > 0")
    named = admitted.withColumn("label", F.when(c("rollup"), c("iso639_3")).otherwise(c("label")))
    first = votes.ranks_in_columns(votes.channel_votes(named, "variant"), "variant")
    for r in ("primary", "secondary"):
        first = first.withColumn(f"{r}_cluster", X.cluster_of(f"{r}_label", f"{r}_iso"))
    flags = mixed.evidence(F.col, F.lit(False), cfg)
    return first.withColumn("secondary_high_risk", X.high_risk("secondary_label")).select("variant", "channel_id", c("primary_label").alias("label"), c("primary_iso").alias("iso"), flags["screen"].alias("screen"), flags["credible"].alias("credible"))


def consensus_outcomes(decided: DataFrame) -> DataFrame:
    """The consensus of both models as one more variant. decided: of consensus() and mixed_language()."""
    return decided.select(F.lit(CONSENSUS).alias("variant"), "channel_id", F.col("consensus_label").alias("label"), F.col("consensus_iso").alias("iso"), F.col("mixed_screen").alias("screen"), F.col("mixed_credible").alias("credible"))


def summary(cells: DataFrame, candidates: DataFrame, baseline: str = "default_a") -> DataFrame:
    """One row for each variant: counts, and channels whose label or credible flag is not the baseline's or the consensus's.

    cells: of outcomes() and consensus_outcomes(); candidates: (channel_id) with a Hindi or Indic signal. A label that a baseline
    has and the variant lacks counts as changed.
    """
    c = F.col
    of = lambda v, x: F.max(F.when(c("variant") == v, c(x)))
    bases = cells.groupBy("channel_id").agg(of(baseline, "label").alias("base"), of(CONSENSUS, "label").alias("agreed"), of(CONSENSUS, "credible").alias("agreed_credible"))
    grid = bases.crossJoin(F.broadcast(cells.select("variant").distinct())).join(cells, ["variant", "channel_id"], "left")
    grid = grid.join(candidates.select("channel_id", F.lit(True).alias("candidate")), "channel_id", "left")
    n = lambda e: F.count_if(F.coalesce(e, F.lit(False)))
    changed = lambda b: b.isNotNull() & ~c("label").eqNullSafe(b)
    there = c("label").isNotNull() | c("screen").isNotNull()
    out = grid.groupBy("variant").agg(
        F.count("label").alias("classified"), n(c("screen")).alias("screened"), n(c("credible")).alias("credible"), n(X.high_risk("label")).alias("high_risk"), n(c("iso") == "hin").alias("hindi"), n(c("candidate") & there).alias("hindi_indic"),
        *[n(c("iso") == i).alias(f"n_{i}") for i in COUNTED],
        n(changed(c("base"))).alias("changed_base"), F.count("base").alias("_b"), n(changed(c("agreed"))).alias("changed_consensus"), F.count("agreed").alias("_a"),
        n(F.coalesce("credible", F.lit(False)) != F.coalesce("agreed_credible", F.lit(False))).alias("changed_credible"),
    )
    share = lambda x, y, name: F.round(F.try_divide(x, y), 6).alias(name)
    return out.select("*", share("changed_base", "_b", "share_changed_base"), share("changed_consensus", "_a", "share_changed_consensus")).drop("_a", "_b")
