"""Two models side by side, and the consensus of each channel as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import ARABIC_FAMILY_ISO
from glossaria.functions import text as X


def canonical_iso(iso: Column | str) -> Column:
    return F.when(X.col(iso).isin(ARABIC_FAMILY_ISO), F.lit("ara")).otherwise(X.col(iso))


def compare_segments(long: DataFrame, a: str, b: str) -> DataFrame:
    """First labels of both models for each segment; agreement is null where only the second is missing."""
    top = long.filter("prediction_rank = 1 or prediction_rank is null")
    side = lambda m, p: top.filter(F.col("lid_model") == m).select("segment_id", "channel_id", F.col("label").alias(f"{p}_label"), F.col("iso639_3").alias(f"{p}_iso"), F.col("script").alias(f"{p}_script"), F.col("score").alias(f"{p}_score"))
    df = side(a, "a").join(side(b, "b"), ["segment_id", "channel_id"], "full_outer")
    agree = lambda c: F.col(f"a_{c}").isNotNull() & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return df.withColumns({"agree_exact": agree("label"), "agree_iso": agree("iso"), "agree_script": agree("script")})


def compare_channels(summary: DataFrame, a: str, b: str) -> DataFrame:
    """Both models' summaries of a channel, with clusters, high-risk flags and agreement that is never null."""
    keep = [c for c in summary.columns if c not in ("channel_id", "lid_model", "language_votes_json")]
    side = lambda m, p: summary.filter(F.col("lid_model") == m).select("channel_id", *[F.col(c).alias(f"{p}_{c}") for c in keep], F.lit(True).alias(f"{p}_present"))
    df = side(a, "a").join(side(b, "b"), "channel_id", "full_outer")
    for p in ("a", "b"):
        for r in ("primary", "secondary"):
            df = df.withColumn(f"{p}_{r}_cluster", X.cluster_of(f"{p}_{r}_label", f"{p}_{r}_iso")).withColumn(f"{p}_{r}_high_risk", X.high_risk(f"{p}_{r}_label"))
    same = lambda x, y: F.coalesce(x.isNotNull() & y.isNotNull() & (x == y), F.lit(False))
    c = F.col
    return df.withColumns({
        "agree_exact_primary": same(c("a_primary_label"), c("b_primary_label")), "agree_iso_primary": same(canonical_iso("a_primary_iso"), canonical_iso("b_primary_iso")),
        "agree_script_primary": same(c("a_primary_script"), c("b_primary_script")), "agree_cluster_primary": same(c("a_primary_cluster"), c("b_primary_cluster")),
        "agree_exact_secondary": same(c("a_secondary_label"), c("b_secondary_label")), "agree_cluster_secondary": same(c("a_secondary_cluster"), c("b_secondary_cluster")),
    })


def consensus_columns(cfg: Config) -> dict[str, Column]:
    """The consensus of a row of compare_channels(), as expressions: the first rule that fits decides."""
    c, null = F.col, F.lit(None).cast("string")
    a, b = c("a_primary_label"), c("b_primary_label")
    share = lambda p: F.coalesce(F.nanvl(c(f"{p}_vote_share"), F.lit(0.0)), F.lit(0.0))
    sa, sb, ra, rb = share("a"), share("b"), c("a_primary_high_risk"), c("b_primary_high_risk")
    ca, cb, ia, ib = c("a_primary_cluster"), c("b_primary_cluster"), c("a_primary_iso"), c("b_primary_iso")
    roll = lambda p: F.coalesce(c(f"{p}_primary_cluster"), c(f"{p}_primary_iso"))

    def row(status: str, label: Column = null, cluster: Column = null, rollup: Column = null, manual: bool = False) -> Column:
        return F.struct(F.lit(status).alias("consensus_status"), label.alias("consensus_label"), cluster.alias("consensus_cluster"), rollup.alias("consensus_rollup"), F.lit(manual).alias("requires_manual"))

    review = row("model_disagreement_needs_review", manual=True)
    arabic = F.coalesce(ia.isin(ARABIC_FAMILY_ISO) & ib.isin(ARABIC_FAMILY_ISO), F.lit(False))
    rules = [
        (a.isNull() & b.isNull(), row("insufficient_text")),
        ((a == b) & ra & (sa >= cfg.high_share) & (sb >= cfg.high_share), row("high_risk_tail_exact_agreement", a, ca, roll("a"))),
        ((a == b) & ra, row("high_risk_tail_label_needs_review", null, ca, roll("a"), manual=True)),
        (a == b, row("exact_model_agreement", a, ca, roll("a"))),
        (b.isNull() & (sa >= cfg.high_share) & ~ra, row("openlid_high_confidence_glotlid_missing_or_error", a, ca, roll("a"))),
        (b.isNull(), row("openlid_high_confidence_glotlid_missing_or_error", null, ca, roll("a"), manual=True)),
        (a.isNull() & (sb >= cfg.high_share) & ~rb, row("glotlid_fallback_openlid_low_confidence", b, cb, roll("b"))),
        (a.isNull(), review),
        (arabic, row("taxonomy_normalized_agreement", F.lit("ara_Arab"), F.coalesce(ca, cb), F.lit("ara"))),
        (ra | rb, row("high_risk_tail_label_needs_review", manual=True)),
        (F.coalesce(ia == ib, F.lit(False)), row("iso_or_script_variant_agreement", null, F.coalesce(ca, cb), F.coalesce(ca, cb, ia))),
        (F.coalesce(ca == cb, F.lit(False)), row("cluster_model_agreement", null, ca, ca)),
        ((sa < cfg.low_share) & (sb >= cfg.high_share), row("glotlid_fallback_openlid_low_confidence", b, cb, roll("b"))),
    ]
    out = F.when(*rules[0])
    for when, what in rules[1:]:
        out = out.when(when, what)
    return {"_consensus": out.otherwise(review)}


def consensus(compared: DataFrame, cfg: Config) -> DataFrame:
    """Adds consensus status, label, language, script, cluster, rollup label, source and whether a person must decide."""
    df = compared.withColumns(consensus_columns(cfg)).select("*", "_consensus.*").drop("_consensus")
    part = lambda k: F.get(F.split("consensus_label", "_"), F.lit(k))
    status = F.col("consensus_status")
    source = (
        F.when(status == "taxonomy_normalized_agreement", "taxonomy_normalized").when(status == "high_risk_tail_exact_agreement", "fasttext_tail_agreement")
        .when(F.col("requires_manual"), "manual_adjudication_required")
        .when(status.isin("exact_model_agreement", "iso_or_script_variant_agreement", "cluster_model_agreement", "openlid_high_confidence_glotlid_missing_or_error", "glotlid_fallback_openlid_low_confidence"), "fasttext_agreement")
        .otherwise("fasttext_unlabeled_consensus")
    )
    return df.withColumns({"consensus_iso": part(0), "consensus_script": part(1), "consensus_source": source})
