"""The final table: every channel of the universe once, with its language status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import SOUTH_ASIAN_ISO
from glossaria.functions import text as X


def final_channels(universe: DataFrame, decided: DataFrame, audit: DataFrame, bilingual: bool = False) -> DataFrame:
    """universe: (channel_id, source_language); decided: of consensus() and mixed_language(); channels without either stay."""
    keep = ["channel_id", "a_primary_label", "b_primary_label", "a_primary_iso", "b_primary_iso", "a_primary_high_risk", "b_primary_high_risk", "a_vote_share", "b_vote_share", "consensus_status", "consensus_source", "consensus_label", "consensus_iso", "consensus_script", "consensus_cluster", "consensus_rollup", "requires_manual", "mixed_screen", "mixed_credible", "mixed_rejection_reason"]
    df = universe.join(decided.select(*keep), "channel_id", "left").join(audit.select("channel_id", "hindi_indic_status", "source_hi_disagreement", "source_indic_disagreement", "hindi_keywords", "indic_keywords", "non_latin_any"), "channel_id", "left")
    none = F.col("a_primary_label").isNull() & F.col("b_primary_label").isNull()
    status = (
        F.when(none | (F.col("consensus_status") == "insufficient_text"), "insufficient_text")
        .when(F.coalesce("mixed_credible", F.lit(False)), "bilingual" if bilingual else "mixed_language_candidate")
        .when(F.coalesce("requires_manual", F.lit(False)), "needs_review").otherwise("classified")
    )
    return df.withColumn("language_status", status)


def romanized_override(final: DataFrame, cfg: Config, least: int = 1) -> DataFrame:
    """Off by default: an English consensus with Indic words and a South Asian model label takes that label; originals stay."""
    second = F.col("b_primary_iso").isin(SOUTH_ASIAN_ISO)
    first = F.col("a_primary_iso").isin(SOUTH_ASIAN_ISO) & (F.coalesce("a_vote_share", F.lit(0.0)) >= cfg.low_share)
    applies = F.coalesce((F.col("consensus_iso") == "eng") & (F.col("indic_keywords") >= least) & (second | first), F.lit(False))
    label = F.when(second, F.col("b_primary_label")).otherwise(F.col("a_primary_label"))
    part = lambda k: F.get(F.split(label, "_"), F.lit(k))
    new = {"consensus_label": label, "consensus_iso": part(0), "consensus_script": part(1), "consensus_cluster": X.cluster_of(label, part(0)), "consensus_rollup": F.coalesce(X.cluster_of(label, part(0)), part(0))}
    df = final.withColumns({f"original_{c}": F.col(c) for c in new} | {"romanized_override": applies})
    return df.select("*", *[F.when(F.col("romanized_override"), e).otherwise(F.col(f"original_{c}")).alias(f"_{c}") for c, e in new.items()]).drop(*new).withColumnsRenamed({f"_{c}": c for c in new})


def language_updates(final: DataFrame, form: str = "label") -> DataFrame:
    """(channel_id, language) of the rows that a source table would take over: classified, labelled, no manual decision."""
    value = F.col("consensus_label") if form == "label" else F.regexp_replace("consensus_label", "_[A-Za-z]+$", "")
    return final.filter("consensus_label is not null and not requires_manual and language_status = 'classified'").select("channel_id", value.alias("language"))


def merged(target: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """target with a column updated where there is an update: what MERGE would do, as a new table."""
    return target.join(updates.select(F.col("channel_id").alias("_id"), F.col("language").alias("_new")), F.col("channel_id") == F.col("_id"), "left").withColumn(column, F.coalesce("_new", column)).drop("_id", "_new")


def strata(final: DataFrame) -> DataFrame:
    """Channels that qualify for a validation stratum: all of them in fixed priority, and the first."""
    c, status = F.col, F.col("consensus_status")
    share = F.coalesce("a_vote_share", "b_vote_share", F.lit(0.0))
    has = c("a_primary_label").isNotNull() | c("b_primary_label").isNotNull()
    tests = [
        ("high_confidence_major_language", status.isin("exact_model_agreement", "taxonomy_normalized_agreement") & (share >= 0.65)), ("low_confidence", has & (share < 0.50)),
        ("credible_mixed", c("mixed_credible")), ("mixed_screen_not_credible", c("mixed_screen") & ~c("mixed_credible")), ("high_risk_latin_tail_label", c("a_primary_high_risk") | c("b_primary_high_risk")),
        ("hindi_indic_audit_candidate", c("hindi_indic_status") != "no_hindi_or_indic_signal"), ("source_language_disagreement", c("source_hi_disagreement") | c("source_indic_disagreement")),
        ("exact_disagreement", has & (c("a_primary_label") != c("b_primary_label"))), ("cluster_disagreement", status == "model_disagreement_needs_review"),
        ("insufficient_text_or_unclassified", c("language_status") == "insufficient_text"), ("non_latin_script_control", c("non_latin_any") > 0),
    ]
    df = final.withColumn("qualifying_strata", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests])))
    return df.withColumn("primary_stratum", F.get("qualifying_strata", F.lit(0))).filter("primary_stratum is not null")


def sampled(df: DataFrame, group: str, n: int, seed: str, strategy: str = "xxhash64") -> DataFrame:
    """Up to n rows of each group in hash order, ties by channel."""
    order = Window.partitionBy(group).orderBy(X.order_hash("channel_id", F.lit(seed), group, strategy=strategy), "channel_id")
    return df.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= n)


def tail_labels(final: DataFrame) -> DataFrame:
    """One row for each channel and distinct high-risk primary label."""
    labels = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{p}_primary_high_risk"), F.col(f"{p}_primary_label")) for p in ("a", "b")])))
    return final.select("channel_id", F.explode(labels).alias("high_risk_label"))
