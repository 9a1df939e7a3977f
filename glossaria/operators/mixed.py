"""Mixed-language screening: a broad screen, and a credible one with evidence from segments and both models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.config import Config


def evidence(c: Callable[[str], Column], exact: Column, cfg: Config) -> dict[str, Column]:
    """Of one model's first two labels: cross_script, same_cluster, screen and credible. c: a column by its name without the
    model; exact: whether the other model has the same second label."""
    false = F.lit(False)
    z = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
    has = c("secondary_label").isNotNull()
    cross = F.coalesce(c("secondary_script") != c("primary_script"), false)
    same = F.coalesce(c("secondary_cluster") == c("primary_cluster"), false)
    screen = has & (z("secondary_ratio") >= cfg.screen_ratio) & (z("secondary_segment_count") >= cfg.screen_segments)
    credible = (
        has & (z("secondary_ratio") >= cfg.credible_ratio) & (z("secondary_segment_count") >= cfg.credible_segments) & (z("secondary_top1_segment_count") >= cfg.credible_top1)
        & (z("secondary_mean") >= cfg.credible_mean) & ((z("secondary_max") >= cfg.credible_max) | cross) & (z("secondary_margin_ratio") >= cfg.credible_margin)
        & (cross | (z("secondary_type_count") >= cfg.credible_types)) & ~same & ~(c("secondary_high_risk") & ~exact)
    )
    return {"cross_script": cross, "same_cluster": same, "screen": screen, "credible": credible}


def mixed_language(compared: DataFrame, cfg: Config) -> DataFrame:
    """Adds each model's screen and credible flags, the channel's, and why a screened channel was not credible."""
    false = F.lit(False)
    cols: dict[str, Column] = {}
    for p in ("a", "b"):
        cols |= {f"{p}_{n}": e for n, e in evidence(lambda c, p=p: F.col(f"{p}_{c}"), F.col("agree_exact_secondary"), cfg).items()}
    df = compared.withColumns(cols)
    c = F.col
    either = c("a_credible") | c("b_credible")
    full = F.coalesce(c("a_present"), false) & F.coalesce(c("b_present"), false)
    peer = lambda p, q: c(f"{p}_credible") & c(f"{p}_cross_script") & (c(f"{q}_secondary_cluster").isNull() | F.coalesce(c(f"{q}_secondary_cluster") == c(f"{p}_secondary_cluster"), false))
    backed = full & ((c("agree_exact_secondary") & either) | (c("agree_cluster_secondary") & either) | peer("a", "b") | peer("b", "a"))
    df = df.withColumns({"mixed_screen": c("a_screen") | c("b_screen"), "mixed_credible": F.coalesce(backed, false) if cfg.require_second_model else either})
    reason = (
        F.when(c("mixed_credible"), F.lit(None).cast("string")).when(~c("mixed_screen"), "no_model_screen")
        .when((c("a_secondary_high_risk") | c("b_secondary_high_risk")) & ~c("agree_exact_secondary"), "high_risk_secondary_without_model_agreement")
        .when((c("a_screen") & c("a_same_cluster")) | (c("b_screen") & c("b_same_cluster")), "secondary_same_analysis_cluster_as_primary")
        .when(either, "no_cross_model_secondary_support").otherwise("insufficient_secondary_evidence")
    )
    return df.withColumn("mixed_rejection_reason", reason)
