"""Channel text features, Hindi and Indic audit, redirects of high-risk labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.constants import HIGH_RISK_LABELS, HINDI_CLUSTER, HINDI_RELATED_ISO, INDIC_AUDIT_ISO, ROMANCE_ISO, ROMANIZED_HINDI_KEYWORDS, ROMANIZED_INDIC_KEYWORDS, SOURCE_HINDI_CODES, SOURCE_INDIC_CODES
from glossaria.functions import text as X


def romanized_keywords(segments: DataFrame) -> DataFrame:
    """Adds counts of romanized keywords in the raw text, and the distinct ones found, sorted."""
    # one pass: the Indic list begins with the Hindi one, and no keyword that it adds overlaps one of these
    df = segments.select("*", F.explode(F.array(X.keyword_hits("text", ROMANIZED_INDIC_KEYWORDS))).alias("_i"))
    df = df.withColumn("_h", F.filter("_i", lambda w: w.isin(ROMANIZED_HINDI_KEYWORDS)))
    return df.withColumns({"hindi_keyword_count": F.size("_h"), "indic_keyword_count": F.size("_i"), "keyword_examples": F.array_sort(F.array_distinct("_i"))}).drop("_h", "_i")


def text_features(segments: DataFrame) -> DataFrame:
    """One row a channel: segment and letter counts, keyword counts and up to 25 examples, its segment with most letters."""
    df = romanized_keywords(segments)
    n = lambda c: F.sum(F.col(c).cast("long"))
    return df.groupBy("channel_id").agg(
        F.count("*").alias("segment_count"), n("is_valid").alias("valid_segment_count"), n("clean_letter_count").alias("letters"), n("devanagari_char_count").alias("devanagari_chars"),
        F.sum((F.col("devanagari_char_count") > 0).cast("long")).alias("devanagari_segments"), n("hindi_keyword_count").alias("hindi_keywords"), n("indic_keyword_count").alias("indic_keywords"),
        F.array_sort(F.collect_set("segment_type")).alias("segment_types"), F.max(F.col("is_valid_non_latin_rule").cast("int")).alias("non_latin_any"),
        F.slice(F.array_sort(F.array_compact(F.array(*[F.max(F.when(F.array_contains("keyword_examples", w), F.lit(w))) for w in ROMANIZED_INDIC_KEYWORDS]))), 1, 25).alias("keyword_examples"),
        F.max(F.struct("clean_letter_count", "text"))["text"].alias("longest_text"),
    )


def aggregation_signals(summary: DataFrame) -> DataFrame:
    """One row a channel: whether a model's first or second label is Hindi-related or Indic, and both models' votes as JSON."""
    among = lambda isos, *cs: F.max(F.coalesce(F.greatest(*[F.coalesce(F.col(c).isin(isos), F.lit(False)) for c in (*cs, cs[0])]), F.lit(False)))
    votes = lambda m: F.max(F.when(F.col("lid_model") == m, F.col("language_votes_json"))).alias(f"{m}_votes_json")
    return summary.groupBy("channel_id").agg(
        among(HINDI_RELATED_ISO, "primary_iso").alias("hindi_primary"), among(HINDI_RELATED_ISO, "primary_iso", "secondary_iso").alias("hindi_position"),
        among(INDIC_AUDIT_ISO, "primary_iso", "secondary_iso").alias("indic_position"), votes("a"), votes("b"),
    )


def vote_presence(long: DataFrame) -> DataFrame:
    """One row a channel: whether any top-k label of each model is Hindi-related, or Indic."""
    any_of = lambda m, isos, n: F.max(F.coalesce((F.col("lid_model") == m) & F.col("iso639_3").isin(isos), F.lit(False))).alias(n)
    return long.groupBy("channel_id").agg(any_of("a", HINDI_RELATED_ISO, "a_hindi_vote"), any_of("b", HINDI_RELATED_ISO, "b_hindi_vote"), any_of("a", INDIC_AUDIT_ISO, "a_indic_vote"), any_of("b", INDIC_AUDIT_ISO, "b_indic_vote"))


def indic_audit(universe: DataFrame, features: DataFrame, presence: DataFrame, compared: DataFrame) -> DataFrame:
    """One row for each channel of the universe (channel_id, source_language) with all signals and the first status that fits."""
    isos = F.array(*[F.col(f"{p}_{r}_iso") for p in ("a", "b") for r in ("primary", "secondary")])
    firsts = F.array("a_primary_iso", "b_primary_iso")
    has = lambda arr, values: F.coalesce(F.exists(arr, lambda x: F.coalesce(x.isin(values), F.lit(False))), F.lit(False))
    positions = compared.select("channel_id", "consensus_cluster", has(isos, HINDI_RELATED_ISO).alias("hindi_position"), has(isos, INDIC_AUDIT_ISO).alias("indic_position"), has(firsts, ["hin"]).alias("hindi_primary"))
    df = universe.join(features.select("channel_id", "devanagari_segments", "devanagari_chars", "hindi_keywords", "indic_keywords", "non_latin_any"), "channel_id", "left").join(presence, "channel_id", "left").join(positions, "channel_id", "left")
    flags = ["a_hindi_vote", "b_hindi_vote", "a_indic_vote", "b_indic_vote", "hindi_position", "indic_position", "hindi_primary"]
    df = df.fillna(0, ["devanagari_segments", "devanagari_chars", "hindi_keywords", "indic_keywords", "non_latin_any"]).fillna(False, flags)
    c = F.col
    df = df.withColumns({"contains_devanagari": c("devanagari_chars") > 0, "any_hindi_vote": c("a_hindi_vote") | c("b_hindi_vote"), "any_indic_vote": c("a_indic_vote") | c("b_indic_vote")})
    told = c("source_language").isNotNull()
    said = lambda codes: F.coalesce(c("source_language").isin(codes), F.lit(False))
    df = df.withColumns({"source_hi_disagreement": told & (said(SOURCE_HINDI_CODES) != c("any_hindi_vote")), "source_indic_disagreement": told & (said(SOURCE_INDIC_CODES) != c("any_indic_vote"))})
    status = (
        F.when(c("hindi_primary"), "hindi_primary_metadata").when(c("any_hindi_vote") | c("hindi_position"), "hindi_secondary_or_topk_metadata").when(c("indic_position"), "indic_primary_or_secondary_metadata")
        .when(c("contains_devanagari"), "devanagari_non_hindi_primary").when(c("hindi_keywords") > 0, "romanized_hindi_candidate").when(c("indic_keywords") > 0, "romanized_indic_candidate")
        .when(c("source_hi_disagreement"), "source_hi_disagreement").when(c("source_indic_disagreement"), "source_indic_disagreement")
        .when(F.coalesce(c("consensus_cluster") == HINDI_CLUSTER, F.lit(False)), "indic_cluster_candidate").otherwise("no_hindi_or_indic_signal")
    )
    return df.withColumn("hindi_indic_status", status)


def redirect_signals(compared: DataFrame, audit: DataFrame) -> DataFrame:
    """One row for each channel and place (model, primary or secondary) of a high-risk label, with signals that speak against it."""
    places = F.array(*[F.struct(F.lit(f"{p}_{r}").alias("model_label_source"), F.col(f"{p}_{r}_label").alias("high_risk_label")) for p in ("a", "b") for r in ("primary", "secondary")])
    foreign = lambda c: F.coalesce(~F.col(c).isin(ROMANCE_ISO), F.lit(False))
    rows = compared.select("channel_id", F.col("a_vote_share").alias("vote_share"), foreign("a_primary_iso").alias("sig_a_non_romance"), foreign("b_primary_iso").alias("sig_b_non_romance"), F.explode(places).alias("p")).select("*", "p.*").drop("p")
    rows = rows.filter(F.col("high_risk_label").isin(HIGH_RISK_LABELS))
    signals = audit.select("channel_id", F.col("contains_devanagari").alias("sig_devanagari"), (F.col("hindi_keywords") > 0).alias("sig_hindi_words"), (F.col("indic_keywords") > 0).alias("sig_indic_words"), F.col("any_indic_vote").alias("sig_indic_vote"), F.coalesce(F.col("source_language").isin(SOURCE_INDIC_CODES), F.lit(False)).alias("sig_source_indic"), (F.col("non_latin_any") > 0).alias("sig_non_latin"))
    c = F.col
    return rows.join(signals, "channel_id", "left").withColumn("sig_any", c("sig_devanagari") | c("sig_indic_words") | c("sig_indic_vote") | c("sig_source_indic") | c("sig_non_latin"))


def redirect_summary(rows: DataFrame, sample: int, seed: str, strategy: str = "xxhash64") -> DataFrame:
    """Counts of each signal for each place and label, the mean share, and up to ``sample`` ids in hash order."""
    keys = ["model_label_source", "high_risk_label"]
    sigs = [c for c in rows.columns if c.startswith("sig_")]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("channels"), *[F.sum(F.col(s).cast("long")).alias(s.replace("sig_", "n_")) for s in sigs], F.round(F.avg("vote_share"), 6).alias("mean_share"))
    order = Window.partitionBy(*keys).orderBy(X.order_hash("channel_id", F.lit(seed), strategy=strategy), "channel_id")
    ids = rows.select(*keys, "channel_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("channel_id")), ",").alias("sample_ids"))
    return counts.join(ids, keys, "left")
