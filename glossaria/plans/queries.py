"""One query for each operator over the driver's tables: documents stand for videos of channels, customers for channels with
subscribers, orders for labelled videos, events for provider results. Samples use the portable hash, so that SQL can follow.

Segments and predictions are written once for each query that reads them more than once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.config import Config, plan_partitions
from glossaria.constants import CATEGORIES
from glossaria.functions import text as X
from glossaria.operators import ablation, category, channels, cohort, consensus, dedup, diagnostics, mixed, panel, predictions, qa, segments, votes
from glossaria.schema import CANDIDATES, first_existing_column
from glossaria.sources import acceptance, ledger, models, published, sinks, tables
from glossaria.sources.scratch import Scratch, some_keys_suffice

CFG = Config()
WORDS_A = {"eng_Latn": ["the", "and", "of", "on"], "fra_Latn": ["que", "des", "les", "qui", "dans"], "deu_Latn": ["der", "die", "und", "von", "mit"], "spa_Latn": ["los", "el", "una", "y"]}
WORDS_B = {"eng_Latn": ["that", "is", "to", "in"], "fra_Latn": ["le", "est", "une", "la"], "deu_Latn": ["das", "ein", "ist", "der"], "spa_Latn": ["que", "se", "no", "las"], "ast_Latn": ["la", "del", "que"]}
MODELS = [("openai", "m1", 1), ("anthropic", "m2", 2), ("gemini", "m3", 3)]
SEED = "20260520"
#: What the evidence reads of segments and their metrics; nothing else is computed and written for it.
MEASURED = [*predictions.CARRY, "text", "clean_text", "clean_text_len", "dominant_script_share", "devanagari_char_count", "is_valid_non_latin_rule", "is_valid", "short_text_reason"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(*cols: str) -> list[Column]:
    return [F.array_join(c, ",").alias(c) for c in cols]


# sources in the roles of the domain


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as videos. Very short ones make channels of their own, some of which have no valid text."""
    d = table(spark, sf, "documents")
    if d._jdf.queryExecution().toRdd().getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        d = d.repartition(cores)  # a table of one file is one task otherwise, and the patterns that follow are the work
    channel = F.when(F.length("text") < 50, F.concat(F.lit("short/"), (F.col("doc_id") % 10).cast("string"))).otherwise(F.concat("source", F.lit("/"), F.expr("(doc_id div 100) % 10").cast("string")))
    return d.select(channel.alias("channel_id"), F.col("doc_id").cast("string").alias("video_id"), F.substring("text", 1, 80).alias("title"), "text", "lang")


def universe(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.min("lang") == F.max("lang"), F.min("lang"))
    return videos(spark, sf).groupBy("channel_id").agg(one.alias("l")).select("channel_id", F.when(F.col("l") == "de", "hi").otherwise(F.col("l")).alias("source_language"))


def parts(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    v = videos(spark, sf) if of is None else segments.of_channels(videos(spark, sf), of)
    return segments.unpivot(v, "channel_id", "video_id", {"video_title": "title", "video_description": "text", "video_tags": "lang"}, CFG)


class Evidence:
    """The frames of a query, of all channels or of some.

    Segments with their metrics are written once. Predictions, which are short, are written once in buckets by channel, as are the
    universe, features, decisions and audit, which come out of aggregates by channel: whatever is joined or grouped by channel
    after that moves no row.
    """

    def __init__(self, spark: SparkSession, sf: str, of: DataFrame | None = None) -> None:
        self.spark, self.sf, self.of = spark, sf, of
        self.scratch = Scratch(spark)

    @cached_property
    def universe(self) -> DataFrame:
        u = universe(self.spark, self.sf)
        return self.scratch.bucketed(u if self.of is None else segments.of_channels(u, self.of), "channel_id", dealt=True)

    @cached_property
    def measured(self) -> DataFrame:
        return self.scratch.table(segments.with_metrics(parts(self.spark, self.sf, self.of), CFG).select(*MEASURED))

    @cached_property
    def valid(self) -> DataFrame:
        return self.measured.filter("is_valid")

    @cached_property
    def predicted(self) -> DataFrame:
        return self.scratch.bucketed(predictions.word_list_models(self.valid, {"a": WORDS_A, "b": WORDS_B}, CFG.top_k), "channel_id")

    @cached_property
    def long(self) -> DataFrame:
        return predictions.long(self.predicted)

    @cached_property
    def votes(self) -> DataFrame:
        return votes.channel_votes(votes.admit(self.long, CFG))

    @cached_property
    def summary(self) -> DataFrame:
        return votes.channel_summary(self.votes, self.predicted)

    @cached_property
    def decided(self) -> DataFrame:
        with some_keys_suffice(self.spark):
            return self.scratch.bucketed(mixed.mixed_language(consensus.consensus(consensus.compare_channels(self.summary, "a", "b"), CFG), CFG), "channel_id", dealt=True)

    @cached_property
    def features(self) -> DataFrame:
        return self.scratch.bucketed(diagnostics.text_features(self.measured), "channel_id", dealt=True)

    @cached_property
    def audit(self) -> DataFrame:
        return self.scratch.bucketed(diagnostics.indic_audit(self.universe, self.features, diagnostics.vote_presence(self.long), self.decided), "channel_id", dealt=True)

    @cached_property
    def final(self) -> DataFrame:
        return channels.final_channels(self.universe, self.decided, self.audit)

    @cached_property
    def routed(self) -> DataFrame:
        return panel.route(panel.indic_evidence(self.decided, self.features, self.audit), 0.2, "20260526", "md5")


# language evidence


@query
def segment_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf)


@query
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return segments.with_metrics(parts(spark, sf), CFG).drop("text", "video_id").withColumn("dominant_script_share", F.round("dominant_script_share", 6))


@query
def segment_qa(spark: SparkSession, sf: str) -> DataFrame:
    return segments.with_metrics(parts(spark, sf), CFG).groupBy("segment_type", "is_valid", "short_text_reason", "dominant_script").agg(F.count("*").alias("segments"))


@query
def smoke_channels(spark: SparkSession, sf: str) -> DataFrame:
    some = segments.first_channels(universe(spark, sf), 50, "md5")
    return segments.of_channels(videos(spark, sf), some).groupBy("channel_id").agg(F.count("*").alias("videos"))


@query
def bucket_filter(spark: SparkSession, sf: str) -> DataFrame:
    cfg = Config(buckets=64, bucket_start=0, bucket_end=15, segments_per_partition=20, min_partitions=2, max_partitions=100).check()
    some = segments.in_buckets(videos(spark, sf), "channel_id", cfg, "md5").withColumns({"channel_hash_bucket": segments.bucket("channel_id", cfg.buckets, "md5"), "segment_id": F.col("video_id")})
    return segments.by_bucket(some, cfg, plan_partitions(some.count(), cfg)).groupBy("channel_hash_bucket").agg(F.count("*").alias("videos"), F.countDistinct("channel_id").alias("channels"))


@query
def topk_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).long.drop("score_1", "clean_letter_count", "dominant_script")


@query
def long_sample(spark: SparkSession, sf: str) -> DataFrame:
    return predictions.long_sample(Evidence(spark, sf).long, "default", 0.3, "md5").select("segment_id", "lid_model", "prediction_rank", "label")


@query
def distributed_model(spark: SparkSession, sf: str) -> DataFrame:
    """The word lists of model a as a file that is sent to the executors; read by the Python path for any model."""
    path = os.path.join(tempfile.mkdtemp(prefix="glossaria-model-"), "words.json")

    def fetch(name: str, folder: str) -> str:
        if name != "model.bin":
            raise FileNotFoundError(name)
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(WORDS_A, f)
        return f.name

    told = models.distribute(spark, models.ensure_model(path, ["absent.bin"], fetch))
    return predictions.long(predictions.run_model(Evidence(spark, sf).valid, "a", models.SharedModel(models.WordListFile, told), CFG.top_k)).select("segment_id", "prediction_rank", "label", "iso639_3", "script", "score")


@query
def audit_universe(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return predictions.second_universe(e.valid, "audit_segments", e.long, "a").select("segment_id", "segment_type")


@query
def native_clean(spark: SparkSession, sf: str) -> DataFrame:
    return predictions.native_audit(Evidence(spark, sf).valid, 1.0, allow_full=True, seed=1).select("segment_id", "clean_text_native")


@query
def native_audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    return predictions.native_audit(Evidence(spark, sf).valid, 0.2, allow_full=False, seed=20260520).select("segment_id", "clean_text_native")


@query
def checksum_parity(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return qa.checksum_parity(e.valid, e.predicted, segments.bucket("channel_id", 16, "md5"), "a")


@query
def vote_admission(spark: SparkSession, sf: str) -> DataFrame:
    return votes.admit(Evidence(spark, sf).long, CFG).select("segment_id", "lid_model", "prediction_rank", "label", F.round("weighted_score", 6).alias("weighted_score"))


@query
def latin_name_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Titles in the role of channel names, and most other segments in that of Han texts."""
    kind = F.when(F.col("segment_type") == "video_title", "channel_name").otherwise(F.col("segment_type"))
    script = F.when((kind != "channel_name") & (F.substring("segment_id", 1, 1) < "c"), "han").otherwise("latin")
    v = votes.admit(Evidence(spark, sf).long.withColumns({"dominant_script": script, "segment_type": kind}), CFG)
    return votes.without_latin_names(v).groupBy("channel_id", "lid_model").agg(votes.total(F.col("weighted_score")).alias("weighted"), F.count_if(F.col("weighted_score") == 0).alias("silenced"))


@query
def channel_votes(spark: SparkSession, sf: str) -> DataFrame:
    df = Evidence(spark, sf).votes
    return df.select("channel_id", "lid_model", "label", "iso639_3", "script", "weighted_score", "top1_weighted_score", "mean_segment_score", "max_segment_score", "top1_mean_score", "top1_max_score", "segment_count", "top1_segment_count", "top2_segment_count", "vote_count", *joined("segment_types"), "segment_type_count", "language_rank")


@query
def channel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).summary.select("channel_id", "lid_model", "valid_segment_count", "valid_type_count", "total_letters", "primary_label", "primary_iso", "secondary_label", "secondary_segment_count", *[F.round(c, 6).alias(c) for c in ("primary_score", "vote_share", "top1_vote_share", "secondary_ratio", "secondary_margin_ratio")])


@query
def model_qa(spark: SparkSession, sf: str) -> DataFrame:
    return qa.model_qa(Evidence(spark, sf).summary)


@query
def aggregation_signals(spark: SparkSession, sf: str) -> DataFrame:
    df = diagnostics.aggregation_signals(Evidence(spark, sf).summary)
    return df.select("channel_id", "hindi_primary", "hindi_position", "indic_position", *[F.coalesce(F.json_array_length(f"{p}_votes_json"), F.lit(0)).alias(f"{p}_votes") for p in "ab"])


@query
def model_comparison_segment(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.compare_segments(Evidence(spark, sf).long, "a", "b").select("segment_id", "a_label", "b_label", "agree_exact", "agree_iso", "agree_script")


@query
def model_comparison_channel(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.compare_channels(Evidence(spark, sf).summary, "a", "b").select("channel_id", "a_primary_label", "b_primary_label", "a_primary_cluster", "b_primary_cluster", "a_primary_high_risk", "b_primary_high_risk", "agree_exact_primary", "agree_iso_primary", "agree_script_primary", "agree_cluster_primary", "agree_exact_secondary", "agree_cluster_secondary")


@query
def consensus_labels(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).decided.select("channel_id", "consensus_status", "consensus_label", "consensus_iso", "consensus_script", "consensus_cluster", "consensus_rollup", "requires_manual", "consensus_source")


@query
def consensus_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a list of labels, each with three shares: all rules of the consensus."""
    labels = ["eng_Latn", "spa_Latn", "glg_Latn", "ast_Latn", "arb_Arab", "arz_Arab", "cmn_Hans", "cmn_Latn", "srp_Latn", "srp_Cyrl", "hrv_Latn", "hin_Deva", "bho_Deva", None]
    one = spark.createDataFrame([(x, s) for x in labels for s in (0.4, 0.6, 0.7)], "label string, share double")
    side = lambda p: one.select(F.col("label").alias(f"{p}_primary_label"), F.col("share").alias(f"{p}_vote_share"))
    df = side("a").crossJoin(side("b"))
    for p in "ab":
        parsed = X.parsed_label(f"{p}_primary_label")
        df = df.withColumn(f"{p}_primary_iso", parsed["iso639_3"]).withColumns({f"{p}_primary_cluster": X.cluster_of(f"{p}_primary_label", parsed["iso639_3"]), f"{p}_primary_high_risk": X.high_risk(f"{p}_primary_label")})
    return consensus.consensus(df, CFG).select("a_primary_label", "b_primary_label", "a_vote_share", "b_vote_share", "consensus_status", "consensus_label", "consensus_cluster", "consensus_rollup", "requires_manual", "consensus_source")


@query
def mixed_language(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).decided.select("channel_id", "a_screen", "b_screen", "a_credible", "b_credible", "mixed_screen", "mixed_credible", "mixed_rejection_reason")


@query
def romanized_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.romanized_keywords(parts(spark, sf)).select("segment_id", "hindi_keyword_count", "indic_keyword_count", *joined("keyword_examples"))


@query
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).features.select("channel_id", "segment_count", "valid_segment_count", "letters", "devanagari_chars", "devanagari_segments", "hindi_keywords", "indic_keywords", *joined("segment_types", "keyword_examples"), "non_latin_any", F.md5("longest_text").alias("longest_md5"))


@query
def indic_audit(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).audit.select("channel_id", "source_language", "contains_devanagari", "any_hindi_vote", "any_indic_vote", "hindi_position", "indic_position", "hindi_primary", "source_hi_disagreement", "source_indic_disagreement", "hindi_indic_status")


@query
def redirect_diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return diagnostics.redirect_summary(diagnostics.redirect_signals(e.decided, e.audit), 25, SEED, "md5")


@query
def final_channels(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).final.select("channel_id", "source_language", "a_primary_label", "b_primary_label", "consensus_status", "consensus_label", "requires_manual", "mixed_screen", "mixed_credible", "hindi_indic_status", "language_status")


@query
def romanized_override(spark: SparkSession, sf: str) -> DataFrame:
    """Spanish in the role of Hindi, Asturian in that of Urdu, and a consensus on French in that of English with Indic words."""
    turned = lambda c: F.when(F.col(c) == "spa_Latn", "hin_Latn").when(F.col(c) == "ast_Latn", "urd_Arab").otherwise(F.col(c))
    df = Evidence(spark, sf).final.withColumns({f"{p}_primary_label": turned(f"{p}_primary_label") for p in "ab"})
    df = df.withColumns({f"{p}_primary_iso": F.get(F.split(f"{p}_primary_label", "_"), F.lit(0)) for p in "ab"} | {"consensus_iso": F.lit("eng"), "indic_keywords": F.length("channel_id") % 3})
    return channels.romanized_override(df, CFG).select("channel_id", "romanized_override", "consensus_label", "consensus_iso", "consensus_script", "consensus_cluster", "consensus_rollup", "original_consensus_label")


@query
def language_summary(spark: SparkSession, sf: str) -> DataFrame:
    return qa.language_summary(Evidence(spark, sf).final).withColumn("median_share", F.round("median_share", 6))


@query
def rollup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return qa.counts_by(Evidence(spark, sf).final, "consensus_rollup", "consensus_status", "language_status")


@query
def agreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return qa.agreement_summary(Evidence(spark, sf).decided)


@query
def source_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return qa.source_confusion(Evidence(spark, sf).final)


@query
def tail_sample(spark: SparkSession, sf: str) -> DataFrame:
    return channels.sampled(channels.tail_labels(Evidence(spark, sf).final), "high_risk_label", 50, SEED, "md5")


def strata(spark: SparkSession, sf: str) -> DataFrame:
    return channels.sampled(channels.strata(Evidence(spark, sf).final), "primary_stratum", 100, SEED, "md5")


@query
def validation_strata(spark: SparkSession, sf: str) -> DataFrame:
    return strata(spark, sf).select("channel_id", "primary_stratum", *joined("qualifying_strata"), "sample_rank")


@query
def strata_counts(spark: SparkSession, sf: str) -> DataFrame:
    return qa.strata_counts(strata(spark, sf), 20)


@query
def unclassified(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return qa.unclassified(e.universe, e.features, e.final)


@query
def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions of videos in the role of those of channels."""
    e = Evidence(spark, sf)
    kind = F.when(F.col("segment_type") == "video_description", "channel_description").otherwise(F.col("segment_type"))
    cells = ablation.outcomes(spark, e.long.withColumn("segment_type", kind), ablation.default_variants(), CFG).unionByName(ablation.consensus_outcomes(e.decided))
    return ablation.summary(e.scratch.table(cells), e.audit.filter("hindi_indic_status <> 'no_hindi_or_indic_signal'"))


@query
def universe_parity(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return qa.universe_parity(e.valid.select("segment_id").distinct(), e.predicted, ["a", "b"])


@query
def acceptance_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return qa.acceptance(e.universe, e.final).select("check", "ok")


@query
def qa_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return qa.distributions(Evidence(spark, sf).decided)


@query
def accepted_final(spark: SparkSession, sf: str) -> DataFrame:
    """The final table measured as it is written: each check with what was measured."""
    e = Evidence(spark, sf)
    final = acceptance.numbered(e.final, "channel_id")
    acceptance.require_columns(final, acceptance.FINAL_COLUMNS)
    checks = acceptance.final_checks(e.universe.count())
    path = e.scratch.path()
    got = acceptance.write_accepted(final, lambda x: x.write.parquet(path), checks)
    return spark.createDataFrame([(c.name, int(got[c.name]), c.ok(got[c.name])) for c in checks], "check string, measured long, ok boolean")


@query
def signature_drill_down(spark: SparkSession, sf: str) -> DataFrame:
    """Valid segments against predictions in which some segments have come under a wrong channel: what the unequal buckets show."""
    e = Evidence(spark, sf)
    valid = e.valid.select("channel_id", "segment_id")
    moved = F.when(F.col("segment_id") < "02", F.lit("wrong/channel")).otherwise(F.col("channel_id"))
    seen = e.predicted.filter("lid_model = 'a'").select(moved.alias("channel_id"), "segment_id")
    bucket = F.pmod(F.conv(F.substring("segment_id", 1, 2), 16, 10).cast("int"), F.lit(64))
    parity = e.scratch.table(qa.signature_parity(qa.signatures(valid, bucket, "md5"), qa.signatures(seen, bucket, "md5")))
    return qa.drill_down(valid, seen, parity, bucket)


@query
def bucket_signatures(spark: SparkSession, sf: str) -> DataFrame:
    df = qa.signatures(Evidence(spark, sf).valid, segments.bucket("channel_id", 16, "md5"), "md5")
    return df.select("bucket", "n", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


@query
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """Videos in buckets, counted by language; the run breaks in its second group of buckets and goes on from there."""
    scratch, name = Scratch(spark), f"glossaria_{uuid.uuid4().hex}"
    source = scratch.path()
    ledger.deal(videos(spark, sf).select("channel_id", "lang"), source, segments.bucket("channel_id", 16, "md5"))
    out, book, calls = published.Published(spark, name, scratch.path()), ledger.Ledger(spark, scratch.path()), []

    def work(rows: DataFrame) -> DataFrame:
        calls.append(rows)
        if len(calls) == 2:
            raise ConnectionError("an executor's host was lost")
        return rows.groupBy("channel_hash_bucket", "channel_id", "lang").agg(F.count("*").alias("videos"))

    for _ in range(2):
        try:
            ledger.resume(spark, source, out, book, "r1", "v1", work, step=5)
        except ConnectionError:
            continue
    return out.read()


@query
def published_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of two runs in buckets, then one run's middle buckets replaced by part of their rows, with a new name."""
    scratch = Scratch(spark)
    t = published.Published(spark, f"glossaria_{uuid.uuid4().hex}", scratch.path())
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 8).cast("int").alias("channel_hash_bucket"))
    for run in ("one", "two"):
        t.replace(rows.withColumn("run_id", F.lit(run)), run, [(0, 7)])
    some = rows.filter("channel_hash_bucket between 2 and 4 and c_custkey % 3 = 0 and channel_hash_bucket <> 3").withColumns({"c_mktsegment": F.lit("NEW"), "run_id": F.lit("one")})
    t.replace(some, "one", [(2, 4)])
    return t.read()


@query
def flat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the files of one folder, without those of the folders in it."""
    path = Scratch(spark).path()
    c = table(spark, sf, "customer")
    c.filter("c_custkey % 2 = 1").select("c_name").write.text(path)
    c.filter("c_custkey % 2 = 0").select("c_name").write.text(f"{path}/nested")
    return tables.result_lines(spark, path, recursive=False)


@query
def language_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return channels.merged(e.universe.withColumnRenamed("source_language", "language"), channels.language_updates(e.final, "iso639_3"), "language")


# deduplication and cohorts


@query
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "props")
    return dedup.latest(e, ["user_id", "event_type"], "ts").select("event_id", "user_id", "event_type", "props")


@query
def dedup_qa(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedupe_qa(table(spark, sf, "events"), ["user_id", "event_type"], "events").union(dedup.dedupe_qa(table(spark, sf, "documents").select(F.xxhash64("text").alias("h"), F.md5("text").alias("m")), ["h", "m"], "documents"))


@query
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 < 4, F.concat(F.lit(" "), F.col("doc_id").cast("string"))).alias("video_id"))
    return d.select("doc_id", dedup.stable_key(d, "video_id").alias("key"))


@query
def top_n_recent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return dedup.most_recent(o, "o_custkey", "o_orderkey", "o_orderdate", CFG.videos_per_channel).drop("o_orderdate")


def sized(spark: SparkSession, sf: str) -> DataFrame:
    a = F.floor("c_acctbal").cast("long").cast("string")
    kind = F.col("c_custkey") % 4
    told = F.when(kind == 0, a).when(kind == 1, F.concat(a, F.lit("k"))).when(kind == 2, F.concat(a, F.lit(" million subscribers"))).otherwise("abc")
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), told.alias("follower_count"), "c_mktsegment")
    return c.withColumn("subscribers", X.subscribers("follower_count"))


@query
def subscriber_parse(spark: SparkSession, sf: str) -> DataFrame:
    return sized(spark, sf).drop("c_mktsegment")


def both_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    known = sized(spark, sf).filter("subscribers is not null").select("channel_id", "subscribers")
    top = cohort.top_n(known, "subscribers", 100)
    return top.unionByName(cohort.band_sample(known, "subscribers", 1000, top, 100, SEED, "md5"))


@query
def cohort_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return both_cohorts(spark, sf).filter("cohort = 'top'")


@query
def cohort_band_sample(spark: SparkSession, sf: str) -> DataFrame:
    return both_cohorts(spark, sf).filter("cohort = 'band'")


@query
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.cohort_stats(both_cohorts(spark, sf), "subscribers")


@query
def usable_channels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("channel_id"), F.floor("o_totalprice").cast("long").alias("subscribers"), F.expr("date_trunc('MONTH', o_orderdate)").alias("ts"), "o_orderpriority")
    return cohort.usable(o, "subscribers", "ts").select("channel_id", "subscribers")


@query
def cohort_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    known = sized(spark, sf).filter("subscribers is not null").select("channel_id", "subscribers")
    return cohort.cutoff(known, cohort.top_n(known, "subscribers", 100), "subscribers")


@query
def selected_videos(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.selected(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", both_cohorts(spark, sf))


def document_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of documents, with the characters of all their texts as their size."""
    size = videos(spark, sf).groupBy("channel_id").agg(F.sum(F.length("text")).alias("subscribers"))
    top = cohort.top_n(size, "subscribers", 40)
    return cohort.union_all([top, cohort.band_sample(size, "subscribers", 500, top, 40, SEED, "md5")])


class CohortRuns:
    """A run of the evidence for each cohort, side by side, with a final table and an agreement summary each, and the log."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.scratch = Scratch(spark)
        self.ids = self.scratch.table(document_cohorts(spark, sf))
        self.finals: dict[str, DataFrame] = {}
        self.agreements: dict[str, DataFrame] = {}

        def run(name: str) -> int:
            e = Evidence(spark, sf, self.ids.filter(F.col("cohort") == name).select("channel_id"))
            final = self.scratch.table(e.final.withColumn("run_id", F.lit(f"run_{name}")))
            self.agreements[name] = self.scratch.table(qa.agreement_summary(e.decided).withColumn("run_id", F.lit(f"run_{name}")))
            self.finals[name] = final
            e.scratch.keep()  # the run's own tables go, its outputs stay
            return final.count()

        self.log = cohort.run_side_by_side(spark, ["top", "band"], run, at_once=2)
        if failed := self.log.filter("status <> 'succeeded'").collect():
            raise RuntimeError(str(failed))


def all_results(spark: SparkSession, sf: str) -> DataFrame:
    """The final table of a run for each cohort."""
    runs = CohortRuns(spark, sf)
    out = runs.scratch.table(cohort.cohort_results(runs.ids, cohort.union_all(list(runs.finals.values()))))
    runs.scratch.keep(out)
    return out


@query
def cohort_run_log(spark: SparkSession, sf: str) -> DataFrame:
    return CohortRuns(spark, sf).log.select("cohort", "run_id", "pool", "status", "rows", (F.col("started") <= F.col("ended")).alias("in_order"))


@query
def agreement_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    runs = CohortRuns(spark, sf)
    return cohort.agreement_by_cohort(cohort.union_all(list(runs.agreements.values())), runs.ids)


@query
def cohort_results(spark: SparkSession, sf: str) -> DataFrame:
    return all_results(spark, sf).select("cohort", "run_id", "channel_id", "selection_rank", "consensus_status", "consensus_label", "language_status")


@query
def cohort_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.status_summary(all_results(spark, sf), "subscribers")


@query
def cohort_language_review(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.language_review(all_results(spark, sf))


@query
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.review_queue(Evidence(spark, sf).final).select("channel_id", "language_status", "consensus_status", "hindi_indic_status")


# categories


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    name = F.when(p == "1", " News & Politics").when(p == "2", "music").when(p == "3", "Gaming").when(p == "4", "unknown thing").otherwise("27")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("channel_id"), F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderdate").alias("rank_value"), F.col("o_orderpriority").alias("title"), name.alias("ai_label"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    return category.reference_labels(labelled(spark, sf), "ai_label", 3, 0.5)


@query
def reference_labels(spark: SparkSession, sf: str) -> DataFrame:
    return references(spark, sf).withColumn("agreement", F.round("agreement", 6))


@query
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = references(spark, sf).select("channel_id", "category_id").join(sized(spark, sf).select("channel_id", "c_mktsegment"), "channel_id")
    return category.stratified(df, ["c_mktsegment", "category_id"], 25, 50_000, "20260511")


@query
def prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    return category.prompt_lines(labelled(spark, sf), 10, 350, 7000)


@query
def request_fanout(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame([(p, m) for p, m, _ in MODELS], "provider string, model string")
    return category.fan_out(references(spark, sf).select("channel_id"), models, "default", 50)


@query
def request_fanout_plain(spark: SparkSession, sf: str) -> DataFrame:
    models_ = spark.createDataFrame([(p, m) for p, m, _ in MODELS], "provider string, model string")
    return category.fan_out(references(spark, sf).select("channel_id"), models_, "default", 50, "plain")


def category_inputs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("description"))
    told = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("channel_id"), F.concat(F.lower(F.substring("c_mktsegment", 1, 3)), F.lit("_Latn")).alias("label"), F.lower(F.substring("c_mktsegment", 1, 3)).alias("iso639_3"))
    return category.prompt_inputs(c, category.prompt_lines(labelled(spark, sf), 10, 350, 7000), references(spark, sf), told, 300)


@query
def prompt_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return category_inputs(spark, sf)


@query
def run_modes(spark: SparkSession, sf: str) -> DataFrame:
    inputs = category_inputs(spark, sf)
    return cohort.union_all([category.chosen(inputs, m, 7, 40, "20260511").select(F.lit(m).alias("mode"), "channel_id") for m in category.RUN_MODES])


@query
def batch_lines(spark: SparkSession, sf: str) -> DataFrame:
    return request_lines(spark, sf).select("request_id", F.md5("batch_line").alias("line_md5"))


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    asked = [("openai", "gpt-4.1"), ("openai", "gpt-5-mini"), ("anthropic", "m2"), ("gemini", "m3")]
    df = category.fan_out(category.prompt_lines(labelled(spark, sf), 10, 350, 7000), spark.createDataFrame(asked, "provider string, model string"), "default", 500)
    return df.withColumn("batch_line", panel.batch_line(F.col("provider"), F.col("model"), F.col("request_id"), "Return JSON.", F.col("prompt"), 300, 0.0))


@query
def request_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of request lines, written and read again, beside their registry and the jobs of a dry run."""
    path = Scratch(spark).path()
    known = sinks.write_lines(request_lines(spark, sf), path)
    jobs = sinks.submit(known, panel.DryRun(), "default").select("provider", "model", "chunk_id", "status")
    file = F.input_file_name()
    read = tables.result_lines(spark, path).select(F.regexp_extract(file, "provider=([^/]+)", 1).alias("provider"), F.regexp_extract(file, "model=([^/]+)", 1).alias("model"), F.regexp_extract(file, "chunk_id=([0-9]+)", 1).cast("int").alias("chunk_id"), file.alias("f"))
    lines = read.groupBy("provider", "model", "chunk_id").agg(F.count("*").alias("n_lines"), F.countDistinct("f").alias("n_files"))
    return known.drop("path").join(jobs, ["provider", "model", "chunk_id"]).join(lines, ["provider", "model", "chunk_id"])


def judged(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame(MODELS, "provider string, model string, k long")
    key = F.col("channel_id").cast("long")
    ids = F.array(*[F.lit(c) for c in sorted(CATEGORIES, key=int)])
    df = sized(spark, sf).select("channel_id").join(references(spark, sf).select("channel_id", F.col("category_id").alias("reference")), "channel_id", "left").crossJoin(F.broadcast(models))
    other = F.get(ids, ((key * F.col("k") + F.col("k")) % 15).cast("int"))
    said = F.when(key % 11 == F.col("k"), F.lit(None).cast("string")).when((key + F.col("k")) % 2 == 0, F.coalesce("reference", other)).otherwise(other)
    return df.select("channel_id", "provider", "model", "reference", said.alias("predicted"), ((key % 10 + F.col("k")) / 20.0).alias("confidence"), (key % 5 == 0).alias("ambiguous"), F.when(said.isNull(), "invalid_category_id:").alias("parse_error"))


@query
def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return category.overall(judged(spark, sf))


@query
def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    df = category.per_class(judged(spark, sf), list(CATEGORIES))
    return df.select("provider", "model", "category_id", "predicted_n", "reference_n", "true_n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return category.macro_f1(category.per_class(judged(spark, sf), list(CATEGORIES)))


@query
def pairwise_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return category.pairwise(judged(spark, sf))


@query
def category_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return category.majority(judged(spark, sf))


@query
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    pred = judged(spark, sf).join(sized(spark, sf).select("channel_id", F.col("c_mktsegment").alias("language")), "channel_id")
    return category.evaluation(pred, list(CATEGORIES), "language")


@query
def results_to_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results of requests, of which customers are the map; some results have no request, some requests have two rows."""
    c = table(spark, sf, "customer").filter("c_custkey % 7 <> 0").withColumn("twice", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 2).cast("int"))))
    ids = [str(i) for i in sorted(map(int, CATEGORIES))]
    pick = lambda k: F.get(F.array(*map(F.lit, ids)), (k % 15).cast("int"))
    known = c.select(F.lit("r").alias("run_id"), F.col("c_custkey").cast("string").alias("request_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.col("c_name").alias("channel_id"), F.when(F.col("c_custkey") % 3 > 0, pick(F.col("c_custkey"))).alias("reference_category_id"), F.lower("c_mktsegment").alias("iso639_3"))
    got = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, "q").otherwise("r").alias("run_id"), F.col("o_custkey").cast("string").alias("request_id"), "o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, pick(F.col("o_custkey") + F.col("o_orderkey") % 2)).alias("category_id"))
    return category.with_requests(got, known).select("o_orderkey", "channel_id", "reference", "category_id", "correct", "iso639_3")


# panel


@query
def panel_routing(spark: SparkSession, sf: str) -> DataFrame:
    return Evidence(spark, sf).routed.select("channel_id", "route_reason", "consensus_status", "consensus_label", "fasttext_source")


@query
def panel_cap(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return panel.route(panel.indic_evidence(e.decided, None, e.audit), 0.2, "20260526", "md5", most=20).select("channel_id", "route_reason")


@query
def panel_prompts(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    bare = spark.createDataFrame([("none/0",)], "channel_id string")
    return panel.routed_prompts(e.routed.select("channel_id").union(bare), e.measured)


def panel_results(spark: SparkSession, e: Evidence) -> DataFrame:
    """What three models say of each routed channel, as result lines; one model answers twice, one request is of another run."""
    routed = e.routed.select("channel_id").join(e.decided.select("channel_id", F.coalesce("a_primary_label", F.lit("eng_Latn")).alias("a"), F.coalesce("b_primary_label", F.lit("none")).alias("b")), "channel_id")
    known = category.fan_out(routed.select("channel_id"), spark.createDataFrame([(p, m) for p, m, _ in MODELS], "provider string, model string"), "now", 1000, "plain")
    requests = e.scratch.table(known.select(F.when(F.col("request_id").rlike("7$") & (F.col("model") == "m3"), "before").otherwise("now").alias("run_id"), "request_id", "provider", "model", "channel_id"))
    n = F.length("channel_id")
    label = F.when(F.col("model") == "m1", F.col("a")).when(F.col("model") == "m2", F.col("b")).when(n % 2 == 0, F.col("a")).otherwise("und_Latn")
    told = F.concat(
        F.lit('{\\"primary_language_label\\": \\"'), label, F.lit('\\", \\"primary_language_iso639_3\\": \\"'), F.when(n % 3 == 0, F.get(F.split(label, "_"), F.lit(0))).otherwise("none"), F.lit('\\", \\"status\\": \\"'), F.when((F.col("model") == "m1") & (n % 5 == 0), "unsure").otherwise("Classified"),
        F.lit('\\", \\"is_romanized\\": \\"yes\\", \\"is_mixed_language\\": false, \\"mixed_languages\\": [\\"'), F.col("model"), F.lit('\\", \\"x\\"], \\"confidence\\": \\"'), F.when(F.col("model") == "m2", "high").otherwise("low"), F.lit('\\", \\"evidence\\": \\"e\\"}'),
    )
    line = lambda code, text: F.concat(F.lit('{"custom_id":"'), F.col("request_id"), F.lit('","response":{"status_code":'), F.lit(code), F.lit(',"body":{"model":"x","choices":[{"message":{"content":"'), text, F.lit('"}}]}}}'))
    rows = requests.join(routed, "channel_id")
    lines = rows.select(line("200", told).alias("value")).union(rows.filter("model = 'm2'").select(line("429", F.lit("busy")).alias("value")))
    return e.scratch.table(panel.imported(lines, requests, "now"))  # verdicts read it more than once; lines are parsed here only


@query
def imported_results(spark: SparkSession, sf: str) -> DataFrame:
    df = panel_results(spark, Evidence(spark, sf))
    return df.select("request_id", "provider", "model", "channel_id", "label", "iso639_3", "script", "result_status", "is_valid", "is_romanized", "is_mixed", "confidence", *joined("mixed_languages"))


@query
def panel_verdict(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    df = panel.verdicts(e.routed, panel_results(spark, e), 3)
    return df.select("channel_id", "route_reason", "panel_iso", "winning_votes", "panel_label", "panel_script", "panel_confidence", "panel_is_romanized", "panel_is_mixed", *joined("panel_mixed_languages", "panel_models"), "openai_label", "anthropic_label", "gemini_label", "n_reached", "panel_status", "consensus_source", "audit_sample")


@query
def audit_agreement(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return panel.audit_agreement(panel.verdicts(e.routed, panel_results(spark, e), 3))


@query
def verdict_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = Evidence(spark, sf)
    return panel.coverage(e.routed, panel.verdicts(e.routed, panel_results(spark, e), 3))


@query
def result_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5).alias("k"))
    cat = F.get(F.array(*[F.lit(c) for c in ("10", "27", "unsure", "nonsense")]), (F.col("event_id") % 4).cast("int"))
    payload = F.concat(F.lit('{"category_id": "'), cat, F.when(cat == "unsure", '", "category_name": "gaming').otherwise(""), F.lit('", "confidence": "'), (F.col("event_id") % 3).cast("string"), F.lit('", "ambiguous": "yes"}'))
    quoted = F.to_json(F.struct(F.concat(F.lit("Sure: "), payload, F.lit(" done {")).alias("t")))
    quoted = F.regexp_extract(quoted, r'^\{"t":(.*)\}$', 1)
    rid = F.concat(F.lit("r"), F.col("event_id").cast("string"))
    head = F.concat(F.lit('{"custom_id":"'), rid, F.lit('",'))
    line = (
        F.when(F.col("k") == 0, F.concat(head, F.lit('"response":{"status_code":200,"body":{"choices":[{"message":{"content":'), quoted, F.lit("}}]}}}")))
        .when(F.col("k") == 1, F.concat(head, F.lit('"response":{"body":{"output":[{"content":[{"type":"output_text","text":'), quoted, F.lit("}]}]}}}")))
        .when(F.col("k") == 2, F.concat(head, F.lit('"result":{"type":"succeeded","message":{"content":[{"type":"text","text":'), quoted, F.lit('}],"usage":{"input_tokens":7,"output_tokens":2}}}}')))
        .when(F.col("k") == 3, F.concat(F.lit('{"key":"'), rid, F.lit('","response":{"candidates":[{"content":{"parts":[{"text":'), quoted, F.lit("}]}}]}}")))
        .otherwise(F.concat(head, F.lit('"error":{"message":"x"}}')))
    )
    lines = e.select(F.explode(F.array(line)).alias("value"))  # so that a line is not made again for each path read from it
    got = lines.select(panel.provider_text("value").alias("r")).select("r.*")
    return got.withColumn("p", panel.category_prediction(panel.first_json_object("text"))).select("request_id", "status", "error", "input_tokens", "p.category_id", "p.category_name", "p.confidence", "p.ambiguous", "p.parse_error")


# tables


@query
def scoped_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of two runs in 8 buckets; then one run's buckets 2 to 5 anew with fewer rows, and its buckets 6 and 7 cleared."""
    path = Scratch(spark).path()
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 8).cast("int").alias("channel_hash_bucket"), F.lit(8).alias("inference_hash_buckets"))
    for run in ("one", "two"):
        sinks.write_scoped(c.withColumn("run_id", F.lit(run)), path, run, (0, 7), full=True)
    fewer = tables.read_table(spark, path).filter("run_id = 'one' and channel_hash_bucket between 2 and 5 and c_custkey % 8 <> 3 and c_custkey % 3 = 0")
    sinks.write_scoped(fewer, path, "one", (2, 5), full=False)
    sinks.clear_scope(spark, path, "one", (6, 7))
    cfg = Config(run_id="one", buckets=8, bucket_start=1, bucket_end=7)
    mine = tables.current_run(tables.read_table(spark, path), cfg).withColumn("scope", F.lit("current run"))
    return mine.unionByName(tables.read_table(spark, path).withColumn("scope", F.lit("all"))).groupBy("scope", "run_id", "channel_hash_bucket").agg(F.count("*").alias("n"))


@query
def run_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Nations written for two runs, one of them twice with another column; appended rows with a column of their own; and scopes."""
    top = Scratch(spark)
    one, two = top.path(), top.path()
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.write_run(n, one, "r1")
    sinks.write_run(n.filter("n_nationkey < 5"), one, "r2")
    sinks.write_run(n.filter("n_nationkey < 9").drop("n_name").withColumn("more", F.lit(1)), one, "r1")
    sinks.append(sinks.read_merged(spark, one).withColumns({"is_full_bucket_range": F.lit(True), "bucket_start": F.lit(0), "bucket_end": F.lit(CFG.buckets - 1)}), two)
    sinks.append(n.select("n_nationkey", F.lit("r1").alias("run_id"), F.lit(False).alias("is_full_bucket_range"), F.lit(3).alias("bucket_start"), F.lit(4).alias("bucket_end")), two)
    both = sinks.read_merged(spark, two)
    full = tables.current_scope(both, Config(run_id="r1")).withColumn("scope", F.lit("full"))
    part = tables.current_scope(both, Config(run_id="r1", bucket_start=3, bucket_end=4)).withColumn("scope", F.lit("part"))
    return full.union(part).union(both.withColumn("scope", F.lit("all"))).groupBy("scope", "run_id").agg(F.count("*").alias("n"), F.count("n_name").alias("named"), F.count("more").alias("more"))


@query
def found_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table overwritten with another schema and read as a view by a detected column, and one that isn't there."""
    path = Scratch(spark).path()
    sinks.overwrite(table(spark, sf, "region"), path)
    sinks.overwrite(table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("text").alias("Caption")), path)
    df = tables.read_table(spark, path)
    sinks.register_views({"glossaria_found": sinks.stamped(df, "r")})
    key, text = (first_existing_column(df, CANDIDATES[c]) for c in ("video_id", "video_description"))
    none = tables.read_optional(spark, path + "-none", df.schema)
    return spark.table("glossaria_found").select(F.col(key).alias("key"), F.length(text).alias("chars"), "run_id").union(none.select("ID", F.length("Caption"), F.lit("none")))


@query
def fixture_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed rows as JSON and as CSV, where all values are text."""
    rows = [{"channel_id": c, "follower_count": n} for c, n in (("a", "1,234"), ("b", "1.2M"), ("c", "abc"))]
    folder = tempfile.mkdtemp(prefix="glossaria-fixture-")
    with open(f"{folder}/f.json", "w", encoding="utf-8") as f:
        json.dump(rows, f)
    with open(f"{folder}/f.csv", "w", encoding="utf-8") as f:
        f.write("channel_id,follower_count\n" + "".join(f'{r["channel_id"]},"{r["follower_count"]}"\n' for r in rows))
    read = lambda kind: tables.read_fixture(spark, f"{folder}/f.{kind}").select(F.lit(kind).alias("kind"), "channel_id", X.subscribers("follower_count").alias("subscribers"))
    return read("json").union(read("csv"))
