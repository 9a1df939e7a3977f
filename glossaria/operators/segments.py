"""Text fields of entities as segments, with script metrics and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import SCRIPTS
from glossaria.functions import text as X


def unpivot(df: DataFrame, entity: str, child: str | None, fields: dict[str, str], cfg: Config) -> DataFrame:
    """(channel_id, video_id, segment_type, text, segment_id): one row for each text field that is not blank, in one scan."""
    if not fields:
        raise ValueError("no text field")
    entry = lambda kind, c: F.struct(F.lit(kind).alias("segment_type"), F.substring(F.col(c).cast("string"), 1, cfg.max_segment_chars).alias("text"))
    video = F.col(child).cast("string") if child else F.lit(None).cast("string")
    rows = df.select(F.col(entity).cast("string").alias("channel_id"), video.alias("video_id"), F.explode(F.array(*[entry(k, c) for k, c in fields.items()])).alias("s")).select("channel_id", "video_id", "s.*")
    rows = rows.filter(F.col("channel_id").isNotNull() & (F.trim(F.col("text")) != ""))
    return rows.withColumn("segment_id", F.sha2(F.concat_ws("||", "channel_id", F.coalesce("video_id", F.lit("")), "segment_type", "text"), 256))


def bucket(c: Column | str, buckets: int, strategy: str = "xxhash64") -> Column:
    """The hash bucket of an id; md5 gives one that other engines can follow."""
    text = X.col(c).cast("string")
    value = F.xxhash64(text) if strategy == "xxhash64" else F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(value, F.lit(buckets)).cast("int")


def in_buckets(df: DataFrame, c: str, cfg: Config, strategy: str = "xxhash64") -> DataFrame:
    """The rows of the run's range of buckets, to be taken before any deduplication or count; a full range needs no filter."""
    if cfg.bucket_start == 0 and cfg.bucket_end == cfg.buckets - 1:
        return df
    return df.filter(bucket(c, cfg.buckets, strategy).between(cfg.bucket_start, cfg.bucket_end))


def by_bucket(df: DataFrame, cfg: Config, partitions: int) -> DataFrame:
    """Rows dealt by bucket, and by segment as well where there are more partitions than buckets."""
    return df.repartition(partitions, "channel_hash_bucket", *(["segment_id"] if partitions > cfg.buckets else []))


def first_channels(channels: DataFrame, n: int, strategy: str = "xxhash64") -> DataFrame:
    """n channels in the order of their hash, ties by id: a distributed top-k. 0 takes all."""
    return channels.orderBy(X.order_hash("channel_id", strategy=strategy), F.asc_nulls_last("channel_id")).limit(n) if n > 0 else channels


def of_channels(df: DataFrame, channels: DataFrame) -> DataFrame:
    """The rows of the given channels, each once however often a channel is listed."""
    return df.join(channels.select("channel_id"), "channel_id", "left_semi")


def with_metrics(segments: DataFrame, cfg: Config) -> DataFrame:
    """Adds cleaned text, script counts, the dominant script, flags of the raw text, validity and its reason."""
    names = [*SCRIPTS, "other"]
    # explode() of one value keeps the optimizer from copying the patterns below it into every filter and CASE above
    df = segments.select("*", F.explode(F.array(X.lower_line("text"))).alias("_l"))
    df = df.select("*", F.explode(F.array(X.clean("_l"))).alias("clean_text")).drop("_l")
    df = df.select("*", F.explode(F.array(X.beyond_ascii("clean_text"))).alias("_b"))
    counts = {"raw_text_len": F.length("text"), "clean_text_len": F.length("clean_text"), "clean_token_count": X.tokens("clean_text", "_b"), **X.script_columns("clean_text", "_b")}
    df = df.select("*", F.explode(F.array(F.struct(*[e.alias(n) for n, e in counts.items()]))).alias("_c")).select("*", "_c.*").drop("_c", "_b")
    df = df.withColumn("other_char_count", F.greatest(F.lit(0), F.col("clean_letter_count") - sum((F.col(f"{s}_char_count") for s in SCRIPTS), F.lit(0))))
    df = df.withColumn("dominant_script", X.dominant_script(names))
    share = F.greatest(*[F.col(f"{s}_char_count") for s in names]) / F.col("clean_letter_count")
    df = df.withColumns({
        "dominant_script_share": F.when(F.col("clean_letter_count") > 0, share).otherwise(0.0),
        "has_url": X.has_url("text"), "has_hashtag": X.has_hashtag("text"), "has_emoji_or_symbol": X.has_symbol("text"),
    })
    letters, other = F.col("clean_letter_count"), ~F.col("dominant_script").isin("latin", "none")
    latin_ok = letters >= cfg.min_clean_chars
    other_ok = other & (letters >= cfg.min_clean_chars_non_latin) & (F.col("dominant_script_share") >= cfg.dominant_script_share)
    reason = (
        F.when(latin_ok | other_ok, F.lit(None).cast("string")).when(letters == 0, "no_letters").when(~other, "below_min_clean_chars_latin_or_mixed")
        .when(letters < cfg.min_clean_chars_non_latin, "below_min_clean_chars_non_latin").when(F.col("dominant_script_share") < cfg.dominant_script_share, "low_dominant_script_share").otherwise("invalid_other")
    )
    return df.withColumns({"is_valid_latin_rule": latin_ok, "is_valid_non_latin_rule": other_ok, "is_valid": latin_ok | other_ok, "short_text_reason": reason})
