"""Metrics of segments against the plain patterns that they stand for, over all of Unicode's planes in use."""

from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.constants import ROMANIZED_HINDI_KEYWORDS, ROMANIZED_INDIC_KEYWORDS
from glossaria.functions import text as X
from glossaria.operators import diagnostics, predictions, segments

URL = r"(?i)https?://\S+|www\.\S+"


def texts():
    points = [*range(0x3100), *range(0xA000, 0xABFF), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800, 7), *range(0x1F300, 0x1F6FF, 5), 0x4E00, 0xAC00, 0xE0100]
    each = [chr(p) for p in points if not 0xD800 <= p < 0xE000]
    out = [f"{c}Ab{c}x{c}{c}9 Z{c} {c}q_{c}" for c in each]
    out += ["a\tb\r\nc \t d", "See HTTPS://x.y/z and www.A.b #tag", "#", "# a", "a+b", "\n\n", " ", "12 34", "a_b  c", "http", "WWW.", "Ünï  cödé　x", "a\n", " a b ", "KKelvin İı"]
    return out + [f"{w.upper()} x{w} {w}. {w}-{w}" for w in ROMANIZED_INDIC_KEYWORDS]


def test_metrics_equal_plain_patterns(spark):
    df = spark.createDataFrame([(f"c{i}", "v", "t", t) for i, t in enumerate(texts())], "channel_id string, video_id string, segment_type string, text string")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s\s+", " ")
    line = F.lower(F.translate(strip(F.col("text")), "\r\n", "  "))
    want = strip(squeeze(F.regexp_replace(squeeze(F.regexp_replace(line, URL, " ")), r"(?U)[^\w\p{Zs}]|\d", "")))
    got = segments.with_metrics(df, Config()).withColumn("w", want).localCheckpoint()
    counts = {"clean_text": F.col("w"), "clean_token_count": F.when(F.col("w") == "", 0).otherwise(F.size(F.split("w", r"(?U)\s+"))), "clean_letter_count": F.regexp_count("w", F.lit(r"\p{L}")), "latin_char_count": F.regexp_count("w", F.lit(r"\p{IsLatin}"))}
    flags = {"has_url": F.col("text").rlike(URL), "has_hashtag": F.col("text").rlike(r"(?U)#\w+"), "has_emoji_or_symbol": F.col("text").rlike(r"[\p{So}\p{Sk}\p{Sc}\p{Sm}]")}
    for name, plain in (counts | flags).items():
        assert [r.text for r in got.filter(~F.col(name).eqNullSafe(plain)).select("text").limit(5).collect()] == [], name
    low = got.select("text", F.lower("text").alias("low"), X.letter_words("clean_text").alias("words"), F.split("clean_text", r"[^\p{L}]+").alias("plain")).localCheckpoint()
    assert low.filter("words <> plain").count() == 0
    for name, words in (("hindi", ROMANIZED_HINDI_KEYWORDS), ("indic", ROMANIZED_INDIC_KEYWORDS)):
        pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        found = diagnostics.romanized_keywords(low).withColumn("n", F.size(F.regexp_extract_all("low", F.lit(rf"\b({pattern})\b"), F.lit(1))))
        assert found.filter(f"{name}_keyword_count <> n").count() == 0 and found.agg(F.sum("n")).first()[0] > 50


def test_matches_are_counted_once(spark):
    """Neither a label's matches nor a text's cleaning may be computed again for each rank or branch: plans hold their patterns once."""
    df = spark.createDataFrame([("c", "v", "t", "the cat")], "channel_id string, video_id string, segment_type string, text string")
    measured = segments.with_metrics(df, Config())
    assert measured._jdf.queryExecution().optimizedPlan().toString().count("trim(text") == 1
    told = predictions.word_list_models(measured.withColumn("segment_id", F.lit("s")), {"a": {"eng_Latn": ["the"], "fra_Latn": ["le"]}}, 5)
    assert [tuple(p) for p in told.first().predictions] == [(1, "eng_Latn", 1.0)]
