"""Classifiers over valid segments: a native word-list detector, and any model through mapInPandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions import text as X
from glossaria.sources.shipping import ship

CARRY = ["channel_id", "segment_id", "segment_type", "clean_letter_count", "dominant_script"]


class LanguageModel(Protocol):
    """What run_model() needs: the k best (raw label, score) of each text."""

    def predict(self, texts: list[str], k: int) -> list[list[tuple[str, float]]]: ...


def _hits(words: dict[str, list[str]]) -> Column:
    """The labels with matches among the words in ``_w``: minus their number, raw label; most matches first."""

    def member(ws: list[str]) -> Callable[[Column], Column]:
        return lambda w: w.isin(ws)

    found = F.array(*[F.struct((-F.size(F.filter("_w", member(ws)))).alias("n"), F.lit(label).alias("label_raw")) for label, ws in sorted(words.items())])
    return F.array_sort(F.filter(found, lambda h: h["n"] < 0))


def _best(hits: Column, k: int) -> Column:
    """The k first of _hits(): rank, raw label, share of all matches. hits: a column, as it is read for each rank."""
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"])
    return F.transform(F.slice(hits, 1, k), lambda h, i: F.struct((i + 1).alias("prediction_rank"), h["label_raw"].alias("label_raw"), F.round(h["n"] / total, 6).alias("score")))


def word_list_models(segments: DataFrame, models: dict[str, dict[str, list[str]]], k: int) -> DataFrame:
    """Top-k labels by the share of matched words, as (carry, lid_model, predictions: array of rank, raw label, score).

    Ranks order by score, then label; labels without a match are left out. The words of a text are split once for all models,
    and only those of some list are looked up label by label.
    """
    listed = sorted({w for words in models.values() for ws in words.values() for w in ws})
    df = segments.select(*CARRY, F.explode(F.array(F.filter(X.letter_words("clean_text"), lambda w: w.isin(listed)))).alias("_w"))
    rows = F.array(*[F.struct(F.lit(m).alias("lid_model"), _hits(words).alias("hits")) for m, words in models.items()])
    return df.select(*CARRY, F.explode(rows).alias("m")).select(*CARRY, "m.lid_model", _best(F.col("m.hits"), k).alias("predictions"))


def _by_bytes(f: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """A frame in parts of at most ``most`` characters of text each; a longer text stands alone."""
    at, total = 0, 0
    for i, n in enumerate(f["clean_text"].str.len().fillna(0).astype(int).tolist()):
        if total and total + n > most:
            yield f.iloc[at:i]
            at, total = i, 0
        total += n
    if at < len(f):
        yield f.iloc[at:]


def run_model(segments: DataFrame, model: str, load: Callable[[], LanguageModel], k: int, most: int = 1 << 20) -> DataFrame:
    """The same for a model that needs Python; if a call fails, its rows are tried one by one.

    load is called once a task: give a models.SharedModel, and the model is loaded once for each worker process. The model sees
    ``most`` characters of text in a call. A frame of an audit stays marked as such.
    """
    ship(segments.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lid = load()
        for whole in frames:
            for f in _by_bytes(whole, most):
                texts, errors = f["clean_text"].fillna("").tolist(), [None] * len(f)
                try:
                    best = lid.predict(texts, k)
                except Exception:  # noqa: BLE001
                    best = []
                    for i, t in enumerate(texts):
                        try:
                            best += lid.predict([t], k)
                        except Exception as e:  # noqa: BLE001
                            best.append([])
                            errors[i] = repr(e)[:500]
                rows = [[{"prediction_rank": r + 1, "label_raw": a, "score": float(s)} for r, (a, s) in enumerate(p)] if t.strip() else [] for p, t in zip(best, texts, strict=True)]
                yield f[CARRY].assign(lid_model=model, predictions=rows, lid_error=errors)

    schema = "channel_id string, segment_id string, segment_type string, clean_letter_count int, dominant_script string, lid_model string, predictions array<struct<prediction_rank:int,label_raw:string,score:double>>, lid_error string"
    out = segments.select(*CARRY, "clean_text").mapInPandas(run, schema)
    return marked(out, o) if (o := origin(segments)) else out


#: The key, in the metadata of segment_id, of the audit that a frame comes from.
ORIGIN = "glossaria_audit"


def marked(df: DataFrame, audit: str) -> DataFrame:
    """df with an audit's name in the metadata of segment_id, where selections, joins and Parquet files keep it."""
    return df.withMetadata("segment_id", {**df.schema["segment_id"].metadata, ORIGIN: audit})


def origin(df: DataFrame) -> str | None:
    """The audit that a frame comes from, if it does."""
    return next((f.metadata[ORIGIN] for f in df.schema if f.name == "segment_id" and ORIGIN in f.metadata), None)


def main_only(df: DataFrame) -> DataFrame:
    """df, if it doesn't come from an audit; results of audits must not feed the main tables, so else it raises."""
    if o := origin(df):
        raise ValueError(f"rows of the audit {o!r} must not feed the main tables")
    return df


def long(predictions: DataFrame) -> DataFrame:
    """One row for each rank, labels parsed, with the first rank's score; segments without a prediction keep one row of nulls."""
    df = predictions.select(*CARRY, "lid_model", F.get(F.col("predictions")["score"], F.lit(0)).alias("score_1"), F.explode_outer("predictions").alias("p"))
    return df.select(*CARRY, "lid_model", F.col("p.prediction_rank").cast("int").alias("prediction_rank"), F.col("p.label_raw").alias("label_raw"), X.parsed_label("p.label_raw").alias("x"), F.col("p.score").alias("score"), "score_1").select(*CARRY, "lid_model", "prediction_rank", "label_raw", "x.*", "score", "score_1")


def audit_segments(long: DataFrame, model: str, least: float = 0.50) -> DataFrame:
    """(segment_id) of a model's segments without a label, with a weak first one, or with a high-risk one."""
    first = long.filter((F.col("lid_model") == model) & F.coalesce(F.col("prediction_rank") == 1, F.lit(True)))
    return first.filter(F.col("label").isNull() | (F.col("score") < least) | X.high_risk("label")).select("segment_id").distinct()


def second_universe(valid: DataFrame, mode: str, long: DataFrame | None = None, model: str = "a") -> DataFrame | None:
    """What the second model reads: nothing, all valid segments, or those that audit the first model. Only the results on all
    valid segments may feed the main tables; the others are marked, and main_only() refuses them."""
    if mode == "disabled":
        return None
    if mode == "all_valid_segments":
        return valid
    if mode != "audit_segments":
        raise ValueError(f"unknown mode {mode!r}")
    if long is None:
        raise ValueError("audit_segments needs the predictions of the first model")
    return marked(valid.join(audit_segments(long, model), "segment_id", "left_semi"), mode)


def native_audit(valid: DataFrame, fraction: float, allow_full: bool, seed: int) -> DataFrame:
    """Segments with ``clean_text_native``, for an audit of the cleaning: a Bernoulli sample, or all of them if that is allowed.

    A fraction of 0 stands for all.
    """
    full = fraction <= 0 or fraction >= 1
    if full and not allow_full:
        raise ValueError("the audit would read all valid segments: allow that, or give a fraction between 0 and 1")
    some = valid if full else valid.sample(withReplacement=False, fraction=fraction, seed=seed)
    return marked(some.withColumn("clean_text_native", X.clean_native("text")), "native_cleaning")


def long_sample(long: DataFrame, run_id: str, fraction: float, strategy: str = "xxhash64") -> DataFrame:
    """A share of the long predictions, all ranks of a segment and model or none, by a hash of segment, run and model."""
    parts = [F.col("segment_id"), F.lit(run_id), F.col("lid_model")]
    draw = F.xxhash64(*parts) if strategy == "xxhash64" else F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    return long.filter(F.pmod(draw, F.lit(1_000_000)) < int(fraction * 1_000_000))
