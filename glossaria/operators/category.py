"""Reference labels, stratified samples, prompts and the evaluation of category predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.constants import CATEGORIES
from glossaria.functions import text as X
from glossaria.operators.dedup import keep_top
from glossaria.sources.scratch import Scratch


def reference_labels(videos: DataFrame, label: str, least: int, share: float) -> DataFrame:
    """The commonest known category of each channel with enough labelled videos and enough agreement; ties by id."""
    known = videos.withColumn("category_id", X.category_id(label, CATEGORIES)).filter("category_id is not null")
    votes = known.groupBy("channel_id", "category_id").agg(F.count("*").alias("votes"))
    per = Window.partitionBy("channel_id")
    votes = votes.withColumn("labelled", F.sum("votes").over(per)).withColumn("agreement", F.round(F.col("votes") / F.col("labelled"), 9))
    best = keep_top(votes, ["channel_id"], [F.desc("votes"), F.desc("agreement"), F.col("category_id").cast("int").asc()])
    return best.filter((F.col("labelled") >= least) & (F.col("agreement") >= share))


def stratified(df: DataFrame, stratum: list[str], n: int, cap: int, seed: str) -> DataFrame:
    """Up to n channels of each stratum and ``cap`` in all, in the order of a portable hash."""
    mark = F.sha2(F.concat_ws("||", F.lit(seed), "channel_id"), 256)
    return keep_top(df.withColumn("_mark", mark), stratum, [F.col("_mark").asc(), F.col("channel_id").asc()], n).orderBy("_mark", "channel_id").limit(cap).drop("_mark")


#: How a run mode chooses: whether a reference label must be there (None: either), and the columns of its strata.
RUN_MODES = {
    "labeled_validation": (True, ["iso639_3", "category_id"]), "unlabeled_pilot": (False, ["iso639_3"]), "full_unlabeled": (False, []), "all": (None, []),
}


def chosen(inputs: DataFrame, mode: str, per_stratum: int, cap: int, seed: str) -> DataFrame:
    """The channels that a run of a mode asks about: up to per_stratum of each stratum, if it has strata, and ``cap`` in all.

    A cap of 0 is none, and a full run has none. inputs: channel_id, iso639_3, category_id and more.
    """
    if mode not in RUN_MODES:
        raise ValueError(f"unknown run mode {mode!r}")
    labelled, strata = RUN_MODES[mode]
    known = F.col("category_id").isNotNull()
    df = inputs if labelled is None else inputs.filter(known if labelled else ~known)
    mark = F.sha2(F.concat_ws("||", F.lit(seed), "channel_id"), 256)
    if strata:
        df = keep_top(df, strata, [mark.asc(), F.col("channel_id").asc()], per_stratum)
    return df.orderBy(mark, "channel_id").limit(cap) if cap > 0 and mode != "full_unlabeled" else df


#: The text that a prompt begins with.
PROMPT_HEAD = "Classify the following YouTube channel into exactly one allowed category. Return strict JSON only.\n\n"


def prompt_inputs(channels: DataFrame, lines: DataFrame, references: DataFrame, languages: DataFrame, cap: int) -> DataFrame:
    """Each channel with what is known of it, and its prompt of at most ``cap`` characters, which never holds the reference.

    channels: channel_id, name, description; lines: of prompt_lines(); references: of reference_labels(); languages: channel_id,
    label, iso639_3.
    """
    told = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    df = channels.join(lines.select("channel_id", F.col("prompt").alias("lines"), "n_videos"), "channel_id", "left").join(references.select("channel_id", "category_id"), "channel_id", "left").join(languages, "channel_id", "left")
    df = df.withColumns({"label": told("label", "unknown"), "iso639_3": told("iso639_3", "unknown"), "n_videos": told("n_videos", 0)})
    text = F.concat(
        F.lit(PROMPT_HEAD + "Channel name: "), told("name", ""), F.lit("\nDetected language: "), "label", F.lit(" ("), "iso639_3", F.lit(")\nChannel description: "), told("description", ""),
        F.lit("\n\nRecent videos:\n"), told("lines", ""), F.lit("\n"),
    )
    return df.select("channel_id", "label", "iso639_3", "n_videos", "category_id", F.substring(text, 1, cap).alias("prompt"))


def prompt_lines(videos: DataFrame, n: int, title_chars: int, cap: int) -> DataFrame:
    """One prompt a channel: its first n videos as numbered lines, cut to ``cap`` characters."""
    top = keep_top(videos, ["channel_id"], [F.desc_nulls_last("rank_value"), F.asc("video_id")], n, "rn")
    line = F.concat(F.col("rn").cast("string"), F.lit(". "), F.substring(F.coalesce("title", F.lit("")), 1, title_chars))
    lines = F.array_sort(F.collect_list(F.struct(F.col("rn"), line.alias("line"))))
    return top.groupBy("channel_id").agg(F.substring(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), 1, cap).alias("prompt"), F.count("*").alias("n_videos"))


#: Rows up to which a table of models is broadcast.
MODELS = 1000


def request_id(run_id: str, form: str = "hash") -> Column:
    """The id of a request: a hash of run, provider, model and channel, or these in plain text."""
    parts = [F.lit(run_id), F.col("provider"), F.col("model"), F.col("channel_id")]
    if form == "plain":
        return F.concat_ws("__", *parts)
    return F.concat(F.lit("yc_"), F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 61))


def fan_out(inputs: DataFrame, models: DataFrame, run_id: str, chunk: int, form: str = "hash") -> DataFrame:
    """A request for each input and model: its id and a chunk of at most ``chunk`` requests of one provider and model.

    models are broadcast if there are at most MODELS of them.
    """
    small = F.broadcast(models) if models.limit(MODELS + 1).count() <= MODELS else models
    df = inputs.crossJoin(small).withColumn("request_id", request_id(run_id, form))
    keys = ["provider", "model"]
    if form == "hash":
        return numbered_chunks(df, keys, "request_id", F.substring("request_id", 1, 5), chunk)
    return numbered_chunks(ranged(df, [*keys, "request_id"]), keys, "request_id", F.col("_lead"), chunk)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of an order, as many as a shuffle has partitions, with _lead: the number of a row's range. Written, so that
    a task that is run again finds the same ranges; for ids that may all begin alike."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Scratch(df.sparkSession).table(df.repartitionByRange(n, *order).withColumn("_lead", F.spark_partition_id()))


def numbered_chunks(df: DataFrame, keys: list[str], order: str, lead: Column, chunk: int) -> DataFrame:
    """df with chunk_id: the rows of each key, in the order of a column, by ``chunk``.

    lead: what the order begins with, so that no task has all rows of a key: rows are numbered among those of one lead, and go on
    where the leads before it end.
    """
    df = df.withColumn("_lead", lead)
    counts = df.groupBy(*keys, "_lead").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_lead", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_lead").orderBy(order))
    numbered = df.withColumn("_rank", rank).join(offsets, [*keys, "_lead"])
    return numbered.withColumn("chunk_id", F.floor((F.col("_before") + F.col("_rank") - 1) / chunk).cast("int")).drop("_lead", "_rank", "_before")


def overall(pred: DataFrame, *by: str) -> DataFrame:
    """pred: provider, model, predicted, reference, confidence, ambiguous. Accuracy counts rows with a reference."""
    right = correct(F.col("predicted"), F.col("reference")).cast("double")
    errors = [F.count_if(F.col("parse_error").isNotNull()).alias("n_parse_errors")] if "parse_error" in pred.columns else []
    return pred.groupBy("provider", "model", *by).agg(F.count("*").alias("n"), F.count("predicted").alias("n_predicted"), F.count("reference").alias("n_reference"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum(F.coalesce(F.col("ambiguous").cast("long"), F.lit(0))).alias("n_ambiguous"), *errors)


def by_language(pred: DataFrame, *by: str) -> DataFrame:
    """Accuracy on rows that have both labels, by language."""
    both = pred.filter("reference is not null and predicted is not null")
    return both.groupBy("provider", "model", *by).agg(F.count("*").alias("n"), F.round(F.avg(correct(F.col("predicted"), F.col("reference")).cast("double")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def evaluation(pred: DataFrame, categories: list[str], language: str) -> DataFrame:
    """One table of both levels: each model with its macro measures, and each model's accuracy by language."""
    macro = per_class(pred, categories).groupBy("provider", "model").agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    whole = overall(pred).join(macro, ["provider", "model"], "left").withColumn("level", F.lit("overall"))
    return whole.unionByName(by_language(pred, language).withColumns({"level": F.lit("language"), "n_predicted": F.col("n"), "n_reference": F.col("n")}), allowMissingColumns=True)


def with_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results with what their request was about, by run_id and request_id, of which the map has one row each.

    results: run_id, request_id, category_id, parse_error and more. A result without a known request stays, with nulls.
    """
    known = requests.select("run_id", "request_id", "provider", "model", "channel_id", F.col("reference_category_id").alias("reference"), "iso639_3").dropDuplicates(["run_id", "request_id"])
    df = results.join(known, ["run_id", "request_id"], "left")
    return df.withColumn("correct", correct(F.col("category_id"), F.col("reference")))


def per_class(pred: DataFrame, categories: list[str]) -> DataFrame:
    """Precision, recall and F1 of every category of the full grid, 0 where undefined, in one conditional aggregate."""
    grid = pred.sparkSession.createDataFrame([(c,) for c in categories], "category_id string")
    both = pred.filter("reference is not null")
    cells = both.select("provider", "model", F.explode(F.array(F.struct(F.col("predicted").alias("category_id"), F.lit(1).alias("p"), F.lit(0).alias("r"), (F.col("predicted") == F.col("reference")).cast("int").alias("t")), F.struct(F.col("reference").alias("category_id"), F.lit(0).alias("p"), F.lit(1).alias("r"), F.lit(0).alias("t")))).alias("x")).select("provider", "model", "x.*")
    sums = cells.filter("category_id is not null").groupBy("provider", "model", "category_id").agg(*[F.sum(c).alias(n) for c, n in (("p", "predicted_n"), ("r", "reference_n"), ("t", "true_n"))])
    df = pred.select("provider", "model").distinct().crossJoin(F.broadcast(grid)).join(sums, ["provider", "model", "category_id"], "left").fillna(0, ["predicted_n", "reference_n", "true_n"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("true_n", "predicted_n")), zero(F.try_divide("true_n", "reference_n"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", F.round(zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))), 9)).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.groupBy("provider", "model").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def pairwise(pred: DataFrame) -> DataFrame:
    """Agreement of each two models over the channels that both predicted."""
    side = lambda s: pred.filter("predicted is not null").select("channel_id", F.col("model").alias(f"model_{s}"), F.col("predicted").alias(f"p_{s}"))
    return side("a").join(side("b"), "channel_id").filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("overlap"), F.round(F.avg((F.col("p_a") == F.col("p_b")).cast("double")), 6).alias("agreement"))


def majority(pred: DataFrame) -> DataFrame:
    """Each channel's category with most models, then the highest mean confidence, then the smallest id."""
    votes = pred.filter("predicted is not null").groupBy("channel_id", F.col("predicted").alias("category_id")).agg(F.count("*").alias("votes"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    return keep_top(votes, ["channel_id"], [F.desc("votes"), F.desc("mean_confidence"), F.col("category_id").cast("int").asc()])


def correct(predicted: Column, reference: Column) -> Column:
    return F.when(predicted.isNotNull() & reference.isNotNull(), predicted == reference)
