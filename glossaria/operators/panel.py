"""Routing of channels to a panel, requests, result parsing for several providers, and the majority verdict."""

from __future__ import annotations

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.constants import AGREEMENT_STATUSES, ARABIC_FAMILY_ISO, CATEGORIES, DISAGREEMENT_STATUSES, PANEL_SOURCE_INDIC_CODES, ROUTES
from glossaria.functions import text as X
from glossaria.operators.dedup import keep_top


class BatchSubmitter(Protocol):
    """Sends a file of request lines to a provider; none is included, jobs are recorded as (provider, model, path, job_id, status)."""

    def submit(self, provider: str, model: str, path: str) -> str: ...


class DryRun:
    """A submitter that sends nothing."""

    def submit(self, provider: str, model: str, path: str) -> str:
        return f"dry-run:{provider}:{model}:{path.rsplit('/', 1)[-1]}"


def indic_evidence(compared: DataFrame, features: DataFrame | None, audit: DataFrame | None) -> DataFrame:
    """compared with ``indic``: whether texts, keywords or the source's language speak for an Indic language.

    features: channel_id, devanagari_chars, indic_keywords; audit: channel_id, contains_devanagari, indic_keywords, source_language.
    Either may be missing, and lists of several rows for a channel count once.
    """
    signals = []
    if features is not None:
        side = features.select("channel_id", (F.col("devanagari_chars") > 0).alias("_f1"), (F.col("indic_keywords") > 0).alias("_f2")).dropDuplicates(["channel_id"])
        compared, signals = compared.join(side, "channel_id", "left"), ["_f1", "_f2"]
    if audit is not None:
        side = audit.select("channel_id", F.col("contains_devanagari").alias("_a1"), (F.col("indic_keywords") > 0).alias("_a2"), F.lower(F.trim("source_language")).isin(PANEL_SOURCE_INDIC_CODES).alias("_a3")).dropDuplicates(["channel_id"])
        compared, signals = compared.join(side, "channel_id", "left"), [*signals, "_a1", "_a2", "_a3"]
    any_of = F.coalesce(F.greatest(F.lit(False), F.lit(False), *[F.coalesce(F.col(s), F.lit(False)) for s in signals]), F.lit(False))
    return compared.withColumn("indic", any_of).drop(*signals)


def route(compared: DataFrame, fraction: float, seed: str, strategy: str = "xxhash64", most: int = 0) -> DataFrame:
    """(channel_id, route_reason, ...): channels for the panel, each for its first reason; ``most`` of them in hash order, if that isn't 0.

    compared: of indic_evidence().
    """
    c, f = F.col, F.lit(False)
    arabic = F.coalesce(c("a_primary_iso").isin(ARABIC_FAMILY_ISO) & c("b_primary_iso").isin(ARABIC_FAMILY_ISO), f)
    if strategy == "xxhash64":
        draw = F.pmod(F.xxhash64(F.concat_ws("|", "channel_id", F.lit(seed))), F.lit(1_000_000))
    else:
        draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "channel_id", F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000))
    tests = [
        c("consensus_status").isin(DISAGREEMENT_STATUSES) & ~arabic, (c("consensus_status") == "high_risk_tail_label_needs_review") & c("consensus_label").isNull(),
        (c("consensus_iso") == "eng") & c("indic"), c("consensus_status").isin(AGREEMENT_STATUSES) & (draw < int(fraction * 1_000_000)),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(t, f), F.lit(n)) for n, t in zip(ROUTES, tests, strict=True)])
    keep = ["consensus_status", "consensus_label", "consensus_iso", F.col("consensus_source").alias("fasttext_source"), "a_primary_label", "b_primary_label"]
    routed = compared.select("channel_id", reason.alias("route_reason"), *keep).filter("route_reason is not null")
    return routed.orderBy(X.order_hash("channel_id", strategy=strategy), "channel_id").limit(most) if most > 0 else routed


#: What prompts say around a channel's texts.
PROMPT_HEAD, PROMPT_NAME, PROMPT_DESCRIPTIONS, PROMPT_TITLES = "Channel metadata to classify:", "CHANNEL NAME: ", "DESCRIPTIONS:", "VIDEO TITLES:"
PROMPT_NOTE = "(Items tagged [lid-invalid: ...] failed the fastText eligibility rule; use the reason/letter/script diagnostics and weigh them as weak evidence.)"
NO_METADATA = "No usable channel metadata was found."


def panel_prompt(segments: DataFrame, chars: int = 350, descriptions: int = 4, titles: int = 12, cap: int = 6000) -> DataFrame:
    """One prompt a channel: a name, descriptions and titles, or other texts where there are neither; valid ones first, the others with
    a tag that says why they are not. Of each group only as many texts as a prompt takes are gathered."""
    c = F.col
    text = F.substring("text", 1, chars)
    why = F.array_compact(F.array(
        F.concat(F.lit("reason="), F.col("short_text_reason")), F.concat(F.lit("letters="), c("clean_letter_count").cast("string")), F.concat(F.lit("clean_len="), c("clean_text_len").cast("string")),
        F.concat(F.lit("script="), F.col("dominant_script"), F.lit(":"), F.format_string("%.2f", F.col("dominant_script_share"))),
    ))
    tag = F.when(c("is_valid"), "").otherwise(F.concat(F.lit(" [lid-invalid: "), F.array_join(why, ", "), F.lit("]")))
    group = F.when(c("segment_type") == "channel_name", 0).when(c("segment_type").isin("channel_description", "video_description"), 1).when(c("segment_type") == "video_title", 2).otherwise(3)
    rows = segments.select("channel_id", "segment_type", text.alias("cut"), group.alias("g"), F.when(group > 0, ~c("is_valid")).otherwise(F.lit(False)).alias("late"), F.concat(X.strip(text), tag).alias("entry")).filter(X.strip(c("cut")) != "")
    most = F.when(c("g") == 0, 1).when(c("g") == 1, descriptions).otherwise(titles)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("channel_id", "g").orderBy("late", "segment_type", "cut"))).filter((c("n") <= max(descriptions, titles, 1)) & (c("n") <= most))
    df = first.groupBy("channel_id").agg(F.array_sort(F.collect_list(F.struct("g", "n", "entry"))).alias("all"))
    of = lambda g: F.transform(F.filter("all", lambda e: e["g"] == g), lambda e: e["entry"])
    listed = lambda g: F.transform(of(g), lambda e: F.concat(F.lit("- "), e))
    headed = lambda g, head: F.when(F.size(of(g)) > 0, F.concat(F.array(F.lit(head)), listed(g))).otherwise(F.array().cast("array<string>"))
    other = F.when((F.size(of(1)) == 0) & (F.size(of(2)) == 0), listed(3)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.lit(PROMPT_HEAD)), F.transform(of(0), lambda e: F.concat(F.lit(PROMPT_NAME), e)), headed(1, PROMPT_DESCRIPTIONS), headed(2, PROMPT_TITLES), other, F.array(F.lit(PROMPT_NOTE)))
    return df.select("channel_id", F.substring(F.array_join(lines, "\n"), 1, cap).alias("prompt"))


def routed_prompts(routed: DataFrame, segments: DataFrame) -> DataFrame:
    """Each routed channel with its prompt; one that has no text gets a sentence that says so."""
    mine = segments.join(routed.select("channel_id"), "channel_id", "left_semi")
    return routed.join(panel_prompt(mine), "channel_id", "left").withColumn("prompt", F.coalesce("prompt", F.lit(NO_METADATA)))


def batch_line(provider: Column, model: Column, request_id: Column, system: str, prompt: Column, max_tokens: int, temperature: float | None = None) -> Column:
    """A provider's request as a JSON line; fields that are null are left out; an unknown provider raises."""
    sys_, lim = F.lit(system), F.lit(max_tokens)
    temp = F.lit(temperature).cast("double")
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    chat = F.to_json(F.struct(request_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(model.alias("model"), F.array(msg("system", sys_), msg("user", prompt)).alias("messages"), lim.alias("max_tokens"), temp.alias("temperature")).alias("body")))
    responses = F.to_json(F.struct(request_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), F.struct(model.alias("model"), sys_.alias("instructions"), prompt.alias("input"), lim.alias("max_output_tokens")).alias("body")))
    anthropic = F.to_json(F.struct(request_id.alias("custom_id"), F.struct(model.alias("model"), sys_.alias("system"), F.array(msg("user", prompt)).alias("messages"), lim.alias("max_tokens"), temp.alias("temperature")).alias("params")))
    part = lambda c: F.array(F.struct(c.alias("text")))
    gemini = F.to_json(F.struct(request_id.alias("key"), F.struct(F.struct(part(sys_).alias("parts")).alias("system_instruction"), F.array(F.struct(F.lit("user").alias("role"), part(prompt).alias("parts"))).alias("contents"), F.struct(lim.alias("maxOutputTokens"), temp.alias("temperature")).alias("generation_config")).alias("request")))
    newer = model.rlike("^(gpt-5|o[0-9])")
    return F.when((provider == "openai") & newer, responses).when(provider == "openai", chat).when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(F.raise_error(F.concat(F.lit("unknown provider: "), provider)))


_PART = "array<struct<type:string,text:string>>"


def provider_text(line: Column | str) -> Column:
    """struct(request_id, model, text, status, input_tokens, output_tokens, error) of a result line of any provider."""
    x = X.col(line)
    j = lambda path: F.get_json_object(x, path)
    texts = lambda parts, kinds: F.transform(F.filter(parts, lambda p: p["type"].isin(kinds) & p["text"].isNotNull()), lambda p: p["text"])
    some = lambda arr: F.when(F.size(arr) > 0, F.array_join(arr, "\n"))
    blank = lambda c: F.when(c != "", c)
    output = F.from_json(j("$.response.body.output"), f"array<struct<content:{_PART}>>")
    chunks = F.flatten(F.transform(output, lambda o: F.coalesce(o["content"], F.array().cast(_PART))))
    body, result = j("$.response.body"), j("$.result")
    openai = F.coalesce(blank(j("$.response.body.output_text")), blank(j("$.response.body.choices[0].message.content")), some(texts(chunks, ["output_text", "text"])))
    anthropic = F.when(result.isNotNull(), F.array_join(texts(F.from_json(j("$.result.message.content"), _PART), ["text"]), "\n"))
    gemini = F.coalesce(j("$.response.candidates[0].content.parts[0].text"), j("$.candidates[0].content.parts[0].text"), j("$.response.text"))
    text = F.coalesce(openai, anthropic, gemini)
    ok = F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*\{")
    status = F.coalesce(F.when(openai.isNull(), j("$.result.type")), F.when(body.isNotNull(), F.coalesce(j("$.response.status_code"), j("$.response.body.status"), F.lit("succeeded"))), j("$.status"), F.when(text.isNull(), "unknown").otherwise("succeeded"))
    failure = F.coalesce(j("$.error"), j("$.response.error"), j("$.result.error"))
    error = F.when(~ok, "json_load_error").when(text.isNull(), F.coalesce(F.substring(failure, 1, 300), F.lit("could_not_extract_text")))
    count = lambda *paths: F.coalesce(*[j(p).try_cast("long") for p in paths])
    return F.struct(
        F.coalesce(j("$.custom_id"), j("$.key"), j("$.id")).alias("request_id"),
        F.coalesce(j("$.response.body.model"), j("$.result.message.model"), j("$.modelVersion"), j("$.response.modelVersion")).alias("model"),
        text.alias("text"), F.when(ok, status).otherwise("json_load_error").alias("status"),
        count("$.response.body.usage.prompt_tokens", "$.response.body.usage.input_tokens", "$.result.message.usage.input_tokens", "$.response.usageMetadata.promptTokenCount", "$.usageMetadata.promptTokenCount").alias("input_tokens"),
        count("$.response.body.usage.completion_tokens", "$.response.body.usage.output_tokens", "$.result.message.usage.output_tokens", "$.response.usageMetadata.candidatesTokenCount", "$.usageMetadata.candidatesTokenCount").alias("output_tokens"),
        error.alias("error"),
    )


def first_json_object(text: Column | str) -> Column:
    """The text if it is a JSON object, else the first object in it that can be decoded.

    Texts that are one object, as most are, are told by a native parse. Balanced scanning is beyond regular expressions, so the
    others go through Python, over Arrow batches; those that the parse has settled are null there and cost nothing.
    """

    def first(value: str | None) -> str | None:
        if not value:
            return None
        at, decoder = value.find("{"), json.JSONDecoder()
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(value, at)
            except (ValueError, RecursionError):
                found = None
            if isinstance(found, dict):
                return json.dumps(found)
            at = value.find("{", at + 1)
        return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(first)

    whole = F.try_parse_json(X.col(text)).isNotNull() & X.col(text).rlike(r"^\s*\{")
    return F.when(whole, X.col(text)).otherwise(run(F.when(F.coalesce(whole, F.lit(False)), F.lit(None)).otherwise(X.col(text))))


def _flag(c: Column, yes: tuple[str, ...], no: tuple[str, ...] | None = None) -> Column:
    """A truth value written as JSON or as text; without ``no`` any other text is false."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*yes), F.lit(True)).when(low.isNotNull() if no is None else low.isin(*no), F.lit(False))


def category_prediction(obj: Column | str) -> Column:
    """struct(category_id, category_name, confidence, ambiguous, rationale, parse_error) of a payload.

    An id that is unknown is made good by the category's name; if that is unknown too, nothing else of the payload counts.
    """
    x = X.col(obj)
    j = lambda k: F.get_json_object(x, f"$.{k}")
    ids = F.create_map(*[F.lit(v) for i in CATEGORIES for v in (i, i)])
    names = F.create_map(*[F.lit(v) for i, n in CATEGORIES.items() for v in (n.lower(), i)])
    said, name = F.trim(F.coalesce(j("category_id"), F.lit(""))), F.trim(F.coalesce(j("category_name"), F.lit("")))
    cid = F.coalesce(F.element_at(ids, said), F.element_at(names, F.lower(name)))
    known = F.element_at(F.create_map(*[F.lit(v) for i, n in CATEGORIES.items() for v in (i, n)]), cid)
    conf = j("confidence").try_cast("double")
    error = F.when(x.isNull(), "invalid_or_missing_json").when(cid.isNull(), F.concat(F.lit("invalid_category_id:"), said))
    return F.struct(
        cid.alias("category_id"), F.coalesce(known, F.when(name != "", name)).alias("category_name"), F.when(cid.isNotNull() & conf.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))).alias("confidence"),
        F.when(cid.isNotNull(), _flag(j("ambiguous"), ("true", "1", "yes", "y"))).alias("ambiguous"), F.substring(j("rationale_short"), 1, 500).alias("rationale"), error.alias("parse_error"),
    )


#: What a panel's payload calls its fields.
_YES, _NO = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")


def language_prediction(obj: Column | str) -> Column:
    """struct(label, iso639_3, script, status, is_romanized, is_high_risk_tail, is_mixed, secondary_label, dialect, mixed_languages,
    confidence, evidence, parse_error). Language and script come from the label where they are not given."""
    x = X.col(obj)
    j = lambda k: F.get_json_object(x, f"$.{k}")
    label = j("primary_language_label")
    part = lambda k: F.get(F.split(label, "_"), F.lit(k))
    some = lambda c: F.when(c != "", c)
    listed = F.filter(F.try_variant_get(F.try_parse_json(j("mixed_languages")), "$", "array<string>"), lambda v: F.trim(v) != "")
    mixed = F.coalesce(listed, F.when(F.trim(j("mixed_languages")) != "", F.array(F.trim(j("mixed_languages")))), F.array().cast("array<string>"))
    return F.struct(
        label.alias("label"), F.coalesce(some(j("primary_language_iso639_3")), F.lower(part(0))).alias("iso639_3"), F.coalesce(some(j("primary_language_script")), part(1)).alias("script"), j("status").alias("status"),
        *[_flag(j(k), _YES, _NO).alias(n) for k, n in (("is_romanized", "is_romanized"), ("is_high_risk_tail", "is_high_risk_tail"), ("is_mixed_language", "is_mixed"))],
        j("secondary_language_label").alias("secondary_label"), j("dialect_or_variant").alias("dialect"), mixed.alias("mixed_languages"), j("confidence").alias("confidence"),
        F.when(x.isNotNull(), F.substring(F.coalesce(j("evidence"), F.lit("")), 1, 500)).alias("evidence"), F.when(x.isNull(), "no_json_object").alias("parse_error"),
    )


def base_iso(iso: Column, label: Column) -> Column:
    """The language of a prediction, lower-case: as given, else what its label begins with; empty, null and none are no language."""
    blank = lambda c: F.when(~F.lower(F.trim(c)).isin("", "null", "none"), F.lower(F.trim(c)))
    return F.coalesce(blank(iso), blank(F.get(F.split(label, "_"), F.lit(0))))


#: Result statuses that make a vote invalid, beside 4xx and 5xx.
FAILED = ["error", "failed", "failure", "errored", "expired", "cancelled", "canceled", "json_load_error", "rate_limited", "timeout"]


def valid_vote(iso: Column, status: Column, result_error: Column, parse_error: Column, result_status: Column) -> Column:
    told = F.lower(F.coalesce(result_status.cast("string"), F.lit("")))
    return iso.isNotNull() & (F.lower(F.coalesce(status, F.lit(""))) == "classified") & result_error.isNull() & parse_error.isNull() & ~(told.rlike(r"^[45]\d\d$") | told.isin(FAILED))


def imported(lines: DataFrame, requests: DataFrame, run_id: str) -> DataFrame:
    """One parsed result for each request of a run that has any; results of other runs are left out.

    lines: (value) of result files; requests: the registry (run_id, request_id, provider, model, channel_id).
    """
    got = lines.select(provider_text("value").alias("r")).select("r.*").withColumnsRenamed({"model": "result_model", "status": "result_status", "error": "result_error"})
    got = got.withColumn("p", language_prediction(first_json_object("text"))).select("*", "p.*").drop("p")
    known = requests.filter(F.col("run_id") == run_id).select("request_id", "provider", "model", "channel_id").dropDuplicates(["request_id"])
    got = got.join(known, "request_id").withColumn("iso639_3", base_iso(F.col("iso639_3"), F.col("label")))
    valid = valid_vote(F.col("iso639_3"), F.col("status"), F.col("result_error"), F.col("parse_error"), F.col("result_status"))
    return one_result(got.withColumn("is_valid", valid))


def one_result(results: DataFrame) -> DataFrame:
    """The best result of each request: valid, read without an error, with a text; then by status, model and text."""
    order = [F.desc("is_valid"), F.col("result_error").isNull().desc(), F.col("text").isNotNull().desc(), F.coalesce("result_status", F.lit("")).asc(), F.coalesce("result_model", F.lit("")).asc(), F.asc_nulls_last("text")]
    return keep_top(results, ["request_id"], order)


def verdicts(routed: DataFrame, results: DataFrame, models: int) -> DataFrame:
    """One verdict for each routed channel: the language with most valid votes, its commonest label, and what its voters say.

    results: of imported(); models: how many were asked. Where several voters differ in a field, the smallest value is taken.
    """
    c = F.col
    good = results.filter("is_valid")
    rank = F.when(c("confidence") == "high", 3).when(c("confidence") == "medium", 2).when(c("confidence") == "low", 1).otherwise(0)
    win = keep_top(good.groupBy("channel_id", "iso639_3").agg(F.count("*").alias("winning_votes")), ["channel_id"], [F.desc("winning_votes"), F.asc("iso639_3")])
    voters = good.join(win.select("channel_id", "iso639_3"), ["channel_id", "iso639_3"])
    flag = lambda n: F.coalesce(F.max(n), F.lit(False)).alias(f"panel_{n}")
    side = voters.groupBy("channel_id", "label").agg(
        F.count("*").alias("k"), F.max(rank).alias("r"), F.min("script").alias("_script"), F.min("secondary_label").alias("panel_secondary_label"), F.min("dialect").alias("panel_dialect"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("mixed_languages")))).alias("panel_mixed_languages"), flag("is_mixed"), flag("is_romanized"), F.min("evidence").alias("panel_evidence"),
    )
    label = keep_top(side, ["channel_id"], [F.desc("k"), F.desc("r"), F.asc_nulls_first("label")])
    label = label.withColumn("panel_confidence", F.when(c("r") == 3, "high").when(c("r") == 2, "medium").when(c("r") == 1, "low")).drop("k", "r").withColumnRenamed("label", "panel_label")
    of = lambda p: F.min(F.when(c("is_valid") & (c("provider") == p), c("label"))).alias(f"{p}_label")
    panel = results.groupBy("channel_id").agg(of("openai"), of("anthropic"), of("gemini"), F.count_if("is_valid").alias("n_reached"), F.array_sort(F.collect_set(F.when(c("is_valid"), c("model")))).alias("panel_models"))
    df = routed.join(win.withColumnRenamed("iso639_3", "panel_iso"), "channel_id", "left").join(label, "channel_id", "left").join(panel, "channel_id", "left")
    status = F.when(c("panel_iso").isNull(), "no_panel_result").when(c("winning_votes") >= max(2, models // 2 + 1), "panel_majority").otherwise("needs_human_review")
    audit = c("route_reason") == "agreement_audit"
    source = F.when(audit, "audit_sample").when(status == "panel_majority", "llm_panel").otherwise("human_review")
    script = F.coalesce("_script", F.get(F.split("panel_label", "_"), F.lit(1)))
    df = df.withColumns({"panel_script": script, "panel_status": status, "consensus_source": source, "audit_sample": audit}).drop("_script")
    return df.fillna(0, ["winning_votes", "n_reached"]).fillna(False, ["panel_is_mixed", "panel_is_romanized"])


def coverage(routed: DataFrame, verdict: DataFrame) -> DataFrame:
    """(check, ok): whether each routed channel has exactly one verdict."""
    n = routed.agg(F.count("*").alias("n")).crossJoin(verdict.agg(F.count("*").alias("v"), F.countDistinct("channel_id").alias("d")))
    return n.select(F.lit("one_verdict_per_routed_channel").alias("check"), ((F.col("n") == F.col("v")) & (F.col("v") == F.col("d"))).alias("ok"))


def audit_agreement(verdict: DataFrame) -> DataFrame:
    """Counts of audited channels by whether the panel's language is the consensus's; null without a panel result."""
    told = F.lower(F.get(F.split(F.coalesce("consensus_label", F.lit("")), "_"), F.lit(0)))
    return verdict.filter("audit_sample").groupBy((told == F.col("panel_iso")).alias("agrees")).agg(F.count("*").alias("channels"))
