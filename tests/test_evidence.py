"""Rules of the evidence operators, one case for each branch, and queries against their SQL."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from glossaria.config import Config, plan_partitions
from glossaria.functions import text as X
from glossaria.operators import category, cohort, consensus, dedup, panel, predictions, qa, segments
from glossaria.plans.oracles import ORACLE_SQL
from glossaria.plans.queries import QUERIES
from glossaria.schema import CANDIDATES, first_existing_column
from glossaria.sources import models, sinks, tables

SF = "/root/testdata/sf0.001"
SIDE = "{0}_primary_label string, {0}_primary_iso string, {0}_primary_cluster string, {0}_primary_high_risk boolean, {0}_vote_share double"


@pytest.mark.parametrize(
    ("a", "sa", "b", "sb", "status", "label", "manual"),
    [
        (None, None, None, None, "insufficient_text", None, False), ("ast_Latn", 0.65, "ast_Latn", 0.65, "high_risk_tail_exact_agreement", "ast_Latn", False), ("ast_Latn", 0.64, "ast_Latn", 0.9, "high_risk_tail_label_needs_review", None, True),
        ("eng_Latn", 0.1, "eng_Latn", float("nan"), "exact_model_agreement", "eng_Latn", False), ("eng_Latn", 0.65, None, None, "openlid_high_confidence_glotlid_missing_or_error", "eng_Latn", False), ("eng_Latn", 0.6, None, None, "openlid_high_confidence_glotlid_missing_or_error", None, True),
        (None, None, "eng_Latn", 0.65, "glotlid_fallback_openlid_low_confidence", "eng_Latn", False), (None, None, "eng_Latn", 0.64, "model_disagreement_needs_review", None, True), ("arb_Arab", 0.1, "arz_Arab", 0.1, "taxonomy_normalized_agreement", "ara_Arab", False),
        ("ast_Latn", 0.9, "eng_Latn", 0.9, "high_risk_tail_label_needs_review", None, True), ("srp_Latn", 0.9, "srp_Cyrl", 0.9, "iso_or_script_variant_agreement", None, False), ("spa_Latn", 0.9, "glg_Latn", 0.9, "cluster_model_agreement", None, False),
        ("eng_Latn", 0.49, "fra_Latn", 0.65, "glotlid_fallback_openlid_low_confidence", "fra_Latn", False), ("eng_Latn", 0.50, "fra_Latn", 0.65, "model_disagreement_needs_review", None, True),
    ],
)
def test_consensus(spark, a, sa, b, sb, status, label, manual):
    df = spark.createDataFrame([(a, sa, b, sb)], "a_primary_label string, a_vote_share double, b_primary_label string, b_vote_share double")
    for p in "ab":
        parsed = X.parsed_label(f"{p}_primary_label")
        df = df.withColumn(f"{p}_primary_iso", parsed["iso639_3"])
        df = df.withColumn(f"{p}_primary_cluster", X.cluster_of(f"{p}_primary_label", f"{p}_primary_iso")).withColumn(f"{p}_primary_high_risk", X.high_risk(f"{p}_primary_label"))
    r = consensus.consensus(df, Config()).first()
    assert (r.consensus_status, r.consensus_label, r.requires_manual) == (status, label, manual)


@pytest.mark.parametrize(("raw", "want"), [("__label__eng_Latn", ("eng_Latn", "eng", "Latn")), ("eng", ("eng", "eng", None)), ("", (None, None, None)), (None, (None, None, None)), ("_Latn", ("_Latn", None, "Latn"))])
def test_labels(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(X.parsed_label("x").alias("p")).first().p) == want


@pytest.mark.parametrize(("raw", "n"), [("1,234", 1234), ("1.2M", 1_200_000), ("3k subscribers", 3000), ("2 billion", 2_000_000_000), ("abc", None), (None, None), ("-5", None), ("17", 17)])
def test_subscribers(spark, raw, n):
    assert spark.createDataFrame([(raw,)], "x string").select(X.subscribers("x").alias("n")).first().n == n


@pytest.mark.parametrize(
    ("text", "valid", "reason"),
    [("a" * 39, False, "below_min_clean_chars_latin_or_mixed"), ("a" * 40, True, None), ("न" * 11, False, "below_min_clean_chars_non_latin"), ("न" * 12, True, None), ("123 http://x.y", False, "no_letters"), ("न" * 12 + "a" * 12, False, "below_min_clean_chars_latin_or_mixed"), ("த" * 12, True, None), ("न" * 14 + "த" * 13, False, "low_dominant_script_share")],
)
def test_validity(spark, text, valid, reason):
    df = spark.createDataFrame([("c", "v", "t", text)], "channel_id string, video_id string, segment_type string, text string")
    r = segments.with_metrics(df, Config()).first()
    assert (r.is_valid, r.short_text_reason) == (valid, reason)


def test_dedup_does_not_depend_on_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), ("b", None, "q"), (None, 3, "n")]
    got = {tuple(sorted(map(str, dedup.latest(spark.createDataFrame(p, "k string, ts int, v string").repartition(3), ["k"], "ts").collect()))) for p in itertools.islice(itertools.permutations(rows), 0, 720, 180)}
    assert len(got) == 1


def test_results_of_providers(spark):
    lines = ['{"custom_id":"r1","response":{"status_code":200,"body":{"choices":[{"message":{"content":"{}"}}]}}}', '{"key":"r4","response":{"candidates":[{"content":{"parts":[{"text":"t"}]}}]}}', "not json", '{"custom_id":"r6","result":{"type":"errored"}}']
    got = [(r.p.request_id, r.p.text, r.p.status, r.p.error) for r in spark.createDataFrame([(x,) for x in lines], "v string").select(panel.provider_text("v").alias("p")).collect()]
    assert got == [("r1", "{}", "200", None), ("r4", "t", "succeeded", None), (None, None, "json_load_error", "json_load_error"), ("r6", None, "errored", "could_not_extract_text")]
    obj = spark.createDataFrame([('x {"a": 1} {"b": 2}',), ("{bad",), (None,)], "v string").select(panel.first_json_object("v").alias("o"))
    assert [r.o for r in obj.collect()] == ['{"a": 1}', None, None]


def test_scoped_write_clears_stale_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("q", 1, "c")], "run_id string, channel_hash_bucket int, v string")
    with pytest.raises(ValueError, match="rows outside"):
        sinks.write_scoped(rows, path, "r", (0, 1), full=True)
    with pytest.raises(ValueError, match="rows outside"):
        sinks.write_scoped(rows.filter("run_id = 'r'"), path, "r", (0, 0), full=True)
    sinks.write_scoped(rows.filter("run_id = 'q'"), path, "q", (0, 1), full=True)
    sinks.write_scoped(rows.filter("run_id = 'r'"), path, "r", (0, 1), full=True)
    sinks.write_scoped(spark.read.parquet(path).filter("v = 'a'"), path, "r", (0, 1), full=False)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["a", "c"] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError, match="columns differ"):
        sinks.write_scoped(rows.withColumn("w", F.lit(1)), path, "r", (0, 1), full=False)
    sinks.clear_scope(spark, path, "q", (1, 1))
    assert [r.v for r in spark.read.parquet(path).collect()] == ["a"]
    cfg = Config(run_id="r", buckets=2, bucket_end=1)
    df = rows.withColumn("inference_hash_buckets", F.lit(2))
    assert tables.current_run(df, cfg).count() == 2


def test_configuration_and_schema(spark):
    with pytest.raises(ValueError, match="low_share is above high_share"):
        Config(low_share=0.9).check()
    assert Config().check() and plan_partitions(10**9, Config()) == 4000 and plan_partitions(1, Config()) == 800
    df = spark.createDataFrame([], "ID string, Title string")
    assert first_existing_column(df, CANDIDATES["video_title"]) == "Title" and first_existing_column(df, ["none"]) is None
    with pytest.raises(ValueError, match="no column"):
        first_existing_column(df, ["id"], "gone")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", ["segment_metrics", "channel_votes", "consensus_labels", "final_channels", "validation_strata", "ablation_summary", "panel_verdict", "panel_prompts", "consensus_rules", "cohort_results", "run_modes", "evaluation", "imported_results", "request_files", "scoped_overwrite", "run_overwrite", "distributed_model", "per_class_f1", "request_fanout", "cohort_band_sample", "result_parse", "dedup_latest"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "orders", "events", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


def test_native_operators_run_no_python(spark):
    plan = QUERIES["final_channels"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_language_predictions(spark):
    rows = [
        ('{"primary_language_label": "hin_Latn", "status": "classified", "is_romanized": "Yes", "is_mixed_language": 0, "mixed_languages": ["a", " "], "confidence": "high"}', ("hin_Latn", "hin", "Latn", "classified", True, False, ["a"], "high", None)),
        ('{"primary_language_label": "eng", "primary_language_iso639_3": "fra", "primary_language_script": "Latn", "mixed_languages": " b ", "is_romanized": "?"}', ("eng", "fra", "Latn", None, None, None, ["b"], None, None)),
        ("{}", (None, None, None, None, None, None, [], None, None)), (None, (None, None, None, None, None, None, [], None, "no_json_object")),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "k int, o string").select("k", panel.language_prediction("o").alias("p")).orderBy("k")
    names = ("label", "iso639_3", "script", "status", "is_romanized", "is_mixed", "mixed_languages", "confidence", "parse_error")
    assert [tuple(r.p[n] for n in names) for r in df.collect()] == [w for _, w in rows]


@pytest.mark.parametrize(("iso", "status", "result", "want"), [("eng", "Classified", "200", True), (None, "classified", "200", False), ("eng", "unsure", "200", False), ("eng", "classified", "429", False), ("eng", "classified", "Rate_Limited", False), ("eng", "classified", None, True)])
def test_valid_votes(spark, iso, status, result, want):
    df = spark.createDataFrame([(iso, status, result)], "i string, s string, r string").withColumn("n", F.lit(None).cast("string"))
    assert df.select(panel.valid_vote(F.col("i"), F.col("s"), F.col("n"), F.col("n"), F.col("r")).alias("v")).first().v is want


def test_modes_and_gates(spark):
    df = spark.createDataFrame([("c", "s", "text")], "channel_id string, segment_id string, text string")
    assert predictions.second_universe(df, "disabled") is None and predictions.second_universe(df, "all_valid_segments") is df
    for call, match in ((lambda: predictions.second_universe(df, "other"), "unknown mode"), (lambda: predictions.second_universe(df, "audit_segments"), "needs the predictions"), (lambda: predictions.native_audit(df, 0, allow_full=False, seed=1), "allow that"), (lambda: category.chosen(df, "x", 1, 1, "s"), "unknown run mode"), (lambda: cohort.run_cohorts(df, ["a", "a"], None), "repeat"), (lambda: cohort.union_all([]), "no frame")):
        with pytest.raises(ValueError, match=match):
            call()


def test_models_are_found_fetched_and_sent(spark, tmp_path):
    path = tmp_path / "m" / "model.json"
    with pytest.raises(FileNotFoundError):
        models.ensure_model(str(path), ["x"])
    tried = []

    def fetch(name, folder):
        tried.append(name)
        if name != "model.bin":
            raise OSError(name)
        (tmp_path / "m" / name).write_text('{"eng_Latn": ["the"]}')
        return str(tmp_path / "m" / name)

    assert models.ensure_model(str(path), ["a", "", "b", "a"], fetch) == str(path) and tried == ["a", "b", "model.bin"]
    assert models.ensure_model(str(path), ["a"], None) == str(path)
    with pytest.raises(RuntimeError, match="no usable model"):
        models.ensure_model(str(tmp_path / "n"), ["a"], lambda n, f: (_ for _ in ()).throw(OSError(n)))
    told = models.distribute(spark, str(path))
    assert models.WordListFile(told).predict(["the cat", ""], 2) == [[("eng_Latn", 1.0)], []] and models.distribute(spark, str(path), "direct") == str(path)


def test_tables_and_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"a": 1, "b": "x"}]')
    (tmp_path / "f.csv").write_text("a,b\n1,x\n")
    assert tables.read_fixture(spark, str(tmp_path / "f.json")).collect()[0].a == 1 and tables.read_fixture(spark, str(tmp_path / "f.csv")).collect()[0].a == "1"
    schema = spark.createDataFrame([], "a int").schema
    assert tables.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        tables.read_optional(spark, str(tmp_path / "bad.parquet"), schema).count()
    sinks.write_run(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"), "r")
    with pytest.raises(ValueError, match="dealt by"):
        sinks.write_run(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"), "r", "a")

    class Broken:
        def submit(self, provider, model, path):
            raise OSError("refused")

    files = spark.createDataFrame([("p", "m", 0, "x")], "provider string, model string, chunk_id int, path string")
    assert [(r.status, r.error) for r in sinks.submit(files, Broken(), "r").collect()] == [("error", "OSError('refused')")]


def test_hash_tells_rows_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "-"), ("-", None), ("<null>", "-")], "x string, y string")
    assert df.select(dedup.row_hash(df).alias("h")).distinct().count() == 5


def test_parity_shows_what_is_missing(spark):
    valid = spark.createDataFrame([("c", "s1"), ("c", "s2"), ("d", "s3")], "channel_id string, segment_id string")
    seen = spark.createDataFrame([("c", "s1", "a"), ("d", "s3", "a"), ("e", "s4", "a")], "channel_id string, segment_id string, lid_model string")
    got = sorted(map(tuple, qa.checksum_parity(valid, seen, F.col("channel_id"), "a").collect()))
    assert got == [("c", 2, 1, False), ("d", 1, 1, True), ("e", 0, 1, False)]
    r = qa.universe_parity(valid.select("segment_id"), seen, ["a"]).first()
    assert (r.matched, r.missing, r.unexpected, r.checksum_equal) == (2, 1, 1, False)


def test_streamed_segments(spark, tmp_path):
    from glossaria.streaming.segments import stream_predictions

    spark.createDataFrame([("c", "v", "the cat and the dog sat on the mat of the old house by the sea")], "channel_id string, video_id string, title string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel_id string, video_id string, title string").json(str(tmp_path / "in"))
    out = stream_predictions(stream, "channel_id", "video_id", {"video_title": "title"}, {"eng_Latn": ["the", "and"]}, Config())
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.predictions[0].label_raw for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["eng_Latn"]
