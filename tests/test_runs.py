"""Runs over many tasks and buckets: shared models, co-partitioned tables, audits that must not feed the main tables."""

import os
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from glossaria.config import Config
from glossaria.operators import category, cohort, panel, predictions, qa, votes
from glossaria.plans import queries as plans
from glossaria.sources import acceptance, ledger, models
from glossaria.sources.published import Published, ranges_of, without
from glossaria.sources.scratch import Scratch, some_keys_suffice

SF = "/root/testdata/sf0.001"
SEGMENT = "channel_id string, segment_id string, segment_type string, clean_letter_count int, dominant_script string, clean_text string"


def test_a_model_is_loaded_once_for_each_worker(spark, tmp_path):
    path, log = tmp_path / "model.txt", str(tmp_path / "log")
    path.write_text("eng_Latn")
    os.makedirs(log)

    class Logged:
        def __init__(self, told):
            with open(models.local_path(told), encoding="utf-8") as f:
                self.label = f.read()
            open(f"{log}/load-{os.getpid()}-{time.time_ns()}", "w").close()

        def predict(self, texts, k):
            open(f"{log}/task-{os.getpid()}-{time.time_ns()}", "w").close()
            assert sum(map(len, texts)) <= 100 or len(texts) == 1
            return [[(self.label, 1.0)] for _ in texts]

    told = models.distribute(spark, str(path), "direct")
    rows = spark.createDataFrame([("c", str(i), "t", 9, "latin", "x" * (i % 70)) for i in range(400)], SEGMENT).repartition(24)
    for _ in range(2):
        got = predictions.run_model(rows, "a", models.SharedModel(Logged, told), 1, most=100).select("segment_id", F.size("predictions").alias("n"), "lid_error").collect()
        assert len(got) == 400 and all(r.lid_error is None and r.n == (int(r.segment_id) % 70 > 0) for r in got)
    names = os.listdir(log)
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    tasks = {n.split("-")[1] for n in names if n.startswith("task")}
    assert sorted(loads) == sorted(tasks) and len(loads) <= 8 and sum(n.startswith("task") for n in names) >= 48


def test_model_cache_follows_files_and_bytes(tmp_path):
    made = []

    class Kind:
        def __init__(self, told):
            made.append(told)

    a, b, c = (tmp_path / n for n in "abc")
    for f in (a, b, c):
        f.write_text("x" * 40)
    cache = models.ModelCache(most=100)
    assert cache.get(Kind, str(a)) is cache.get(Kind, str(a)) and cache.loads == 1
    a.write_text("y" * 41)
    first = cache.get(Kind, str(a))
    assert cache.loads == 2 and len(cache.models) == 1
    cache.get(Kind, str(b))
    assert cache.get(Kind, str(a)) is first
    cache.get(Kind, str(c))  # b was used least recently
    assert cache.get(Kind, str(a)) is first and cache.loads == 4
    cache.get(Kind, str(b))
    assert cache.loads == 5 and made == [str(x) for x in (a, a, b, c, b)]
    assert len(models.ModelCache(most=1).models) == 0 and models.ModelCache(most=1).get(Kind, str(a))


def test_joins_by_channel_move_no_row(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = plans.Evidence(spark, SF)
        for df, joins in ((e.final, 2), (e.votes, 0), (e.summary, 1), (e.audit, 0)):
            with some_keys_suffice(spark):
                plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("SortMergeJoin") >= joins, plan
        rows = e.final.count()
        assert rows == e.universe.count() == e.final.select("channel_id").distinct().count()
        buckets = e.predicted.select("channel_id", F.input_file_name().alias("f")).distinct().groupBy("channel_id").count()
        assert buckets.filter("count > 1").isEmpty()
        names = [n for n in e.scratch.names.values()]
        e.scratch.keep(e.universe)
        left = {t.name for t in spark.catalog.listTables()} & set(names)
        assert len(names) == 5 and len(left) == 1 and e.universe.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_bucketed_tables_hold_nulls_repeats_and_nothing(spark):
    s = Scratch(spark)
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3)], "k string, v int")
    assert sorted(map(tuple, s.bucketed(df, "k").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert s.bucketed(df.limit(0), "k").collect() == []
    one = s.bucketed(df.groupBy("k").agg(F.count("*").alias("n")), "k", dealt=True)
    assert sorted(map(tuple, one.join(s.bucketed(df, "k"), "k").collect())) == [("", 1, 3), ("a", 2, 1), ("a", 2, 1)]
    s.keep()


def test_audits_do_not_feed_the_main_tables(spark, tmp_path):
    seg = spark.createDataFrame([("c", "s1", "video_title", 30, "latin", "the and of"), ("c", "s2", "video_title", 30, "latin", "xx")], SEGMENT).withColumn("text", F.col("clean_text"))
    lists = {"a": {"eng_Latn": ["the", "and"]}}
    long = predictions.long(predictions.word_list_models(seg, lists, 2))
    cfg = Config()
    assert votes.admit(long, cfg).count() == 1
    every = predictions.second_universe(seg, "all_valid_segments")
    assert votes.admit(predictions.long(predictions.word_list_models(every, lists, 2)), cfg).count() == 1
    some = predictions.second_universe(seg, "audit_segments", long, "a")
    audited = predictions.long(predictions.word_list_models(some, lists, 2))
    audited.write.parquet(str(tmp_path / "a"))
    model = predictions.run_model(some, "a", lambda: None, 1)
    native = predictions.native_audit(seg, 1.0, allow_full=True, seed=1)
    for df, name in ((audited, "audit_segments"), (spark.read.parquet(str(tmp_path / "a")), "audit_segments"), (predictions.long(model), "audit_segments"), (predictions.long(predictions.word_list_models(native.drop("clean_text").withColumnRenamed("clean_text_native", "clean_text"), lists, 2)), "native_cleaning"), (Scratch(spark).bucketed(audited, "channel_id"), "audit_segments")):
        assert predictions.origin(df) == name
        with pytest.raises(ValueError, match=name):
            votes.admit(df, cfg)
    with pytest.raises(ValueError, match="audit"):
        votes.channel_summary(votes.channel_votes(votes.admit(long, cfg)), some.withColumn("lid_model", F.lit("a")))


def job_count(spark, f):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    f()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("other", "")
    return after - before


def test_checks_cost_no_job_and_stop_a_write(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id / 100 as share")
    checks = [acceptance.rows("all", 100), acceptance.no_row("share", F.col("share") >= 1)]
    plain = job_count(spark, lambda: df.write.parquet(str(tmp_path / "plain")))
    got = {}
    assert job_count(spark, lambda: got.update(acceptance.write_accepted(df, lambda x: x.write.parquet(str(tmp_path / "ok")), checks))) == plain == 1
    assert got == {"all": 100, "share": 0} and spark.read.parquet(str(tmp_path / "ok")).count() == 100
    undone = []
    with pytest.raises(acceptance.RejectedError, match="share: 1") as e:
        acceptance.write_accepted(df.withColumn("share", F.when(F.col("id") == 7, 2.0).otherwise(F.col("share"))), lambda x: x.write.parquet(str(tmp_path / "bad")), checks, lambda: undone.append(1))
    assert e.value.failed == {"share": 1} and undone == [1]
    twice = acceptance.numbered(df.union(df.limit(1)), "id")
    with pytest.raises(acceptance.RejectedError, match="once: 1"):
        acceptance.write_accepted(twice, lambda x: x.write.parquet(str(tmp_path / "twice")), [acceptance.no_repeat("once")])
    assert spark.read.parquet(str(tmp_path / "twice")).columns == ["id", "share"]
    with pytest.raises(acceptance.RejectedError, match="gone: no such column; id: is bigint, not string"):
        acceptance.require_columns(df, {"gone": None, "id": "string", "share": "double"})
    with pytest.raises(acceptance.RejectedError, match="none_such"):
        acceptance.require_tables(spark, ["none_such"])


def test_final_table_is_accepted_in_one_job(spark, tmp_path):
    e = plans.Evidence(spark, SF)
    final = acceptance.numbered(e.final, "channel_id")
    acceptance.require_columns(final, acceptance.FINAL_COLUMNS)
    n = e.universe.count()
    acceptance.write_accepted(final, lambda x: x.write.parquet(str(tmp_path / "a")), acceptance.final_checks(n))
    for bad, name in ((final.union(final.limit(1)), "all_channels_present"), (final.withColumn("a_vote_share", F.lit(1.5)), "shares_in_range"), (final.withColumns({"mixed_credible": F.lit(True), "mixed_screen": F.lit(False)}), "credible_implies_screen"), (final.withColumn("channel_id", F.lit(None).cast("string")), "channel_is_named")):
        with pytest.raises(acceptance.RejectedError, match=name):
            acceptance.write_accepted(bad, lambda x, name=name: x.write.parquet(str(tmp_path / name)), acceptance.final_checks(n))
    e.scratch.keep()


ROW = "run_id string, channel_hash_bucket int, v string"


def test_readers_see_old_or_new_rows(spark, tmp_path, monkeypatch):
    t = Published(spark, "published_t", str(tmp_path / "t"))
    put = lambda rows, run, ranges, **k: t.replace(spark.createDataFrame(rows, ROW), run, ranges, **k)
    see = lambda: sorted((r.run_id, r.channel_hash_bucket, r.v) for r in t.read().collect())
    assert put([("007", 0, "a"), ("007", 1, "b"), ("007", 5, "c")], "007", [(0, 7)])["rows_written"] == 3
    put([("q", 1, "it's")], "q", [(0, 7)])
    old = see()
    assert old == [("007", 0, "a"), ("007", 1, "b"), ("007", 5, "c"), ("q", 1, "it's")]
    monkeypatch.setattr(Published, "_show", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # killed between write and switch
        put([("007", 1, "B")], "007", [(1, 3)])
    monkeypatch.undo()
    assert see() == old and len(t.vacuum()) == 1 and see() == old
    with pytest.raises(acceptance.RejectedError, match="outside_of_scope: 2"):
        put([("007", 1, "B"), ("007", 4, "B"), ("q", 1, "B")], "007", [(1, 3)])
    assert see() == old and t.vacuum() == []
    put([("007", 3, "B")], "007", [(1, 3)])  # bucket 1 gets no row
    assert see() == [("007", 0, "a"), ("007", 3, "B"), ("007", 5, "c"), ("q", 1, "it's")]
    reader = t.read().filter("channel_hash_bucket = 3")
    assert "PartitionFilters: [isnotnull(channel_hash_bucket" in reader._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="columns differ"):
        t.replace(spark.createDataFrame([("q", 1, 2)], "run_id string, channel_hash_bucket int, w int"), "q", [(0, 7)])
    t.replace(spark.createDataFrame([("q", 1, 2)], "run_id string, channel_hash_bucket int, w int"), "q", [(0, 7)], full=True)
    assert sorted(map(tuple, t.read().select("run_id", "v", "w").collect()), key=str)[-1] == ("q", None, 2)
    with pytest.raises(ValueError, match="types differ"):
        t.replace(spark.createDataFrame([("q", 1, 2, 3)], "run_id string, channel_hash_bucket int, v int, w int"), "q", [(0, 7)])
    put([], "007", [(0, 7)], full=True)
    t.clear("q", [(0, 7)])
    assert see() == [] and t.read().columns == ["v", "w", "channel_hash_bucket", "run_id"] and len(t.vacuum()) >= 3
    spark.sql("DROP VIEW published_t")
    assert without([(0, 9)], [(2, 3), (9, 12)]) == [(0, 1), (4, 8)] and ranges_of([5, 1, 2, 2]) == [(1, 2), (5, 5)]


def test_a_broken_run_goes_on_with_what_is_missing(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [(f"c{i}", i % 12, i) for i in range(300)]
    df = spark.createDataFrame(data, "channel_id string, b int, v int")
    ledger.deal(df.drop("b"), source, F.substring("channel_id", 2, 9).cast("int") % 12)
    seen = []

    def work(breaks_at):
        def f(rows):
            seen.append(sorted({int(x.split("channel_hash_bucket=")[1].split("/")[0]) for x in rows.inputFiles()}))
            if breaks_at is not None and breaks_at in seen[-1]:
                raise OSError("broken")
            return rows.groupBy("channel_hash_bucket").agg(F.sum("v").alias("s"))

        return f

    want = {b: sum(v for _, c, v in data if c == b) for b in range(12)}
    got = lambda t: {r.channel_hash_bucket: r.s for r in t.read().collect()}
    t, book = Published(spark, "resumed_t", str(tmp_path / "out")), ledger.Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(OSError, match="broken"):
        ledger.resume(spark, source, t, book, "r", "v1", work(6), step=3)
    assert got(t) == {b: s for b, s in want.items() if b < 6} and seen == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    seen.clear()
    assert ledger.resume(spark, source, t, book, "r", "v1", work(None), step=3) == list(range(6, 12))
    assert got(t) == want and seen == [[6, 7, 8], [9, 10, 11]]
    seen.clear()
    assert ledger.resume(spark, source, t, book, "r", "v1", work(None)) == [] and seen == []
    # one bucket's input changes, another vanishes: the first is done anew, the second is shown no more
    spark.createDataFrame([("c4", 1000)], "channel_id string, v int").write.mode("append").parquet(f"{source}/channel_hash_bucket=4")
    import shutil

    shutil.rmtree(f"{source}/channel_hash_bucket=7")
    assert ledger.resume(spark, source, t, book, "r", "v1", work(None)) == [4] and seen == [[4]]
    assert got(t) == {b: s + 1000 * (b == 4) for b, s in want.items() if b != 7}
    assert len(ledger.resume(spark, source, t, book, "r", "v2", work(None))) == 11  # another configuration makes all stale
    assert len(ledger.resume(spark, source, t, book, "other", "v2", work(None))) == 11 and t.read().count() == 22
    spark.sql("DROP VIEW resumed_t")


def test_cohorts_run_side_by_side_and_fail_alone(spark):
    import threading

    both = threading.Barrier(2, timeout=60)

    def run(name):
        if name == "bad":
            raise OSError("no such table")
        both.wait()  # neither ends before the other has begun
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == name
        n = spark.range(100).repartition(2).count()
        both.wait()
        return n

    log = {r.cohort: r for r in cohort.run_side_by_side(spark, ["x", "bad", "y"], run, at_once=3).collect()}
    assert {k: (r.status, r.rows) for k, r in log.items()} == {"x": ("succeeded", 100), "y": ("succeeded", 100), "bad": ("failed", None)}
    assert "no such table" in log["bad"].error and log["x"].started < log["y"].ended and log["y"].started < log["x"].ended
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(ValueError, match="repeat"):
        cohort.run_side_by_side(spark, ["x", "x"], run)


def test_signatures_find_a_wrong_channel_and_read_unequal_buckets_only(spark, tmp_path):
    rows = [(f"c{i % 40}", f"s{i}", i % 8) for i in range(400)]
    left = spark.createDataFrame(rows, "channel_id string, segment_id string, b int")
    swapped = {"s3": "c4", "s4": "c3"}  # the same counts and the same segments in all
    right = spark.createDataFrame([(swapped.get(s, c), s, 3 if s in swapped else b) for c, s, b in rows] + [("c5", "s5", 5)], "channel_id string, segment_id string, b int")
    left = left.withColumn("b", F.when(F.col("segment_id").isin("s3", "s4"), 3).otherwise(F.col("b")))
    for strategy in ("xxhash64", "md5"):
        parity = qa.signature_parity(qa.signatures(left, F.col("b"), strategy), qa.signatures(right, F.col("b"), strategy))
        got = {r.bucket: r.equal for r in parity.collect()}
        assert got == {b: b not in (3, 5) for b in range(8)}
    for name, df in (("left", left), ("right", right)):
        df.repartition("b").write.partitionBy("b").parquet(str(tmp_path / name))
    x, y = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    out = qa.drill_down(x, y, parity, F.col("b"))
    assert sorted(map(tuple, out.collect())) == [("c3", "s3", 1, 0), ("c3", "s4", 0, 1), ("c4", "s3", 0, 1), ("c4", "s4", 1, 0), ("c5", "s5", 1, 2)]
    scans = [x for x in qa.drill_down(x, y, parity, F.col("b"))._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("IN (3,5)" in s for s in scans)
    none = qa.signature_parity(qa.signatures(left.limit(0), F.col("b")), qa.signatures(left.filter("b = 1"), F.col("b")))
    assert [(r.bucket, r.left_n, r.right_n, r.equal) for r in none.collect()] == [(1, 0, 50, False)]
    assert qa.drill_down(left.filter("b = 9"), left.filter("b = 1"), none, F.col("b")).count() == 50


def test_draw_of_the_routing_is_one_hash_of_one_text(spark):
    names = [f"channel/{i}" for i in range(200)]
    cols = {c: F.lit(None).cast("string") for c in ("a_primary_iso", "b_primary_iso", "consensus_label", "consensus_iso", "consensus_source", "a_primary_label", "b_primary_label")}
    df = spark.createDataFrame([(n,) for n in names], "channel_id string").withColumns(cols | {"consensus_status": F.lit("exact_model_agreement"), "indic": F.lit(False)})
    got = {r.channel_id for r in panel.route(df, 0.3, "20260526").collect()}
    signed = lambda n: xxhash.xxh64_intdigest(f"{n}|20260526".encode(), seed=42)
    drawn = lambda h: (h - 2**64 if h >= 2**63 else h) % 1_000_000
    assert got == {n for n in names if drawn(signed(n)) < 300_000} and 30 < len(got) < 90


def test_plain_request_ids_are_dealt_over_tasks(spark):
    """All ids begin alike; chunks are in order and full, and no task numbers them all."""
    df = spark.createDataFrame([(f"source/{i:05d}",) for i in range(1000)], "channel_id string")
    models_ = spark.createDataFrame([("p", "m1"), ("p", "m2")], "provider string, model string")
    out = category.fan_out(df, models_, "r", 30, "plain")
    got = {}
    for r in out.collect():
        got.setdefault((r.model, r.chunk_id), []).append(r.request_id)
    assert all(len(got[m, k]) == (30 if k < 33 else 10) for m in ("m1", "m2") for k in range(34)) and len(got) == 68
    assert all(max(got[m, k]) < min(got[m, k + 1]) for m in ("m1", "m2") for k in range(33))
    assert category.ranged(df, ["channel_id"]).groupBy("_lead").count().count() > 1


def test_cohort_stats_read_the_cohorts_once(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 3), ("a", 9), ("b", 1)], "cohort string, size int")
    out = cohort.cohort_stats(df, "size")
    assert sorted(map(tuple, out.collect())) == [("a", 3, 4, 2, 3), ("b", 1, 1, 1, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_distributions_take_one_scan(spark, tmp_path):
    e = plans.Evidence(spark, SF)
    df = qa.distributions(e.decided)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Expand" in plan
    rows = df.collect()
    for m in {r.metric for r in rows}:
        assert sum(r.channels for r in rows if r.metric == m) == e.decided.count()
    e.scratch.keep()
