"""The clause grammar against the transducers run one by one, what it means, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from glossaria.llm import toxicity
from glossaria.llm.queries import QUERIES

DOC = "text string, doc_id long, lang string, score double, toxic int, held_out boolean"
MODEL = toxicity.Model()


def test_table_equals_the_transducers():
    rng, grammar = random.Random(2), toxicity.compiled()
    for _ in range(300):
        kinds = [rng.choice(toxicity.KINDS) for _ in range(rng.randint(1, 25))]
        machines = [toxicity.reported(), toxicity.negation(), toxicity.target(), toxicity.threat()]
        states, at = [m.start for m in machines], 0
        for kind in kinds:
            symbol = (kind, frozenset())
            for k, m in enumerate(machines):
                states[k], symbol = m.step(states[k], symbol)
            at, out = grammar.moves[at][toxicity.KINDS.index(kind)]
            want = symbol if symbol[0] in ("insult", "threat") or symbol[1] else ("other", frozenset())
            assert grammar.outputs[out] == want, kinds


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("What an idiot.", {"plain": 1.0}), ("You are an idiot.", {"plain": 1.0, "targeted": 1.0}), ("Idiot, you!", {"plain": 1.0, "targeted": 1.0}), ("You are not an idiot", {"negated": 1.0}), ("He said you are an idiot", {"reported": 1.0}),
        ('the word "idiot" here', {"reported": 1.0}), ("I will kill you", {"threats": 1.0}), ("kill you", {"weak_threats": 0.0, "threats": 1.0}), ("to kill time", {"weak_threats": 1.0}), ("he wrote I will kill you", {"weak_threats": 1.0}), ("I will not hurt you", {"weak_threats": 1.0}),
        ("Du bist ein DUMMKOPF", {"plain": 1.0, "targeted": 1.0}), ("a fine day", None), ("idiotic", None), ("", None),
    ],
)
def test_clauses(text, found):
    got = [f for _, _, f in MODEL.clauses(text)]
    assert got == ([found] if found else [])


def test_context_orders_scores():
    score = lambda t: MODEL.score(t)[0]
    assert score("You are an idiot.") > score("An idiot.") > score("She said an idiot.") > score("A day.") == score("")
    assert score("A scum. A moron.") > score("A scum.") > score("Not a scum.")
    assert score("I will kill you") > score("they kill time") > score("they like time")


def test_learned_patterns_cover_and_generalise():
    rng = random.Random(4)
    filler = ["la", "que", "menta", "wort", "haus", "baum", "the", "of", "work", "world"]
    texts, toxic = [], []
    for k in range(600):
        ws = [rng.choice(filler) + rng.choice(["", "en", "s"]) for _ in range(40)]
        bad = k % 5 == 0
        if bad:
            ws[rng.randrange(40)] = "zork" + rng.choice("abcdefghij") if k % 2 else "worgle"
        texts.append(" ".join(ws))
        toxic.append(bad)
    model = toxicity.train(texts, np.array(toxic))
    assert "worgle" in model.whole and any("zork".startswith(s) for s in model.stems) and len(model.stems) + len(model.whole) < len(toxicity.WORDS["insult"]) + 6
    assert model.score("die zorkxyz haus")[0] > 0.5 and model.score("haus worgle baum")[0] > 0.5
    assert max(model.score(t)[0] for t in ("hausen world work", "baums of the wort")) < 0.1


def brute_rows(docs):
    return sorted((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, *MODEL.score(t or "")) for t, i, *_ in docs)


def test_query_rows(spark, tmp_path):
    texts = [None, "", " \n", "You idiot!", "…idiot", "İSTANBUL idiot", "scum " * 9000, "x" * 200_000, "no letters 123", "fine"]
    rows = [(t, i, None, 1.0, 1, True) for i, t in enumerate(texts)] + [("You idiot!", 3, "en", None, None, None)] * 2
    docs = spark.createDataFrame(rows + [("scum", None, None, None, None, None)], DOC)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (3, 0), (None, 1), (77, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = QUERIES["op12_toxicity"](spark, str(tmp_path))
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    named = sorted((r.doc_id, r.held_out, r.score, r.n_clauses) for r in got if r.doc_id is not None)
    assert named == brute_rows(rows)
    assert [r.predicted for r in got if r.doc_id is None] == [1] and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score_documents(docs.limit(0), MODEL).collect() == []
    clauses = {(r.doc_id, r.start, r.end, r.clause) for r in toxicity.matched_clauses(docs, MODEL).collect()}
    assert {(3, 0, 9, "You idiot"), (4, 1, 6, "idiot"), (5, 0, 14, "İSTANBUL idiot")} <= clauses


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op12_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "score").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean(np.array(bad) >= 0.3) > 0.8 and np.mean(np.array(good) >= 0.3) < 0.03
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9


def test_learning_is_bounded_and_without_labels_given(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights.tolist() == MODEL.weights.tolist() and none.whole == MODEL.whole
    held = docs.select("doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert toxicity.learn(docs, held).weights.tolist() == MODEL.weights.tolist()
