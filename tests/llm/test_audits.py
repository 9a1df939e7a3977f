"""Periodic runs and the filter audit against brute force."""

import hashlib
import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from glossaria.llm import filter_audit, periodic
from glossaria.llm.oracles import ORACLE_SQL
from glossaria.llm.queries import QUERIES

RNG = random.Random(11)
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def naive_runs(w):
    """Every maximal stretch by its definition."""
    n, found = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and smallest_period(w[s : i + q]) == q:
                found.add((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    """A text of random stretches, some of them repetitions, often one inside another."""
    out = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            base = base * rng.randint(2, 5) + ["z"]
        out += (base * rng.randint(1, 7))[: rng.randint(1, 150)]
    return out


def test_runs_equal_their_definition():
    rng = random.Random(3)
    texts = [periodic_words(rng) for _ in range(600)] + [["a"] * n for n in range(9)] + [["a"] * 300, ["a", "b"] * 200, []]
    coded = [np.array([hash(x) % 1009 for x in t], dtype=np.int64) for t in texts]
    for t, c, lags in zip(texts, coded, periodic.likely_lags(coded), strict=True):
        want = naive_runs(t)
        assert periodic.word_runs(c, lags) == want, t
        assert periodic.word_runs(c) == want
    assert sum(bool(naive_runs(t)) for t in texts) > 200


def test_runs_take_time_near_to_the_length():
    rng = np.random.default_rng(1)
    long = np.concatenate([np.zeros(200_000, dtype=np.int64), rng.integers(0, 5_000, 400_000), np.tile(rng.integers(0, 5_000, 50_000), 6), np.tile(np.arange(7), 30_000)])
    began = time.time()
    got = periodic.word_runs(long, periodic.likely_lags([long])[0])
    assert time.time() - began < 20
    assert {q for _, _, q in got} >= {1, 7, 50_000}


def report(rows):
    out = []
    for doc_id, text in rows:
        w = split(text)
        if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = naive_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


DOC = "text string, doc_id long, lang string, source string, runs string, part string, mask string, n long"


def documents(spark, rows):
    return spark.createDataFrame([(t, i, lang, "s", "r", "p", "m", 3) for i, t, lang in rows], DOC).repartition(3)


def test_periodic_query(spark, tmp_path):
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "été\x0bété\x0cété été été\rété", "x y x y x y x y x y x y", *[" ".join(periodic_words(RNG)) for _ in range(120)], *[" ".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(1, 200))) for _ in range(60)]]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(4, texts[9], "en"), (4, texts[9], "en"), (None, texts[4], None), (None, None, None)]
    for name, part in (("all", rows), ("none", [])):
        documents(spark, part).write.parquet(str(tmp_path / name / "documents.parquet"))
        df = QUERIES["op11_periodic_runs"](spark, str(tmp_path / name))
        assert sorted(map(tuple, df.collect()), key=str) == report([(i, t) for i, t, _ in part])
    assert df.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i is not None) > 10


def test_periodic_query_on_given_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000").select("doc_id", "text").collect()]
    got = {r[0]: r for r in map(tuple, QUERIES["op11_periodic_runs"](spark, sf).collect())}
    assert all(got[r[0]] == r for r in report(rows)) and len(rows) > 100


def test_generic_runs_keep_texts(spark):
    df = periodic.find_runs(documents(spark, [(1, "a b a b a b a b c", "en"), (2, "p q", "en")]))
    assert {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in df.collect()} == {1: ([(0, 8, 2)], "a b c"), 2: ([], "p q")}


def naive_report(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = split(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        mine = [(q, x) for k, q, x in labels if k == i and i is not None]
        facts.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = []
    for part in {f[0] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        some = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [x for x in facts if x[0] == part and f in x[1] and not x[1] & set(order[:k])]
                shapley[f] += len(here)
                some.append(("".join(order), k + 1, f, sum(x[0] == part and not x[1] & set(order[: k + 1]) for x in facts), len(here), sum(x[0] == part and f in x[1] for x in facts) - len(here), sum(x[0] == part and x[1] == {f} for x in facts), sum(x[2] for x in here), sum(x[3] for x in here)))
        out += [(part, o, k, *rest, shapley[f]) for o, k, f, *rest in some]
    return sorted(out)


def test_filter_audit(spark, tmp_path):
    word = lambda: RNG.choice(["Alpha", "beta", "été", "the", "of", "a" * 70, "a" * 71, "x1", "日本", "#tag", "NASA"][: RNG.choice([5, 9, 11])])
    texts = [None, "", " ", "A", "a|b", "É É É", "\u0085x y", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), " ".join(["a", "b"] * 100), " ".join(f"w{i % 100}" for i in range(200)), "B" * 3 + "é" * 97, "B" * 4 + "é" * 96, *[" ".join(word() for _ in range(RNG.randint(1, 400))) for _ in range(40)]]
    rows = [(i, t, [None, "", "en", "fr"][i % 4]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[9], "en") for i in range(60)] + [(i, t, "de") for i, t, _ in rows[::3]] + [(200 + i, t, lang) for i, t, lang in rows[::2]] + [(None, texts[9], "en"), (None, None, None), (None, "only here", "fr"), (-3, texts[20], "fr"), (-3, texts[20], "fr")]
    labels = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    table.write.parquet(str(tmp_path / "labels.parquet"))
    df = QUERIES["op13_filter_audit"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == naive_report(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op13_filter_audit']})").fetchall()) == got
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    none = filter_audit.audit_filters(documents(spark, []), table)
    assert none.collect() == []
    assert len(filter_audit.audit_filters(documents(spark, rows[:9]), table.limit(0)).collect()) == 600 * len({lang or "" for _, _, lang in rows[:9]})


def scanned(texts, scanner=None):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    return (scanner or filter_audit.Scanner()).scan(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)


def test_scanner_counts_and_verifies(monkeypatch):
    texts = ["", *["".join(RNG.choice(["a", "B", "é", "日", " ", "\n", "\t", "#", "word ", "long" * 30 + " "]) for _ in range(RNG.randint(0, 300))) for _ in range(200)], ""]
    want = [(len(split(t)), len(set(split(t))), len(t), sum("A" <= c <= "Z" for c in t), t.count("#")) for t in texts]
    as_rows = lambda c: list(zip(*[c[k].tolist() for k in ("words", "distinct", "points", "capitals", "symbols")], strict=True))
    assert as_rows(scanned(texts)) == want
    assert [tuple(filter_audit.scan_long(t.encode(), block=7)[k] for k in ("words", "distinct", "points", "capitals", "symbols")) for t in texts] == want
    # a hash that deceives: all powers 1, so that words of the same letters collide
    monkeypatch.setattr(filter_audit, "_powers", lambda base, n: np.ones(n + 1, dtype=np.uint64))
    assert scanned(["ab ba ab ac", "ba", "xy yx xy yx"])["distinct"].tolist() == [3, 1, 2]
    assert as_rows(scanned(texts)) == want


@pytest.mark.parametrize("copies", [1, 3000])
def test_copies_are_counted_before_they_move(spark, copies):
    rows = [(i, "same text", "en") for i in range(copies)] + [(copies + i, f"text {i}", "en") for i in range(10)]
    scan = filter_audit.scan_documents(documents(spark, rows))
    counts = {(r["mask"], r["n"]) for r in filter_audit.mask_counts(scan, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts == {(1, 11)} | ({(17, copies - 1)} if copies > 1 else set())
