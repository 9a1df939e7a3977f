"""Heavy clusters of vectors against brute force, and how many pairs they compare."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.llm import balls, embedding_dedup
from glossaria.llm.common import Scratch


def chain(n=1500, dims=48, step=0.2, seed=5):
    """Vectors along a wandering curve: each is linked with its neighbours, far ones are at right angles."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(dims)]
    for _ in range(n - 1):
        x.append(math.cos(step) * x[-1] / np.linalg.norm(x[-1]) + math.sin(step) * rng.standard_normal(dims) / math.sqrt(dims))
    return np.array(x)


def table(spark, x):
    rows = [(k, v.tobytes()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "node long, vector binary").repartition(4)


def exact(x, least=0.9):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= least
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("kind", ["chain", "cone", "lopsided"])
def test_every_link_meets_once(spark, kind):
    rng = np.random.default_rng(2)
    x = chain()
    if kind == "cone":
        x = rng.standard_normal(48) + 0.3 * rng.standard_normal((700, 48))
    if kind == "lopsided":  # one ball with most members, which is dealt into parts
        x = np.concatenate((x[0] + 1e-4 * rng.standard_normal((600, 48)), x[:600]))
    vectors, size = table(spark, x), 60
    members = vectors.select("node", F.lit(7).cast("long").alias("comp"), F.lit(48).alias("dims"))
    scratch = Scratch(spark)
    rows = scratch.table(balls.ball_blocks(members, vectors, scratch, size, math.acos(0.9))).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.i, r.j), []).append((r.node, r.own))
    met, compared = np.zeros((len(x), len(x)), dtype=int), 0
    for (i, j), g in groups.items():
        compared += len(g) ** 2
        node, own = (np.array(c) for c in zip(*g, strict=True))
        met[np.ix_(node, node)] += (own[:, None] != own[None, :]) if i != j else 1
    np.fill_diagonal(met, 0)
    assert met.max() == 1 and (met[exact(x)] == 1).all() and max(map(len, groups.values())) <= 4 * size
    if kind == "chain":
        assert compared < 0.5 * len(x) ** 2


def test_compared_pairs_of_a_chain_grow_with_its_length(spark):
    pairs = []
    for n in (1000, 4000):
        vectors = table(spark, chain(n))
        scratch = Scratch(spark)
        rows = balls.ball_blocks(vectors.select("node", F.lit(1).cast("long").alias("comp"), F.lit(48).alias("dims")), vectors, scratch, 60, math.acos(0.9))
        pairs.append(rows.groupBy("i", "j").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0])
    print("compared pairs", pairs)
    assert pairs[1] < 8 * pairs[0]  # all pairs would be 16 times as many


def test_heavy_clusters_of_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    x = chain(500)
    short = np.random.default_rng(1).standard_normal(5) + 0.05 * np.random.default_rng(3).standard_normal((90, 5))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(short)] + [(2000, x[0].tolist()), (2001, x[499].tolist()), (2002, [0.0] * 48), (None, x[3].tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    long = np.concatenate((x, x[[0, 499]]))
    want = dict(zip([*range(500), 2000, 2001], exact(long).sum(axis=1).tolist(), strict=True))
    want |= {1000 + k: n for k, n in enumerate(exact(short).sum(axis=1).tolist())} | {2002: 0, None: 0}
    found, all_links = sum(n for n, _ in got.values()), sum(want.values())
    assert all(got[k][0] <= n for k, n in want.items()) and found >= 0.99 * all_links
    assert got[2000][1] == 0 and got[2002] == (0, 2002) and got[1003][1] >= 1000
