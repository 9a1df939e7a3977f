"""What a region joins doesn't depend on its size."""

import numpy as np
from pyspark.sql import functions as F

from glossaria.llm import regions
from glossaria.llm.common import Scratch
from glossaria.llm.embedding_dedup import DIFFER, LOOK, SKETCH_BITS
from glossaria.llm.graph import connected_components


def test_crowded_and_usual_regions_join_the_same(spark, monkeypatch):
    """400 items of one region, most of them alone, and 200 pairs that are just alike: longer prefixes miss some of these."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (400, SKETCH_BITS), dtype=np.uint8)
    bits[200:] = bits[:200]
    for row in bits[200:]:
        row[rng.choice(SKETCH_BITS, DIFFER, replace=False)] ^= 1
    looks = np.packbits(bits, axis=1)
    near = np.array([LOOK.near(x[None, :], looks) for x in looks])
    assert near.sum() == 800
    items = spark.createDataFrame([(i, [7], bytearray(x.tobytes())) for i, x in enumerate(looks)], "node long, keys array<long>, look binary")
    monkeypatch.setattr(regions, "LEFT", 0)
    calls, real = [], regions._deepened
    monkeypatch.setattr(regions, "_deepened", lambda *a: calls.append(1) or real(*a))
    scratch = Scratch(spark)
    want = sorted((i, i % 200) for i in range(400))
    for most in (10_000, 32):
        got = connected_components(regions.forest_links(items, scratch, LOOK, most=most), scratch).orderBy("node")
        assert [tuple(r) for r in got.select("node", F.col("comp")).collect()] == want
    assert len(calls) == 1
