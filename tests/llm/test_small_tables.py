"""Small tables between the steps of an operator are not cut into as many files as a shuffle has partitions."""

import os
from urllib.parse import urlparse

from glossaria.llm import near_dedup
from glossaria.llm.common import Scratch
from glossaria.llm.graph import connected_components


def test_tables_have_the_files_that_their_rows_ask_for(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files, real = [], Scratch.table

    def table(self, df):
        out = real(self, df)
        files.append(sum(f.endswith(".parquet") for f in os.listdir(urlparse(out._scratch).path)))
        return out

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    want = sorted(near_dedup.near_duplicates(spark, docs).collect())
    monkeypatch.setattr(Scratch, "table", table)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = near_dedup.near_duplicates(spark, docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got.collect()) == want
    assert len(files) > 8 and max(files) <= 2 * spark.sparkContext.defaultParallelism


def test_links_that_are_written_are_not_written_again(spark, monkeypatch):
    """A chain, a star, loops and repeated links; the tables of the links stay."""
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200), (201, 200)]
    scratch = Scratch(spark)
    links = scratch.table(spark.createDataFrame(pairs, "a long, b long"))
    calls, real = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: calls.append(1) or real(self, df))
    found = [sorted(connected_components(links, scratch, written=w).collect()) for w in (False, True)]
    assert found[0] == found[1] == sorted([(i, 0) for i in range(41)] + [(100 + i, 100) for i in range(30)] + [(200, 200), (201, 200)])
    assert len(calls) % 2 == 1 and links.count() == len(pairs)
