"""Connected components of links in DataFrames, and splitting of large clusters into blocks that one task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, spread

#: Members of a heavy cluster that are in each of its first blocks.
PIVOTS = 16


def connected_components(edges: DataFrame, scratch: Scratch, written: bool = False) -> DataFrame:
    """(node, comp) for each node of the links (a, b) of longs; comp is the smallest node reachable. written: edges are read from
    tables, so that the first round can read them where they lie.

    Each round points every node to its smallest neighbour, follows the pointers twice, and contracts the links to
    the nodes pointed to; the links left shrink to none. Each round is cut off by a written table, and a hub with
    very many links costs a partial aggregate and a join that Spark can split. A round's tables are written by as
    many tasks as its links ask for.
    """
    live = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not written:
        live = scratch.table(live.distinct())
    maps: list[DataFrame] = []
    while links := live.count():
        parts = spread(scratch.spark, 2 * links)
        both = live.union(live.select("b", "a"))
        # written first: an aggregate between shuffle and join would keep Spark from splitting the part of a hub
        near = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")).coalesce(parts))
        over = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
        up = scratch.table(near.join(over, "to").select("node", F.col("next").alias("to")).coalesce(parts))
        scratch.drop(near)
        maps.append(up)
        at = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))  # noqa: E731, B023
        moved = live.join(at("a"), "a").join(at("b"), "b").filter("a2 <> b2")
        old, live = live, scratch.table(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct().coalesce(parts))
        if maps[1:] or not written:
            scratch.drop(old)
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = maps[0].withColumnRenamed("to", "comp")
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return out


def first_blocks(members: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, key, i): light clusters whole, as block 0, and heavy ones dealt into blocks, with PIVOTS members in all.

    members: (key, node, ...); heavy: (key, parts). That joins most of what belongs together in a heavy cluster.
    """
    if heavy.isEmpty():
        return members.select("node", "key", F.lit(0).cast("long").alias("i"))
    light = members.join(heavy, "key", "left_anti").select("node", "key", F.lit(0).cast("long").alias("i"))
    big = members.join(heavy, "key")
    dealt = big.select("node", "key", F.pmod(F.xxhash64("node"), F.col("parts")).alias("i"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(1)), "node")
    chosen = big.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
    return light.union(dealt).union(chosen.select("node", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i")))


def left_over_blocks(members: DataFrame, size: int) -> DataFrame:
    """Groups (key, i, j) of at most about twice ``size`` in which whatever lies outside its key's largest component meets all
    members of the key whose band differs by one at most; members of one component only form no group.

    members: (key, node, comp, weight, band, ...); the other columns stay. ``own`` tells a group's two blocks apart, and ``based`` the
    members of the largest component.
    """
    comps = members.groupBy("key", "comp").agg(F.sum("weight").alias("w")).groupBy("key").agg(F.max(F.struct("w", "comp"))["comp"].alias("base"), F.count("*").alias("comps"))
    opened = members.join(comps.filter("comps > 1").select("key", "base"), "key").withColumn("based", F.col("comp") == F.col("base"))
    blocks = opened.groupBy("key", "band", "based").agg(F.ceil(F.sum("weight") / size).cast("long").alias("parts"))
    known = blocks.groupBy("key").agg(F.collect_list(F.struct("band", "based", "parts")).alias("blocks"))  # two for each band, of which there are few
    name = lambda band, based, part: (band.cast("long") * 2 + based.cast("long")) * (1 << 32) + part
    told = opened.join(known, "key")
    own_block = F.filter("blocks", lambda b: (b["band"] == F.col("band")) & (b["based"] == F.col("based")))
    told = told.withColumn("own", name(F.col("band"), F.col("based"), F.pmod(F.xxhash64("node"), F.get(own_block, F.lit(0))["parts"])))

    def meets(b: Column) -> Column:
        return (F.abs(b["band"] - F.col("band")) <= 1) & ~(b["based"] & F.col("based"))

    others = F.flatten(F.transform(F.filter("blocks", meets), lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["parts"] - 1), lambda p: name(b["band"], b["based"], p))))
    told = told.withColumn("other", F.explode(others))
    return told.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other", "base")
