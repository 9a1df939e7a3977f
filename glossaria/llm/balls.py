"""Splitting clusters of vectors into groups that one task can hold, without groups whose members are too far apart to be linked.

A light cluster is one group. A heavy one gets pivots (members of least hash); each member belongs to the ball of its nearest pivot,
whose radius is the largest angle of a member to it. By the triangle inequality of angles, a vector within ``reach`` of some member
of a ball is within ``reach`` and the radius of its pivot: it is dealt to those balls only, and every pair within ``reach`` still meets,
in the group of its two balls (or of the parts of balls that are too large themselves). So a cluster that is a long chain
of small topics costs what its neighbouring balls cost; one that is a single narrow cone still meets as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, map_batches, record, spread
from glossaria.llm.regions import groups

#: Pivots for each part that the size asks for, and at most of a cluster: balls with more members than the size are dealt into parts.
PER_PART, PIVOTS = 4, 512
#: Angle by which rounding may be wrong.
SLACK = 1e-6
#: A group's blocks are named by length of the vectors, ball and part of the ball.
_BALL, _DIMS = 1 << 20, 1 << 40

_PLACED = pa.schema([("comp", pa.int64()), ("dims", pa.int32()), ("salt", pa.int64()), ("node", pa.int64()), ("vector", pa.binary()), ("ball", pa.int32()), ("angle", pa.float64())])
_DEALT = pa.schema([("comp", pa.int64()), ("node", pa.int64()), ("own", pa.int64()), ("others", pa.list_(pa.int64()))])


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    """Doubles of vectors of one length as rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for s in range(0, len(x), 256):
        yield s, np.arccos(np.clip(x[s : s + 256] @ pivots.T, -1, 1))


def _place() -> Callable:
    """Each member's nearest pivot. In a share of a cluster its pivots (member 0) come before its members (member 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (comp, dims, salt), t in groups(batches, 3):
            pivots = int((t.column("member").to_numpy() == 0).sum())
            raw, names = t.column("vector").to_pylist(), t.column("ball").to_pylist()[:pivots]
            p, x = unit_rows(raw[:pivots]), raw[pivots:]
            for s, a in _angles(unit_rows(x), p) if x else ():
                near = a.argmin(axis=1)
                n = len(a)
                yield record(
                    _PLACED, comp=np.full(n, comp), dims=np.full(n, dims, dtype=np.int32), salt=np.full(n, salt), node=t.column("node").to_numpy()[pivots + s : pivots + s + n],
                    vector=x[s : s + n], ball=[names[k] for k in near.tolist()], angle=a[np.arange(n), near],
                )

    return run


def _deal(reach: float) -> Callable:
    """Each member's block, and the blocks that may hold a vector within reach of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (comp, dims, _), t in groups(batches, 3):
            pivots = int((t.column("member").to_numpy() == 0).sum())
            raw = t.column("vector").to_pylist()
            head = t.slice(0, pivots)
            ball, radius, parts = (head.column(c).to_numpy() for c in ("ball", "angle", "parts"))
            node, own, mixed = (t.slice(pivots).column(c).to_numpy() for c in ("node", "ball", "mixed"))
            place = {b: k for k, b in enumerate(ball.tolist())}
            blocks = [dims * _DIMS + b * _BALL + np.arange(n, dtype=np.int64) for b, n in zip(ball.tolist(), parts.tolist(), strict=True)]
            for s, a in _angles(unit_rows(raw[pivots:]), unit_rows(raw[:pivots])) if len(node) else ():
                at = slice(s, s + len(a))
                home = np.array([place[b] for b in own[at].tolist()])
                meets = a <= radius + reach + SLACK
                meets[np.arange(len(a)), home] = True
                mine = [int(blocks[h][m % parts[h]]) for h, m in zip(home.tolist(), mixed[at].tolist(), strict=True)]
                yield record(_DEALT, comp=np.full(len(a), comp), node=node[at], own=mine, others=[np.concatenate([blocks[k] for k in np.flatnonzero(row)]) for row in meets])

    return run


def ball_blocks(members: DataFrame, vectors: DataFrame, scratch: Scratch, size: int, reach: float) -> DataFrame:
    """(node, own, comp, i, j): groups of blocks in which every two members of a cluster within an angle of ``reach`` meet.

    members: (node, comp, dims), one row a node; vectors: (node, vector) with doubles as bytes. ``own`` is a member's block;
    the group of two blocks holds members of both. No group holds more than about two times ``size``.
    """
    zero = F.lit(0).cast("long")
    sizes = scratch.table(members.groupBy("comp", "dims").agg(F.count("*").alias("n")).filter(F.col("n") > size).select("comp", "dims", F.ceil(F.col("n") / size).cast("long").alias("shares")))
    light = members.join(sizes, ["comp", "dims"], "left_anti").select("node", zero.alias("own"), "comp", zero.alias("i"), zero.alias("j"))
    shares = sizes.agg(F.sum("shares")).first()[0]
    if not shares:
        return light
    spark, keys = members.sparkSession, ["comp", "dims", "salt"]
    heavy = members.join(sizes, ["comp", "dims"])
    order = Window.partitionBy("comp", "dims").orderBy(F.xxhash64("node"), "node")
    chosen = heavy.withColumn("ball", F.row_number().over(order)).filter(F.col("ball") <= PIVOTS).filter(F.col("ball") <= PER_PART * F.col("shares"))
    pivots = scratch.table(chosen.join(vectors, "node").select("comp", "dims", "shares", "ball", "vector"))
    salts = F.explode(F.sequence(zero, F.col("shares") - 1)).alias("salt")
    tasks = spread(spark, shares, 1, 4)

    def met(rows: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
        return map_batches(rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "member", "ball"), make, schema)

    first = pivots.select("comp", "dims", salts, F.lit(0).alias("member"), "ball", F.lit(None).cast("long").alias("node"), "vector")
    rest = heavy.join(vectors, "node").select("comp", "dims", F.pmod(F.xxhash64("node", F.lit(1)), "shares").alias("salt"), F.lit(1).alias("member"), F.lit(None).cast("int").alias("ball"), "node", "vector")
    placed = scratch.table(met(first.union(rest), _place, "comp long, dims int, salt long, node long, vector binary, ball int, angle double"))
    balls = placed.groupBy("comp", "dims", "ball").agg(F.max("angle").alias("angle"), F.ceil(F.count("*") / size).cast("long").alias("parts"))
    known = pivots.join(balls, ["comp", "dims", "ball"])
    columns = [*keys, "member", "ball", "angle", "parts", "mixed", "node", "vector"]
    first = known.select("*", salts).withColumns({"member": F.lit(0), "mixed": zero, "node": F.lit(None).cast("long")}).select(columns)
    rest = placed.withColumns({"member": F.lit(1), "parts": zero, "mixed": F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 40))}).select(columns)
    dealt = scratch.table(met(first.union(rest), lambda: _deal(reach), "comp long, node long, own long, others array<long>"))
    pairs = dealt.select("node", "own", "comp", F.explode("others").alias("other")).select("node", "own", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    both = pairs.groupBy("comp", "i", "j").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter((F.col("i") == F.col("j")) | (F.col("a") < F.col("b")))
    return light.union(pairs.join(both.select("comp", "i", "j"), ["comp", "i", "j"], "left_semi").select("node", "own", "comp", "i", "j"))
