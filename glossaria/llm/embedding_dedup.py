"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

1. Equal vectors are one class, for which its smallest vec_id stands; copies are never paired. A vec_id whose rows have
   different vectors may stand for several classes.
2. Each class's signs on random hyperplanes (a fixed seed) give one bucket in each of several tables. The bits
   of a bucket follow the number of vectors, and the number of tables follows from the bits and the wanted recall, so
   that buckets stay small and recall stays the same at every size. Crowded buckets get longer keys and more tables of their
   own (regions.py), so that recall holds there too.
3. Within a bucket, a longer sign sketch is compared; what agrees far enough is joined in spanning stars.
4. Each cluster's vectors meet in one task (a heavy cluster's in the groups of those balls that are near enough to hold a link,
   see balls.py), where cosines are computed in double precision: rows carry link counts and spanning stars, never all pairs.
5. Components of the confirmed links, by DataFrame joins.

Defined results: vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing;
vectors of different lengths link with nothing; rows that repeat a vec_id are one node, whose links are the
most that one of its vectors has; of equal vectors the smallest vec_id stands for all; a null vec_id gives component_id null
and kept true; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.balls import ball_blocks, unit_rows
from glossaria.llm.common import Scratch, bounded_joins, map_batches, record, spread
from glossaria.llm.graph import connected_components
from glossaria.llm.regions import Look, forest_links, groups, mix

COSINE = 0.9
#: Bits of sign sketch for the comparison in a bucket, and the largest number of differing ones: at cosine 0.9 73.5
#: are expected with a standard deviation of 7.9; 111 is 4.7 deviations more.
SKETCH_BITS, DIFFER = 512, 111
#: Chance, at cosine 0.9, that two vectors share a bucket of some table.
RECALL = 0.995
#: Vectors that a bucket should hold on average.
BUCKET = 16
SEED = 20240229
#: Vectors in a block of a cluster.
BLOCK_ROWS = 8_000

_SIGNED = pa.schema([("node", pa.int64()), ("vector", pa.binary()), ("dims", pa.int32()), ("keys", pa.list_(pa.int64())), ("look", pa.binary())])
_OUT = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=-1, dtype=np.int64) <= DIFFER


#: Looks are the packed signs of the sketch; the units of a longer prefix are single signs.
LOOK = Look(SKETCH_BITS // 8, _near, lambda x: np.unpackbits(x, axis=1), 1 - math.acos(COSINE) / math.pi, (8, 16, 24))


def table_plan(vectors: int, recall: float = RECALL, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a bucket, tables) for so many vectors."""
    bits = max(6, round(math.log2(max(vectors, 1) / BUCKET)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, vector, dims, keys, look) of the valid vectors: doubles as bytes; a bucket of each table; a sketch of packed signs."""

    def make() -> Callable:
        planes: dict[int, np.ndarray] = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    column = part.column(1)
                    lens = np.diff(np.asarray(column.offsets))
                    lens[np.asarray(column.is_null())] = 0
                    nodes = part.column(0)
                    flat = column.flatten()
                    numbers = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
                    starts = np.concatenate(([0], np.cumsum(lens)))
                    good = np.array([n > 0 and bool(np.isfinite(v := numbers[s : s + n]).all()) and bool(v.any()) for n, s in zip(lens, starts[:-1], strict=True)], dtype=bool)
                    good &= ~np.asarray(nodes.is_null())
                    for n in np.unique(lens[good]).tolist():
                        rows = np.flatnonzero(good & (lens == n))
                        x = numbers[starts[rows][:, None] + np.arange(n)]
                        if n not in planes:
                            planes[n] = np.random.default_rng([SEED, n]).standard_normal((n, SKETCH_BITS + bits * tables))
                        scale = np.abs(x).max(axis=1, keepdims=True)
                        signs = (x / scale) @ planes[n] >= 0
                        look = np.packbits(signs[:, :SKETCH_BITS], axis=1)
                        keys = mix(signs[:, SKETCH_BITS:].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.uint64)) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)).view(np.int64)
                        yield record(_SIGNED, node=nodes.take(pa.array(rows)), vector=[v.tobytes() for v in x], dims=np.full(len(rows), n, dtype=np.int32), keys=list(keys), look=[v.tobytes() for v in look])

        return run

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("node"), F.col("embedding").cast("array<double>").alias("embedding")), make, "node long, vector binary, dims int, keys array<long>, look binary")


def confirmed(rows: DataFrame, parts: int) -> DataFrame:
    """(node, root, links): in each group of blocks, links counted in rows of the table, and the node's star.

    rows: (comp, i, j, own, node, vector, copies). In a group of two parts only pairs across them are counted.
    """

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j), t in groups(batches, 3):
                node, own, copies = (t.column(c).to_numpy() for c in ("node", "own", "copies"))
                raw = t.column("vector").to_pylist()
                size = np.array([len(v) for v in raw])
                total, roots = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    x = unit_rows([raw[k] for k in at.tolist()])
                    for s in range(0, len(at), 256):
                        near = x[s : s + 256] @ x.T >= COSINE
                        near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                        if i != j:
                            near &= own[at[s : s + 256]][:, None] != own[at][None, :]
                        total[at[s : s + 256]] += near @ copies[at]
                        for r in np.flatnonzero(near.any(axis=1)).tolist():
                            met = roots[at[near[r]]]
                            if (met != roots[at[s + r]]).any():
                                parts = np.unique(np.append(met, roots[at[s + r]]))
                                roots[np.isin(roots, parts)] = parts[0]
                some = np.flatnonzero(total)
                yield record(_OUT, node=node[some], root=node[roots[some]], links=total[some])

        return run

    rows = rows.select("comp", "i", "j", "own", "node", "vector", "copies")
    return map_batches(rows.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node"), make, "node long, root long, links long")


@bounded_joins
def near_duplicate_vectors(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """One row for each row of embeddings: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    bits, tables = table_plan(embeddings.count())
    rows = scratch.table(signed(embeddings, bits, tables))
    classes = rows.groupBy("vector").agg(F.min(F.struct("node", "keys", "look")).alias("head"), F.count("*").alias("copies")).select("vector", "head.*", "copies")
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()))
    links = forest_links(classes.select(F.col("class").alias("node"), "keys", "look"), scratch, LOOK)
    comps = connected_components(links, scratch)
    vectors = classes.select(F.col("class").alias("node"), "vector", "copies")
    sized = scratch.table(comps.join(vectors.select("node", (F.octet_length("vector") / 8).cast("int").alias("dims")), "node"))
    blocks = scratch.table(ball_blocks(sized, vectors.select("node", "vector"), scratch, BLOCK_ROWS, math.acos(COSINE)))
    met = blocks.select("comp", "i", "j", "own", "node").join(vectors, "node")
    done = scratch.table(confirmed(met, spread(spark, blocks.count(), 1_000, 50_000)).withColumnRenamed("node", "class"))
    stars = done.join(classes.select("class", F.col("node").alias("a")), "class").join(classes.select(F.col("class").alias("root"), F.col("node").alias("b")), "root").select("a", "b")
    copies = rows.join(classes.filter("copies > 1").select("vector", F.col("node").alias("b")), "vector").select(F.col("node").alias("a"), "b")
    final = scratch.table(connected_components(stars.union(copies), scratch))
    counted = done.groupBy("class").agg(F.sum("links").alias("links"))
    many = classes.filter("copies > 1").select("vector", "class", "copies").join(counted, "class", "left")
    own = scratch.table(
        rows.join(many, "vector").groupBy("node").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
        .union(counted.join(classes.filter("copies = 1").select("class", "node"), "class").select("node", F.col("links").alias("n")))
        .groupBy("node").agg(F.max("n").alias("n"))
    )
    scratch.keep(own, final)
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("node")).join(own.hint("merge"), "node", "left").join(final.hint("merge"), "node", "left")
        .select(F.col("node").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
