"""MinHash near-duplicate documents over an LSH forest, confirmed on full sets of 5-word shingles.

1. Each text is turned into its set of distinct hashed shingles (64 bits), a fingerprint of the set and a signature.
2. Documents with equal sets are one class; its smallest doc_id stands for it, so copies are never paired. A doc_id whose
   rows have different sets may stand for several classes.
3. The forest (regions.py) sorts the classes' signatures in several orders, and joins those whose signatures agree well
   below the threshold into provisional clusters, at every size of a region.
4. Each cluster's texts meet in one task, which decides every pair that could still join two parts, on the full sets. A heavy
   cluster is dealt into blocks that share some members; then whatever lies outside its largest component meets all
   members of a size that a link allows, in pairs of blocks. No link between different texts of a cluster is lost.
5. Components of the confirmed links, by DataFrame joins.

Defined results: null or empty texts, and texts of white space, have an empty set and stand alone; a very long text is
one set, held by one task; rows that repeat a doc_id are one node, with every row's links; of equal texts the smallest doc_id
stands for all; a null doc_id gives component_id null and kept true; other columns are ignored, and an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, bounded_broadcast, bounded_joins, map_batches, record, sliced, spread
from glossaria.llm.graph import connected_components, first_blocks, left_over_blocks
from glossaria.llm.regions import EDGES, Look, Sets, forest_links, groups, mix

SHINGLE = 5
#: A link: 100 * intersection >= 75 * union.
PERCENT = 75
#: Hash values in a signature, sorted orders, and values of the least common prefix of two candidates: two sets of
#: similarity 0.75 share that prefix in one of 24 orders with probability 1 - (1 - 0.75 ** 3) ** 24 = 0.999998.
VALUES, ORDERS, DEPTH = 72, 24, 3
#: Signatures must agree in this many of 72 places (0.51; 0.75 less 4.6 standard errors) to join a provisional cluster.
AGREE = 37
#: Bytes of text that one block of a cluster may have.
BLOCK_BYTES = 12_000_000
#: Sizes of linked sets differ by 100 / PERCENT at most, hence their logarithms to this base by less than 1.
BAND = 1.34

SKETCH = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64())), ("look", pa.binary())])


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _odd(256, 11)
_PLACE = _odd(SHINGLE, 12)
_MULT, _ADD = _odd(VALUES, 13), _odd(VALUES, 14)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, for places up to n."""
    if not _powers or len(_powers[0]) < n + 1:
        n = max(n, 1 << 20)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, b, dtype=np.uint64)
            p[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(p)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its 5-word shingles (of all its words, if fewer)."""
    joined = b" ".join(texts).lower() + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    word = ~_SPACE[buf]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, stops - 1, side="left") if len(start) else np.zeros(len(texts), dtype=np.int64)
    out, at = [], 0
    full = np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE if len(full) else 0):
        full += h[k : k + len(full)] * _PLACE[k]
    full = mix(full)
    for to in bounds.tolist():
        n = to - at
        if n >= SHINGLE:
            s = np.sort(full[at : to - SHINGLE + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = mix(np.array([(h[at:to] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
        else:
            s = full[:0]
        out.append(s)
        at = to
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES 32-bit minima for each set; sets must not be empty."""
    values, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), VALUES), dtype=np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(((values * _MULT[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def order_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature and order t the hash of t and of the DEPTH values that begin the order, those from DEPTH * t on."""
    v = sig.astype(np.uint64).reshape(len(sig), ORDERS, DEPTH)
    out = np.broadcast_to(_odd(ORDERS, 15), (len(sig), ORDERS))
    for k in range(DEPTH):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
    return out.view(np.int64)


#: Looks are the low bytes of the values, in the order of the signature.
LOOK = Look(VALUES, lambda x, y: (x == y).sum(axis=-1) >= AGREE, lambda x: x, PERCENT / 100, (3, 6, 9, 15))


def sketches(documents: DataFrame) -> DataFrame:
    """(node, n, bytes, print, keys, look) of each row: sizes of set and text, fingerprint of the set, the forest's keys and look;
    empty sets have none of the last three."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                sets = shingle_sets(texts)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                mark, keys, look = ([None] * len(sets) for _ in range(3))
                if len(some):
                    sig = signatures([sets[i] for i in some])
                    low = sig.astype(np.uint8)
                    for i, row, short in zip(some.tolist(), order_keys(sig), low, strict=True):
                        keys[i], look[i], mark[i] = row, short.tobytes(), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield record(SKETCH, node=part.column("node"), n=n, bytes=[len(t) for t in texts], print=mark, keys=keys, look=look)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("node"), "text"), make, "node long, n long, bytes long, print binary, keys array<long>, look binary")


def link_exactly(ids: np.ndarray, sets: list[np.ndarray], comp: np.ndarray | None = None, based: np.ndarray | None = None) -> np.ndarray:
    """For each set the id of the first set that it reaches by links of PERCENT or more, every decisive pair compared.

    A pivot's intersections with all sets come from one pass over an inverted index. Sets of the largest component
    need not be pivots: whatever lies outside it becomes one. Sets of one ``comp`` are joined beforehand; if any are
    ``based``, these are the ones that need not be pivots.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    joint = Sets(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    posts, begin = owner[order], np.concatenate(([0], np.cumsum(count)))
    first = np.concatenate(([0], np.cumsum(size)))
    weight = np.add.reduceat(count[where], first[:-1]) / np.maximum(size, 1)
    waiting = np.ones(n, dtype=bool)
    if comp is not None:
        for k, head in enumerate(np.unique(comp, return_index=True)[1][np.unique(comp, return_inverse=True)[1]].tolist()):
            joint.join(k, head)
    if based is not None and based.any():
        waiting &= ~based
    pivot = int(np.argmax(np.where(waiting, weight, -1)))
    while waiting[pivot]:
        waiting[pivot] = False
        at = where[first[pivot] : first[pivot + 1]]
        lens = count[at]
        took = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        both = np.bincount(posts[took], minlength=n)
        linked = np.flatnonzero(100 * both >= PERCENT * (size + size[pivot] - both))
        for j in linked.tolist():
            joint.join(pivot, j)
        roots = joint.roots()
        names, sizes = np.unique(roots, return_counts=True)
        if len(names) == 1:
            break
        rest = waiting & (roots != (names[np.argmax(sizes)] if based is None or not based.any() else roots[np.argmax(based)]))
        if not rest.any():
            break
        pivot = int(np.flatnonzero(rest)[np.argmax(weight[rest])])
    return ids[joint.roots()]


def confirmed_links(documents: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """(a, b): links that join, within each group of blocks, what full sets join. blocks: key, i, j, node, comp, based."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in groups(batches, 3):
                ids, comp, based = t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("based").to_numpy()
                sets: list[np.ndarray] = []
                for _, texts in sliced(t.select(["text"]).to_batches(), "text"):
                    sets += shingle_sets(texts)
                some = [i for i, s in enumerate(sets) if len(s)]
                if len(some) < 2:
                    continue
                a, b = ids[some], link_exactly(ids[some], [sets[i] for i in some], comp[some], based[some])
                yield record(EDGES, a=a[a != b], b=b[a != b])

        return run

    wanted = bounded_broadcast(blocks.select("node", "key", "i", "j", "comp", "based"))
    rows = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node").select("key", "i", "j", "node", "comp", "based", "text")
    return map_batches(rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node"), make, "a long, b long").distinct()


def exact_links(documents: DataFrame, members: DataFrame, scratch: Scratch, size: int = BLOCK_BYTES) -> DataFrame:
    """The links that join what belongs together in each cluster. members: (key, node, weight, band), weights in bytes."""
    spark = documents.sparkSession
    of = lambda rows: spread(spark, rows, 1_000, 10_000)  # noqa: E731  texts, not short rows
    few = spread(spark, members.count())
    weights = members.groupBy("key").agg(F.sum("weight").alias("w"))
    heavy = scratch.table(weights.filter(F.col("w") > size).select("key", F.ceil(F.col("w") / size).alias("parts")).coalesce(few))
    blocks = first_blocks(members, heavy).select("key", "i", F.col("i").alias("j"), "node", F.col("node").alias("comp"), F.lit(False).alias("based")).distinct()
    found = scratch.table(confirmed_links(documents, blocks, of(members.count())).coalesce(few))
    if heavy.isEmpty():
        return found
    big = members.join(heavy.select("key"), "key", "left_semi").join(connected_components(found, scratch, written=True), "node", "left")
    named = scratch.table(big.select("key", "node", "weight", "band", F.coalesce("comp", "node").alias("comp")))
    left = scratch.table(left_over_blocks(named, size).select("key", "i", "j", "node", "comp", "based").distinct())
    return found.union(scratch.table(confirmed_links(documents, left, of(left.count())).coalesce(spread(spark, left.count()))))


@bounded_joins
def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark)
    sketch = scratch.table(sketches(documents))
    known = sketch.filter("node is not null and print is not null")
    heads = known.groupBy("print").agg(F.min(F.struct("node", "n", "keys", "look")).alias("head"), F.count("*").alias("rows")).select("print", "head.*", "rows")
    heads = scratch.table(heads.withColumn("class", F.monotonically_increasing_id()).coalesce(spread(spark, sketch.count(), 1_000, 10_000)))
    few = spread(spark, sketch.count())  # links and names of nodes: short rows
    links = forest_links(heads.select(F.col("class").alias("node"), "keys", "look"), scratch, LOOK, DEPTH)
    classes = connected_components(links, scratch, written=True).withColumnRenamed("node", "class")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int").alias("band")
    clusters = scratch.table(classes.join(heads.select("class", "node", "n"), "class").select(F.col("comp").alias("key"), "node", band).distinct().coalesce(few))
    weights = known.join(clusters.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("bytes").alias("weight"))
    members = scratch.table(clusters.join(weights, "node").coalesce(few))
    exact = exact_links(documents, members, scratch)
    copies = known.join(heads.filter("rows > 1").select("print", F.col("node").alias("rep")), "print").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    copied = scratch.table(copies.filter("a <> b").coalesce(few))
    final = scratch.table(connected_components(exact.union(copied), scratch, written=True).coalesce(few))
    scratch.keep(sketch, final)
    return (
        sketch.select("node", "n").join(final.hint("merge"), "node", "left")
        .select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def told_apart(documents: DataFrame, scratch: Scratch) -> DataFrame | None:
    """documents with _node: the doc_id, but a number of its own for each (doc_id, text) of a doc_id that several rows have;
    None if no doc_id is repeated. The numbers lie above all doc_ids."""
    again = documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again")
    if again.isEmpty():
        return None
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    above = documents.agg(F.max(F.col("doc_id").cast("long"))).first()[0] + 1
    many = documents.join(bounded_broadcast(again), F.col("doc_id") == F.col("_again"), "left_semi").select(F.col("doc_id").alias("_again"), digest.alias("_digest")).distinct()
    named = scratch.table(many.withColumn("_new", F.monotonically_increasing_id() + above))
    at = (F.col("doc_id") == F.col("_again")) & (digest == F.col("_digest"))
    return documents.join(bounded_broadcast(named), at, "left").withColumn("_node", F.coalesce("_new", F.col("doc_id").cast("long"))).drop("_again", "_digest", "_new")


@bounded_joins
def drop_near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents with one row for each group of near duplicates: that of the smallest doc_id.

    Texts decide, not ids: rows that share a doc_id are near duplicates only if their texts are. Of rows with equal doc_id and
    text the least by all columns stays. Rows without a doc_id stay, as do texts without words, which are like nothing.
    """
    scratch = Scratch(spark)
    apart = told_apart(documents, scratch)
    if apart is None:
        gone = near_duplicates(spark, documents).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
        return documents.join(bounded_broadcast(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    rows = scratch.table(apart)
    groups = near_duplicates(spark, rows.withColumn("doc_id", F.col("_node"))).filter("doc_id is not null").select(F.col("doc_id").alias("_node"), "component_id")
    ids = rows.filter("_node is not null").groupBy("_node").agg(F.min("doc_id").alias("_id"))
    first = groups.distinct().join(ids.hint("merge"), "_node").groupBy("component_id").agg(F.min(F.struct("_id", "_node")).alias("_first")).select(F.col("_first._node").alias("_kept"))
    left = rows.join(bounded_broadcast(first), F.col("_node") == F.col("_kept"), "left_semi")
    unnamed = rows.filter("_node is null").select(*documents.columns)
    one = left.groupBy("_node").agg(F.min(F.struct(*documents.columns)).alias("row")).select("row.*")
    return one.select(*documents.columns).union(unnamed)
