"""Packing of token sequences: Karmarkar-Karp multiway differencing.

Each document's ids (and an end id) are cut into full sequences and, from what is left, pieces of at most PIECE ids.
Pieces are dealt at random into groups of a fixed expected size, and each group is divided into windows: every piece
starts as a partition of its own; the two partitions with the largest differences between their fullest and emptiest
window are merged, the fullest windows of one with the emptiest of the other, until one is left. Its windows are nearly
equal. If one exceeds the capacity, the number of windows rises and the group is divided again.

Defined results: null and empty texts have only the end id; a very long text is one task's work and gives full sequences but for
its rest; pieces of one length tie by their place; every row is packed, those that repeat a doc_id too, each as a
document of its own; a null doc_id stays null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, map_batches, record, sliced, spread
from glossaria.llm.regions import groups
from glossaria.llm.tokens import BPE, token_ids

CAPACITY, PIECE = 1024, 256
END = 0
#: Documents in a group, on average.
GROUP = 1024

_PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def divide(sizes: list[int], windows: int) -> list[int]:
    """The window of each size, by differencing: 0 to windows - 1."""
    up = list(range(len(sizes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # a partition: differences in descending order, and a member of each window; windows beyond these are empty
    heap = [(-s, k, np.array([s]), np.array([k])) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, k, a, who = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        free = windows - len(a)
        if len(b) > free:  # fullest with emptiest
            over = len(b) - free
            for x, y in zip(who[len(a) - over :].tolist(), other[:over][::-1].tolist(), strict=True):
                up[root(y)] = root(x)
            a = a.copy()
            a[len(a) - over :] += b[:over][::-1]
            b, other = b[over:], other[over:]
        a, who = np.concatenate((a, b)), np.concatenate((who, other))
        order = np.argsort(-a, kind="stable")
        a, who = a[order], who[order]
        if len(a) == windows:
            a = a - a[-1]
        heapq.heappush(heap, (-int(a[0] - (a[-1] if len(a) == windows else 0)), k, a, who))
    names: dict[int, int] = {}
    return [names.setdefault(root(k), len(names)) for k in range(len(sizes))]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Windows of at most the capacity for sizes of at most the capacity, as few as differencing manages."""
    if not sizes:
        return []
    n = math.ceil(sum(sizes) / capacity)
    while True:
        at = divide(sizes, n)
        over = int(np.bincount(at, weights=sizes).max()) - capacity
        if over <= 0:
            return at
        n += max(1, n * over // (8 * capacity))  # an eighth of the room that the fullest window lacks


def pieces(documents: DataFrame, name: str = BPE, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): each document's ids, cut."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                out: list[list] = [[] for _ in _PIECES]
                for doc, row, t in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), texts, strict=True):
                    ids = token_ids(t.decode("utf-8", "replace"), name)
                    raw = memoryview(np.array([*ids, END], dtype="<u4").tobytes())
                    n = len(ids) + 1
                    full = n - n % capacity
                    cuts = [*range(0, full, capacity), *range(full, n, piece), n]
                    for s, e in zip(cuts, cuts[1:], strict=False):
                        for c, v in zip(out, (doc, row, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n), strict=True):
                            c.append(v)
                yield record(_PIECES, **{f.name: c for f, c in zip(_PIECES, out, strict=True)})

        return run

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return map_batches(rows, make, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(spark: SparkSession, documents: DataFrame, name: str = BPE, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark)
    cut = scratch.table(pieces(documents, name, capacity, piece))
    n = max(1, math.ceil(cut.filter("start = 0").count() / group))
    dealt = cut.select(F.pmod(F.xxhash64("row", "doc_id"), F.lit(n)).alias("grp"), "*")

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (grp,), t in groups(batches, 1):
                size = t.column("length").to_numpy()
                whole = size == capacity
                seq = np.empty(len(size), dtype=np.int64)
                seq[whole] = np.arange(whole.sum())
                seq[~whole] = np.array(pack(size[~whole].tolist(), capacity), dtype=np.int64) + whole.sum()
                order = np.argsort(seq, kind="stable")
                run_up = np.concatenate(([0], np.cumsum(size[order])[:-1]))
                starts = np.concatenate(([True], np.diff(seq[order]) > 0))
                base = np.maximum.accumulate(np.where(starts, run_up, 0))
                t = t.take(pa.array(order))
                cols = {c: t.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                yield record(_OUT, **cols, sequence_id=seq[order] + (grp << 32), offset=run_up - base)

        return run

    return map_batches(dealt.repartition(spread(spark, n, 4, 512), "grp").sortWithinPartitions("grp", "row", "start"), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
