"""Filter interaction audit: five filters, in all 120 orders, from one scan of the texts.

The scan reads Arrow's buffers: byte classes by table look-up, prefix sums of them at the texts' bounds give code points,
capitals and symbols; word bounds are changes of class. A word's hash comes from prefix sums too (a polynomial modulo 2^64,
divided by the power of its place). Sorted by text and hash, equal neighbours are verified byte by byte, and the others are
the distinct words; should a hash ever deceive, the texts concerned are counted by a set. Four filters are a mask of bits.

The fifth, copies of an earlier text, is decided on SHA-256 digests: copies have equal masks, so they are counted by digest,
part, mask and labels before any row moves, and no row is joined with its copies. Each part is then 32 counts, which the
report turns into all orders and steps.

Defined results: a null text is empty, and a null lang is the part ''; a row without doc_id has no label and is neither a copy
nor the first of any; rows that repeat a doc_id count each; where a doc_id has several labels, any 1 counts; other columns are
ignored; an empty table gives an empty report. A text above LONG bytes is counted in blocks, its distinct words as a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import bounded_broadcast, map_batches, slices

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
LONG = 4 << 20
#: Texts of this many bytes together are scanned at once.
SLICE = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL = np.zeros(256, dtype=np.uint8)
_CAPITAL[65:91] = 1
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
#: Bytes that begin a code point.
_POINT = np.ones(256, dtype=np.uint8)
_POINT[0x80:0xC0] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2^64, by doubling."""
    out = np.ones(n + 1, dtype=np.uint64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Scanner:
    """Counts of texts that lie one behind the other in a buffer."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """words, distinct, points, capitals, symbols of each text; text k is data[bounds[k]:bounds[k + 1]]."""
        of = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[bounds])
        white = _WHITE[data]
        before, behind = np.ones(len(data) + 1, dtype=bool), np.ones(len(data) + 1, dtype=bool)
        before[1:], behind[:-1] = white, white
        before[bounds], behind[bounds] = True, True  # at a bound a new text begins
        start, end = np.flatnonzero(~white & before[:-1]), np.flatnonzero(~white & behind[1:]) + 1
        doc = np.searchsorted(bounds, start, side="right") - 1
        n = np.bincount(doc, minlength=len(bounds) - 1)
        return {"words": n, "distinct": n - self._again(data, start, end, doc, len(bounds) - 1), "points": of(_POINT), "capitals": of(_CAPITAL), "symbols": of(_SYMBOL)}

    def _again(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """How many words of each text are the same as another one before them."""
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        mark = (total[end] - total[start]) * self.down[start]
        mark ^= mark >> np.uint64(29)
        mark += doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(mark)
        sorted_mark = mark[order]
        pair = np.flatnonzero(sorted_mark[1:] == sorted_mark[:-1])
        a, b = order[pair], order[pair + 1]
        wrong = self._differ(data, start, end, doc, a, b)
        again = np.bincount(doc[a], minlength=docs)
        if wrong.any():
            for k in set(doc[a[wrong]].tolist()) | set(doc[b[wrong]].tolist()):
                mine = np.flatnonzero(doc == k)
                again[k] = len(mine) - len({data[s:e].tobytes() for s, e in zip(start[mine].tolist(), end[mine].tolist(), strict=True)})
        return again

    @staticmethod
    def _differ(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are of different texts or not the same bytes: eight bytes at a time, long ones whole."""
        size = end[a] - start[a]
        wrong = (doc[a] != doc[b]) | (size != end[b] - start[b])
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        live, at = np.flatnonzero(~wrong), 0
        while len(live) and at < 64:
            x = eight[start[a[live]] + at] ^ eight[start[b[live]] + at]
            rest = np.minimum(size[live] - at, 8).astype(np.uint64)
            wrong[live] |= (x << ((np.uint64(8) - rest) * np.uint64(8))) != 0
            at += 8
            live = live[size[live] > at]
        for k in live.tolist():
            wrong[k] |= data[start[a[k]] : end[a[k]]].tobytes() != data[start[b[k]] : end[b[k]]].tobytes()
        return wrong


def scan_long(text: bytes, block: int = LONG) -> dict[str, int]:
    """The same counts of one long text, in blocks that end between words."""
    out, seen, at = dict.fromkeys(("words", "points", "capitals", "symbols"), 0), set(), 0
    raw = np.frombuffer(text, dtype=np.uint8)
    while at < len(text):
        to = min(at + block, len(text))
        while to < len(text) and not _WHITE[raw[to]]:
            gap = np.flatnonzero(_WHITE[raw[to : to + block]])
            to = to + int(gap[0]) if len(gap) else min(to + block, len(text))
        words = text[at:to].split()
        seen.update(words)
        out["words"] += len(words)
        for name, table in (("points", _POINT), ("capitals", _CAPITAL), ("symbols", _SYMBOL)):
            out[name] += int(np.sum(table[raw[at:to]], dtype=np.int64))
        at = to
    return out | {"distinct": len(seen)}


def masks_of(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The bits of the filters A to D that each text fails."""
    fails = [counts["words"] < LEAST_WORDS, 100 * counts["distinct"] < DISTINCT_PERCENT * counts["words"], 100 * counts["capitals"] > CAPITAL_PERCENT * counts["points"], counts["symbols"] > 0]
    return sum((f.astype(np.int32) << k for k, f in enumerate(fails)), np.zeros(len(counts["words"]), dtype=np.int32))


_OUT = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32()), ("words", pa.int64()), ("distinct", pa.int64()), ("points", pa.int64()), ("capitals", pa.int64()), ("symbols", pa.int64())])
_COUNTS = ["words", "distinct", "points", "capitals", "symbols"]


def scan_documents(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, part, digest of the text, mask of A to D, and the counts behind it."""

    def make() -> Callable:
        scanner = Scanner()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
                sizes = np.asarray(pc.binary_length(text), dtype=np.int64)
                for i, j in slices(sizes, SLICE):
                    part = text.slice(i, j - i)
                    _, offsets, values = part.buffers()
                    at = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
                    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, dtype=np.uint8)
                    bounds = at - at[0]
                    if len(data) > LONG:  # one text
                        counts = {k: np.array([v]) for k, v in scan_long(data.tobytes()).items()}
                    else:
                        counts = scanner.scan(data, bounds)
                    view = memoryview(data)
                    digests = [hashlib.sha256(view[s:e]).digest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("part").slice(i, j - i), pa.array(digests, pa.binary()), pa.array(masks_of(counts), pa.int32()), *[pa.array(counts[c], pa.int64()) for c in _COUNTS]], schema=_OUT)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text"), make, "doc_id long, part string, digest binary, mask int, words long, distinct long, points long, capitals long, symbols long")


def mask_counts(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows of each part by the five filters they fail and their labels."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = scanned.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    # rows without an id find no label; they are dealt by digest, or one task would have them all
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt).join(bounded_broadcast(told).withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    # the copies that a task sees are one row before they move, a third of all rows or not
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    same = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first)
    least = same.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    both = same.join(least, "digest")
    original = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), original.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - original).alias("n")))).alias("x")
    return both.select("part", "good", "toxic", split).groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n")).filter("n > 0")


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_REPORT_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])


def _steps() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """All orders and steps, each step's filter, and which of the 32 masks each counts."""
    names, which, rows = [], [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    m = np.arange(1 << len(FILTERS))
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for f in order:
            bit = 1 << f
            fails, gone = (m & bit) > 0, (m & earlier) > 0
            rows["kept"].append(~fails & ~gone)
            rows["removed"].append(fails & ~gone)
            rows["redundant"].append(fails & gone)
            rows["unique_fails"].append(m == bit)
            names.append("".join(FILTERS[k] for k in order))
            which.append(f)
            earlier |= bit
    return names, np.array(which), {k: np.array(v).astype(np.int64) for k, v in rows.items()}


def order_report(counts: DataFrame) -> DataFrame:
    """Of mask_counts(): one row for each part, order of the filters and step."""
    array = lambda when: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & when, F.col("n"))), F.lit(0)) for m in range(1 << len(FILTERS))])
    parts = counts.groupBy("part").agg(array(F.lit(True)).alias("all"), array(F.col("good")).alias("good"), array(F.col("toxic")).alias("toxic"))

    def make() -> Callable:
        names, which, rows = _steps()
        step = np.arange(len(names), dtype=np.int32) % len(FILTERS) + 1
        share = np.array([rows["removed"][which == f].sum(axis=0) for f in range(len(FILTERS))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, n, good, toxic in zip(*[batch.column(c).to_pylist() for c in ("part", "all", "good", "toxic")], strict=True):
                    n, good, toxic = (np.array(x, dtype=np.int64) for x in (n, good, toxic))
                    columns = [*[rows[k] @ n for k in ("kept", "removed", "redundant", "unique_fails")], rows["removed"] @ good, rows["removed"] @ toxic, (share @ n)[which]]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(step, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], schema=_REPORT_ARROW)

        return run

    return map_batches(parts, make, _REPORT)


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The report on documents: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return order_report(mask_counts(scan_documents(documents), labels))
