"""Periodic run detection on bit planes of word ids.

A run is a stretch of words with smallest period q and at least 4 * q (and 6) words that no neighbouring word extends. The
words of a text are numbered, and each bit of the numbers is one big integer (a plane). For a lag q, every plane is XORed with
itself shifted by q; the OR of these is a big integer whose zeros are the places where a word equals the one q words on. AND
with shifted copies of itself, at doubling shifts, leaves the starts of stretches that are long enough.

Which lags are worth that: in a run of period q, any window of L words with 2q <= L <= 3q occurs again exactly q words on, and
not before (two periods in so long a window would have a common divisor as period), and the run is long enough to hold such a
window and its next occurrence. Windows of 2, 3, 4, 6, 8, 12... words are numbered by doubling over many texts at once, and a
lag is tried where a window's next occurrence lies L/3 to L/2 words on. Such a place is itself a repetition of three times or
more, so a text has few of them (about the root of its length at most), and the time is near to linear in the length.

Defined results: a null text and one without words have no words and no runs; a null doc_id is never replanted; rows that
repeat a doc_id are judged each; other columns are ignored; an empty table gives an empty result. A text is held in memory
as words while it is read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import map_batches, sliced

REPEATS = 4
LEAST_WORDS = 6

Run = tuple[int, int, int]


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (from 1) of the windows that occur more than once, by position, 0 for others; and the positions' distances to
    the next occurrence. keys: of the windows at the ascending positions ``at``."""
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], at[order]
    same = k[1:] == k[:-1]
    many = np.zeros(len(k), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    number = np.zeros(n, dtype=np.int64)
    number[p[many]] = np.cumsum(np.concatenate([[True], ~same]))[many]
    gaps = np.zeros(n, dtype=np.int64)
    gaps[p[:-1][same]] = (p[1:] - p[:-1])[same]
    return number, gaps


def _joined(number: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for windows made of one at a position and one ``shift`` words on."""
    n = len(number)
    at = np.flatnonzero(number[: n - shift] * number[shift:]) if shift < n else np.zeros(0, dtype=np.int64)
    if len(at) < 2:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    return _repeated((number[at] << 32) | number[at + shift], at, n)


def likely_lags(texts: list[np.ndarray]) -> list[list[int]]:
    """For each text, given as word ids from 0: the lags at which it may have runs, ascending."""
    found: list[set[int]] = [set() for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return [[] for _ in texts]
    ends = np.cumsum(lengths + 1)  # one separator behind each text
    flat = np.full(int(ends[-1]), -1, dtype=np.int64)
    for t, e in zip(texts, ends.tolist(), strict=True):
        flat[e - 1 - len(t) : e - 1] = t
    seen = np.bincount(flat[flat >= 0])
    number = np.where((flat >= 0) & (seen[np.maximum(flat, 0)] > 1), flat + 1, 0)  # separators and single words never recur
    size, longest = 1, int(lengths.max())
    while 8 * size <= 3 * longest and number.any():  # two thirds of size, four times, fit into the longest text
        number, gaps = _joined(number, size)
        for length, g in ((2 * size, gaps), (3 * size, _joined(number, size)[1])):
            at = np.flatnonzero((3 * g >= length) & (2 * g <= length) & (g > 0))
            for doc, q in set(zip(np.searchsorted(ends, at, side="right").tolist(), g[at].tolist(), strict=True)):
                found[doc].add(q)
        size *= 2
    return [sorted(x) for x in found]


def planes(ids: np.ndarray) -> list[int]:
    """Bit k of all ids as one integer, the first word lowest."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    return [int.from_bytes(np.packbits(((ids >> k) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def _ones(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def runs_at(bits: list[int], n: int, q: int) -> list[Run]:
    """Stretches (start, length, q) of at least max(6, 4q) words in which every word equals the one q words on."""
    length = max(LEAST_WORDS, REPEATS * q)
    if n < length:
        return []
    differ = 0
    for p in bits:
        differ |= p ^ (p >> q)
    same = ~differ & ((1 << (n - q)) - 1)
    want, have = length - q, 1
    while have < want and same:
        step = min(have, want - have)
        same &= same >> step
        have += step
    if not same:
        return []
    first, last = _ones(same & ~(same << 1), n), _ones(same & ~(same >> 1), n)
    return [(s, e - s + want + q, q) for s, e in zip(first.tolist(), last.tolist(), strict=True)]


def word_runs(ids: np.ndarray, lags: list[int] | None = None) -> list[Run]:
    """All runs (start, length, period) of a text given as word ids, by start, then period; lags: ascending, all by default."""
    n = len(ids)
    if lags is None:
        lags = list(range(1, n // REPEATS + 1))
    if not lags:
        return []
    bits, runs, taken = planes(np.unique(ids, return_inverse=True)[1]), [], set()
    for q in lags:
        for s, length, _ in runs_at(bits, n, q):
            if (s, length) not in taken:  # else a smaller period, which divides q, has this very stretch
                taken.add((s, length))
                runs.append((s, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays if of every run only its first period does."""
    step = np.zeros(n + 1, dtype=np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


def replanted(words: list, doc_id: int | None) -> list:
    """The words with a periodic tail planted into one text of ten, as the id's CRC tells; others unchanged."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def find_runs(documents: DataFrame, replant: bool = False) -> DataFrame:
    """One row for each row of documents: doc_id, its runs by start and period, and its words with repeats left out."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                words = [replanted(t.split(), i) if replant else t.split() for t, i in zip(texts, ids, strict=True)]
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                coded = [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]
                runs, left = [], []
                for w, c, lags in zip(words, coded, likely_lags(coded), strict=True):
                    r = word_runs(c, lags)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in r])
                    left.append(b" ".join([w[k] for k in np.flatnonzero(kept_words(len(w), r)).tolist()] if r else w))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, _OUT.field("runs").type), pa.array(left, pa.binary()).cast(pa.string())], schema=_OUT)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly compared; of ties the first in order. Null where there is none."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def run_report(found: DataFrame) -> DataFrame:
    """Of find_runs(): doc_id, n_runs, start, length, period and exponent_milli of the strongest, digests of runs and rest."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    df = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("r"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return df.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.call_function("div", 1000 * F.col("r.length"), F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
