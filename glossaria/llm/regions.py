"""Candidate links from several sorted orders of signatures (LSH forest).

Each item has a key in each of several orders, a hash of the least prefix that two candidates must share there, and a look:
the signature in short, turned so that it begins where the order does. Items are sorted by key and look, so that the items with
the longest common prefix stand next to each other. A region is a run of one key.

Neighbours in an order are compared first, which joins most of what is alike. What is left in a region of up to ``most`` items
is compared by pivots until every two items that are alike are joined. The depth of a region adapts to its size: a
crowded one is sorted over many tasks, each item is compared with its next neighbours, and regions that are joined then are
done. If many items are left outside of the largest component, the prefix is made longer until regions are small, and the
orders of the region grow in number with its prefix, so that two items at the threshold meet with probability MEET: that
joins most of what is left. What lies outside of the largest component then meets all items of the region, in bounded blocks.
So a region of any size joins the same items, and sizes decide only in which order they are compared; a region of items that
are mostly unlike each other costs the square of its size, over many tasks. Links are spanning stars: a region gives fewer
rows than it has items.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, map_batches, record, spread
from glossaria.llm.graph import connected_components, left_over_blocks

#: Next neighbours with which an item of a crowded region is compared.
NEXT = 8
#: Blocks of items outside the largest component up to which they meet a whole region at once.
LEFT = 8
#: Blocks of a crowded region have so many times the items of a usual one.
WIDER = 8
#: Chance that two items at the threshold meet in one of a crowded region's longer prefixes.
MEET = 0.9
#: Rows that a task reads at a time, and rows of a region that are compared all at once.
CHUNK, SQUARE = 20_000, 96

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("look", pa.binary())])
_PROFILE = pa.schema([("key", pa.int64()), ("depth", pa.int32()), ("sub", pa.int64())])


@dataclass(frozen=True)
class Look:
    """Looks of ``width`` bytes. near(x, y): for each row, whether two looks are alike. units(x): their units, one column
    each, of which two items at the threshold share one with chance ``agree``. depths: units by which a prefix grows."""

    width: int
    near: Callable[[np.ndarray, np.ndarray], np.ndarray]
    units: Callable[[np.ndarray], np.ndarray]
    agree: float
    depths: tuple[int, ...]

    def orders(self, depth: int) -> int:
        return math.ceil(math.log(1 - MEET) / math.log(1 - self.agree**depth))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)


def _changes(b: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    """Whether a row differs from the one before it in the first ``keys`` columns; the first row does."""
    out = np.zeros(b.num_rows, dtype=bool)
    out[:1] = True
    for c in (b.column(k).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(k).to_numpy() for k in range(keys)):
        out[1:] |= c[1:] != c[:-1]
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows, sorted by the first ``keys`` columns, that agree in them; one run at a time is held."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cuts = [*np.flatnonzero(_changes(b, keys)).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(b.column(k)[s].as_py() for k in range(keys))
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], keys: int, least: int = CHUNK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs, of about ``least`` rows, and the places where their runs begin."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(_changes(t, keys))
            if starts[-1]:
                yield t.slice(0, int(starts[-1])), starts[:-1]
            held = t.slice(int(starts[-1])).to_batches()
            rows = t.num_rows - int(starts[-1])
            least = max(CHUNK, 2 * rows)  # a run that is long is not cut anew with each batch
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.flatnonzero(_changes(t, keys))


def spanning(look: np.ndarray, near: Callable, label: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """For each row of ``look`` the smallest row that it reaches by rows found alike, or by rows of an equal ``label``.

    Rows of the largest group need not be pivots: whatever lies outside it becomes one, and is compared with all rows
    outside its own group that were no pivots before. Rows of an equal ``own`` are not compared.
    """
    n = len(look)
    root = np.arange(n)
    if label is not None:
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        root = first[back]
    size = np.bincount(root, minlength=n)
    waiting = np.ones(n, dtype=bool)
    while True:
        rest = waiting & (root != np.argmax(size))
        if not rest.any():
            return root
        pivot = int(np.argmax(rest))
        waiting[pivot] = False
        others = np.flatnonzero(waiting & (root != root[pivot]) if own is None else waiting & (root != root[pivot]) & (own != own[pivot]))
        found = others[near(look[pivot][None, :], look[others])]
        if len(found):
            parts = np.unique(np.append(root[found], root[pivot]))
            total = size[parts].sum()
            root[np.isin(root, parts)] = parts[0]
            size[parts] = 0
            size[parts[0]] = total


def _square(look: np.ndarray, near: Callable, label: np.ndarray) -> np.ndarray:
    """As spanning(), for few rows: all pairs in one comparison, then the smallest row of each component."""
    n = len(look)
    met = near(look[:, None, :], look[None, :, :]) | (label[:, None] == label[None, :])
    root = np.arange(n)
    while True:
        new = np.where(met, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _looks(t: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("look").to_pylist()), dtype=np.uint8).reshape(t.num_rows, width)


def region_stars(look: np.ndarray, starts: np.ndarray, near: Callable, comp: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """For each row the head of what it is joined with, in its run; rows of one ``comp`` are joined beforehand.

    Neighbours are compared for all runs at once. Only runs that are not joined then are looked at one by one.
    """
    n = len(look)
    begins = np.zeros(n, dtype=bool)
    begins[starts] = True
    linked = near(look[1:], look[:-1]) & ~begins[1:]
    run = np.concatenate(([0], np.cumsum(~linked)))
    head = np.flatnonzero(np.concatenate(([True], ~linked)))[run]
    stops = np.append(starts[1:], n)
    open_ = (run[stops - 1] > run[starts]) & (stops - starts > 2)
    if comp is not None:
        open_ = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)
    for s, e in zip(starts[open_].tolist(), stops[open_].tolist(), strict=True):
        label = run[s:e]
        if comp is not None:
            names, back = np.unique(comp[s:e], return_inverse=True)
            sets = Sets(len(names))
            for x, y in zip(back[1:][linked[s : e - 1]].tolist(), back[:-1][linked[s : e - 1]].tolist(), strict=True):
                sets.join(x, y)
            label = sets.roots()[back]
        if e - s <= SQUARE:
            head[s:e] = s + _square(look[s:e], near, label)
        else:
            head[s:e] = s + spanning(look[s:e], near, label, None if own is None or len(set(own[s:e].tolist())) == 1 else own[s:e])
    return head


def _compared(members: DataFrame, parts: int, look: Look, blocks: bool) -> DataFrame:
    """Links of each group. members: key, (if ``blocks``) i, j, comp, own, then look, node."""
    keys = ["key", "i", "j"] if blocks else ["key"]

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, starts in chunks(batches, len(keys)):
                node = t.column("node").to_numpy()
                comp, own = (t.column("comp").to_numpy(), t.column("own").to_numpy()) if blocks else (None, None)
                head = region_stars(_looks(t, look.width), starts, look.near, comp, own)
                moved = np.flatnonzero(head != np.arange(len(head)))
                if comp is not None:
                    moved = moved[comp[moved] != comp[head[moved]]]
                a, b = (node if comp is None else comp)[moved], (node if comp is None else comp)[head[moved]]
                pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
                yield record(EDGES, a=pair[:, 0], b=pair[:, 1])

        return run

    cols = [*keys, *(["comp", "own"] if blocks else []), "look", "node"]
    return map_batches(members.select(*cols).repartition(parts, *keys).sortWithinPartitions(*keys, "look", "node"), make, "a long, b long").distinct()


def _next_neighbours(crowded: DataFrame, look: Look) -> DataFrame:
    """Links of each item of crowded regions with the NEXT items behind it in its order; a task has a range of an order."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail: list[pa.RecordBatch] = []
            for b in batches:
                t = pa.Table.from_batches([*tail, b])
                key, node, seen = t.column("key").to_numpy(), t.column("node").to_numpy(), _looks(t, look.width)
                a, c = [], []
                joined = np.zeros(t.num_rows, dtype=np.int64)
                for step in range(1, min(NEXT + 1, t.num_rows)):
                    ok = (key[step:] == key[:-step]) & look.near(seen[step:], seen[:-step])
                    if step == 1:
                        joined = np.concatenate(([0], np.cumsum(~ok)))
                    else:
                        ok &= joined[step:] != joined[:-step]
                    at = np.flatnonzero(ok)
                    a.append(node[at])
                    c.append(node[at + step])
                if a:
                    x, y = np.concatenate(a), np.concatenate(c)
                    yield record(EDGES, a=np.minimum(x, y), b=np.maximum(x, y))
                tail = t.slice(max(0, t.num_rows - NEXT)).to_batches()

        return run

    return map_batches(crowded.sortWithinPartitions("key", "look", "node").select("key", "node", "look"), make, "a long, b long").distinct()


def _prefix(units: np.ndarray, key: np.ndarray, depth: int, order: int) -> np.ndarray:
    """Hashes of a region's key and ``depth`` units, chosen at random for each order."""
    places = np.random.default_rng([depth, order]).choice(units.shape[1], depth, replace=False)
    out = mix(key.astype(np.int64).view(np.uint64) + np.uint64(order * 1009 + depth))
    for p in places.tolist():
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + units[:, p].astype(np.uint64))
    return out.view(np.int64)


def _deepened(named: DataFrame, look: Look, most: int) -> DataFrame:
    """(key, node, comp, look) of the regions of longer prefixes. named: the same, of regions that are crowded.

    The prefix of a region grows until the region that an item finds itself in has at most ``most`` items on average.
    """

    def profile() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                key, units = t.column("key").to_numpy(), look.units(_looks(t, look.width))
                for d in look.depths:
                    yield record(_PROFILE, key=key, depth=np.full(len(key), d, dtype=np.int32), sub=_prefix(units, key, d, 0))

        return run

    met = map_batches(named.select("key", "look"), profile, "key long, depth int, sub long").groupBy("key", "depth", "sub").agg(F.count("*").alias("c"))
    small = F.sum(F.col("c") * F.col("c")) <= most * F.sum("c")
    depths = met.groupBy("key", "depth").agg(small.alias("small")).groupBy("key").agg(F.coalesce(F.min(F.when(F.col("small"), F.col("depth"))), F.lit(look.depths[-1])).alias("depth"))

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                told = t.column("depth").to_numpy()
                for d in np.unique(told).tolist():
                    part = t.filter(pa.array(told == d)).select(["key", "node", "comp", "look"]).combine_chunks()
                    key, units = part.column("key").to_numpy(), look.units(_looks(part, look.width))
                    rest = {c: part.column(c).combine_chunks() for c in ("node", "comp", "look")}
                    for order in range(look.orders(d)):
                        yield record(_KEYS, key=_prefix(units, key, d, order), **rest)

        return run

    return map_batches(named.join(depths, "key").select("key", "node", "comp", "look", "depth"), make, "key long, node long, comp long, look binary")


def _open(named: DataFrame) -> DataFrame:
    """named without the regions whose items are all joined."""
    return named.join(named.groupBy("key").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).filter("_l < _h").select("key"), "key", "left_semi")


def _blocks_compared(named: DataFrame, look: Look, size: int, parts: int) -> DataFrame:
    """Links that join whatever is alike in a region, each item outside its largest component compared with all others."""
    return _compared(left_over_blocks(named.withColumns({"weight": F.lit(1), "band": F.lit(0)}), size), parts, look, blocks=True)


def forest_links(items: DataFrame, scratch: Scratch, look: Look, step: int = 0, most: int = 512) -> DataFrame:
    """Links (a, b) that join whatever items share a region and look alike, at every size of a region.

    items: (node, keys array<long>, look binary). A key holds the number of its order and what its prefix begins with. In
    order t the look is turned by ``step`` * (t + 1) bytes.
    """
    spark = items.sparkSession
    keyed = items.select("node", F.posexplode("keys").alias("ord", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.table(keyed.join(sizes, "key").select("node", "key", "ord", "n").coalesce(spread(spark, items.count(), 1_000, 5_000)))
    turn = (F.col("ord") + 1) * step % look.width
    turned = F.concat(F.substring("look", turn + 1, F.lit(look.width)), F.substring("look", F.lit(1), turn)) if step else F.col("look")

    def seen(rows: DataFrame) -> DataFrame:
        return rows.join(items.select("node", "look"), "node").select("key", "node", "n", turned.alias("look"))

    usual, rows = shared.agg(F.count_if(F.col("n") <= most), F.count_if(F.col("n") > most)).first()
    first = scratch.table(_compared(seen(shared.filter(F.col("n") <= most)), spread(spark, usual), look, blocks=False).coalesce(spread(spark, usual)))
    if not rows:
        scratch.drop(shared)
        return first
    few = spread(spark, rows)
    crowded = scratch.table(seen(shared.filter(F.col("n") > most)).coalesce(few))
    scratch.drop(shared)
    near = scratch.table(_next_neighbours(crowded.repartitionByRange(few, "key", "look", "node"), look).coalesce(few))
    found = first.union(near)
    named = scratch.table(_open(crowded.join(connected_components(found, scratch, written=True), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), "look")).coalesce(few))
    scratch.drop(crowded)
    by = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg((F.sum("c") - F.max("c")).alias("left"))
    many = scratch.table(by.filter(F.col("left") > LEFT * most).select("key").coalesce(few))
    if not many.isEmpty():
        deep = scratch.table(_open(_deepened(named.join(many, "key", "left_semi"), look, most)))
        parts = spread(spark, deep.count())
        found = found.union(scratch.table(_blocks_compared(deep.select("key", "node", "comp", "look"), look, most, parts).coalesce(parts)))
        # longer prefixes miss some of the links; what they have joined need not meet again
        comps = connected_components(found, scratch, written=True).select(F.col("comp").alias("now"), F.col("node").alias("comp"))
        named = scratch.table(_open(named.join(comps, "comp", "left").select("key", "node", F.coalesce("now", "comp").alias("comp"), "look")).coalesce(few))
    parts = spread(spark, named.count())
    return found.union(scratch.table(_blocks_compared(named, look, WIDER * most, parts).coalesce(parts)))
