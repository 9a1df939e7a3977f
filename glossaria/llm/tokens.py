"""Public tokenizers, and token counts that are kept up to date under edits.

Counts: a document's text is cut into pre-tokens, and the token count and length of each, some to a leaf, are summed by a segment
tree. Edits replace ranges of the text, one after the other; what they change together is cut anew, from CONTEXT pre-tokens
before each change (the pattern looks at most two characters beyond a run of one class) until a new boundary meets an old one
behind it, from where on all is as before, because each match depends only on what follows. Sums on the paths to the touched
leaves are updated; no other part of the text is encoded again. Many edits cost one sweep: the text is joined once, and an
edit at any place of a text with many edits moves one block of its pieces. token_trees() and edited_trees() keep the trees as a
table from one edit to the next.

Defined results: null and empty texts have 0 tokens; a very long text takes time in proportion to its length, but for single
pre-tokens of very many characters, which take the encoder's; rows that repeat a doc_id are counted each by their text; edits that
touch the same place apply in the order of seq; other columns are ignored, and an empty table gives an empty result. The
name of a special token in a text is ordinary text, since an edit may make or break it.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import map_batches, record, sliced

BPE = "byte_bpe_50k.json"
#: Distinct pre-tokens whose counts a worker keeps, and the length up to which it keeps one.
CACHE, KEPT_LENGTH = 400_000, 64
#: Pre-tokens to a leaf of a tree, and those before a change that are cut anew.
LEAF = 16
CONTEXT = 8


@functools.lru_cache(maxsize=2)
def encoding(name: str = BPE):  # noqa: ANN201
    """A tiktoken encoding with the vocabulary of a byte-level BPE file of the tokenizers library; its ids are that file's."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        told = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def tokenizer(name: str = BPE):  # noqa: ANN201
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.lru_cache(maxsize=2)
def _specials(name: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(name).get_added_tokens_decoder().values())


def token_ids(text: str, name: str = BPE) -> list[int]:
    """The ids that tokenizers gives with add_special_tokens=False; texts that name a special token go to that library itself."""
    if any(s in text for s in _specials(name)):
        return tokenizer(name).encode(text, add_special_tokens=False).ids
    return encoding(name).encode_ordinary(text)


class Counts(dict):
    """Token counts of pre-tokens, computed when first asked for; emptied when it has grown to CACHE entries."""

    def __init__(self, name: str = BPE) -> None:
        super().__init__()
        self.enc = encoding(name)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.enc._encode_single_piece(piece))  # noqa: SLF001
        if len(piece) <= KEPT_LENGTH:
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def counts(name: str = BPE) -> Counts:
    return Counts(name)


@functools.lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Edit(NamedTuple):
    """Replace text[start:stop]; places are code points of the text as it is when the edit is made."""

    start: int
    stop: int
    text: str


Change = tuple[int, int, int, int]


class _Pieces:
    """A text under edits, as pieces of the first text and new texts, in blocks; an edit moves one block's pieces only."""

    def __init__(self, n: int) -> None:
        self.blocks: list[list[tuple[int, int, str | None]]] = [[(0, n, None)] if n else []]
        self.sizes, self.length = [n], n

    def _split(self, at: int) -> tuple[int, int]:
        """(block, piece) that begins at a place, after cutting the piece that holds it."""
        k = 0
        while k + 1 < len(self.sizes) and at >= self.sizes[k]:
            at -= self.sizes[k]
            k += 1
        block = self.blocks[k]
        for i, (a, b, text) in enumerate(block):
            if at == 0:
                return k, i
            if at < b - a:
                block[i : i + 1] = [(a, a + at, text), (a + at, b, text)]
                return k, i + 1
            at -= b - a
        return k, len(block)

    def replace(self, e: Edit) -> None:
        start = min(max(0, e.start), self.length)
        stop = min(max(start, e.stop), self.length)
        self._split(start)
        k2, i2 = self._split(stop)
        k1, i1 = self._split(start)
        new = [(0, len(e.text), e.text)] if e.text else []
        if k1 == k2:
            self.blocks[k1][i1:i2] = new
        else:
            self.blocks[k1][i1:] = new
            del self.blocks[k2][:i2]
            del self.blocks[k1 + 1 : k2]
            del self.sizes[k1 + 1 : k2]
            self.sizes[k1 + 1] = sum(b - a for a, b, _ in self.blocks[k1 + 1])
        block = self.blocks[k1]
        if len(block) > 256:
            self.blocks[k1 : k1 + 1] = [block[:128], block[128:]]
            self.sizes[k1 : k1 + 1] = [sum(b - a for a, b, _ in x) for x in (block[:128], block[128:])]
        else:
            self.sizes[k1] = sum(b - a for a, b, _ in block)
        self.length += len(e.text) - (stop - start)

    def changes(self, old: str) -> tuple[str, list[Change]]:
        """The text, and what has changed: (start, stop) in the first text and in this one."""
        parts: list[str] = []
        out: list[Change] = []
        at, place, opened = 0, 0, 0  # in the first text, in the new one, and where in that the open change began
        for a, b, text in (p for block in self.blocks for p in block):
            if text is None:
                if a > at or place > opened:
                    out.append((at, a, opened, place))
                parts.append(old[a:b])
                at = b
                place += b - a
                opened = place
            else:
                parts.append(text[a:b])
                place += b - a
        if at < len(old) or place > opened:
            out.append((at, len(old), opened, place))
        return "".join(parts), out


def changed(old: str, todo: Sequence[Edit]) -> tuple[str, list[Change]]:
    """The text after edits, each made in the text that the one before has left, and all that changed. Edits that come last
    place first need no search."""
    n = len(old)
    ordered = [(min(max(0, e.start), n), min(max(e.start, e.stop, 0), n), e.text) for e in todo]
    if all(max(e.start, e.stop) <= before[0] for e, before in zip(todo[1:], ordered, strict=False)):
        parts, out, at, place = [], [], 0, 0
        for start, stop, text in reversed(ordered):
            parts += [old[at:start], text]
            place += start - at
            out.append((start, stop, place, place + len(text)))
            at, place = stop, place + len(text)
        return "".join([*parts, old[at:]]), out
    pieces = _Pieces(n)
    for e in todo:
        pieces.replace(e)
    return pieces.changes(old)


class TokenTree:
    """A text's pre-tokens, with a segment tree of sums (tokens, characters) over leaves of some LEAF of them."""

    def __init__(self, text: str, known: Counts, leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """leaves: of pre_tokens(), if the tree was built before; nothing is encoded then."""
        self.text, self.known, self.encoded = text, known, 0
        if leaves is None:
            pieces = _pattern().findall(text)
            leaves = np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces)), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self._lay(*leaves)

    def _lay(self, tokens: np.ndarray, chars: np.ndarray) -> None:
        """Leaves of LEAF pre-tokens, and all sums."""
        self.tokens, self.chars = tokens, chars
        n = max(1, -(-len(tokens) // LEAF))
        self.cuts = np.minimum(np.arange(n + 1) * LEAF, len(tokens))
        self.base = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), dtype=np.int64)
        self._sum(np.arange(n))

    def _sum(self, leaves: np.ndarray) -> None:
        """Sums of some leaves, and of the nodes on the paths from these to the root."""
        first, last = self.cuts[leaves], self.cuts[leaves + 1]
        if len(leaves) > 64:
            for k, x in enumerate((self.tokens, self.chars)):
                upto = np.concatenate([[0], np.cumsum(x)])
                self.sums[self.base + leaves, k] = upto[last] - upto[first]
        else:
            for leaf, i, j in zip(leaves.tolist(), first.tolist(), last.tolist(), strict=True):
                self.sums[self.base + leaf] = self.tokens[i:j].sum(), self.chars[i:j].sum()
        nodes = np.unique((leaves + self.base) // 2)
        while len(nodes) and nodes[-1] >= 1:
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
            nodes = np.unique(nodes // 2)
            nodes = nodes[nodes >= 1]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_pretokens(self) -> int:
        return len(self.tokens)

    def pre_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and characters of each pre-token."""
        return self.tokens, self.chars

    def edit(self, e: Edit) -> None:
        self.edits([e])

    def edits(self, todo: Sequence[Edit]) -> None:
        """Make edits one after the other; pre-tokens are cut anew once, where the text has changed by all of them together."""
        text, changes = changed(self.text, todo)
        changes = [c for c in changes if c[0] != c[1] or c[2] != c[3]]
        if not changes:
            return
        regions = self._recut(text, changes)
        self.text = text
        self._splice(regions)

    def _recut(self, text: str, changes: list[Change]) -> list[tuple[int, int, list[int], list[int]]]:
        """(first, last, tokens, characters): what stands for the old pre-tokens first to last - 1, for each region, ascending."""
        ends = np.cumsum(self.chars).tolist()
        match, known, n = _pattern().match, self.known, len(text)
        regions, done, k = [], 0, 0
        while k < len(changes):
            o1, _, n1, _ = changes[k]
            first = max(done, bisect_right(ends, max(o1 - 1, 0)) - CONTEXT)
            place = (ends[first - 1] if first else 0) + n1 - o1
            tokens, chars, last = [], [], first
            while True:
                while k + 1 < len(changes) and place >= changes[k + 1][2]:  # the next change is reached: one region
                    k += 1
                _, o2, _, n2 = changes[k]
                if place >= n2:
                    old = place - n2 + o2
                    last = max(last, bisect_left(ends, old, last) + 1 if old else 0)
                    if old == 0 or last <= len(ends) and ends[last - 1] == old:  # an old boundary: from here all is as before
                        break
                    last = max(first, last - 1)
                if place >= n:
                    last = len(ends)
                    break
                m = match(text, place)
                tokens.append(known[m[0]])
                chars.append(len(m[0]))
                place = m.end()
            self.encoded += len(tokens)
            regions.append((first, last, tokens, chars))
            done = last
            k += 1
        return regions

    def _splice(self, regions: list[tuple[int, int, list[int], list[int]]]) -> None:
        """Put regions in place of what they stand for; leaves keep their bounds elsewhere, and only touched ones are summed anew."""
        first, last = (np.array([r[k] for r in regions], dtype=np.int64) for k in (0, 1))
        size = np.array([len(r[2]) for r in regions], dtype=np.int64)
        shift = np.concatenate([[0], np.cumsum(size - (last - first))])
        parts_t, parts_c, at = [], [], 0
        for i, j, t, c in regions:
            parts_t += [self.tokens[at:i], np.array(t, dtype=np.int64)]
            parts_c += [self.chars[at:i], np.array(c, dtype=np.int64)]
            at = j
        tokens, chars = np.concatenate([*parts_t, self.tokens[at:]]), np.concatenate([*parts_c, self.chars[at:]])
        cuts, leaves = self.cuts, len(self.cuts) - 1
        r = np.searchsorted(last, cuts, side="left")
        inside = np.minimum(r, len(regions) - 1)
        within = (r < len(regions)) & (first[inside] < cuts)
        new = np.where(within, first[inside] + shift[inside] + size[inside], cuts + shift[r])
        new[-1] = len(tokens)
        if int(np.diff(new).max()) > 4 * LEAF:  # an outgrown leaf: deal the leaves anew, without encoding
            self._lay(tokens, chars)
            return
        a = np.minimum(np.searchsorted(cuts, first, side="right") - 1, leaves - 1)
        b = np.minimum(np.searchsorted(cuts, last, side="left"), leaves - 1)
        self.tokens, self.chars, self.cuts = tokens, chars, new
        step = np.zeros(leaves + 1, dtype=np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, np.maximum(a, b) + 1, -1)
        self._sum(np.flatnonzero(np.cumsum(step[:leaves]) > 0))


#: Personal data that the counting query masks: mail addresses, IPv4 addresses, runs of 13 to 19 digits. A run is tried from its
#: first character only and never given back, so that the time is linear in the text.
MASK = regex.compile(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])|(?<![0-9])[0-9]{13,19}(?![0-9])")


def mask_edits(text: str) -> list[Edit]:
    """Edits that replace personal data by [PII], last first, so that each place holds when its turn comes."""
    return [Edit(m.start(), m.end(), "[PII]") for m in MASK.finditer(text)][::-1]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_reencoded", pa.int64()), ("n_tokens_edited", pa.int64())])
_SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_edited long"


def _counted(texts: Sequence[bytes], edits: Callable[[int, str], Sequence[Edit]], name: str) -> dict[str, list[int]]:
    known = counts(name)
    out: dict[str, list[int]] = {f.name: [] for f in _OUT if f.name != "doc_id"}
    for i, t in enumerate(texts):
        tree = TokenTree(t.decode("utf-8", "replace"), known)
        row = [tree.n_pretokens, tree.n_tokens]
        todo = edits(i, tree.text)
        tree.edits(todo)
        for k, v in zip(out, [*row, len(todo), tree.encoded, tree.n_tokens], strict=True):
            out[k].append(v)
    return out


def token_counts(documents: DataFrame, edits: Callable[[str], list[Edit]] = mask_edits, name: str = BPE) -> DataFrame:
    """One row for each row of documents: its pre-tokens and tokens, and its tokens after the edits a rule makes in its text."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                yield record(_OUT, doc_id=part.column("doc_id"), **_counted(texts, lambda _, t: edits(t), name))

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _SCHEMA)


def recount(documents: DataFrame, edits: DataFrame, name: str = BPE) -> DataFrame:
    """As token_counts(), with edits (doc_id, seq, start, stop, text) from a table, made in the order of seq."""
    rows = documents.select("doc_id", "text").join(_listed(edits), "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                todo = [[Edit(e["start"], e["stop"], e["new"] or "") for e in x or []] for x in part.column("edits").to_pylist()]
                yield record(_OUT, doc_id=part.column("doc_id"), **_counted(texts, lambda i, _, todo=todo: todo[i], name))

        return run

    return map_batches(rows, make, _SCHEMA)


_TREES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("tokens", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_reencoded", pa.int64())])
_TREES_DDL = "doc_id long, text string, tokens array<int>, chars array<int>, n_tokens long, n_reencoded long"


def token_trees(documents: DataFrame, name: str = BPE) -> DataFrame:
    """A table of trees to keep: doc_id, text, tokens and chars of each pre-token, n_tokens, n_reencoded (0)."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                yield _kept(part.column("doc_id"), [TokenTree(t.decode("utf-8", "replace"), counts(name)) for t in texts])

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _TREES_DDL)


def edited_trees(trees: DataFrame, edits: DataFrame, name: str = BPE) -> DataFrame:
    """The table after edits (doc_id, seq, start, stop, text), made in the order of seq; what they don't touch isn't encoded."""
    rows = trees.join(_listed(edits), "doc_id", "left").select("doc_id", "text", "tokens", "chars", "edits")

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                out = []
                for t, a, b, todo in zip(texts, *(part.column(c).to_pylist() for c in ("tokens", "chars", "edits")), strict=True):
                    out.append(TokenTree(t.decode("utf-8", "replace"), counts(name), (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))))
                    out[-1].edits([Edit(e["start"], e["stop"], e["new"] or "") for e in todo or []])
                yield _kept(part.column("doc_id"), out)

        return run

    return map_batches(rows, make, _TREES_DDL)


def _listed(edits: DataFrame) -> DataFrame:
    return edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", F.col("text").alias("new")))).alias("edits"))


def _kept(ids: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    both = [t.pre_tokens() for t in trees]
    return record(_TREES, doc_id=ids, text=[t.text for t in trees], tokens=[a for a, _ in both], chars=[b for _, b in both], n_tokens=[t.n_tokens for t in trees], n_reencoded=[t.encoded for t in trees])
