"""Language identification: averaged hashed subword embeddings with a linear softmax, SGD in numpy, calibrated rejection.

A text's letters are lower-cased, anything else becomes one blank, and its 2- to 4-grams that have no blank inside are
hashed to rows of an embedding table; their average goes through a linear softmax. As both steps are linear, the trained
tables are multiplied once, and a text costs one small row for each n-gram.

The model learns from a bounded sample of labelled rows (``rows`` at most, about the same number for each language, LEAST_ROWS
at least; of each text at most STRETCH characters) that hash values of doc_id choose; an eighth of it is set aside to fit a temperature, which calibrates the score, and two
floors for rejection: on the score, and on the share of n-grams that training has seen. Both floors lie where at most
``reject`` of the set-aside texts would fall below, so that texts in a learned language stay.

Defined results: null texts, empty ones and texts without a letter are ``und`` with score 0 and rejected; if there is nothing to
learn from, all rows are; a very long text is predicted as a whole, by one task; of languages that tie the first by name is
predicted; rows that repeat a doc_id are each predicted by their text; rows whose doc_id is null are predicted but not learned
from; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, map_batches, record, sliced, slices

ROWS = 4_000
#: Characters that are learned from of a text: a longer one gives a stretch of so many, at a place that a hash chooses.
STRETCH = 8_000
#: The most values of lang that are learned: what the driver collects and the model that tasks get are bounded by it.
LANGUAGES = 1_000
#: Rows of a language, however many languages there are.
LEAST_ROWS = 20
BUCKETS, DIMS = 1 << 16, 16
EPOCHS, RATE = 6, 4.0
REJECT = 0.001
UND = "und"
#: Bytes of text whose n-grams are held at a time; a longer text stands alone.
SLICE = 1 << 17

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter, else a blank; and whether it is a letter."""
    if not _tables:
        low = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                y = x.lower()
                low[c] = ord(y) if len(y) == 1 else c
        _tables.extend((low, low != 32))
    return _tables[0], _tables[1]


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, the text of each, letters in each text)."""
    low, letter = _letters()
    strs = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer(("\n".join(strs) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.repeat(np.arange(len(strs)), [len(s) + 1 for s in strs])
    count = np.bincount(row[letter[points]], minlength=len(strs))
    c = low[points]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep], row[keep]
    c = np.concatenate((np.array([32], dtype=np.uint32), c))  # each word stands between blanks
    row = np.concatenate((row[:1], row))
    inner = c != 32
    out, of = [], []
    h = c.astype(np.uint32) * np.uint32(0x9E3779B1)
    acc = h
    for n in (2, 3, 4):
        if len(c) < n:
            break
        acc = acc[:-1] * np.uint32(0x85EBCA6B) + h[n - 1 :]
        ok = row[n - 1 :] == row[: len(acc)] if n == 2 else None
        if n == 2:
            ok = inner[:-1] | inner[1:]
        else:
            ok = inner[1 : 1 + len(acc)].copy()
            for k in range(2, n - 1):
                ok &= inner[k : k + len(acc)]
        x = acc[ok] ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(16)
        out.append((x & np.uint32(BUCKETS - 1)).astype(np.int32))
        of.append(row[n - 1 :][ok])
    if not out:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), count
    return np.concatenate(out), np.concatenate(of), count


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x (labels + 1): each n-gram's part of the logits, and whether training saw it
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, share of n-grams seen in training, letters) of each text, SLICE bytes of text at a time."""
        parts = [self._logits(texts[i:j]) for i, j in slices(np.array([len(t) for t in texts], dtype=np.int64), SLICE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else self._logits([])

    def _logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, row, letters = ngrams(texts)
        order = np.argsort(row, kind="stable") if len(row) else row
        gram, row = gram[order], row[order]
        total = np.zeros((len(texts), self.table.shape[1]))
        names, first = np.unique(row, return_index=True)
        if len(names):
            total[names] = np.add.reduceat(self.table[gram], first, axis=0, dtype=np.float64)
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)[:, None]
        total /= n
        return total[:, :-1] + self.bias, total[:, -1], letters

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(label numbers, calibrated scores, rejected, whether a text has letters)."""
        z, seen, letters = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return best, score, (score < self.least_score) | (seen < self.least_seen) | (letters == 0), letters > 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], aside: np.ndarray, reject: float = REJECT, seed: int = 7) -> Model | None:
    """A model from labelled texts; those marked ``aside`` calibrate it."""
    labels = sorted(set(langs))
    if not labels:
        return None
    y = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    use, cal = np.flatnonzero(~aside), np.flatnonzero(aside)
    if not len(use):
        use = cal
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out, bias, seen = np.zeros((DIMS, len(labels)), dtype=np.float32), np.zeros(len(labels), dtype=np.float32), np.zeros(BUCKETS, dtype=bool)

    samples: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in use.tolist():
        s = texts[i].decode("utf-8", "replace")
        cuts = [s]
        if len(s) > 80:  # short texts are learned from pieces of longer ones
            for n in (24, 60):
                at = int(rng.integers(0, len(s) - n))
                cuts.append(s[at : at + n])
        gram, row, _ = ngrams([c.encode("utf-8", "replace") for c in cuts])
        for k in range(len(cuts)):
            ids, n = np.unique(gram[row == k], return_counts=True)
            if len(ids):
                samples.append((ids, (n / n.sum()).astype(np.float32), int(y[i])))
                seen[ids] = True
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)).tolist():
            ids, share, label = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ emb[ids]
            p = _softmax((x @ out + bias)[None])[0]
            p[label] -= 1
            back = out @ p
            out -= rate * 0.25 * np.outer(x, p)
            bias -= rate * 0.01 * p
            emb[ids] -= rate * np.outer(share, back)
    model = Model(labels, np.concatenate((emb @ out, seen[:, None].astype(np.float32)), axis=1), bias.astype(np.float64))
    check = cal if len(cal) else use
    z, part, letters = model.logits([texts[i] for i in check])
    true, z, part = y[check][letters > 0], z[letters > 0], part[letters > 0]
    if len(true):
        grid = np.geomspace(0.02, 20, 120)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(true)), true], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == true
        if right.any():
            model.least_score = min(0.5, float(np.quantile(p.max(axis=1)[right], reject)))
            model.least_seen = 0.8 * float(np.quantile(part[right], reject))
    return model


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn_share(n: Column, each: int) -> Column:
    """The share of n hash values that holds the ``each`` smallest ones, with room to spare; the rest need not be sorted."""
    return F.lit(4.0 * each + 100) / n


def learn(documents: DataFrame, rows: int = ROWS) -> Model | None:
    """Train on the labelled documents that are not held out: of each language the same number, by smallest hash of the id.

    That number is a share of ``rows``, but LEAST_ROWS at least, so that every language is learned; of more than LANGUAGES values
    those with most rows are. The texts are read twice: to count, and to take the sample.
    """
    known = documents.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    scratch = Scratch(documents.sparkSession)
    counts = scratch.table(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    languages = counts.count()
    if not languages:
        scratch.keep()
        return None
    each = max(math.ceil(rows / languages), LEAST_ROWS)
    draw = F.xxhash64(F.col("doc_id"), F.lit("learn"))
    some = known.join(F.broadcast(counts), "lang").filter(draw.cast("double") / 2.0**64 + 0.5 <= drawn_share(F.col("n"), each))
    part = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", "text"))).filter(F.col("rank") <= each)
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("stretch")), F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
    got = part.orderBy(draw, "text", "lang").select(F.substring("text", at, F.lit(STRETCH)).alias("text"), "lang", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("aside")), F.lit(8)) == 0).alias("aside")).collect()
    scratch.keep()
    return train([r["text"].encode("utf-8", "replace") for r in got], [r["lang"] for r in got], np.array([r["aside"] for r in got], dtype=bool))


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score, rejected; only the text decides."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the languages

    def make() -> Callable:
        m = shared.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                lang, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                if m is not None:
                    best, p, no, some = m.predict(texts)
                    lang = [m.labels[k] if s else UND for k, s in zip(best.tolist(), some.tolist(), strict=True)]
                    score, rejected = np.where(some, np.clip(p, 0, 1), 0.0), no
                yield record(_OUT, doc_id=part.column("doc_id"), held_out=part.column("held_out"), lang_pred=lang, score=score, rejected=rejected)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def drop_rejected(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents without the rows that the model rejects; with no model, only without those that have no letter."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m = shared.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                no = m.predict(texts)[2] if m is not None else ngrams(texts)[2] == 0
                yield part.filter(pa.array(~no))

        return run

    return map_batches(documents, make, documents.schema)
