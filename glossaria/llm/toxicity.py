"""Toxicity by a weighted finite-state grammar of clauses.

A text is cut into clauses, and a lexicon reads each word as a symbol: insult, threat, intent, target (the person spoken to),
negation, report (verbs of speech), quote, or other. Small transducers rewrite the symbols of a clause: reported speech and
negation mark the insults and threats that they cover, the target transducer marks insults that are aimed at someone, before or
behind them, and the threat transducer tells threats that are intended or aimed from bare verbs. They are composed into one table
of states. What it emits, with the weights of the words, is scored by clause; a text's score is a logistic function of its clauses.

The words of the grammar are given; insults are also learned, as whole words or beginnings of words: those that stand in
toxic texts far more often than in others, by a test that allows for the number of patterns tried, each toxic text being
covered a few times at most. How much a targeted, negated, reported or plain match means is learned too, with given values as
prior. Learned from a bounded sample (ROWS and BYTES of each class, by hash of the id) of labelled rows that are not held out.

Defined results: null and empty texts have no clause and get the score of no match; a null doc_id is not held out and not
learned from; where a doc_id has several labels, any toxic one counts; rows that repeat a doc_id are scored each; other columns
are ignored; an empty table gives an empty result. Without labelled rows of both classes, the given words and weights are used.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import bounded_broadcast, map_batches, sliced
from glossaria.llm.langid import held_out

#: The most rows of each class that are learned from, and the most bytes of their texts.
ROWS = {1: 1_200, 0: 3_000}
BYTES = 40 << 20
THRESHOLD = 0.3
#: Beginnings of words that may be learned as a pattern, in characters.
STEM = range(3, 13)
#: How often a toxic text is covered by patterns before it asks for no more, and the least weight of a pattern.
COVER, LEAST_WEIGHT = 4, 3.0
GIVEN_WEIGHT = 4.0
CACHE = 300_000

WORDS = {
    "insult": "idiot idiots moron morons imbecile stupid scum trash loser losers pathetic worthless disgusting clown dumbass bastard bitch asshole idiotin trottel dummkopf arschloch abschaum versager hurensohn connard connasse salaud abruti crétin ordure imbécile imbécil estúpido estúpida idiota gilipollas cabrón escoria".split(),
    "threat": "kill murder hurt beat shoot stab destroy strangle töten umbringen verletzen schlagen erschießen tuer frapper massacrer étrangler matar golpear apuñalar destruir".split(),
    "intent": "will shall gonna going i'll we'll werde werden wollen vais allons voy vamos".split(),
    "target": "you your yours you're yourself u du dich dir dein deine euch ihr sie tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split(),
    "negation": "not never no isn't aren't don't doesn't wasn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco".split(),
    "report": "said says say told called calls claimed wrote quoted allegedly sagte sagt nannte behauptete schrieb dit disait appelé écrit dijo dice llamó escribió".split(),
}
KINDS = ["other", "insult", "threat", "intent", "target", "negation", "report", "quote"]
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|[\"“”«»„]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = frozenset(".!?;:\n")

Symbol = tuple[str, frozenset]
NONE: frozenset = frozenset()
HITS = ("insult", "threat")


@dataclass(frozen=True)
class Transducer:
    """A start state, and a step (state, symbol) -> (state, symbol); symbols are a kind with marks."""

    start: object
    step: Callable[[object, Symbol], tuple[object, Symbol]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def _marked(symbol: Symbol, mark: str) -> Symbol:
    return symbol[0], symbol[1] | {mark}


def reported() -> Transducer:
    """Marks hits behind a verb of speech, and between quotes."""

    def step(state: tuple[bool, bool], symbol: Symbol) -> tuple[tuple[bool, bool], Symbol]:
        said, quoted = state
        if symbol[0] == "report":
            return (True, quoted), symbol
        if symbol[0] == "quote":
            return (said, not quoted), symbol
        return state, _marked(symbol, "reported") if symbol[0] in HITS and (said or quoted) else symbol

    return Transducer((False, False), step)


def negation(reach: int = 3) -> Transducer:
    """Marks hits within so many words behind a negation."""

    def step(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        if symbol[0] == "negation":
            return reach, symbol
        return max(0, left - 1), _marked(symbol, "negated") if symbol[0] in HITS and left else symbol

    return Transducer(0, step)


def target(before: int = 3, behind: int = 2) -> Transducer:
    """Marks insults behind a target; a target behind an insult is marked as aiming it."""

    def step(state: tuple[int, int], symbol: Symbol) -> tuple[tuple[int, int], Symbol]:
        aimed, open_ = state
        if symbol[0] == "target":
            return (before, 0), _marked(symbol, "aims insult") if open_ else symbol
        if symbol[0] == "insult":
            return (max(0, aimed - 1), behind), _marked(symbol, "targeted") if aimed else symbol
        return (max(0, aimed - 1), max(0, open_ - 1)), symbol

    return Transducer((0, 0), step)


def threat(before: int = 3, behind: int = 2) -> Transducer:
    """Marks threats behind an intent; a target behind a threat is marked as aiming it."""

    def step(state: tuple[int, int], symbol: Symbol) -> tuple[tuple[int, int], Symbol]:
        meant, open_ = state
        if symbol[0] == "intent":
            return (before, max(0, open_ - 1)), symbol
        if symbol[0] == "threat":
            return (max(0, meant - 1), behind if "negated" not in symbol[1] and "reported" not in symbol[1] else 0), _marked(symbol, "intended") if meant else symbol
        if symbol[0] == "target" and open_:
            return (max(0, meant - 1), 0), _marked(symbol, "aims threat")
        return (max(0, meant - 1), max(0, open_ - 1)), symbol

    return Transducer((0, 0), step)


@dataclass
class Grammar:
    """The composition as a table: moves[state][kind] is (next state, number of the output); outputs[0] means nothing."""

    moves: list[list[tuple[int, int]]]
    outputs: list[Symbol]


def compiled() -> Grammar:
    machine = reported().then(negation()).then(target()).then(threat())
    number, todo, moves, outputs = {machine.start: 0}, [machine.start], [], [("other", NONE)]
    of = {outputs[0]: 0}
    while len(moves) < len(todo):
        state, row = todo[len(moves)], []
        for kind in KINDS:
            to, out = machine.step(state, (kind, NONE))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            if out[0] not in HITS and not out[1]:
                out = outputs[0]
            if out not in of:
                of[out] = len(outputs)
                outputs.append(out)
            row.append((number[to], of[out]))
        moves.append(row)
    return Grammar(moves, outputs)


#: What is learned about a text, and the prior of each weight; strengths are weights of words over 4.
FEATURES = {"plain": 2.0, "clauses": 1.0, "targeted": 0.5, "negated": 0.3, "reported": 0.3, "threats": 1.5, "weak_threats": 0.2}
BIAS = -3.5


@dataclass
class Model:
    """Patterns of insults with weights (whole words, beginnings by length), the grammar, and the weights of the features."""

    whole: dict[str, float] = field(default_factory=lambda: dict.fromkeys(WORDS["insult"], GIVEN_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([BIAS, *FEATURES.values()]))
    grammar: Grammar = field(default_factory=compiled)

    def __post_init__(self) -> None:
        self.kind = {w: k for k, name in enumerate(KINDS) for w in WORDS.get(name, ()) if name != "insult"}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.cache: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """(kind, weight) of a lower-cased word; the strongest pattern that fits an insult counts."""
        if (known := self.cache.get(word)) is not None:
            return known
        best = max([self.whole.get(word, 0.0), *[self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)]])
        got = (1, best) if best > 0 else (self.kind.get(word, 0), 0.0)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = got
        return got

    def clauses(self, text: str) -> Iterator[tuple[int, int, dict[str, float]]]:
        """Of each clause with a match: start, end, and what matched: strengths by kind, numbers of threats and weak threats."""
        low = text.lower()
        if len(low) != len(text):  # places are those of the text
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        symbol = self.symbol
        if not any(symbol(w)[0] in (1, 2) for w in set(_WORD.findall(low))):
            return
        moves, outputs = self.grammar.moves, self.grammar.outputs
        state, first, last, found, strength = 0, -1, 0, {}, 0.0
        for m in _TOKEN.finditer(low):
            token = m.group()
            if token in _ENDS:
                if found:
                    yield first, last, found
                state, first, found = 0, -1, {}
                continue
            kind, weight = symbol(token) if token[0].isalpha() else (7, 0.0)
            state, out = moves[state][kind]
            first, last = (m.start() if first < 0 else first), m.end()
            if out:
                strength = weight or strength
                self._take(found, outputs[out], strength)
        if found:
            yield first, last, found

    @staticmethod
    def _take(found: dict[str, float], symbol: Symbol, strength: float) -> None:
        kind, marks = symbol
        if kind == "insult":
            name = "negated" if "negated" in marks else "reported" if "reported" in marks else "plain"
            found[name] = max(found.get(name, 0.0), strength / 4)
            if name == "plain" and "targeted" in marks:
                found["targeted"] = max(found.get("targeted", 0.0), strength / 4)
        elif kind == "threat":
            name = "threats" if "intended" in marks and not marks & {"negated", "reported"} else "weak_threats"
            found[name] = found.get(name, 0.0) + 1
        else:
            if "aims insult" in marks and "plain" in found:
                found["targeted"] = max(found.get("targeted", 0.0), found["plain"])
            if "aims threat" in marks and found.get("weak_threats"):
                found["weak_threats"] -= 1
                found["threats"] = found.get("threats", 0.0) + 1

    def features(self, text: str) -> tuple[np.ndarray, int]:
        """Features of a text, the bias first, and the number of its matched clauses."""
        top, plain, n = dict.fromkeys(FEATURES, 0.0), 0, 0
        for _, _, found in self.clauses(text):
            n += 1
            plain += "plain" in found
            for k, v in found.items():
                top[k] = top[k] + v if k.endswith("threats") else max(top[k], v)
        top["clauses"] = math.log1p(plain)
        for k in ("threats", "weak_threats"):
            top[k] = math.log1p(top[k])
        return np.array([1.0, *top.values()]), n

    def score(self, text: str) -> tuple[float, int]:
        x, n = self.features(text)
        return 1 / (1 + math.exp(-min(max(float(x @ self.weights), -40.0), 40.0))), n

    def clause_weight(self, found: dict[str, float]) -> float:
        """The weight of one clause by itself."""
        x = dict.fromkeys(FEATURES, 0.0) | found | {"clauses": math.log1p("plain" in found)}
        return float(np.array([1.0, *[x[k] for k in FEATURES]]) @ self.weights)


def _pattern_counts(words: list[list[str]], toxic: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Patterns (a whole word ends with a blank) that stand in three toxic texts or more: how many toxic and other texts have
    each, and which toxic ones."""
    number: dict[str, int] = {}
    vocabulary = [np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
    doc = np.repeat(np.arange(len(words)), [len(v) for v in vocabulary])
    word = np.concatenate(vocabulary) if vocabulary else np.zeros(0, dtype=np.int64)
    names, some, others, where = [], [], [], []
    for n in [0, *STEM]:
        stems: dict[str, int] = {}
        of = np.array([stems.setdefault(w[:n] if n else w + " ", len(stems)) if not n or len(w) >= n else -1 for w in number], dtype=np.int64)
        mine = of[word] if len(word) else word
        pair = np.unique(mine[mine >= 0] * len(words) + doc[mine >= 0])
        stem, d = pair // len(words), pair % len(words)
        a = np.bincount(stem[toxic[d]], minlength=len(stems))
        b = np.bincount(stem[~toxic[d]], minlength=len(stems))
        keep = np.flatnonzero(a >= 3)
        stem, d = stem[toxic[d]], d[toxic[d]]
        bounds = np.searchsorted(stem, np.stack([keep, keep + 1]))
        text = list(stems)
        for k, i, j in zip(keep.tolist(), *bounds.tolist(), strict=True):
            names.append(text[k])
            where.append(d[i:j])
        some += a[keep].tolist()
        others += b[keep].tolist()
    return names, np.array(some, dtype=float), np.array(others, dtype=float), where


def learn_patterns(words: list[list[str]], toxic: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """(whole words, beginnings) with weights, from the distinct words of each text. Given insults keep half a text of prior."""
    positives, negatives = int(toxic.sum()), int((~toxic).sum())
    whole = dict.fromkeys(WORDS["insult"], GIVEN_WEIGHT)
    stems: dict[str, float] = {}
    if not positives or not negatives:
        return whole, stems
    names, a, b, where = _pattern_counts(words, toxic)
    odds = lambda x, y: math.log((x + 0.5) / (positives + 1)) - math.log((y + 0.5) / (negatives + 1))
    seen_by_chance = {w: 0 for w in whole}
    for ws, bad in zip(words, toxic.tolist(), strict=True):
        if not bad:
            for w in seen_by_chance.keys() & set(ws):
                seen_by_chance[w] += 1
    at = {n: k for k, n in enumerate(names)}
    for w, clean in seen_by_chance.items():
        k = at.get(w + " ")
        if k is not None or clean:
            whole[w] = max(0.0, odds((a[k] if k is not None else 0) + 1, clean))
    base = positives / (positives + negatives)
    rate = np.clip(a / np.maximum(a + b, 1), 1e-9, 1 - 1e-9)
    surprise = (a + b) * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    weight = np.array([odds(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    fit = np.flatnonzero((rate > base) & (surprise >= math.log(len(names) + 1) + 3) & (weight >= LEAST_WEIGHT))
    longer: dict[str, list[int]] = {}
    for k in fit.tolist():
        for n in range(STEM.start, len(names[k])):
            longer.setdefault(names[k][:n], []).append(k)
    covered, taken = np.zeros(len(toxic), dtype=np.int64), []
    # of patterns that cover as much, those with fewer other texts, then the longest
    heap = [(-int(a[k]), int(b[k]), -len(names[k]), names[k], k) for k in fit.tolist()]
    heapq.heapify(heap)
    least = max(3, int(np.min(a[fit])) if len(fit) else 3)
    while heap:
        gain, other, size, name, k = heapq.heappop(heap)
        now = int((covered[where[k]] < COVER).sum())
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, other, size, name, k))
            continue
        if any(t.startswith(name) or name.startswith(t) for t in taken):
            continue
        if near := [j for j in longer.get(name, ()) if a[j] >= 0.9 * a[k]]:  # "worthless" says as much as "wor", of fewer words
            k = max(near, key=lambda j: len(names[j]))
            name = names[k]
        taken.append(name)
        covered[where[k]] += 1
        if name.endswith(" "):
            whole[name[:-1]] = float(weight[k])
        else:
            stems[name] = float(weight[k])
    return {w: v for w, v in whole.items() if v > 0}, stems


def fitted(x: np.ndarray, toxic: np.ndarray, per_row: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of the logistic function by Newton's method, drawn to the prior."""
    prior = np.array([BIAS, *FEATURES.values()])
    w, pull = prior.copy(), np.full(len(prior), ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (per_row * (p - toxic)) + pull * (w - prior)
        step = np.linalg.solve((x * (per_row * p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str], toxic: np.ndarray, per_row: np.ndarray | None = None) -> Model:
    """Patterns from all texts; the weights of features from texts that the patterns used for them were not learned from."""
    if not toxic.any() or toxic.all():
        return Model()
    words = [sorted(set(_WORD.findall(t.lower()))) for t in texts]
    per_row = np.ones(len(texts)) if per_row is None else per_row * len(texts) / per_row.sum()
    half = np.random.default_rng(0).permutation(len(texts)) % 2 == 0
    parts = [(half, ~half), (~half, half)] if min(toxic.sum(), (~toxic).sum()) >= 20 else [(half | True, half | True)]
    x = np.zeros((len(texts), len(FEATURES) + 1))
    for learn, use in parts:
        model = Model(*learn_patterns([w for w, k in zip(words, learn.tolist(), strict=True) if k], toxic[learn]))
        for i in np.flatnonzero(use).tolist():
            x[i] = model.features(texts[i])[0]
    return Model(*learn_patterns(words, toxic), weights=fitted(x, toxic.astype(float), per_row))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that are not held out: of each class the ROWS with the smallest hashes, BYTES of text at most
    (rows beyond are not in the sample)."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return Model()
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    share = F.when(F.col("toxic") == 1, (4.0 * ROWS[1] + 100) / n[1]).otherwise((4.0 * ROWS[0] + 100) / n[0])
    some = told.filter(draw.cast("double") / 2.0**64 + 0.5 <= share)
    rank = Window.partitionBy("toxic").orderBy(draw, "doc_id")
    bound = F.when(F.col("toxic") == 1, ROWS[1]).otherwise(ROWS[0])
    some = some.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= bound)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(bounded_broadcast(some.select("doc_id", "toxic")), "doc_id")
    size = Window.partitionBy("toxic").orderBy(draw, "doc_id", "text")
    rows = rows.withColumn("rank", F.row_number().over(size)).filter(F.col("rank") <= bound).withColumn("upto", F.sum(F.octet_length("text")).over(size)).filter(F.col("upto") <= BYTES)
    got = rows.select("toxic", "text", F.xxhash64("text").alias("h"), draw.alias("draw")).orderBy("draw", "text").collect()
    once = list({r["h"]: r for r in got}.values())  # copies would count as evidence of their own
    toxic = np.array([r["toxic"] == 1 for r in once], dtype=bool)
    per_row = np.where(toxic, n[1] / max(1, toxic.sum()), n[0] / max(1, (~toxic).sum()))
    return train([r["text"] for r in once], toxic, per_row)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64())])


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted, and the number of matched clauses."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred patterns: COVER for each text of the sample at most

    def make() -> Callable:
        m = shared.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                got = [m.score(t.decode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int64())], schema=_OUT)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")


def matched_clauses(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each matched clause: doc_id, start and end (code points), the clause, its weight, and what matched."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("clause", pa.string()), ("weight", pa.float64()), ("matched", pa.string())])

    def rows_of(ids: Iterable, texts: Iterable[bytes], m: Model) -> Iterator[tuple]:
        for i, raw in zip(ids, texts, strict=True):
            text = raw.decode("utf-8", "replace")
            for s, e, found in m.clauses(text):
                yield i, s, e, text[s:e], m.clause_weight(found), ",".join(sorted(k for k, v in found.items() if v))

    def make() -> Callable:
        m = shared.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                rows = list(rows_of(part.column("doc_id").to_pylist(), texts, m))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, start long, end long, clause string, weight double, matched string")
