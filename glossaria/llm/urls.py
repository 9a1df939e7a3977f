"""URL filters: explicit host and path rules, else logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver, in numpy, from the small labelled table of url_table.py; its weights have a fixed size.

Defined results: a null or empty url, or one without ``://``, has an empty host and path and is judged by the classifier's bias, which
the table's own row without host and path teaches to allow; a very long url is one row's work; of rules of one length that fit, the last by name counts; rows that repeat a
page_id are each judged; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import map_batches, record
from glossaria.llm.url_table import labelled

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains, if the url's path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

DIMS, EPOCHS, RATE, DECAY = 1 << 16, 6, 4.0, 1e-5
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the hashed 2- to 5-grams of host and path, digits as 0, scaled to length 1.

    Each gram counts once under the mark of its half and once for both, so that a word of a host is also known in a path.
    """
    grams = set()
    for mark, s in (("h", host), ("p", path)):
        s = "^" + "".join("0" if c.isdigit() else c for c in s.lower()) + "$"
        own = {s[i : i + n] for n in (2, 3, 4, 5) for i in range(len(s) - n + 1)}
        grams.update(own, (mark + "|" + g for g in own))
    if not grams:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    ids, n = np.unique([zlib.crc32(g.encode("utf-8", "replace")) % DIMS for g in sorted(grams)], return_counts=True)
    return ids, n / np.sqrt((n * n).sum())


#: Each url is learned as it is and so often under another end and beginning of its host: what these tell is less than what a name does.
COPIES = 2
ENDS, STARTS = ("com", "org", "net", "de", "co.uk", "io", "info", "example.com"), ("www.", "www.", "www.", "m.", "blog.", "", "", "", "")


def with_end(url: str, end: str) -> str:
    """url with another end of its host: the last label, and a short one (co, gov, ac) that stands before a country's."""
    host, path = _halves(url)
    labels = host.split(".")
    cut = 2 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 1
    return ".".join([*labels[:-cut], end]) + path if len(labels) > cut else url


def varied(table: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The table with its copies under other ends and beginnings, drawn alike for both classes."""
    rng, out = np.random.default_rng(7), []
    for url, y in table:
        out.append((url, y))
        for _ in range(COPIES if url else 0):
            start, end = (xs[int(rng.integers(len(xs)))] for xs in (STARTS, ENDS))
            out.append((start + with_end(url, end).removeprefix("www."), y))
    return out


def train(table: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias, as means over the later half of the epochs."""
    rows = [(features(*_halves(u)), y) for u, y in varied(table)]
    rng, w, b = np.random.default_rng(3), np.zeros(DIMS), 0.0
    mean_w, mean_b, half = np.zeros(DIMS), 0.0, EPOCHS // 2
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        for k in rng.permutation(len(rows)).tolist():
            (ids, x), y = rows[k]
            g = 1 / (1 + np.exp(-(x @ w[ids] + b))) - y
            w[ids] -= rate * (g * x + DECAY * w[ids])
            b -= rate * 0.1 * g
        if epoch >= half:
            mean_w, mean_b = mean_w + w / (EPOCHS - half), mean_b + b / (EPOCHS - half)
    return mean_w, float(mean_b)


@functools.lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, float]:
    return train(labelled())


def score(host: str, path: str, w: np.ndarray, b: float) -> float:
    """The chance that a url is to be blocked."""
    ids, x = features(host, path) if host or path else (np.zeros(0, dtype=np.int64), np.zeros(0))
    return float(1 / (1 + np.exp(-(x @ w[ids] + b))))


def _halves(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see the module; A-Z of the host are lower-cased."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, path = _halves(rest[:end])
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def matching_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score (the classifier's chance of block)."""
    w, b = weights()

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                rows = []
                for u in part.column(1).to_pylist():
                    host, path = split_url(u)
                    p = score(host, path, w, b)
                    rule = matching_rule(host, path, rules)
                    rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if p >= 0.5 else "allow", p))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield record(_OUT, page_id=part.column(0), host=list(cols[0]), path=list(cols[1]), rule=list(cols[2]), verdict=list(cols[3]), score=list(cols[4]))

        return run

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), make, "page_id long, host string, path string, rule string, verdict string, score double")
