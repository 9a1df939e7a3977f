"""Secret scans with multipart credential linking.

Three strong kinds are always reported: assignments, access identifiers and long hexadecimal runs. Weak parts - account
names and mail addresses (kind id), key-like tokens and short key assignments (kind key), addresses of services (kind
endpoint) - are ordinary text by themselves. They are reported only where complementary parts stand in one scope: an
interval join links each secret (strong or weak) with the identifiers and endpoints whose interval lies within REACH
characters of its own, or in the same run of setting lines (.env, INI, JSON; a blank line or prose ends the run). Of a
URL that holds a credential, user, password and host are parts of their own, so that they link with each other.

The join is by searches in the sorted starts and ends of one text's spans, as no link leaves a text; its time grows with the
spans times the logarithm of their number.

Defined results: null and empty texts give empty strings and the digest of nothing, as do texts without spans; a very long text
takes time in proportion to its length; spans that tie in place are listed by kind; rows that repeat a doc_id are each judged by
their text; other columns are ignored, and an empty table gives an empty result. Places are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import map_batches, record, sliced

REACH = 200
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]

#: The strong kinds and the least lengths of their decisive part.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_NAME = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.ASCII | re.IGNORECASE)
_NAME_WORDS = (b"user", b"login", b"account", b"client", b"access")
_MAIL = re.compile(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: What stands before and behind :// in a URL; the scheme is looked for from there, so that long runs of letters cost nothing.
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_REST = re.compile(r"""://[^\s"'<>]+""")
SCHEME_LENGTH = 40
#: Of a URL's authority: user, password, host.
_AUTHORITY = re.compile(r"://([^\s/?#:]*)(?::([^\s/?#]*))?@([^\s/?#@]+)|://([^\s/?#@]+)")
_HOST = re.compile(r"""(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.ASCII | re.IGNORECASE)
_HOST_WORDS = (b"host", b"endpoint", b"server")
_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SHORT = re.compile(r"""\b(?:pwd|pass|auth|bearer|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.ASCII | re.IGNORECASE)
#: A line that sets a value, or goes on with such lines (brackets, sections, comments).
_SETTING = re.compile(r"""\s*(?:(?:(?:export|set|-)\s+)?["']?[\w.-]+["']?\s*(?::(?!//)|=)(?:.{0,200}|\s*\S+\s*)|[\[\]{}(),;]+\s*|["']?[\w.-]*["']?\s*[\[{(]\s*|\[[^\]]+\]\s*|[#;].{0,200})""")
_SHORT_WORDS = (b"pwd", b"pass", b"auth", b"bearer", b"key")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def strong_spans(text: str, low: bytes) -> list[Span]:
    """low: the text's UTF-8, A-Z lower-cased."""
    out: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _key_like(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.0


def url_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each URL; a scheme has SCHEME_LENGTH characters at most."""
    out: list[tuple[int, int]] = []
    upto = 0
    while m := _REST.search(text, upto):
        if scheme := _SCHEME.search(text[max(upto, m.start() - SCHEME_LENGTH) : m.start()]):
            out.append((m.start() - len(scheme[0]), m.end()))
            upto = m.end()
        else:
            upto = m.start() + 3
    return out


def _url_parts(text: str, at: int) -> list[Span]:
    """User, password and host of a URL that holds a credential. at: its place."""
    m = _AUTHORITY.search(text)
    if m is None:
        return []
    host = 3 if m[3] else 4
    parts = []
    if m[2]:
        parts += [(m.start(1), 3, m.end(1))] * bool(m[1]) + [(m.start(2), 4, m.end(2))]
    elif m[1] and len(m[1]) >= 16 and _key_like(m[1]):
        parts += [(m.start(1), 4, m.end(1))]
    elif not (_SHORT.search(text, m.end()) or any(len(x[2]) >= LEAST_ASSIGNED for x in ASSIGN.finditer(text, m.end()))):
        return []
    return [(at + s, k, at + e) for s, k, e in [*parts, (m.start(host), 5, m.end(host))]]


def setting_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run of setting lines."""
    out: list[tuple[int, int]] = []
    at, inside = 0, False
    for line in text.split("\n"):
        now = bool(line.strip()) and _SETTING.fullmatch(line) is not None
        if now:
            out.append((out.pop()[0] if inside else at, at + len(line)))
        inside = now
        at += len(line) + 1
    return out


def weak_spans(text: str, low: bytes) -> list[Span]:
    out: list[Span] = []
    if any(w in low for w in _NAME_WORDS):
        out += [(m.start(), 3, m.end()) for m in _NAME.finditer(text)]
    if b"@" in low:
        out += [(m.start(), 3, m.end()) for m in _MAIL.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _key_like(m[0])]
    if any(w in low for w in _SHORT_WORDS):
        out += [(m.start(), 4, m.end()) for m in _SHORT.finditer(text)]
    if b"://" in low:
        for at, end in url_places(text):
            out.append((at, 5, end))
            out += _url_parts(text[at:end], at)
    if any(w in low for w in _HOST_WORDS):
        out += [(m.start(), 5, m.end()) for m in _HOST.finditer(text)]
    out += [(m.start(), 5, m.end()) for m in _IP.finditer(text)]
    return out


def linked(strong: list[Span], weak: list[Span], runs: list[tuple[int, int]], reach: int = REACH) -> list[Span]:
    """The weak spans that have a complementary part in their scope. runs: of setting_runs()."""
    secrets = sorted([s for s in strong if s[1] != 1] + [w for w in weak if w[1] == 4])
    others = sorted([s for s in strong if s[1] == 1] + [w for w in weak if w[1] != 4])

    begins = [r[0] for r in runs]

    def near(one: Span, side: Side) -> bool:
        k = bisect_right(begins, one[0]) - 1
        run = runs[k] if k >= 0 and one[0] < runs[k][1] else (one[0], one[0])
        behind = bisect_left(side.starts, one[2])
        before = bisect_right(side.ends, one[0])
        return (
            behind < len(side.starts) and side.starts[behind] <= max(one[2] + reach, run[1] - 1)
            or before > 0 and side.ends[before - 1] >= one[0] - reach
            or side.least_end[bisect_left(side.starts, run[0])] <= one[0] and run[0] < run[1]
        )

    sides = {True: Side(others), False: Side(secrets)}
    return [w for w in weak if near(w, sides[w[1] == 4])]


class Side:
    """Spans by start; their ends in order; the smallest end of all spans from each place on."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts, self.ends = [s[0] for s in spans], sorted(s[2] for s in spans)
        self.least_end = [*list(accumulate((s[2] for s in reversed(spans)), min))[::-1], math.inf]


def all_spans(text: str, low: bytes) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), each by start, then kind."""
    strong = strong_spans(text, low)
    weak = weak_spans(text, low)
    if weak:
        covered = [(s[0], s[2]) for s in strong]
        first, upto = [s for s, _ in covered], -1
        reach = [upto := max(upto, e) for _, e in covered]
        weak = [w for w in weak if not ((k := bisect_right(first, w[0])) and reach[k - 1] >= w[2])]
    found = linked(strong, weak, setting_runs(text)) if weak and len(weak) + len(strong) > 1 else []
    return strong, sorted({*strong, *found})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_secrets(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                n: list[list[int]] = [[], [], []]
                sha, spans = [], []
                for t in texts:
                    strong, every = all_spans(t.decode("utf-8", "replace"), t.lower())
                    for k in range(3):
                        n[k].append(sum(s[1] == k for s in strong))
                    sha.append(hashlib.sha256(joined(strong).encode()).hexdigest())
                    spans.append(joined(every))
                yield record(_OUT, doc_id=part.column("doc_id"), n_assign=n[0], n_access=n[1], n_hex=n[2], base_sha256=sha, spans=spans)

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones together) replaced."""
    _, spans = all_spans(text, text.encode("utf-8", "replace").lower())
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def redact_documents(documents: DataFrame) -> DataFrame:
    """documents with secrets in text replaced and n_chars set anew where the text changed; all columns and rows stay."""
    names = documents.columns
    at = documents.schema.names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else -1

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _ in sliced(batches, "text"):
                old = part.column(at).to_pylist()
                new = [None if t is None else redact(t) for t in old]
                cols = list(part.columns)
                cols[at] = pa.array(new, type=part.schema.field(at).type)
                if chars >= 0:
                    n = [len(y) if x is not None and x != y else c for x, y, c in zip(old, new, cols[chars].to_pylist(), strict=True)]
                    cols[chars] = pa.array(n, type=part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

        return run

    return map_batches(documents, make, documents.schema)
