"""Helpers shared by the operators: bounded broadcasts, code shipping, batch slicing."""

from __future__ import annotations

import hashlib
import math
import os
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.sources.scratch import Scratch, bounded_joins, shared_dir

__all__ = ["Scratch", "ascii_lower", "ascii_words", "bounded_broadcast", "bounded_joins", "map_batches", "record", "shared_dir", "sha256_joined", "ship", "sliced", "slices", "spread", "text_bytes", "words_of"]

#: Rows up to which an (id, number...) table is broadcast after its rows have been counted.
BROADCAST_ROWS = 100_000
#: Bytes of its strings up to which that is done.
BROADCAST_BYTES = 32_000_000

#: ASCII characters that end a word of the contracts' class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z).
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each context."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    files = sorted(top.rglob("*.py"))
    tag = hashlib.sha1(b"".join(f.read_bytes() for f in files)).hexdigest()[:10]
    to = os.path.join(tempfile.mkdtemp(prefix="glossaria-code-"), f"glossaria-{tag}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, str(Path(top.name) / f.relative_to(top)))
    sc.addPyFile(to)
    _shipped[sc] = to


def spread(spark: SparkSession, rows: int, least: int = 8_000, most: int = 250_000) -> int:
    """A number of partitions for so many short rows: two for each core, unless they had more than ``most`` or less than ``least`` rows."""
    return max(1, math.ceil(rows / most), min(math.ceil(rows / least), 2 * spark.sparkContext.defaultParallelism))


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, of numbers and short strings, with a broadcast hint if a count (of at most rows + 1) and the size of its strings
    prove it small, else with a hint that has Spark shuffle it, however well it compresses."""
    strings = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= BROADCAST_BYTES else df.hint("merge")


def slices(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds at most ``most`` bytes of text (or one row), with that text as bytes."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
        for i, j in slices(sizes, most):
            part = b.slice(i, j - i)
            yield part, text_bytes(part.column(part.schema.get_field_index(text)))


def ascii_words(text: bytes) -> list[bytes]:
    """The contracts' words: runs of 0-9, a-z and everything beyond ASCII, A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow with code sent to the executors; ``make()`` is called once in each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make()(batches)

    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(n).type) for n, x in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; lower() has a quick way for texts of ASCII only."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """The contracts' words, in the case they have, with built-in functions; null and empty texts have none.

    Lower-casing word by word afterwards costs far less than lower-casing whole texts first.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def sha256_joined(values: Column) -> Column:
    """Lower-case hex SHA-256 of comma-joined strings."""
    return F.sha2(F.array_join(values, ",").cast("binary"), 256)
