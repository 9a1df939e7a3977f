"""Acceptance in the write itself: what is written is measured as it is written, and a table that fails never counts as done.

Measures are aggregates that ``DataFrame.observe`` takes (no distinct counts), so they cost no scan and no job of their own. The
frame that is observed is the one handed to the writer, so each row is measured in the task that writes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class RejectedError(ValueError):
    """What was wrong, by check: ``failed`` holds the measured values."""

    def __init__(self, failed: Mapping[str, object]) -> None:
        super().__init__("; ".join(f"{k}: {v}" for k, v in failed.items()))
        self.failed = dict(failed)


@dataclass(frozen=True)
class Check:
    """A name, an aggregate over the written rows, and what it must satisfy."""

    name: str
    measure: Column
    ok: Callable[[object], bool]


def no_row(name: str, condition: Column) -> Check:
    """No written row may satisfy a condition."""
    return Check(name, F.count_if(F.coalesce(condition, F.lit(False))), lambda n: n == 0)


def rows(name: str, n: int) -> Check:
    """Exactly so many rows are written."""
    return Check(name, F.count(F.lit(1)), lambda x: x == n)


REPEAT = "_repeat"


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with each row's number among those of its keys, from 0, for no_repeat(); no shuffle where rows are dealt by the keys."""
    return df.withColumn(REPEAT, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)


def no_repeat(name: str) -> Check:
    return no_row(name, F.col(REPEAT) > 0)


def write_accepted(df: DataFrame, write: Callable[[DataFrame], None], checks: Iterable[Check], undo: Callable[[], None] | None = None) -> dict[str, object]:
    """write(df), measured; returns the measures by name. If a check fails, undo() runs and RejectedError is raised.

    The column of numbered() is measured and not written.
    """
    checks = list(checks)
    seen = Observation()
    write(df.observe(seen, *[c.measure.alias(c.name) for c in checks]).drop(REPEAT))
    got = seen.get
    failed = {c.name: got[c.name] for c in checks if not c.ok(got[c.name])}
    if failed:
        if undo:
            undo()
        raise RejectedError(failed)
    return dict(got)


def require_tables(spark: SparkSession, names: Iterable[str]) -> None:
    """All tables of the catalog must be there; those that aren't are named together."""
    missing = {n: "no such table" for n in names if not spark.catalog.tableExists(n)}
    if missing:
        raise RejectedError(missing)


def require_columns(df: DataFrame, columns: Mapping[str, str | None]) -> None:
    """Columns by name, each with its type or None for any; all that is wrong is named together. No job runs."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = {c: "no such column" if c not in have else f"is {have[c]}, not {t}" for c, t in columns.items() if c not in have or t is not None and have[c] != t}
    if wrong:
        raise RejectedError(wrong)


#: Columns that the final table must have.
FINAL_COLUMNS = {"channel_id": "string", "a_vote_share": "double", "b_vote_share": "double", "consensus_status": "string", "mixed_screen": "boolean", "mixed_credible": "boolean", "requires_manual": "boolean", "language_status": "string"}


def final_checks(channels: int) -> list[Check]:
    """Of a final table numbered by channel_id: each of so many channels once, shares within 0..1, credible only if screened,
    a label only where no person must decide, and a status for all."""
    share = lambda p: ~F.col(f"{p}_vote_share").between(0, 1)
    credible = F.col("mixed_credible") & ~F.coalesce("mixed_screen", F.lit(False))
    return [
        rows("all_channels_present", channels), no_repeat("one_row_per_channel"), no_row("channel_is_named", F.col("channel_id").isNull()), no_row("shares_in_range", F.coalesce(share("a"), F.lit(False)) | F.coalesce(share("b"), F.lit(False))),
        no_row("credible_implies_screen", credible), no_row("status_is_given", F.col("language_status").isNull()),
    ]
