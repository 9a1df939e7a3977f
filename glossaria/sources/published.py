"""Tables that are replaced at once: rows are written to a new folder, and one statement of the catalog shows them.

A published table is a view over folders, each written once and never changed. Which folder serves which buckets of which run
stands in the view's properties. A write that replaces a run, or some of its buckets, writes only the new rows, and then
``CREATE OR REPLACE VIEW`` switches text and properties together: readers see the old rows or the new ones. A write that is
killed before leaves a folder that nobody reads; vacuum() removes those. One writer at a time for each table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.sources.acceptance import Check, RejectedError, no_row, write_accepted
from glossaria.sources.scratch import _fs

BUCKET = "channel_hash_bucket"
Range = tuple[int, int]
_PART = 3_000
_PROPERTY = "glossaria.layers"


def without(have: Iterable[Range], gone: Iterable[Range]) -> list[Range]:
    """Ranges of buckets less other ranges."""
    left = list(have)
    for a, b in gone:
        left = [r for lo, hi in left for r in ((lo, min(hi, a - 1)), (max(lo, b + 1), hi)) if r[0] <= r[1]]
    return sorted(left)


def ranges_of(buckets: Iterable[int]) -> list[Range]:
    """Buckets as ranges of consecutive ones."""
    out: list[Range] = []
    for b in sorted(set(buckets)):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def _named(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


class Published:
    """A table by the name of its view and the folder that holds its data; rows have run_id and channel_hash_bucket."""

    def __init__(self, spark: SparkSession, name: str, root: str) -> None:
        self.spark, self.name, self.root = spark, name, root.rstrip("/")

    def _state(self) -> dict:
        """columns: (name, type) of the table; layers: folder, run, ranges of buckets and the columns it has."""
        if not self.spark.catalog.tableExists(self.name):
            return {"columns": [], "layers": []}
        props = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}
        return json.loads("".join(props[f"{_PROPERTY}.{k}"] for k in range(sum(p.startswith(f"{_PROPERTY}.") for p in props))))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def layers(self) -> list[dict]:
        return self._state()["layers"]

    def replace(self, df: DataFrame, run_id: str, ranges: Sequence[Range], full: bool = False, checks: Iterable[Check] = ()) -> dict[str, object]:
        """Replace one run's rows in ranges of buckets by those of df; buckets that get no row are empty afterwards.

        A row of another run or beyond the ranges is rejected, as is what fails one of the checks, before anything is shown. Columns
        must be those of the table, unless ``full`` says that the ranges are the whole run; types never change. Returns the measures.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
            raise ValueError(f"run_id {run_id!r} has characters other than letters, digits, _ . -")
        state = self._state()
        columns = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in ("run_id", BUCKET, "_repeat")]
        had = dict(map(tuple, state["columns"]))
        if had and not full and set(dict(columns)) != set(had):
            raise ValueError(f"columns differ in {sorted(set(dict(columns)) ^ set(had))} and the range of buckets is partial")
        if changed := [c for c, t in columns if had.get(c, t) != t]:
            raise ValueError(f"types differ in {changed}")
        path = f"{self.root}/{uuid.uuid4().hex}"
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col(BUCKET).between(a, b)
        scope = no_row("outside_of_scope", ~(F.col("run_id").eqNullSafe(run_id) & F.coalesce(inside, F.lit(False))))
        count = Check("rows_written", F.count(F.lit(1)), lambda _: True)
        got = write_accepted(df, lambda x: x.drop("run_id").write.partitionBy(BUCKET).parquet(path), [scope, count, *checks], lambda: self._delete(path))
        layers = self._cut(state["layers"], run_id, ranges)
        if got["rows_written"]:
            layers.append({"path": path, "run": run_id, "ranges": [list(r) for r in ranges], "columns": [c for c, _ in columns]})
        self._show({"columns": [*state["columns"], *[list(c) for c in columns if c[0] not in had]], "layers": layers})
        return got

    def clear(self, run_id: str, ranges: Sequence[Range]) -> None:
        """Show no row of a run in ranges of buckets any more."""
        state = self._state()
        self._show(state | {"layers": self._cut(state["layers"], run_id, ranges)})

    @staticmethod
    def _cut(layers: list[dict], run_id: str, ranges: Sequence[Range]) -> list[dict]:
        left = [x | {"ranges": [list(r) for r in without(map(tuple, x["ranges"]), ranges)]} if x["run"] == run_id else x for x in layers]
        return [x for x in left if x["ranges"]]

    def _show(self, state: dict) -> None:
        columns = state["columns"]
        selects = []
        for x in state["layers"]:
            some = [_named(c) if c in x["columns"] else f"CAST(NULL AS {t}) AS {_named(c)}" for c, t in columns]
            where = " OR ".join(f"{BUCKET} BETWEEN {int(a)} AND {int(b)}" for a, b in x["ranges"])
            selects.append(f"SELECT {', '.join([*some, f'{BUCKET}', _text(x['run']) + ' AS run_id'])} FROM parquet.{_named(x['path'])} WHERE {where}")
        if not selects:
            selects = [f"SELECT {', '.join([f'CAST(NULL AS {t}) AS {_named(c)}' for c, t in columns] + [f'CAST(NULL AS INT) AS {BUCKET}', 'CAST(NULL AS STRING) AS run_id'])} WHERE FALSE"]
        told = json.dumps(state)
        props = ", ".join(f"'{_PROPERTY}.{k}' = {_text(told[i : i + _PART])}" for k, i in enumerate(range(0, len(told), _PART)))
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ({props}) AS {' UNION ALL '.join(selects)}")

    def vacuum(self) -> list[str]:
        """Remove the folders that the view doesn't read (of killed writes, and replaced ones that no reader uses any more)."""
        fs, at = _fs(self.spark, self.root)
        used = {x["path"].rpartition("/")[2] for x in self.layers()}
        gone = [n for s in fs.listStatus(at) if s.isDirectory() and (n := s.getPath().getName()) not in used] if fs.exists(at) else []
        for n in gone:
            self._delete(f"{self.root}/{n}")
        return gone

    def _delete(self, path: str) -> None:
        fs, at = _fs(self.spark, path)
        fs.delete(at, True)


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


__all__ = ["BUCKET", "Published", "RejectedError", "ranges_of", "without"]
