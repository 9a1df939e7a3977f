"""This package's code on the executors, for the few operators that run Python there."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as an archive, once for each context; Spark copies it from the driver."""
    sc = spark.sparkContext
    if sc in _sent:
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="glossaria-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(Path(top.name) / f.relative_to(top)))
    sc.addPyFile(str(to))
    _sent[sc] = str(to)
