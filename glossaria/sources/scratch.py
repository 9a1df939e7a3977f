"""Tables that a query writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.

    Where neither is set, a local master gets a folder of its own; on a cluster no executor could read that, so it raises.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told:
        return told
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossaria-"))
    return sc.getCheckpointDir()


@contextmanager
def some_keys_suffice(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a join may use sides that are dealt by some of its keys (a channel, of channel and model) as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Compressed bytes up to which Spark may turn a join within an operator into a broadcast on its own.
BROADCAST_UNASKED = 256 << 10


def bounded_joins(f: Callable) -> Callable:
    """f(spark, ...), in whose jobs only tiny tables are broadcast without a hint: Spark goes by compressed bytes, of which ids and
    hashes take few, and the driver builds the whole hash table. Tables with a hint have been counted. What f returns runs
    later: its joins have hints of their own."""
    name = "spark.sql.autoBroadcastJoinThreshold"

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object, **kwargs: object) -> object:
        before, now = spark.conf.get(name), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(name, str(min(now, BROADCAST_UNASKED)))
        try:
            return f(spark, *args, **kwargs)
        finally:
            spark.conf.set(name, before)

    return run


#: Bucketed tables that are still in a catalog, with their sessions.
_listed: dict[str, SparkSession] = {}


@atexit.register
def _forget() -> None:
    """A catalog that outlives the driver must not keep tables whose files go with it."""
    for name, spark in _listed.items():
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001, PERF203  the session may be gone
            return


class Scratch:
    """Parquet tables in the shared folder that cut lineage, so that a lost executor costs a rescan and no recomputation.

    ``keep()`` at the end of an operator removes all tables but those that its result still reads; these go when the driver's JVM
    ends, whether its session has been stopped before or not.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.open = spark, f"{shared_dir(spark)}/glossaria-{uuid.uuid4().hex}", set()
        self.names: dict[str, str] = {}
        fs, at = _fs(spark, self.top)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def path(self) -> str:
        """A new path for a table."""
        return f"{self.top}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        self.open.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # noqa: SLF001
        return out

    def bucketed(self, df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
        """A table dealt by keys into as many buckets as a shuffle has partitions, each sorted: joins and aggregates of such
        tables by the keys (or by more) move no row. dealt: the rows come from an aggregate or join by just these keys, so
        they lie in the right partitions and need no shuffle of their own.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, name = self.path(), f"glossaria_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(n, *keys)
        rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        _listed[name] = self.spark
        self.open.add(path)
        self.names[path] = name
        out = self.spark.table(name)
        out._scratch = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in {t._scratch for t in tables} & self.open:
            self._remove(path)
            self.open.remove(path)

    def keep(self, *tables: DataFrame) -> None:
        for path in self.open - {t._scratch for t in tables}:
            self._remove(path)
            self.open.remove(path)

    def _remove(self, path: str) -> None:
        if name := self.names.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            _listed.pop(name, None)
        fs, at = _fs(self.spark, path)
        fs.delete(at, True)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
