"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table written there cuts lineage: a lost executor never makes the steps before it run again.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Unset, a local master (tests) gets a folder; a cluster is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sluice-llm-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


_open_blocks: list[list[str]] = []
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """One run's tables, each written once and read back.

    A result reads some of them when it runs, so they stay until whoever has written that result removes them: see ``passing``.
    Those that nothing reads any more go before, by ``drop`` or ``last``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._tables: list[tuple[DataFrame, str]] = []
        for block in _open_blocks:
            block.append(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        with _shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of ``keep`` that nothing will read any more."""
        for table, path in self._tables:
            if any(table is t for t in tables):
                _remove(self.spark, path)
        self._tables = [x for x in self._tables if not any(x[0] is t for t in tables)]

    def last(self, df: DataFrame) -> DataFrame:
        """Keeps ``df`` and removes all tables before it."""
        before = [table for table, _ in self._tables]
        out = self.keep(df)
        self.drop(*before)
        return out


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """The shuffle files of what is written inside go as soon as it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES) if before is None else spark.conf.set(_SHUFFLES, before)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Removes, at its end, the folders of all ``Scratch`` made inside: for steps whose result is written by then."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.pop()
        for folder in made:
            _remove(spark, folder)
