"""Stores of results by key that a run can be given: in a shared folder, or in the session's memory.

A store is anything with the methods of ``Store``; ``get_or_set`` is all that a run needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources import tables


class Store(Protocol):
    def get(self, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """What is held of the wanted keys, and the keys that aren't."""

    def put(self, results: DataFrame, now: Column) -> None: ...

    def delete(self, keys: DataFrame, now: Column) -> None: ...

    def has(self, wanted: DataFrame, now: Column) -> DataFrame:
        """(key, held)."""

    def clear(self) -> None: ...

    def size(self, now: Column) -> int: ...

    def keys(self, now: Column) -> DataFrame: ...


def get_or_set(store: Store, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """Results of the wanted keys: those that the store holds, and the others computed and put there."""
    held, due = store.get(wanted, now)
    made = tables.cut(compute(due))
    store.put(made, now)
    return held.unionByName(made) if held.columns else made


def wrap(store: Store, compute: Callable[[DataFrame], DataFrame], now: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda wanted: get_or_set(store, wanted, compute, now)


class FolderStore:
    """Results in a folder that all executors share, for ``seconds`` each.

    Results are added; deleting writes what is left to a new version of the folder and
    removes the old one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "url", seconds: int = 3600) -> None:
        self.spark, self.path, self.key, self.seconds = spark, path.rstrip("/"), key, seconds

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self) -> str | None:
        fs, path = self._files()
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        mine = sorted((n for n in names if n.startswith("v-")), key=lambda n: int(n.split("-")[1]))
        return f"{self.path}/{mine[-1]}" if mine else None

    def _next(self) -> str:
        now = self._version()
        return f"{self.path}/v-{int(now.rsplit('/', 1)[1].split('-')[1]) + 1 if now else 0}-{uuid.uuid4().hex[:8]}"

    def _live(self, now: Column) -> DataFrame | None:
        version = self._version()
        return self.spark.read.parquet(version).where(F.col("_until") > now) if version else None

    def get(self, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        version = self._version()
        if version is None:
            return self.spark.range(0).select(), wanted
        return tables.recall(wanted, version, self.key, now)

    def put(self, results: DataFrame, now: Column) -> None:
        tables.remember(results, self._version() or self._next(), self.key, now + F.make_interval(secs=F.lit(self.seconds)))

    def delete(self, keys: DataFrame, now: Column) -> None:
        if (live := self._live(now)) is None:
            return
        old, new = self._version(), self._next()
        left = live.join(keys.select(self.key).distinct(), self.key, "left_anti")
        left.repartition("_shard").write.partitionBy("_shard").parquet(new)
        self._remove(old)

    def has(self, wanted: DataFrame, now: Column) -> DataFrame:
        held = self.keys(now).withColumn("held", F.lit(True))
        return wanted.select(self.key).distinct().join(held, self.key, "left").select(self.key, F.coalesce("held", F.lit(False)).alias("held"))

    def _remove(self, path: str) -> None:
        fs, _ = self._files()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def clear(self) -> None:
        self._remove(self.path)

    def size(self, now: Column) -> int:
        return self.keys(now).count()

    def keys(self, now: Column) -> DataFrame:
        live = self._live(now)
        return self.spark.createDataFrame([], f"{self.key} string") if live is None else live.select(self.key).distinct()


class MemoryStore:
    """Results in the executors' memory, for a session, for ``seconds`` each."""

    def __init__(self, spark: SparkSession, key: str = "url", seconds: int = 3600) -> None:
        self.spark, self.key, self.seconds = spark, key, seconds
        self.held: DataFrame | None = None

    def _keep(self, df: DataFrame) -> None:
        old, self.held = self.held, df.persist()
        self.held.count()
        if old is not None:
            old.unpersist()

    def _live(self, now: Column) -> DataFrame | None:
        return None if self.held is None else self.held.where(F.col("_until") > now)

    def get(self, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        if (live := self._live(now)) is None:
            return self.spark.range(0).select(), wanted
        held = live.drop("_until").join(wanted.select(self.key).distinct(), self.key, "left_semi")
        return held, wanted.join(held.select(self.key), self.key, "left_anti")

    def put(self, results: DataFrame, now: Column) -> None:
        new = results.withColumn("_until", now + F.make_interval(secs=F.lit(self.seconds)))
        live = self._live(now)
        self._keep(new if live is None else live.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame, now: Column) -> None:
        if (live := self._live(now)) is not None:
            self._keep(live.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def has(self, wanted: DataFrame, now: Column) -> DataFrame:
        held = self.keys(now).withColumn("held", F.lit(True))
        return wanted.select(self.key).distinct().join(held, self.key, "left").select(self.key, F.coalesce("held", F.lit(False)).alias("held"))

    def clear(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None

    def size(self, now: Column) -> int:
        return self.keys(now).count()

    def keys(self, now: Column) -> DataFrame:
        live = self._live(now)
        return self.spark.createDataFrame([], f"{self.key} string") if live is None else live.select(self.key).distinct()
