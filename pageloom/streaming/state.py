"""Keyed state: sliding-window limiter, circuit breaker, TTL and LRU cache, polite host schedule.

Each is a fold over a key's events in the order of time.  ``replay`` runs a fold over
a table; ``stream`` runs it as stateful Structured Streaming, with the state carried
between micro-batches.
"""

from __future__ import annotations

import heapq
import pickle
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


@dataclass
class SlidingLimiter:
    """Allows ``most`` requests in any ``window_ms``; denied ones don't count."""

    most: int
    window_ms: int = 60_000
    times: deque = field(default_factory=deque)
    result = "boolean"

    def step(self, ms: int, row: Any) -> bool:
        while self.times and ms - self.times[0] >= self.window_ms:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(ms)
        return True


@dataclass
class CircuitBreaker:
    """"closed", "open" (the call is rejected) or "half_open" at each call; ``row.ok`` is whether the call succeeds."""

    threshold: int = 3
    reset_ms: int = 30_000
    failures: int = 0
    last: int = 0
    state: str = "closed"
    result = "string"

    def step(self, ms: int, row: Any) -> str:
        if self.state == "open":
            if ms - self.last < self.reset_ms:
                return "open"
            self.state = "half_open"
        seen = self.state
        if row.ok:
            self.failures, self.state = 0, "closed"
        else:
            self.failures, self.last = self.failures + 1, ms
            if self.failures >= self.threshold:
                self.state = "open"
        return seen


@dataclass
class TtlCache:
    """Whether each lookup of ``row.item`` hits; a miss puts it in, and the least recently used go while it is over
    ``most`` items or, if rows have ``bytes``, over ``most_bytes``.  What alone is larger isn't kept."""

    ttl_ms: int = 300_000
    most: int = 100
    most_bytes: int = 100 << 20
    items: OrderedDict = field(default_factory=OrderedDict)
    used: int = 0
    result = "boolean"

    def _drop(self, item: Any) -> None:
        if item in self.items:
            self.used -= self.items.pop(item)[1]

    def step(self, ms: int, row: Any) -> bool:
        held = self.items.get(row.item)
        if held is not None and ms < held[0]:
            self.items.move_to_end(row.item)
            return True
        self._drop(row.item)
        size = int(getattr(row, "bytes", 0) or 0)
        if size > self.most_bytes:
            return False
        while self.items and (len(self.items) >= self.most or self.used + size > self.most_bytes):
            self._drop(next(iter(self.items)))
        self.items[row.item] = ms + self.ttl_ms, size
        self.used += size
        return False


@dataclass(frozen=True)
class LimiterPreset:
    """Requests a second and at once to a host, at once to all, and the longest wait after an error."""

    per_second: float
    at_once: int
    at_once_in_all: int
    most_backoff_ms: int


LIMITERS = {"conservative": LimiterPreset(1, 2, 10, 30_000), "moderate": LimiterPreset(2, 3, 20, 30_000), "aggressive": LimiterPreset(4, 5, 30, 15_000)}
#: (threshold, reset_ms) of the circuit breakers of feeds, of pages, and of tests.
BREAKERS = {"rss": (3, 30_000), "scraping": (5, 30_000), "scraping_test": (3, 60_000)}


def breaker(preset: str) -> Callable[[], CircuitBreaker]:
    return lambda: CircuitBreaker(*BREAKERS[preset])


@dataclass
class HostSchedule:
    """The time (ms) at which each request to a host may go: ``per_second`` at most, one after another."""

    per_second: float = 2.0
    free: float = 0.0
    result = "long"

    def step(self, ms: int, row: Any) -> int:
        at = max(float(ms), self.free)
        self.free = at + 1000 / self.per_second
        return int(at)


Maker = Callable[[], Any]


def host_times(df: DataFrame, per_second: float = 2.0, key: str = "host", ts: str = "ts", order: str = "event_id", name: str = "value") -> DataFrame:
    """(key, order, value): what ``HostSchedule`` gives, by a window: the k-th request goes k gaps after the one that
    found the host free last."""
    gap = F.lit(1000 / per_second)
    by_time = W.partitionBy(key).orderBy(ts, order)
    numbered = df.select(key, order, ts, F.row_number().over(by_time).alias("_n"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")).alias("_ms"))
    free = F.max(F.col("_ms") - F.col("_n") * gap).over(by_time.rowsBetween(W.unboundedPreceding, W.currentRow))
    return numbered.select(key, order, F.floor(free + F.col("_n") * gap + 1e-6).cast("long").alias(name))


def priority_times(df: DataFrame, preset: str = "moderate", key: str = "host", ts: str = "ts", order: str = "event_id", priority: str = "priority", ms: str = "ms", name: str = "value") -> DataFrame:
    """(key, order, value): when (ms) each request to a host goes if, of those that wait, the one of the highest priority
    goes first (the oldest of equals), ``per_second`` at most and ``at_once`` at the same time, each taking ``ms``.

    A host is one group.  How many go at once to all hosts is a matter of the fetcher.
    """
    how = LIMITERS[preset]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([ts, order], kind="stable")
        came = (frame[ts].astype("datetime64[us]").astype("int64") // 1000).tolist()
        rank, took = frame[priority].tolist(), frame[ms].tolist()
        at, waiting, busy, next_free, k = [0] * len(came), [], [], 0.0, 0
        while k < len(came) or waiting:
            now = next_free if waiting else max(next_free, float(came[k]))
            if len(busy) >= how.at_once:
                now = max(now, heapq.heappop(busy))
            while k < len(came) and came[k] <= now:
                heapq.heappush(waiting, (-rank[k], k))
                k += 1
            i = heapq.heappop(waiting)[1]
            at[i] = int(now)
            heapq.heappush(busy, now + took[i])
            next_free = now + 1000 / how.per_second
        return pd.DataFrame({key: frame[key], order: frame[order], name: pd.Series(at, index=frame.index, dtype="int64")})

    return df.groupBy(key).applyInPandas(run, _schema(df, key, order, name, "long"))


def _fold(state: Any, frame: pd.DataFrame, key: str, ts: str, order: str, name: str) -> pd.DataFrame:
    ms = (frame[ts].astype("datetime64[us]").astype("int64") // 1000).tolist()
    values = [state.step(t, row) for t, row in zip(ms, frame.itertuples(index=False))]
    return pd.DataFrame({key: frame[key], order: frame[order], name: pd.Series(values, index=frame.index, dtype=object)})


def _schema(df: DataFrame, key: str, order: str, name: str, kind: str) -> StructType:
    return StructType([df.schema[key], df.schema[order], StructField(name, _parse_datatype_string(kind))])


def replay(df: DataFrame, make: Maker, key: str, ts: str = "ts", order: str = "event_id", name: str = "value") -> DataFrame:
    """(key, order, value) of every event; ``order`` breaks ties of time.

    Partitions are sorted once, by key and time, and a key's events come to its fold in
    batches, so that a key with very many of them needs no more memory than its state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = make()
        for frame in frames:
            yield _fold(state, frame, key, ts, order, name)

    by_time = df.repartition(key).sortWithinPartitions(key, ts, order)
    return by_time.groupBy(key).applyInPandas(run, _schema(df, key, order, name, make().result))


def stream(df: DataFrame, make: Maker, key: str, ts: str = "ts", order: str = "event_id", name: str = "value", idle_ms: int = 3_600_000) -> DataFrame:
    """As ``replay``, for a stream; a key that is idle for ``idle_ms`` loses its state."""

    def run(group: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = pickle.loads(held.get[0]) if held.exists else make()
        frame = pd.concat(list(frames)).sort_values([ts, order], kind="stable")
        yield _fold(state, frame, key, ts, order, name)
        held.update((pickle.dumps(state),))
        held.setTimeoutDuration(idle_ms)

    schema = _schema(df, key, order, name, make().result)
    return df.groupBy(key).applyInPandasWithState(run, schema, StructType([StructField("state", _parse_datatype_string("binary"))]), "append", GroupStateTimeout.ProcessingTimeTimeout)


def backoff_ms(retry: Column, base: int = 1000, multiplier: Column | float = 1.0, most: int = 60_000) -> Column:
    """The wait before a retry: it doubles each time, up to ``most``."""
    factor = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return F.least(F.lit(float(base)) * factor * F.pow(F.lit(2.0), retry), F.lit(float(most))).cast("long")


def retryable(status: Column, code: Column | None = None, message: Column | None = None) -> Column:
    """Whether an error may pass: lost connections, 408, 429, 5xx and time-outs."""
    test = F.coalesce((status == 408) | (status == 429) | (status >= 500), F.lit(False))
    if code is not None:
        test = F.coalesce(code.isin("ENOTFOUND", "ECONNREFUSED"), F.lit(False)) | test
    if message is not None:
        test = test | (status.isNull() & F.coalesce(message.contains("timeout"), F.lit(False)))
    return test
