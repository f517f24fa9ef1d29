"""Capture index of web pages: locally sorted runs, merged k ways by a loser tree.

1. Each task sorts its captures by (URL key, timestamp, id) into runs of at most
   ``run_rows`` and cuts each run at the splitters, which deal the key space into
   ranges; the packed pieces are written to the shared folder (the external runs).
2. Each range merges its pieces of all runs with a loser tree, which does one
   comparison a level for each row.  Pieces stay packed and are opened ``_BATCH``
   rows at a time, and what is merged is given away in batches.
3. Ranges are in order, and so are the files of the result; row counts of the ranges
   give every row its global position, and a URL whose captures lie in several
   ranges goes on counting.

Ranges have about ``range_rows`` captures, or more where there would be over
``MOST_RANGES`` of them: the driver holds a few keys and counts for each range, so
what it holds is bounded.  Splitters come from about ``SAMPLES`` keys a range, chosen
by a hash; they only balance the ranges and never change the result.  They hold the
whole sort key, so one URL with very many captures is spread too.

The URL key is the host's labels reversed, then ``)``, path and query; scheme,
``www.``, the scheme's own port and the fragment are dropped.

Defined results: captures without a URL are left out; null timestamps and ids sort
first; equal captures keep an arbitrary order among themselves, and each has its own
place; null bodies have length 0 and no digest; an empty table gives an empty index;
other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared
from pageloom.llm.postings import runs as cuts_of

RUN_ROWS = 200_000
RANGE_ROWS = 100_000
#: Captures below which a range isn't made only to use another core.
LEAST_ROWS = 2_000
SAMPLES = 16
MOST_RANGES = 20_000
#: Rows of a piece that are open at once, and of a batch of the result.
_BATCH = 4_096
_OUT_ROWS = 32_768

_ROW = pa.schema([("url_key", pa.string()), ("ts", pa.int64()), ("id", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
_RUN = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("tail", pa.int64()), ("piece", pa.binary())])
_OUT = pa.schema([("position", pa.int64()), ("url_key", pa.string()), ("ts", pa.int64()), ("capture", pa.int64()), ("id", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
_OUT_DDL = "position long, url_key string, ts long, capture long, id long, length long, digest string"

Key = tuple[str, int, int]
_LEAST = -(1 << 63)


def url_key(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def captures(pages: DataFrame, url: str = "url", body: str = "html", ts: Column | None = None, key: str = "page_id") -> DataFrame:
    """(url_key, ts, id, length, digest) of stored pages; ``ts`` in seconds."""
    text = F.col(body)
    return pages.where(F.col(url).isNotNull()).select(
        url_key(F.col(url)).alias("url_key"), (F.lit(None) if ts is None else ts).cast("long").alias("ts"), F.col(key).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("length"), F.md5(text).alias("digest")
    )


class LoserTree:
    """Merges sorted keys; an inner node holds the run that lost there."""

    def __init__(self, runs: list[Iterable]) -> None:
        self.runs, self.k = list(map(iter, runs)) or [iter(())], max(1, len(runs))
        self.at = [0] * self.k
        self.now = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._sift(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.now[i], self.now[j]
        if a is None or b is None:
            return b is None and a is not None
        return a < b or (a == b and i < j)

    def _sift(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        losers = self.losers
        while node:
            other = losers[node]
            if other == -1:  # the first to arrive while the tree is built waits here
                losers[node] = winner
                return
            if self._less(other, winner):
                losers[node], winner = winner, other
            node >>= 1
        losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it), in order of the keys; of equal keys the earlier run's first."""
        while self.now[w := self.losers[0]] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.now[w] = next(self.runs[w], None)
            self._sift(w)


def _keys(table: pa.Table | pa.RecordBatch) -> list[Key]:
    low = lambda c: [_LEAST if x is None else x for x in table.column(c).to_pylist()]
    return list(zip(table.column("url_key").to_pylist(), low("ts"), low("id")))


def _write_piece(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        for at in range(0, batch.num_rows, _BATCH):
            out.write_batch(batch.slice(at, _BATCH))
    return sink.getvalue().to_pybytes()


def _make_runs(splitters: list[Key], run_rows: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def run() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = _keys(table)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            table = table.take(pa.array(order, pa.int64())).combine_chunks()
            keys = [keys[i] for i in order]
            range_of = np.array([bisect_left(splitters, k) for k in keys], np.int64)
            out: dict[str, list] = {name: [] for name in _RUN.names}
            cuts = cuts_of(range_of)
            for a, b in zip(cuts, cuts[1:]):
                r = int(range_of[a])
                last = splitters[r][0] if r < len(splitters) else None
                tail = b - max(a, bisect_left(keys, (last, _LEAST, _LEAST), a, b)) if last is not None else 0
                for name, x in zip(out, (r, number, b - a, tail, _write_piece(table.slice(a, b - a).to_batches()[0]))):
                    out[name].append(x)
            return shared.rows(_RUN, **out)

        for batch in batches:
            for at in range(0, batch.num_rows, run_rows):
                part = batch.slice(at, run_rows)
                if n and n + part.num_rows > run_rows:
                    yield run()
                    held, n, number = [], 0, number + 1
                held.append(part)
                n += part.num_rows
        if n:
            yield run()

    return make


class _Piece:
    """A piece of a run: its keys one by one, and the rows of the batch that is open."""

    def __init__(self, blob: bytes) -> None:
        self.blob = blob
        self.rows: pa.RecordBatch | None = None
        self.first = 0

    def __iter__(self) -> Iterator[Key]:
        for batch in pa.ipc.open_stream(self.blob):
            self.first += self.rows.num_rows if self.rows is not None else 0
            self.rows = batch
            yield from _keys(batch)


def _merge(before: dict[int, int], carry: dict[int, tuple[str, int]]):
    """``before``: rows of earlier ranges; ``carry``: a URL and its captures in earlier ranges."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((run, piece) for b in batches for run, piece in zip(b.column("run").to_pylist(), b.column("piece").to_pylist()))
        pieces = [_Piece(piece) for _, piece in found]
        del found
        r = key[0].as_py()
        position = before[r]
        url, nth = carry.get(r, (None, 0))
        opened: list[pa.RecordBatch] = []  # batches that waiting rows are in
        place = [(-1, 0)] * len(pieces)  # by piece: its open batch's first row, and where that is in ``opened``
        size = 0
        waiting: list[int] = []

        def give() -> pa.RecordBatch:
            nonlocal position, url, nth, opened, size, waiting
            table = pa.Table.from_batches(opened).take(pa.array(waiting, pa.int64())).combine_chunks()
            urls, capture = table.column("url_key").to_pylist(), []
            for u in urls:
                nth = nth + 1 if u == url else 1
                url = u
                capture.append(nth)
            whole = lambda c: table.column(c).combine_chunks()
            out = shared.rows(_OUT, position=position + np.arange(1, len(urls) + 1), capture=capture, **{c: whole(c) for c in _ROW.names})
            position, opened, size, waiting = position + len(urls), [], 0, []
            place[:] = [(-1, 0)] * len(pieces)
            return out

        # a piece opens its next batch when the tree asks for its next key, so a row is noted before that
        for w, at in LoserTree(pieces):
            piece = pieces[w]
            if place[w][0] != piece.first:
                place[w] = (piece.first, size)
                opened.append(piece.rows)
                size += piece.rows.num_rows
            waiting.append(place[w][1] + at - piece.first)
            if len(waiting) >= _OUT_ROWS:
                yield give()
        if waiting:
            yield give()

    return merge


def merged_index(found: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(position, url_key, ts, capture, id, length, digest) of captures: ``position`` is the global
    place by (url_key, ts, id), ``capture`` the place in its URL's history, both from 1."""
    spark = found.sparkSession
    total = found.count()
    ranges = max(1, min(total // range_rows, MOST_RANGES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // least_rows))
    every = max(1, total // (ranges * SAMPLES))
    sample = found.select("url_key", F.coalesce("ts", F.lit(_LEAST)), F.coalesce("id", F.lit(_LEAST))).where(F.pmod(F.xxhash64("url_key", "ts", "id"), F.lit(every)) == 0) if ranges > 1 else None
    keys = sorted(map(tuple, sample.collect())) if sample is not None else []
    splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    runs = shared.store(found.select(*_ROW.names).mapInArrow(_make_runs(splitters, run_rows), "range int, run long, n long, tail long, piece binary"), "runs")
    rows = {r[0]: (r[1], r[2]) for r in runs.groupBy("range").agg(F.sum("n"), F.sum("tail")).collect()}
    before, carry, n = {}, {}, 0
    for r in range(len(splitters) + 1):
        before[r] = n
        n += rows.get(r, (0, 0))[0]
        if r:
            url = splitters[r - 1][0]
            known = carry.get(r - 1, ("", 0))
            carry[r] = (url, rows.get(r - 1, (0, 0))[1] + (known[1] if known[0] == url else 0))
    # partitions by the order of the ranges, so that the result's files are in order too
    return runs.repartitionByRange("range").groupBy("range").applyInArrow(_merge(before, carry), _OUT_DDL)
