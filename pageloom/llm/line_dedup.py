"""Line dedup by two Bloom filters: every line stays only where it occurs first.

1. Each task hashes its lines; only the hashes (8 bytes a line) go to the
   segments of the hash space.  A segment's task puts hashes into a filter of
   those seen once; one that is there already goes into a second filter, of those
   seen twice.
2. Lines that the second filter knows are suspected repeats.  Only these are
   shuffled with their text, which confirms them exactly and gives the first
   occurrence, the least (doc_id, line number).
3. The numbers of the first ones go back to where their documents are read: they
   are written to the shared folder by the split of ``docs`` that each document was
   met in, and a task that reads a split again takes its own list.  The texts are
   never moved.  A document that isn't in its split's list, since splits were cut
   in another way meanwhile, is looked up in the whole table.
4. A suspected line that is no first occurrence goes.  What a filter suspects
   wrongly is its own first occurrence and stays, so the result is exact.

The second filters hold repeated lines only.  Up to ``broadcast_limit`` bytes they
are broadcast; beyond that, packed hashes and places of all lines go to the
segments instead, each is looked up where its filter is, and the numbers of the
suspects go back by split as above.

Lines end at ``\\n``.  Defined results: lines of nothing but white space always
stay; null texts stay null; rows without a doc_id stay as they are, and their
lines don't count; rows that share a doc_id are one document (repeated rows all
keep what is first in it); a text that loses all its lines becomes empty; an empty
table gives an empty table; other columns, whatever their names, come back as
they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import shared, wordhash
from pageloom.llm.postings import bucket_of, read, runs, stable_order

#: Line hashes in one segment.
SEGMENT = 2_000_000
BITS_PER_LINE = 12
PROBES = 6
#: Bytes of filters that a task holds; they are tested as they are, a bit for a bit.
BROADCAST_LIMIT = 64 << 20
#: Splits whose lists are in one folder.
SPLITS = 32


class Bloom:
    """A Bloom filter over 64-bit hashes; its size is a power of two of bits.

    One that is filled has a byte a bit, one read by ``from_bytes`` a bit a bit.
    """

    def __init__(self, expected: int) -> None:
        self.size = 1 << max(10, (expected * BITS_PER_LINE - 1).bit_length())
        self.bits: np.ndarray | None = np.zeros(self.size, bool)
        self.packed: np.ndarray | None = None

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(self.size - 1)
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        at = wordhash.mix(hashes)
        for _ in range(PROBES):
            yield (at & mask).view(np.int64)
            at = at + step

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            self.bits[at] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= self.bits[at] if self.packed is None else (self.packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return out

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Bloom:
        out = cls(0)
        out.bits, out.packed, out.size = None, np.frombuffer(blob, np.uint8), 8 * len(blob)
        return out


class Lines:
    """The lines of a column of texts that aren't blank: byte ranges, hashes, owners and numbers in their text."""

    def __init__(self, array: pa.Array) -> None:
        self.data, offsets = wordhash.text_bytes(array)
        self.offsets = offsets
        breaks = np.flatnonzero(self.data == 10)
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        starts = np.sort(np.concatenate([breaks + 1, offsets[:-1][some]]))
        ends = np.sort(np.concatenate([breaks, offsets[1:][some]]))
        owner = some[np.searchsorted(offsets[1:][some], ends, "left")] if len(some) else np.zeros(0, np.int64)
        number = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
        ink = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~wordhash._SPACE[self.data], out=ink[1:])
        full = ink[ends] > ink[starts]
        self.starts, self.ends, self.owner, self.number = starts[full], ends[full], owner[full], number[full]
        self.hashes = wordhash.hash_ranges(self.data, self.starts, self.ends)


_HASHES = pa.schema([("segment", pa.int32()), ("hashes", pa.binary())])


def _send(segments: int):
    """At most two of each hash from a slice: more can't change a filter."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, limit=16 << 20):
                h = np.sort(Lines(part.column("text")).hashes)
                third = np.zeros(len(h), bool)
                third[2:] = h[2:] == h[:-2]
                h = h[~third]
                segment = bucket_of(h, segments)
                cuts = runs(segment)
                if len(h):
                    yield shared.rows(_HASHES, segment=segment[cuts[:-1]], hashes=[h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    return send


def seen_twice(parts: list[np.ndarray]) -> np.ndarray:
    """The hashes that the filter of once-seen ones already knew, each once."""
    once, twice = Bloom(sum(map(len, parts))), []
    for h in parts:
        h, n = np.unique(h, return_counts=True)
        twice.append(h[(n > 1) | once.has(h)])
        once.add(h)
    return np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)


def _filters(key: tuple, group: pa.Table) -> pa.Table:
    twice = seen_twice([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")])
    bloom = Bloom(len(twice))
    bloom.add(twice)
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([bloom.to_bytes()], pa.binary())})


def _suspected(filters: dict[int, Bloom], segments: int, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), bool)
    segment = bucket_of(hashes, segments)
    order = stable_order(segment, segments)
    cuts = runs(segment[order])
    for a, b in zip(cuts, cuts[1:]):
        at = order[a:b]
        if bloom := filters.get(int(segment[at[0]])):
            out[at] = bloom.has(hashes[at])
    return out


_PLACED = pa.schema([("segment", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("numbers", pa.binary())])
_NUMBERS = pa.schema([("doc_id", pa.int64()), ("number", pa.int32())])


def _send_places(segments: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, limit=16 << 20):
                x = Lines(part.column("text"))
                ids = part.column("doc_id").to_numpy()[x.owner]
                segment = bucket_of(x.hashes, segments)
                order = stable_order(segment, segments)
                cuts = runs(segment[order])
                blob = lambda v: [v[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B023, E731
                if len(order):
                    yield shared.rows(_PLACED, segment=segment[order][cuts[:-1]], hashes=blob(x.hashes), docs=blob(ids), numbers=blob(x.number.astype(np.int32)))

    return send


def _look_up(key: tuple, places: pa.Table, filters: pa.Table) -> pa.Table:
    docs, numbers, hashes = read(places, "docs", np.int64), read(places, "numbers", np.int32), read(places, "hashes", np.uint64)
    hit = np.zeros(len(docs), bool)
    for blob in filters.column("filter").to_pylist():
        hit |= Bloom.from_bytes(blob).has(hashes)
    return pa.Table.from_batches([shared.rows(_NUMBERS, doc_id=docs[hit], number=numbers[hit])], _NUMBERS)


class _LineNumbers:
    """Line numbers of documents, which a task reads for the split that it works on."""

    def __init__(self, homes: DataFrame, numbers: DataFrame) -> None:
        """``homes`` has the split of every document asked for, ``numbers`` its line numbers, if any."""
        lists = homes.join(numbers, "doc_id", "left").groupBy("split", "doc_id").agg(F.collect_list("number").alias("numbers"))
        lists = lists.withColumn("part", (F.col("split") / SPLITS).cast("int"))
        self.path = shared.own_folder(homes.sparkSession, "lines") + "/lists"
        lists.repartition("part").sortWithinPartitions("split", "doc_id").write.partitionBy("part").parquet(self.path)
        self.split: int | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "split": None}

    def _read(self, folder: str, what: ds.Expression) -> tuple[np.ndarray, np.ndarray]:
        where, path = shared.file_system(self.path + folder)
        if where.get_file_info(path).type.name != "Directory":
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        files = ds.dataset(path, format="parquet", filesystem=where)
        if not files.files:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = files.to_table(columns=["doc_id", "numbers"], filter=what).combine_chunks()
        docs = found.column("doc_id").to_numpy()
        sizes = found.column("numbers").combine_chunks().value_lengths().to_numpy()
        values = found.column("numbers").combine_chunks().flatten().to_numpy().astype(np.int64)
        return docs, np.stack([np.repeat(docs, sizes), values], 1) if len(values) else np.zeros((0, 2), np.int64)

    def has(self, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which of these lines are listed."""
        if (split := TaskContext.get().partitionId()) != self.split:
            self.split = split
            self._keep(*self._read(f"/part={split // SPLITS}", ds.field("split") == split))
        if len(ids) and len(missing := np.setdiff1d(ids, self.known)):
            docs, lines = self._read("", ds.field("doc_id").isin(pa.array(missing)))
            self._keep(np.concatenate([self.known, missing, docs]), np.concatenate([self.lines, lines]) if len(lines) else self.lines)
        at = np.searchsorted(self.known, ids)
        return np.isin(at << 32 | numbers, self.listed)

    def _keep(self, docs: np.ndarray, lines: np.ndarray) -> None:
        self.known, self.lines = np.unique(docs), lines.reshape(-1, 2)
        self.listed = np.searchsorted(self.known, self.lines[:, 0]) << 32 | self.lines[:, 1]


_LINE = pa.schema([("split", pa.int32()), ("doc_id", pa.int64()), ("number", pa.int32()), ("line", pa.binary())])

#: Of hashes, doc_ids and numbers of lines: which are suspected.
Suspects = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _occurrences(suspects: Suspects):
    """The suspected lines with their text, the first of each text and slice only (others can't be first);
    and a row without a line for each document that has any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TaskContext.get().partitionId()
        for batch in batches:
            for part in wordhash.slices(batch, limit=16 << 20):
                x = Lines(part.column("text"))
                ids = part.column("doc_id").to_numpy()
                at = np.flatnonzero(suspects(x.hashes, ids[x.owner], x.number))
                first: dict[bytes, tuple[int, int]] = {}
                raw = x.data.tobytes()
                for a, b, d, n in zip(x.starts[at].tolist(), x.ends[at].tolist(), ids[x.owner[at]].tolist(), x.number[at].tolist()):
                    if (old := first.get(line := raw[a:b])) is None or (d, n) < old:
                        first[line] = (d, n)
                if first:
                    homes = np.unique(ids[x.owner[at]]).tolist()
                    none = [None] * len(homes)
                    yield shared.rows(_LINE, split=[split] * (len(first) + len(homes)), doc_id=[*(d for d, _ in first.values()), *homes], number=[*(n for _, n in first.values()), *none], line=[*first, *none])

    return find


def dedup_lines(docs: DataFrame, segment: int = SEGMENT, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with only the first occurrence of every line, and ``lines_removed`` (int) beside its columns.

    If ``docs`` has a column of that name, the new one's has leading underscores.
    """
    spark = docs.sparkSession
    own = shared.core(docs, "doc_id", "text")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    segments = shared.buckets_for(own.agg(F.sum(breaks)).first()[0] or 0, segment)
    filters = shared.store(own.mapInArrow(shared.freed(_send(segments)), "segment int, hashes binary").groupBy("segment").applyInArrow(shared.freed(_filters), "segment int, filter binary"), "filters")
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= broadcast_limit:
        held = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in filters.collect()})
        ready: dict[int, Bloom] = {}

        def suspects(hashes: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            if not ready:
                ready.update((k, Bloom.from_bytes(v)) for k, v in held.value.items())
            return _suspected(ready, segments, hashes)
    else:
        places = own.mapInArrow(shared.freed(_send_places(segments)), "segment int, hashes binary, docs binary, numbers binary")
        hits = places.groupBy("segment").cogroup(filters.groupBy("segment")).applyInArrow(shared.freed(_look_up), "doc_id long, number int")
        hit = _LineNumbers(own.select("doc_id", F.spark_partition_id().alias("split")).distinct(), hits)

        def suspects(hashes: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            return hit.has(ids, numbers)

    occurrences = shared.store(own.mapInArrow(shared.freed(_occurrences(suspects)), "split int, doc_id long, number int, line binary"), "suspects")
    firsts = occurrences.where("line IS NOT NULL").groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    homes = occurrences.where("line IS NULL").select("split", "doc_id").distinct()
    kept = _LineNumbers(homes, firsts.select("first.doc_id", "first.number"))
    shared.discard(filters, occurrences)
    names, removed = docs.columns, shared.free_name("lines_removed", docs)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch):
                x = Lines(part.column("text"))
                real = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
                at = np.flatnonzero(real[x.owner])
                at = at[suspects(x.hashes[at], ids[x.owner[at]], x.number[at])]
                at = at[~kept.has(ids[x.owner[at]], x.number[at])]
                count = np.bincount(x.owner[at], minlength=part.num_rows)
                texts = part.column("text")
                if len(at):
                    lost: dict[int, set[int]] = {}
                    for d, n in zip(x.owner[at].tolist(), x.number[at].tolist()):
                        lost.setdefault(d, set()).add(n)
                    new = texts.to_pylist()
                    for d, numbers in lost.items():
                        new[d] = "\n".join(line for n, line in enumerate(new[d].split("\n")) if n not in numbers)
                    texts = pa.array(new, texts.type)
                yield pa.RecordBatch.from_arrays([texts if n == "text" else part.column(n) for n in names] + [pa.array(count, pa.int32())], [*names, removed])

    return docs.mapInArrow(shared.freed(strip), T.StructType([*docs.schema.fields, T.StructField(removed, T.IntegerType())]))
