"""Benchmark decontamination: n-grams of test items looked up in every training window.

The normalised n-grams of the benchmark become sorted arrays of hashes, which are
broadcast.  Each window of a document's words is looked up by its hash; a hit is
verified word for word against the item.  Windows that hit merge into spans, which
are cut out; a document with a larger share of such words goes as a whole.  The
documents aren't shuffled.

Executors build the arrays in slices of about ``slice_bytes`` bytes, which hold an
item's words once and address its n-grams in them.  Up to ``broadcast_bytes`` bytes,
as built, all slices are broadcast.  More stay in the shared folder, and a task reads
one after another for each ``HELD_BYTES`` bytes of its texts; the result is the same.

Words are those of ``wordhash`` kind "plain".  An item with fewer words than
``width`` is one n-gram of all its words; one with fewer than ``min_words`` is too
common a phrase to accuse a document and is left out.

Defined results: null texts are empty and stay null; null items have no n-gram;
an empty benchmark finds nothing; rows without a doc_id are cleaned like others,
but spans are not listed for them; every row is judged on its own text, so repeated
rows have the same result each; other columns, whatever their names, stay.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared, wordhash
from pageloom.llm.postings import BYTES_PER_WORD, runs

WIDTH = 13
MIN_WORDS = 5
#: Share of its words from which a contaminated document goes as a whole.
DROP_SHARE = 0.5
#: Bytes of n-grams that are broadcast, and in one slice.
BROADCAST_BYTES = 64 << 20
SLICE_BYTES = 32 << 20
#: Bytes of texts that a task holds while it reads the slices of a large benchmark.
HELD_BYTES = 32 << 20
#: Words of an item that are in one piece; the pieces of a longer one overlap.
ITEM_WORDS = 20_000
#: About the bytes of a slice for each word of an item.
_BYTES_PER_GRAM = 33

_PIECES = pa.schema([("slice", pa.int32()), ("item_id", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])
_BUILT = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("grams", pa.int64())])


class Grams:
    """The n-grams of a slice: sorted hashes, where each one's words are in ``text`` (between single spaces), its number of words, and its items."""

    _HEAD = struct.Struct("<4q")

    def __init__(self, blob: bytes) -> None:
        n, words, items, size = self._HEAD.unpack_from(blob)
        at = self._HEAD.size

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.hashes, self.of_item, self.items = take(np.uint64, n), take(np.int64, n + 1), take(np.int64, items)
        self.first, self.place, self.sizes = take(np.uint32, n), take(np.uint32, words + 1), take(np.uint8, n)
        self.text = memoryview(blob)[at : at + size]

    @classmethod
    def pack(cls, hashes: np.ndarray, of_item: np.ndarray, items: np.ndarray, first: np.ndarray, place: np.ndarray, sizes: np.ndarray, text: bytes) -> bytes:
        head = cls._HEAD.pack(len(hashes), len(place) - 1, len(items), len(text))
        kinds = (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint8)
        return head + b"".join(x.astype(k).tobytes() for x, k in zip((hashes, of_item, items, first, place, sizes), kinds)) + text

    def words(self, k: int) -> memoryview:
        first = int(self.first[k])
        return self.text[int(self.place[first]) : int(self.place[first + int(self.sizes[k])]) - 1]

    def items_of(self, k: int) -> list[int]:
        return self.items[self.of_item[k] : self.of_item[k + 1]].tolist()


def _cut_items(width: int, min_words: int, slices: int, item_words: int):
    """An item's normalised words, in pieces that hold each of its n-grams once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch):
                w = wordhash.words(part.column("text"), "plain")
                raw, found = w.data.tobytes(), []
                for item, a, b in zip(part.column("item_id").to_pylist(), w.doc, w.doc[1:]):
                    if (n := min(int(b - a), width)) < min_words:
                        continue
                    for i in range(int(a), int(b) - n + 1, item_words):
                        j = min(i + item_words + n - 1, int(b))
                        words = b" ".join([raw[x:y] for x, y in zip(w.starts[i:j].tolist(), w.ends[i:j].tolist())])
                        found.append((int((int(w.hashes[i]) + (item ^ i)) % slices), item, n, words))
                if found:
                    yield shared.rows(_PIECES, **dict(zip(_PIECES.names, map(list, zip(*found)))))

    return cut


def _build(folder: str):
    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        texts, items, sizes = group.column("words").to_pylist(), group.column("item_id").to_numpy(), group.column("n").to_numpy()
        text = b" ".join(texts) + b" "
        w = wordhash.words(pa.array(texts, pa.binary()).cast(pa.string()), "space")
        begin = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        place = np.append(w.starts + np.arange(len(texts)).repeat(w.counts()), begin[-1])
        found = [(h, at, np.searchsorted(w.doc, at, "right") - 1, n) for n in np.unique(sizes) for h, at in [wordhash.windows(w.hashes, w.doc, int(n))]]
        found = [(h[mine], at[mine], row[mine], n) for h, at, row, n in found for mine in [sizes[row] == n]]
        hashes, first, row = (np.concatenate([f[k] for f in found]) for k in range(3))
        n = np.repeat([f[3] for f in found], [len(f[0]) for f in found])
        # an item once for each n-gram that it has, and each n-gram once: the same hash and size with other words stays apart
        raw = memoryview(text)
        order = np.lexsort((first, items[row], n, hashes))
        hashes, first, row, n = hashes[order], first[order], row[order], n[order]
        words = lambda k: raw[int(place[first[k]]) : int(place[first[k] + n[k]]) - 1]
        cuts = runs(hashes)
        kept: list[tuple[int, list[int]]] = []
        for a, b in zip(cuts, cuts[1:]):
            mine: list[tuple[int, list[int]]] = []
            for k in range(a, b):
                item = int(items[row[k]])
                same = next((m for m in mine if n[m[0]] == n[k] and words(m[0]) == words(k)), None)
                if same is None:
                    mine.append((k, [item]))
                elif same[1][-1] != item:
                    same[1].append(item)
            kept += mine
        at = np.array([k for k, _ in kept], np.int64)
        blob = Grams.pack(hashes[at], np.append(0, np.cumsum([len(x) for _, x in kept])), np.array([i for _, x in kept for i in x], np.int64), first[at], place, n[at], text)
        path = f"{folder}/{key[0].as_py()}-{uuid.uuid4().hex}"
        where, local = shared.file_system(path)
        with where.open_output_stream(local) as f:
            f.write(blob)
        return pa.Table.from_batches([shared.rows(_BUILT, path=[path], bytes=[len(blob)], grams=[len(at)])], _BUILT)

    return build


def _load(path: str) -> Grams:
    where, local = shared.file_system(path)
    with where.open_input_stream(local) as f:
        return Grams(f.read())


class _Benchmark:
    """The slices of n-grams, on the driver and in tasks."""

    def __init__(self, benchmark: DataFrame, width: int, min_words: int, broadcast_bytes: int, slice_bytes: int) -> None:
        spark = benchmark.sparkSession
        items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slices = shared.buckets_for(size // BYTES_PER_WORD * _BYTES_PER_GRAM, slice_bytes)
        pieces = items.mapInArrow(shared.freed(_cut_items(width, min_words, slices, ITEM_WORDS)), "slice int, item_id long, n int, words binary")
        built = shared.store(pieces.groupBy("slice").applyInArrow(shared.freed(_build(shared.own_folder(spark, "grams"))), "path string, bytes long, grams long"), "slices")
        self.built = [tuple(r) for r in built.orderBy("path").collect()]
        shared.discard(built)
        paths = [path for path, *_ in self.built]
        self.paths = None if sum(n for _, n, _ in self.built) <= broadcast_bytes else paths
        self.held = spark.sparkContext.broadcast([bytes(_load(p).text.obj) for p in paths]) if self.paths is None else None
        self.ready: list[Grams] = []
        self.held_bytes = HELD_BYTES

    def __getstate__(self) -> dict:
        return {"paths": self.paths, "held": self.held, "held_bytes": self.held_bytes, "ready": []}

    def hits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, wordhash.Words, dict[int, list[tuple[int, int, set[int]]]]]]:
        """Parts of batches, their words, and by text the spans."""
        waiting, size = [], 0
        for batch in batches:
            for part in wordhash.slices(batch):
                if self.paths is None:
                    yield from self._found([part])
                    continue
                waiting.append(part)
                size += part.column("text").nbytes
                if size >= self.held_bytes:
                    yield from self._found(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from self._found(waiting)

    def _slices(self) -> Iterator[Grams]:
        if self.paths is None:
            if not self.ready:
                self.ready = list(map(Grams, self.held.value))
            return iter(self.ready)
        return map(_load, self.paths)

    def _found(self, parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        words = [wordhash.words(p.column("text"), "plain") for p in parts]
        raw = [w.data.tobytes() for w in words]
        hits: list[dict[tuple[int, int, int], set[int]]] = [{} for _ in parts]
        for grams in self._slices():
            for w, r, out in zip(words, raw, hits):
                _look_up(grams, w, r, out)
        for part, w, out in zip(parts, words, hits):
            yield part, w, _spans(sorted(out.items()))


def _look_up(grams: Grams, w: wordhash.Words, raw: bytes, out: dict[tuple[int, int, int], set[int]]) -> None:
    """Adds the verified hits: by (text, first word, end word) the items."""
    for n in np.unique(grams.sizes).tolist():
        found, at = wordhash.windows(w.hashes, w.doc, n)
        low = np.searchsorted(grams.hashes, found)
        hit = np.flatnonzero(grams.hashes[np.minimum(low, len(grams.hashes) - 1)] == found)
        row = np.searchsorted(w.doc, at[hit], "right") - 1
        for h, i, k, r in zip(found[hit], at[hit].tolist(), low[hit].tolist(), row.tolist()):
            mine = b" ".join([raw[a:b] for a, b in zip(w.starts[i : i + n].tolist(), w.ends[i : i + n].tolist())])
            while k < len(grams.hashes) and grams.hashes[k] == h:
                if grams.sizes[k] == n and grams.words(k) == mine:
                    first = i - int(w.doc[r])
                    out.setdefault((r, first, first + n), set()).update(grams.items_of(k))
                k += 1


def _spans(hits: list[tuple[tuple[int, int, int], set[int]]]) -> dict[int, list[tuple[int, int, set[int]]]]:
    """By text: windows that overlap, merged, with the items they are from."""
    out: dict[int, list[tuple[int, int, set[int]]]] = {}
    for (r, a, b), items in hits:
        mine = out.setdefault(r, [])
        if mine and a < mine[-1][1]:
            mine[-1] = (mine[-1][0], max(b, mine[-1][1]), mine[-1][2] | items)
        else:
            mine.append((a, b, items))
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("items", pa.list_(pa.int64())), ("action", pa.string())])


def _goes(spans: list[tuple[int, int, set[int]]], n_words: int, share: float) -> bool:
    return sum(b - a for a, b, _ in spans) >= share * n_words


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(doc_id, first_word, end_word, items, action) of every span; ``action`` is "remove_document" if the
    document's spans hold at least ``drop_share`` of its words, else "remove_span"."""
    items = _Benchmark(benchmark, width, min_words, broadcast_bytes, slice_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, spans in items.hits(batches):
            counts, ids = w.counts(), part.column("doc_id").to_numpy()
            found = [(int(ids[r]), a, b, sorted(own), "remove_document" if _goes(s, counts[r], drop_share) else "remove_span") for r, s in spans.items() for a, b, own in s]
            if found:
                yield shared.rows(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*found)))))

    return shared.core(docs, "doc_id", "text").mapInArrow(shared.freed(scan), "doc_id long, first_word long, end_word long, items array<long>, action string")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``docs`` without the documents that go as a whole, and without the spans of the others."""
    items = _Benchmark(benchmark, width, min_words, broadcast_bytes, slice_bytes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, found in items.hits(batches):
            if not found:
                yield part
                continue
            counts, texts, stays = w.counts(), part.column("text").to_pylist(), np.ones(part.num_rows, bool)
            for r, spans in found.items():
                stays[r] = not _goes(spans, counts[r], drop_share)
                raw = texts[r].encode()
                for a, b, _ in reversed(spans):
                    first, end = w.starts[w.doc[r] + a] - w.offsets[r], w.ends[w.doc[r] + b - 1] - w.offsets[r]
                    raw = raw[:first] + raw[end:]
                texts[r] = raw.decode()
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(n).type) if n == "text" else part.column(n) for n in names], names).filter(pa.array(stays))

    return docs.mapInArrow(shared.freed(clean), docs.schema)
