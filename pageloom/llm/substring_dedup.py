"""Substring dedup: repeated windows of words, found by rolling hashes.

Every window of ``width`` words gets a Rabin-Karp hash.  The hashes are dealt
into buckets and packed (8 bytes a window and about one for its place), so that
the shuffle carries arrays and not a row for each window; each bucket is counted
on its own.  Of the windows that a task meets more than once in a slice of texts
only the first goes to the bucket, marked as repeated; the others are known to be
repeats, so that a passage of very many documents fills no bucket.  Windows that occur more than once, in one text or in several, merge
into maximal intervals of each document.

Words are those of ``wordhash`` kind "plain": lower-cased letters and digits.
Hashes have 64 bits; two different windows are taken for the same with a
probability of about n**2 / 2**65 for n windows.

Defined results: null texts are empty; texts of fewer than ``width`` words have
no window; rows without a doc_id are left out of the intervals and keep their
text in ``remove_repeats``; rows that share a doc_id and its text count once; an
empty table gives an empty result; columns other than doc_id and text don't
matter and come back from ``remove_repeats`` as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared, wordhash
from pageloom.llm.postings import BUCKET, bucket_of, chunk_of, estimated_words, read, read_squeezed, runs, squeeze, stable_order, unsqueeze

WIDTH = 50

_PACKED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("many", pa.binary()), ("known_docs", pa.binary()), ("known_places", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("first", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64())])


def _pack(width: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, limit=6 << 20):
                part = part.take(pa.array(np.argsort(part.column("doc_id").to_numpy(), kind="stable")))
                w = wordhash.words(part.column("text"), "plain")
                hashes, at = wordhash.windows(w.hashes, w.doc, width)
                if not len(at):
                    continue
                doc = np.searchsorted(w.doc, at, "right") - 1
                place = at - w.doc[doc]
                ids = part.column("doc_id").to_numpy()
                order = wordhash.order_of(hashes) if (ids[1:] != ids[:-1]).all() else np.lexsort((place, ids[doc], hashes))
                again = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
                many, stays = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
                twice = np.append(False, (ids[doc[order[1:]]] == ids[doc[order[:-1]]]) & (place[order[1:]] == place[order[:-1]]) & again[1:])
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
                many[order[first[again & ~twice]]] = True
                stays[order[again]] = False
                known = order[again & ~twice]
                known = known[np.lexsort((place[known], ids[doc[known]]))]
                known_docs, known_places = squeeze(np.diff(ids[doc[known]], prepend=0)), place[known].astype(np.uint32).tobytes()
                hashes, doc, place, many = hashes[stays], doc[stays], place[stays], many[stays]
                bucket = bucket_of(hashes, buckets)
                order = stable_order(bucket, buckets)
                hashes, doc, place, many, bucket = hashes[order], doc[order], place[order], many[order], bucket[order]
                out: dict[str, list] = {n: [] for n in _PACKED.names}
                cuts = runs(bucket)
                for a, b in zip(cuts, cuts[1:]):
                    d, p = doc[a:b], place[a:b]
                    r = runs(d)
                    step = np.diff(p, prepend=0)
                    step[r[:-1]] = p[r[:-1]]
                    for name, x in zip(out, (int(bucket[a]), hashes[a:b].tobytes(), squeeze(step), ids[d[r[:-1]]].tobytes(), np.diff(r).astype(np.uint32).tobytes(), np.packbits(many[a:b]).tobytes(), known_docs, known_places)):
                        out[name].append(x)
                    known_docs, known_places = squeeze(ids[:0]), b""
                yield shared.rows(_PACKED, **out)

    return pack


def _places(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each run."""
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def _count(chunks: int):
    def count(key: tuple, group: pa.Table) -> pa.Table:
        hashes, ids, counts = read(group, "hashes", np.uint64), read(group, "docs", np.int64), read(group, "counts", np.uint32).astype(np.int64)
        steps = np.concatenate([unsqueeze(x) for x in group.column("places").to_pylist()])
        place = _places(steps, counts)
        sizes = [len(x.as_buffer()) // 8 for x in group.column("hashes")]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(group.column("many"), sizes)]).view(bool)
        entries = np.lexsort((place[np.cumsum(counts) - counts], ids))
        n = counts[entries]
        take = np.repeat((np.cumsum(counts) - counts)[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        del steps
        hashes, place, many = hashes[take], place[take].astype(np.uint32), many[take]
        del take
        doc = np.repeat(ids[entries], n)
        order = wordhash.order_of(hashes)
        hashes = hashes[order]
        same = np.zeros(len(hashes) + 1, bool)
        same[1:-1] = hashes[1:] == hashes[:-1]
        kept = same[1:] | same[:-1] | many[order]
        order, hashes = order[kept], hashes[kept]
        doc, place, many = doc[order], place[order], many[order]
        if ((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] < place[:-1])).any():  # several texts have one doc_id
            order = np.lexsort((place, doc, hashes))
            hashes, doc, place, many = hashes[order], doc[order], place[order], many[order]
        r = runs(hashes)
        repeated = np.repeat(np.logical_or.reduceat(many, r[:-1]) if len(many) else many, np.diff(r))
        first = np.zeros(len(hashes), bool)
        first[r[:-1]] = True
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        hashes, doc, place, first, repeated = hashes[fresh], doc[fresh], place[fresh], first[fresh], repeated[fresh]
        n = np.diff(runs(hashes))
        repeated |= np.repeat(n > 1, n)
        known = read_squeezed(group, "known_docs", steps=True)
        doc = np.concatenate([doc[repeated], known])
        place = np.concatenate([place[repeated], read(group, "known_places", np.uint32)])
        first = np.append(first[repeated], np.zeros(len(known), bool))
        chunk = chunk_of(doc, chunks)
        order = np.lexsort((place, doc, chunk))
        doc, place, first, chunk = doc[order], place[order], first[order], chunk[order]
        cuts = runs(chunk)
        pairs = list(zip(cuts, cuts[1:]))
        blob = lambda x: [x[a:b].tobytes() for a, b in pairs]
        return pa.Table.from_batches([shared.rows(_FOUND, chunk=chunk[cuts[:-1]], docs=blob(doc), places=blob(place), first=blob(first))], _FOUND)

    return count


def _merge(width: int):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        doc, place, first = read(group, "docs", np.int64), read(group, "places", np.uint32).astype(np.int64), read(group, "first", np.bool_)
        order = np.lexsort((place, first, doc))
        doc, place, first = doc[order], place[order], first[order]
        begins = np.ones(len(doc), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (place[1:] > place[:-1] + width)
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(doc)) - 1
        a, b = place[at], place[last] + width
        return pa.Table.from_batches([shared.rows(_SPANS, doc_id=doc[at], kind=np.where(first[at], "source", "remove").tolist(), first_word=a, end_word=b, n_words=b - a)], _SPANS)

    return merge


def repeated_intervals(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, kind, first_word, end_word, n_words): maximal runs of repeated windows.

    ``kind`` is "remove" for windows that occurred before, in a smaller doc_id or
    earlier in the same text, and "source" for first occurrences.  ``end_word`` is
    the word after the last one.  Every word of a "remove" interval lies in a
    window that is a first occurrence somewhere else.
    """
    docs = shared.core(docs, "doc_id", "text")
    buckets = shared.buckets_for(estimated_words(docs), bucket)
    packed = docs.mapInArrow(_pack(width, buckets), "bucket int, hashes binary, places binary, docs binary, counts binary, many binary, known_docs binary, known_places binary")
    found = packed.groupBy("bucket").applyInArrow(_count(buckets), "chunk int, docs binary, places binary, first binary")
    return found.groupBy("chunk").applyInArrow(_merge(width), "doc_id long, kind string, first_word long, end_word long, n_words long")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents, all columns, without the words of ``spans`` (doc_id, first_word, end_word: in "plain"
    words, not overlapping) and the separators inside those."""
    at = shared.free_name("cut_at", docs)
    key = shared.free_name("cut_doc", docs)
    gone = spans.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias(at))
    both = docs.join(gone, docs["doc_id"] == gone[key], "left").drop(key)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch):
                cuts = part.column(at).to_pylist()
                texts = part.column("text").to_pylist()
                some = [i for i, c in enumerate(cuts) if c and texts[i]]
                w = wordhash.words(pa.array([texts[i] for i in some], pa.string()), "plain")
                for k, i in enumerate(some):
                    raw, base = texts[i].encode(), w.offsets[k]
                    for s in reversed(cuts[i]):
                        a, b = w.starts[w.doc[k] + s["first_word"]] - base, w.ends[w.doc[k] + s["end_word"] - 1] - base
                        raw = raw[:a] + raw[b:]
                    texts[i] = raw.decode()
                names = [n for n in part.schema.names if n != at]
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(n).type) if n == "text" else part.column(n) for n in names], names)

    return both.mapInArrow(strip, docs.schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """The documents, all columns, without the words of their "remove" intervals."""
    shared_ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most")).where("least <> most").select("doc_id")
    if not shared_ids.take(1):
        return cut_spans(docs, repeated_intervals(docs, width, bucket).where("kind = 'remove'"))
    # texts that share a doc_id get one of their own meanwhile
    mark, old = shared.free_name("several", docs), shared.free_name("old_doc_id", docs)
    several = shared_ids.select(F.col("doc_id").alias(mark))
    own = docs.join(several, docs["doc_id"] == several[mark], "left").withColumn(old, F.col("doc_id"))
    own = shared.store(own.withColumn("doc_id", F.when(F.col(mark).isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))).drop(mark), "own")
    out = cut_spans(own, repeated_intervals(own, width, bucket).where("kind = 'remove'"))
    return out.withColumn("doc_id", F.col(old).cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
