"""Best-fit packing with conflicts: token bins without two documents of one source or of one duplicate cluster.

Bins of ``capacity`` tokens are kept in the order of their residual.  A piece, the
longest first, looks up the tightest bin that has room and goes on to the successor
until the bin's source and duplicate-cluster bitmaps have neither of its own bits;
if no bin is left, it opens one.  For a source or cluster that more than a
sixteenth of a part's pieces have, the bins without it are also kept in that order by
themselves, so that the search doesn't pass all bins that have it.  Documents are dealt to independent parts of about
``part_tokens`` tokens by a hash of doc_id; only ids, sources, clusters and lengths
are shuffled.

A document longer than ``capacity`` is cut into full pieces, which are bins of their
own, and a rest, which is packed.

Defined results: null, empty and untokenisable texts have no tokens and are in no
bin; a null source or cluster conflicts with nothing; rows without a doc_id are left
out; repeated rows are packed as often as they occur, never into one bin if they have
a source or a cluster; ties go by doc_id and the older bin; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared, wordhash
from pageloom.llm.tokenization import TOKENIZER, shared_tokenizer

CAPACITY = 4096
PART_TOKENS = 8_000_000
#: Pieces of one source or cluster from which its free bins are kept by themselves.
HOT_ITEMS = 64

_ITEMS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("n_tokens", pa.int64())])
_PACKED = pa.schema([("bin", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("bin_tokens", pa.int64())])


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given; ``sources`` and ``clusters`` are bitmaps of at most one bit."""
    order: list[tuple[int, int]] = []  # (residual, bin) ascending
    # by a frequent bit: the same of the bins without it
    without = [{bit: [] for bit, n in Counter(bits).items() if bit and n > max(HOT_ITEMS, len(bits) // 16)} for bits in (sources, clusters)]
    of_source: list[int] = []
    of_cluster: list[int] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters):
        found = min((kind[bit] for kind, bit in zip(without, (source, cluster)) if bit in kind), key=len, default=order)
        k = bisect_left(found, (n, -1))
        while k < len(found) and (of_source[found[k][1]] & source or of_cluster[found[k][1]] & cluster):
            k += 1
        old = found[k] if k < len(found) else None
        residual, at = old or (capacity, len(of_source))
        if old is None:
            of_source.append(0)
            of_cluster.append(0)
        else:
            del order[bisect_left(order, old)]
        if residual > n:
            insort(order, (residual - n, at))
        for kind, own, bit in zip(without, (of_source, of_cluster), (source, cluster)):
            for hot, bins in kind.items():
                if not own[at] & hot:
                    if old is not None:
                        del bins[bisect_left(bins, old)]
                    if residual > n and bit != hot:
                        insort(bins, (residual - n, at))
        of_source[at] |= source
        of_cluster[at] |= cluster
        out.append(at)
    return out


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once; no other can conflict."""
    seen: dict = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    places = {v: 1 << i for i, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [places.get(v, 0) for v in values]


def _pack(capacity: int):
    def pack(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster"))), key=lambda r: (-(r[1] % capacity), r[0], r[1], r[2] or "", r[3] or 0))
        out: list[tuple[int, int, int, int]] = []  # bin, doc_id, first token, tokens
        rest = [r for r in rows if r[1] % capacity]
        bins = best_fit([r[1] % capacity for r in rest], _bits([r[2] for r in rest]), _bits([r[3] for r in rest]), capacity)
        for at, r in zip(bins, rest):
            out.append((at, r[0], r[1] // capacity * capacity, r[1] % capacity))
        free = max(bins, default=-1) + 1
        for r in rows:
            for first in range(0, r[1] // capacity * capacity, capacity):
                out.append((free, r[0], first, capacity))
                free += 1
        at, doc, first, n = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        order = np.argsort(at, kind="stable")
        at, doc, first, n = at[order], doc[order], first[order], n[order]
        begin = np.searchsorted(at, at, "left")
        total = np.bincount(at, n).astype(np.int64)[at] if len(at) else n
        return pa.Table.from_batches([shared.rows(_PACKED, bin=(part << 32) + at, slot=(np.arange(len(at)) - begin).astype(np.int32), doc_id=doc, first_token=first, n_tokens=n, bin_tokens=total)], _PACKED)

    return pack


def measured(docs: DataFrame, tokenizer: str = TOKENIZER, source: str | None = "source", cluster: str | None = None, by_words: bool = True) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): without a column ``cluster`` (long), documents of the same "plain" words are one if ``by_words``, else in none."""
    get = shared_tokenizer(docs.sparkSession, tokenizer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = get()
        for batch in batches:
            for part in wordhash.slices(batch):
                clusters = part.column("cluster")
                if cluster is None and by_words:
                    w = wordhash.words(part.column("text"), "plain")
                    clusters = pa.array(wordhash.whole_texts(w.hashes, w.doc).view(np.int64))
                yield shared.rows(_ITEMS, doc_id=part.column("doc_id"), source=part.column("source"), cluster=clusters, n_tokens=encode.lengths(part.column("text").to_pylist()))

    texts = shared.core(docs, "doc_id", "text", *{c for c in (source, cluster) if c})
    of = lambda c, kind, name: (F.col(c) if c else F.lit(None)).cast(kind).alias(name)
    texts = texts.select("doc_id", of(source, "string", "source"), of(cluster, "long", "cluster"), "text")
    return texts.mapInArrow(shared.freed(measure), "doc_id long, source string, cluster long, n_tokens long")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS, source: str | None = "source", cluster: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(bin, slot, doc_id, first_token, n_tokens, bin_tokens): a row for each document, or piece of a long one.

    ``groups`` (doc_id, group) are the clusters instead; documents in none conflict with nothing but their source.
    """
    items = measured(docs, tokenizer, source, cluster, groups is None).where("n_tokens > 0")
    if groups is not None:
        items = items.drop("cluster").join(groups.select("doc_id", F.col("group").alias("cluster")), "doc_id", "left")
    items = shared.store(items, "items")
    parts = shared.buckets_for(items.agg(F.sum("n_tokens")).first()[0] or 0, part_tokens)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(shared.freed(_pack(capacity)), "bin long, slot int, doc_id long, first_token long, n_tokens long, bin_tokens long")
