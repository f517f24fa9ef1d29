"""N-gram Jaccard join with adaptive multi-match prefixes (Wang, Li and Feng, 2012).

A document is the set of its word n-grams ("shingles").  Ordered from rare to
common, two sets of Jaccard similarity t or more share at least l shingles of
their l-prefixes, the first ``size - ceil(t * size) + l`` ones, for every l.  Each
document takes the l of least estimated cost: candidates are verified only if they
share min(l of the one, l of the other) prefix shingles.  The join is exact.

1. Of the texts with the same set that a task meets together, one goes on for all.
2. Shingle hashes are counted in packed buckets.  Those of one document only come
   first in its prefix and find nothing; the others go back to their documents,
   unless the unique ones fill the prefix, as numbers of 4 to 6 bytes.  Then l is
   chosen, and the sets that are still the same are collapsed into one.
3. Prefix shingles meet in packed buckets; each posting list goes to the leader,
   its least document, so that the lists of a group of near copies come together
   and candidates are counted there.  Lists with the same members count as one of
   their number.  A list of over ``LIST_BLOCK`` documents is cut into blocks, and
   its pairs of blocks are spread.  Documents that lists of over ``HOT`` documents
   connect are a family: where that costs less than the pairs of its lists, its sets
   are compared all with all instead, as products of matrices in tiles, and none of
   its pairs becomes a row.  Pairs across families share no such list.
4. Other candidates are verified by blocks of a leader; a set is sent once to a block,
   however many partners it has there.  A block gives each document's number of
   links and its root within the block, so that pairs needn't be listed.

Words are those of ``wordhash`` kind "plain"; a text of fewer than ``n`` words has
one shingle, all its words.

Defined results: null texts are empty, and texts without words are similar to
nothing; rows without a doc_id are left out of the join and stay in
``drop_near_copies``; rows that share a doc_id are one document with the shingles
of all of them (for repeated rows: of one), and all stay or go together; identical
sets have the similarity 1; an empty table gives an empty result; other columns
don't matter and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared, wordhash
from pageloom.llm.components import components
from pageloom.llm.postings import BUCKET, BYTES_PER_WORD, bucket_of, chunk_of, narrow, read, read_narrow, read_squeezed, runs, squeeze, stable_order, text_size, unsqueeze, widen

N = 3
THRESHOLD = 0.5
#: The longest lengthening of a prefix, l.
LONGEST = 6
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 8.0
#: Pairs of one leader from which they are spread over several tasks.
SPREAD = 2_000_000
#: Documents of a posting list that are paired in one piece.
LIST_BLOCK = 1_000
#: Documents of a posting list above which it is kept whole until it is known whether its documents are compared all with all.
HOT = 100
#: Most sets, and shingles, of a family in one tile, on average.
TILE, TILE_TOKENS = 1_000, 1_000_000
#: Pairs of a family that can be compared for each pair of its lists, and for each pair of its longest list.
PER_EVENT, PER_PAIR = 0.2, 20.0
#: Sets in one block of verification.
BLOCK = 8_000
#: Repeated doc_ids that a task can hold; with more of them texts aren't collapsed where they are read.
MOST_REPEATED = 100_000
#: Pairs made at once in a task.
_EVENTS = 1_000_000
#: Bytes of a hash within its bucket: with buckets of ``BUCKET`` hashes a chance of false matches no greater than that of 64 bits.
_HASH = 7

_PACKED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("copies", pa.binary())])
_COMMON = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("ranks", pa.binary()), ("classes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("copies", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("shared", pa.int32()), ("l", pa.int32()), ("prefix", pa.int32()), ("head", pa.binary()), ("rest", pa.binary()), ("same_as", pa.int64())])
_PREFIX = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("ls", pa.binary())])
_LISTS = pa.schema([("part", pa.int32()), ("leaders", pa.binary()), ("lengths", pa.binary()), ("lefts", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("ls", pa.binary()), ("leader", pa.int64())])
_EDGES = pa.schema([("leader", pa.int64()), ("doc_id", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("need", pa.int32()), ("leader", pa.int64())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
_LINKS = pa.schema([("doc_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.Table.from_batches([shared.rows(schema, **columns)], schema)


def _token_width(total: int) -> int:
    """Bytes that hold the number of any shared shingle of ``total`` bytes of text.

    A shingle needs two bytes of text and a shared one two places, so there are at
    most total / 4; buckets are filled evenly, and a factor of two is left for that.
    """
    return max(4, -(-(total // 2 + 1).bit_length() // 8))


def _same_sets(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text the first one with the same set, by 128 bits of the sets."""
    begin = np.append(0, np.cumsum(size))
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.append(np.zeros(1, np.uint64), np.cumsum(wordhash.mix(hashes ^ np.uint64(salt))))
        sums.append(total[begin[1:]] - total[begin[:-1]])
    order = np.lexsort((np.arange(len(size)), sums[1], sums[0], size))
    new = np.ones(len(size), bool)
    for x in (size, *sums):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    first = np.empty(len(size), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(size))))
    return first


def _pack(n: int, buckets: int, repeated: np.ndarray | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, limit=4 << 20):
                part = part.take(pa.array(np.argsort(part.column("doc_id").to_numpy(), kind="stable")))
                w = wordhash.words(part.column("text"), "plain")
                hashes, doc = wordhash.shingles(w.hashes, w.doc, n)
                size = np.bincount(doc, minlength=part.num_rows)
                ids = part.column("doc_id").to_numpy()
                copies = b""
                if repeated is not None:
                    first = _same_sets(hashes, doc, size)
                    goes = (first != np.arange(len(ids))) & (size > 0) & ~np.isin(ids, repeated) & ~np.isin(ids[first], repeated)
                    copies = np.stack([ids[goes], ids[first[goes]]], 1).tobytes()
                    stays = ~goes[doc]
                    hashes, doc = hashes[stays], doc[stays]
                bucket = bucket_of(hashes, buckets)
                # a text's size goes to one bucket only, that of its first hash
                opens = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
                order = stable_order(bucket, buckets)
                hashes, doc, bucket, opens = hashes[order], doc[order], bucket[order], opens[order]
                out: dict[str, list] = {k: [] for k in _PACKED.names}
                cuts = runs(bucket)
                for a, b in zip(cuts, cuts[1:]):
                    r = runs(doc[a:b])
                    of = doc[a:b][r[:-1]]
                    sizes = np.where(np.logical_or.reduceat(opens[a:b], r[:-1]), size[of], 0)
                    for name, x in zip(out, (int(bucket[a]), narrow(hashes[a:b] - _low(int(bucket[a]), buckets), _HASH), squeeze(np.diff(ids[of], prepend=0)), squeeze(np.diff(r)), squeeze(sizes), copies)):
                        out[name].append(x)
                    copies = b""
                if copies:
                    for name, x in zip(out, (int(chunk_of(ids[:1], buckets)[0]), b"", squeeze(ids[:0]), squeeze(ids[:0]), squeeze(ids[:0]), copies)):
                        out[name].append(x)
                if out["bucket"]:
                    yield shared.rows(_PACKED, **out)

    return pack


def _low(bucket: int, buckets: int) -> np.uint64:
    """The least hash of a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def _count(chunks: int):
    """Shingles of two documents or more, with the class of their number: quarter powers of two."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        counts = read_squeezed(group, "counts")
        ids, sizes = read_squeezed(group, "docs", steps=True), read_squeezed(group, "sizes")
        entries = np.argsort(ids, kind="stable")
        n = counts[entries]
        take = np.repeat((np.cumsum(counts) - counts)[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hashes, doc = read_narrow(group, "hashes", _HASH)[take], np.repeat(ids[entries], n)
        del take
        order = wordhash.order_of(hashes)  # by document where hashes are equal
        hashes = hashes[order]
        same = np.zeros(len(hashes) + 1, bool)
        same[1:-1] = hashes[1:] == hashes[:-1]
        kept = same[1:] | same[:-1]
        hashes, doc = hashes[kept], doc[order[kept]]
        del order, same, kept
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        # a document's size is its texts' sizes less what they have twice
        ids, sizes = np.concatenate([ids, doc[~fresh]]), np.concatenate([sizes, np.full((~fresh).sum(), -1)])
        ids, sizes = ids[sizes != 0], sizes[sizes != 0]
        hashes, doc = hashes[fresh], doc[fresh]
        df = np.diff(runs(hashes))
        number = np.repeat(np.cumsum(df > 1) - 1, df)
        df = np.repeat(df, df)
        many = df > 1
        doc, rank, kind = doc[many], number[many].astype(np.uint32), np.floor(4 * np.log2(df[many])).astype(np.uint8)
        chunk = chunk_of(doc, chunks)
        order = np.argsort(doc, kind="stable")
        order = order[stable_order(chunk[order], chunks)]
        doc, rank, kind, chunk = doc[order], rank[order], kind[order], chunk[order]
        owners, where = np.unique(ids, return_inverse=True)
        sizes = np.bincount(where, sizes, len(owners)).astype(np.int64)
        order = np.argsort(home := chunk_of(owners, chunks), kind="stable")
        owners, sizes, home = owners[order], sizes[order], home[order]
        copies = read(group, "copies", np.int64).reshape(-1, 2)
        order = np.argsort(goal := chunk_of(copies[:, 0], chunks), kind="stable")
        copies, goal = copies[order], goal[order]
        out: dict[str, list] = {k: [] for k in _COMMON.names}
        for c in np.union1d(np.union1d(chunk, home), goal).tolist():
            (a, b), (i, j), (p, q) = (np.searchsorted(x, (c, c + 1)) for x in (chunk, home, goal))
            r = runs(doc[a:b])
            for name, x in zip(out, (c, key[0].as_py(), rank[a:b].tobytes(), kind[a:b].tobytes(), squeeze(np.diff(doc[a:b][r[:-1]], prepend=0)), squeeze(np.diff(r)), squeeze(np.diff(owners[i:j], prepend=0)), squeeze(sizes[i:j]), copies[p:q].tobytes())):
                out[name].append(x)
        return _table(_COMMON, **out)

    return count


def choose_l(df: np.ndarray, cut: np.ndarray, base: np.ndarray, limit: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For each set the l of least estimated cost.

    ``df`` holds the shared shingles' document numbers of all sets, ``cut`` where each
    set's begin, ``base`` how many of them the 1-prefix has, and ``limit`` is the
    highest l allowed.  With s the postings that the l-prefix reads, at most s / l
    documents are met l times.
    """
    total = np.append(0, np.cumsum(df - 1.0))
    best, cost = np.ones(len(base), np.int64), np.full(len(base), np.inf)
    for ell in range(1, longest + 1):
        end = np.minimum(cut[:-1] + np.maximum(base + ell - 1, 0), cut[1:])
        postings = total[end] - total[cut[:-1]]
        now = postings * (1 + VERIFY_COST / ell)
        better = (ell <= limit) & (now < cost)
        best[better], cost[better] = ell, now[better]
    return best


def _assemble(t: float, longest: int, buckets: int, width: int):
    def assemble(key: tuple, group: pa.Table) -> pa.Table:
        docs, counts, ranks = [], [], []
        for bucket, d, n, r in zip(*(group.column(c).to_pylist() for c in ("bucket", "docs", "counts", "ranks"))):
            docs.append(np.cumsum(unsqueeze(d)))
            counts.append(unsqueeze(n))
            ranks.append(np.frombuffer(r, np.uint32).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket))
        ids, number = np.unique(np.concatenate(docs), return_inverse=True)
        tokens, number = np.concatenate(ranks) | read(group, "classes", np.uint8).astype(np.uint64) << np.uint64(56), np.repeat(number, np.concatenate(counts))
        del ranks
        order = wordhash.order_by(number, tokens)
        tokens, number = tokens[order], number[order]
        kind, tokens = (tokens >> np.uint64(56)).astype(np.int64), tokens & np.uint64((1 << 56) - 1)
        cut = np.searchsorted(number, np.arange(len(ids) + 1))
        known = np.diff(cut)
        owners, sizes = read_squeezed(group, "owners", steps=True), read_squeezed(group, "sizes")
        at = np.searchsorted(ids, owners)
        mine = at < len(ids)
        mine[mine] = ids[at[mine]] == owners[mine]
        size = np.bincount(at[mine], sizes[mine], len(ids)).astype(np.int64)
        least = least_overlap(size, t)
        base = size - least + 1 - (size - known)
        ell = choose_l(2.0 ** (kind / 4), cut, base, least, longest)
        prefix = np.minimum(base + ell - 1, known)
        some = np.flatnonzero(base > 0)
        begin, end = cut[:-1][some], cut[1:][some]
        heads = [narrow(tokens[a:m], width) for a, m in zip(begin, begin + prefix[some])]
        rests = [narrow(tokens[m:b], width) for m, b in zip(begin + prefix[some], end)]
        copies = read(group, "copies", np.int64).reshape(-1, 2)
        none = [None] * len(copies)
        return _table(
            _SETS,
            doc_id=np.concatenate([ids[some], copies[:, 0]]),
            size=[*size[some].tolist(), *none],
            shared=[*known[some].tolist(), *none],
            l=[*ell[some].tolist(), *none],
            prefix=[*prefix[some].tolist(), *none],
            head=[*heads, *none],
            rest=[*rests, *none],
            same_as=[*[None] * len(some), *copies[:, 1].tolist()],
        )

    return assemble


def least_overlap(size: np.ndarray, t: float) -> np.ndarray:
    """Shingles that a set must share with any set of similarity ``t``."""
    return np.maximum(np.ceil(t * size - 1e-9).astype(np.int64), 1)


def _send_prefix(buckets: int, width: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("prefix").to_numpy()
            tokens = widen(b"".join(batch.column("head").to_pylist()), width)
            row = np.repeat(np.arange(batch.num_rows), counts)
            bucket = bucket_of(wordhash.mix(tokens), buckets)
            order = stable_order(bucket, buckets)
            tokens, row, bucket = tokens[order], row[order], bucket[order]
            ids, size, ell = (batch.column(c).to_numpy() for c in ("doc_id", "size", "l"))
            out: dict[str, list] = {k: [] for k in _PREFIX.names}
            cuts = runs(bucket)
            for a, b in zip(cuts, cuts[1:]):
                r = runs(row[a:b])
                of = row[a:b][r[:-1]]
                for name, x in zip(out, (int(bucket[a]), narrow(tokens[a:b], width), squeeze(np.diff(ids[of], prepend=0)), squeeze(np.diff(r)), size[of].astype(np.uint32).tobytes(), ell[of].astype(np.uint8).tobytes())):
                    out[name].append(x)
            if out["bucket"]:
                yield shared.rows(_PREFIX, **out)

    return send


def _lists(parts: int, width: int, list_block: int, hot: int | None = None):
    """Posting lists of two documents or more, sent to where their leader's are counted; with ``hot`` longer ones are whole, a row each."""

    def make(key: tuple, group: pa.Table) -> pa.Table:
        counts = read_squeezed(group, "counts")
        tokens = read_narrow(group, "tokens", width)
        doc = np.repeat(read_squeezed(group, "docs", steps=True), counts)
        size, ell = (np.repeat(read(group, c, k), counts) for c, k in (("sizes", np.uint32), ("ls", np.uint8)))
        order = np.lexsort((doc, tokens))
        tokens, doc, size, ell = tokens[order], doc[order], size[order], ell[order]
        cut = runs(tokens)
        length = np.diff(cut)
        first, length = cut[:-1][length > 1], length[length > 1].astype(np.int64)
        whole = length > hot if hot is not None else np.zeros(len(length), bool)
        out = _dealt(doc, size, ell, first[~whole], length[~whole], parts, list_block)
        for f, k in zip(first[whole].tolist(), length[whole].tolist()):
            mine = slice(f, f + k)
            for name, x in zip(out, (None, doc[f : f + 1].tobytes(), squeeze(np.array([k])), squeeze(np.zeros(1, np.int64)), doc[mine].tobytes(), size[mine].tobytes(), ell[mine].tobytes(), int(doc[f]))):
                out[name].append(x)
        return _table(_LISTS, **out)

    return make


def _deal(parts: int, list_block: int):
    """Whole lists, cut and sent as the others are."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                doc = read(row, "docs", np.int64)
                yield shared.rows(_LISTS, **_dealt(doc, read(row, "sizes", np.uint32), read(row, "ls", np.uint8), np.zeros(1, np.int64), np.array([len(doc)]), parts, list_block))

    return deal


def _dealt(doc: np.ndarray, size: np.ndarray, ell: np.ndarray, first: np.ndarray, length: np.ndarray, parts: int, list_block: int) -> dict[str, list]:
    """Columns of ``_LISTS`` for the lists that begin at ``first``."""
    # pieces of lists: the places of a piece are two runs, the second empty in a piece that is paired with itself
    short = length <= list_block
    begin, n, begin2, n2 = first[short], length[short], np.zeros(short.sum(), np.int64), np.zeros(short.sum(), np.int64)
    for f, k in zip(first[~short].tolist(), length[~short].tolist()):
        blocks = -(-k // list_block)
        i, j = np.triu_indices(blocks)
        each = np.minimum(list_block, k - np.arange(blocks) * list_block)
        begin, n = np.append(begin, f + i * list_block), np.append(n, each[i])
        begin2, n2 = np.append(begin2, f + j * list_block), np.append(n2, np.where(i == j, 0, each[j]))
    two = np.stack([begin, begin2], 1).ravel(), np.stack([n, n2], 1).ravel()
    take = np.repeat(two[0] - np.append(0, np.cumsum(two[1])[:-1]), two[1]) + np.arange(two[1].sum())
    length, left = n + n2, np.where(n2 > 0, n, 0)
    at = np.append(0, np.cumsum(length))
    doc, size, ell = doc[take], size[take], ell[take]
    leader = doc[at[:-1]] if len(length) else doc[:0]
    # lists of the same members go to the same part, where they count as one
    total = np.append(np.zeros(1, np.uint64), np.cumsum(wordhash.mix(doc.view(np.uint64))))
    content = wordhash.mix(total[at[1:]] - total[at[:-1]])
    pairs = np.where(left > 0, left * (length - left), length * (length - 1) // 2)
    salt = content % (1 + 4 * pairs // list_block**2).astype(np.uint64)
    salt = np.where(left > 0, content % np.uint64(1 << 20), salt).astype(np.int64)
    part = chunk_of(leader + salt * 0x5851F42D4C957F2D, parts)
    order = np.lexsort((leader, part))
    out: dict[str, list] = {k: [] for k in _LISTS.names}
    cuts = runs(part[order])
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        n = length[mine]
        take = np.repeat(at[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for name, x in zip(out, (int(part[mine[0]]), leader[mine].tobytes(), squeeze(n), squeeze(left[mine]), doc[take].tobytes(), size[take].tobytes(), ell[take].tobytes(), None)):
            out[name].append(x)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who is in a whole list with its leader."""
    for batch in batches:
        group = pa.Table.from_batches([batch])
        doc = read(group, "docs", np.int64)
        leader = np.repeat(read(group, "leaders", np.int64), read_squeezed(group, "lengths"))
        order = np.lexsort((doc, leader))
        leader, doc = leader[order], doc[order]
        new = np.append(True, (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1]))
        yield shared.rows(_EDGES, leader=leader[new], doc_id=doc[new])


def _add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    cut = runs(code)
    return code[cut[:-1]], np.add.reduceat(n, cut[:-1]) if len(code) else n


@lru_cache(4)
def _places(k: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of a list of ``k``, or of its first ``left`` documents with the others."""
    if not left:
        return np.triu_indices(k, 1)
    return np.repeat(np.arange(left), k - left), np.tile(np.arange(left, k), left)


def _count_pairs(t: float):
    """Candidates and the prefix shingles that they share, in batches of bounded size; a pair may come in several."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        leaders, length, left = read(group, "leaders", np.int64), read_squeezed(group, "lengths"), read_squeezed(group, "lefts")
        ids, where, local = np.unique(read(group, "docs", np.int64), return_index=True, return_inverse=True)
        local = local.astype(np.int32)
        size, ell = read(group, "sizes", np.uint32)[where].astype(np.int64), read(group, "ls", np.uint8)[where].astype(np.int32)
        del group, where
        at = np.cumsum(length) - length
        order = np.lexsort((left, length, leaders))
        cuts = runs(leaders[order])
        ready: list[tuple[np.ndarray, ...]] = []
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        pending = merged = held = 0

        def flush(leader: np.ndarray) -> None:
            nonlocal codes, counts, held, pending, merged
            code, n = _add_up(codes, counts)
            a, b = code // len(ids), code % len(ids)
            ready.append((ids[a], ids[b], n.astype(np.int32), np.minimum(ell[a], ell[b]), np.full(len(a), leader)))
            codes, counts, held = [], [], held + len(a)
            pending = merged = 0

        def batch() -> pa.RecordBatch:
            nonlocal ready, held
            out = shared.rows(_PAIRS, **{f.name: np.concatenate(c) for f, c in zip(_PAIRS, zip(*ready))})
            ready, held = [], 0
            return out

        for i, j in zip(cuts, cuts[1:]):
            mine = order[i:j]
            kinds = runs(length[mine] << 32 | left[mine])
            for c, d in zip(kinds, kinds[1:]):
                k, half = int(length[mine[c]]), int(left[mine[c]])
                lists = at[mine[c:d]]
                weight = np.ones(len(lists), np.int64)
                if len(lists) > 1:
                    alike = np.ascontiguousarray(local[lists[:, None] + np.arange(k)]).view(np.dtype((np.void, 4 * k))).ravel()
                    _, one, weight = np.unique(alike, return_index=True, return_counts=True)
                    lists = lists[one]
                    del alike
                x, y = _places(k, half)
                step = max(1, _EVENTS // max(1, len(x)))
                for p in range(0, len(lists), step):
                    members = local[lists[p : p + step, None] + np.arange(k)]
                    a, b = members[:, x].ravel(), members[:, y].ravel()
                    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                    fits = low >= t * high - 1e-9
                    code, n = _add_up([a[fits].astype(np.int64) * len(ids) + b[fits]], [np.repeat(weight[p : p + step], len(x))[fits]])
                    codes.append(code)
                    counts.append(n)
                    pending += len(code)
                    if pending > 2 * max(merged, _EVENTS):
                        code, n = _add_up(codes, counts)
                        codes, counts, pending, merged = [code], [n], len(code), len(code)
                        if merged > 2 * _EVENTS:
                            flush(leaders[mine[0]])
                            yield batch()
            if codes:
                flush(leaders[mine[0]])
            if held > _EVENTS // 4:
                yield batch()
        if ready:
            yield batch()
        shared.release()

    return count


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each one's component."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root = up
    return root


def _links(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Each one's number of links, and the least of those that they connect; ``ids`` ascend."""
    links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    root, some = _roots(len(ids), a, b), np.flatnonzero(links)
    return _table(_LINKS, doc_id=ids[some], root=ids[root[some]], links=links[some])


def _verify(t: float, width: int, pairs_too: bool):
    def verify(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        pairs, sets = pairs.combine_chunks(), sets.combine_chunks()
        ids, size = sets.column("doc_id").to_numpy(), sets.column("size").to_numpy().astype(np.int64)
        order = np.argsort(ids)
        head, rest = sets.column("head").to_pylist(), sets.column("rest").to_pylist()
        blobs = [head[i] + rest[i] for i in order]
        del head, rest
        length = np.array(list(map(len, blobs)), np.int64) // width
        tokens = widen(b"".join(blobs), width)
        del blobs
        ids, size = ids[order], size[order]
        tokens = np.unique(tokens, return_inverse=True)[1].astype(np.int32)
        cut = np.append(0, np.cumsum(length))
        a, b = np.searchsorted(ids, pairs.column("a").to_numpy()), np.searchsorted(ids, pairs.column("b").to_numpy())
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        common = np.zeros(len(a), np.int64)
        mark = np.zeros(int(tokens.max(initial=-1)) + 1, bool)
        r = runs(a)
        for i, j in zip(r, r[1:]):
            mine = tokens[cut[a[i]] : cut[a[i] + 1]]
            mark[mine] = True
            for p in range(i, j, 2000):
                q = min(p + 2000, j)
                n = length[b[p:q]]
                at = np.repeat(cut[b[p:q]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits = np.append(0, np.cumsum(mark[tokens[at]]))
                end = np.cumsum(n)
                common[p:q] = hits[end] - hits[end - n]
            mark[mine] = False
        value = np.minimum(common / (size[a] + size[b] - common), 1.0)
        good = value >= t - 1e-12
        a, b = a[good], b[good]
        if pairs_too:
            return _table(_FOUND, a=ids[a], b=ids[b], jaccard=value[good])
        return _links(ids, a, b)

    return verify


def _in_common(token: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For sets ``left`` and ``right`` (places of rows) how many tokens each two different ones share; ``row`` has ``token``, once.

    Tokens of many sets are multiplied as matrices of zeros and ones, which numbers below 2**24 leave exact; those of
    few are counted pair by pair.
    """
    rows = 1 + int(max(x.max(initial=-1) for x in (row, left, right)))
    common = np.zeros((len(left), len(right)), np.float32)
    df = np.bincount(token)
    often = df > max(1, rows // 32)
    number = np.cumsum(often) - 1
    dense = often[token]
    order = np.argsort(number[token[dense]], kind="stable")
    col, at = number[token[dense]][order], row[dense][order]
    for low in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(col, (low, low + 2048))
        ones = np.zeros((rows, min(2048, int(often.sum()) - low)), np.float32)
        ones[at[a:b], col[a:b] - low] = 1
        common += ones[left] @ ones[right].T
    few = ~dense & (df[token] > 1)
    token, row = token[few], row[few]
    sides = []
    for side in (left, right):
        where = np.full(rows, -1)
        where[side] = np.arange(len(side))
        mine = np.flatnonzero(where[row] >= 0)
        mine = mine[np.argsort(token[mine], kind="stable")]
        sides.append((token[mine], where[row[mine]]))
    (t1, r1), (t2, r2) = sides
    begin = np.searchsorted(t2, t1)
    n = np.searchsorted(t2, t1, "right") - begin
    total = np.append(0, np.cumsum(n))
    flat = common.ravel()
    a = 0
    while a < len(t1):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _EVENTS, "right")) - 1)
        take = np.repeat(begin[a:b] - (total[a:b] - total[a]), n[a:b]) + np.arange(total[b] - total[a])
        np.add.at(flat, np.repeat(r1[a:b], n[a:b]) * len(right) + r2[take], np.float32(1))
        a = b
    return common


def _compare(t: float, width: int, pairs_too: bool):
    """A tile of a family with itself or another one: all sets of the one with all of the other."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("doc_id").to_numpy())))
        ids, size, tile = group.column("doc_id").to_numpy(), group.column("size").to_numpy().astype(np.int64), group.column("tile").to_numpy()
        blobs = [h + r for h, r in zip(group.column("head").to_pylist(), group.column("rest").to_pylist())]
        del group
        row = np.repeat(np.arange(len(ids)), np.array(list(map(len, blobs)), np.int64) // width)
        token = np.unique(widen(b"".join(blobs), width), return_inverse=True)[1]
        del blobs
        left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        common = _in_common(token, row, left, right).astype(np.float64)
        value = np.minimum(common / (size[left][:, None] + size[right] - common), 1.0)
        good = value >= t - 1e-12
        if first == second:
            good = np.triu(good, 1)
        i, j = np.nonzero(good)
        a, b = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
        if pairs_too:
            return _table(_FOUND, a=ids[a], b=ids[b], jaccard=value[i, j])
        return _links(ids, a, b)

    return compare


def _families(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc_id, family, tiles) of the families whose sets are compared all with all; ``sets`` has no copies."""
    own = components(hot.select("leaders", "lengths", "docs").mapInArrow(shared.freed(_edges), _ddl(_EDGES)), "leader", "doc_id").withColumnsRenamed({"node": "doc_id", "component": "family"})
    own = shared.store(own, "members")
    k = F.length("docs") / 8
    lists = hot.select(F.col("leader").alias("doc_id"), k.alias("k")).join(own, "doc_id").groupBy("family").agg(F.sum(F.col("k") * F.col("k")).alias("events"), F.max("k").alias("most"))
    counts = sets.select("doc_id", "shared").join(own, "doc_id").groupBy("family").agg(F.count("*").alias("n"), F.sum("shared").alias("tokens"))
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("tokens") / TILE_TOKENS)).cast("int").alias("tiles")
    chosen = counts.join(lists, "family").where(F.col("n") * F.col("n") <= PER_EVENT * F.col("events") + PER_PAIR * F.col("most") * F.col("most")).select("family", tiles)
    out = shared.store(own.join(chosen, "family").select("doc_id", "family", "tiles"), "families")
    shared.discard(own)
    return out


def _linked(docs: DataFrame, n: int, t: float, longest: int, bucket: int, block: int, pairs_too: bool) -> tuple[DataFrame, DataFrame]:
    """What is found of documents with different sets, stored: pairs (a, b, jaccard), or (doc_id, root, links) in
    each block; and the copies (doc_id, same_as), stored: documents with the set of a lesser doc_id, the first of its class."""
    spark = docs.sparkSession
    docs = shared.core(docs, "doc_id", "text")
    total = text_size(docs)
    buckets, width = shared.buckets_for(total // BYTES_PER_WORD, bucket), _token_width(total)
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(MOST_REPEATED + 1).toPandas()["doc_id"].to_numpy(np.int64)
    packed = docs.mapInArrow(shared.freed(_pack(n, buckets, repeated if len(repeated) <= MOST_REPEATED else None)), _ddl(_PACKED)).groupBy("bucket").applyInArrow(shared.freed(_count(buckets)), _ddl(_COMMON))
    stored = shared.store(packed.groupBy("chunk").applyInArrow(shared.freed(_assemble(t, longest, buckets, width)), _ddl(_SETS)), "sets")
    sets = stored.where("same_as IS NULL")
    whole = sets.where("shared = size").select("doc_id", "size", F.md5(F.concat("head", "rest")).alias("set"))
    first = whole.groupBy("set", "size").agg(F.min("doc_id").alias("same_as"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = shared.store(whole.join(first, ["set", "size"]).where("doc_id <> same_as").select("doc_id", "same_as"), "later")
    direct = stored.where("same_as IS NOT NULL").select("doc_id", F.col("same_as").alias("met")).distinct()
    copies = direct.join(later.select(F.col("doc_id").alias("met"), "same_as"), "met", "left").select("doc_id", F.coalesce("same_as", "met").alias("same_as"))
    copies = shared.store(copies.union(later), "copies")
    ones = sets.select("doc_id", "size", "l", "prefix", "head").join(later.select("doc_id"), "doc_id", "left_anti")
    parts = shared.buckets_for(sets.agg(F.sum("prefix")).first()[0] or 0, bucket // 4)
    lists = shared.store(ones.mapInArrow(shared.freed(_send_prefix(parts, width)), _ddl(_PREFIX)).groupBy("bucket").applyInArrow(shared.freed(_lists(parts, width, LIST_BLOCK, HOT)), _ddl(_LISTS)), "lists")
    hot, cold, families = lists.where("leader IS NOT NULL"), lists.where("leader IS NULL"), None
    if not hot.isEmpty():
        families = _families(sets, hot)
        paired = hot.join(families.select(F.col("doc_id").alias("leader")), "leader", "left_anti").select(*lists.columns)
        cold = cold.union(paired.mapInArrow(shared.freed(_deal(parts, LIST_BLOCK)), _ddl(_LISTS)))
    counted = cold.groupBy("part").applyInArrow(_count_pairs(t), _ddl(_PAIRS)).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.min("leader").alias("leader"))
    counted = counted.where("n >= need").select("a", "b", "leader")
    if families is not None:
        for end in ("a", "b"):
            counted = counted.join(families.select(F.col("doc_id").alias(end), F.col("family").alias(f"of_{end}")), end, "left")
        counted = counted.where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b", "leader")
    candidates = shared.store(counted, "candidates")
    big = candidates.groupBy("leader").agg((F.count("*") / SPREAD * 4).cast("long").alias("spread")).where("spread > 0")
    pairs = candidates.join(big, "leader", "left").select("a", "b", F.xxhash64("leader", F.when(F.col("spread") > 0, F.pmod(F.xxhash64("a"), F.col("spread") + 1)).otherwise(0)).alias("block"))
    needed = pairs.select(F.col("a").alias("doc_id"), "block").union(pairs.select(F.col("b").alias("doc_id"), "block")).distinct()
    blocks = shared.buckets_for(needed.count(), block)
    of_block = F.pmod(F.col("block"), F.lit(blocks)).cast("int").alias("block")
    held = needed.select("doc_id", of_block).distinct().join(sets.select("doc_id", "size", "head", "rest"), "doc_id").select("block", "doc_id", "size", "head", "rest")
    found = pairs.select(of_block, "a", "b").groupBy("block").cogroup(held.groupBy("block")).applyInArrow(shared.freed(_verify(t, width, pairs_too)), _ddl(_FOUND if pairs_too else _LINKS))
    if families is not None:
        tiled = families.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("doc_id", "family", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "tile")
        tiled = tiled.join(sets.select("doc_id", "size", "head", "rest"), "doc_id")
        found = found.union(tiled.groupBy("family", "first", "second").applyInArrow(shared.freed(_compare(t, width, pairs_too)), _ddl(_FOUND if pairs_too else _LINKS)))
    found = shared.store(found, "found")
    shared.discard(stored, later, lists, candidates, *[families] * (families is not None))
    return found, copies


def distinct_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, longest: int = LONGEST, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard), a < b, between the least documents of each set, without loss; and the other documents (doc_id, same_as) of sets that several have."""
    return _linked(docs, n, t, longest, bucket, block, True)


def similar(docs: DataFrame, n: int = N, t: float = THRESHOLD, longest: int = LONGEST, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, set_id, n_links, n_copies): a row for each document that is similar to another one.

    ``class_id`` is the least doc_id of all documents that it is similar to, directly
    or by others, ``set_id`` the least one with the same set of shingles, ``n_links``
    the number of other sets of similarity ``t`` or more, and ``n_copies`` that of the
    documents with its set, itself included.
    """
    found, copies = _linked(docs, n, t, longest, bucket, block, False)
    group = components(found, "doc_id", "root")
    links = found.groupBy(F.col("doc_id").alias("set_id")).agg(F.sum("links").alias("n_links"))
    size = copies.groupBy(F.col("same_as").alias("set_id")).agg((F.count("*") + 1).alias("n_copies"))
    sets = links.join(size, "set_id", "full").join(group, F.col("set_id") == F.col("node"), "left")
    sets = sets.select("set_id", F.coalesce("component", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    sets = shared.store(sets, "similar")
    rest = copies.select("doc_id", F.col("same_as").alias("set_id")).join(sets, "set_id")
    columns = ("doc_id", "class_id", "set_id", "n_links", "n_copies")
    return sets.withColumn("doc_id", F.col("set_id")).select(*columns).union(rest.select(*columns))


def groups(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, group) of the documents that are similar to another one, directly or by others; ``group`` is the least doc_id."""
    return similar(docs, n, t).select("doc_id", F.col("class_id").alias("group"))


def drop_near_copies(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with the least doc_id of every group and all documents of none."""
    gone = groups(docs, n, t).where(F.col("doc_id") != F.col("group")).select(F.col("doc_id").alias(key := shared.free_name("near_copy", docs)))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
