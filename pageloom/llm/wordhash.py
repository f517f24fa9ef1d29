"""Vectorised word and window hashing over Arrow string arrays.

A batch of texts is looked at as one run of UTF-8 bytes.  Words are found and
hashed with numpy prefix sums, so no Python object is made for a word.  Hashes
are 64 bits wide; callers whose result must be exact confirm the text of a hit.

Two word definitions exist:

* ``"space"``: a word is a run of bytes without ASCII white space.
* ``"plain"``: a word is a run of lower-cased letters and digits.  Separators are
  every ASCII character that is no letter or digit, U+0080-U+00BF,
  U+2000-U+203F and U+3000-U+303F.  ``PLAIN_SEPARATOR`` is the same class as a
  regular expression (Java, Python and RE2 agree on it).

Null texts count as empty ones.  Texts of any length are handled: the byte work
is done in pieces that end between two words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLAIN_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{2000}-\x{203F}\x{3000}-\x{303F}]"
SPACE_SEPARATOR = r"[\t-\r ]"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW_BASE = 0xD1342543DE82EF95
_WINDOW_INVERSE = pow(_WINDOW_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[:128] = [not chr(i).isalnum() for i in range(128)]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int, inverse: int) -> None:
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _power_table(self.base, n), _power_table(self.inverse, n)
        return self.up, self.down


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTES = _Powers(_BASE, _INVERSE)
_WORDS = _Powers(_WINDOW_BASE, _WINDOW_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``, hashes, and for text i the words ``doc[i]:doc[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def owner(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of text each (a longer text is alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _lowered(array: pa.Array) -> pa.Array:
    """Lower case that keeps every text's byte length, so that offsets hold for the original too."""
    low = pc.utf8_lower(array)
    odd = pc.not_equal(pc.binary_length(low), pc.binary_length(array))
    if not pc.any(odd).as_py():
        return low
    one = lambda c: x if len((x := c.lower()).encode()) == len(c.encode()) else c
    flags = odd.to_pylist()
    return pa.array(["".join(map(one, t)) if f else s for t, s, f in zip(array.to_pylist(), low.to_pylist(), flags)], array.type)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends."""
    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _separators(data: np.ndarray, kind: str) -> np.ndarray:
    if kind == "space":
        return _SPACE[data]
    sep = _PLAIN[data]
    if len(data) and data.max() >= 0x80:
        lead = np.flatnonzero(data == 0xC2)
        for at in (lead, lead + 1):
            sep[at] = True
        for first, second in ((0xE2, 0x80), (0xE3, 0x80)):
            lead = np.flatnonzero(data[:-1] == first)
            lead = lead[data[lead + 1] == second]
            for at in (lead, lead + 1, lead + 2):
                sep[at] = True
    return sep


def words(array: pa.Array, kind: str = "space") -> Words:
    """All words of the texts, hashed; ``kind`` is ``"space"`` or ``"plain"`` (see the module)."""
    array = pc.fill_null(array, "")
    data, offsets = text_bytes(_lowered(array) if kind == "plain" else array)
    n = len(data)
    sep = _separators(data, kind)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = np.ones(n + 1, bool)
    gap[1:] = sep
    gap[1:] |= edge[1:]
    gap[0] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = sep[:-1]
    before |= edge[:-1]
    starts = np.flatnonzero(~sep & before)
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = sep[1:]
    after |= edge[1:]
    ends = np.flatnonzero(~sep & after) + 1
    return Words(data, offsets, starts, ends, hash_ranges(data, starts, ends), np.searchsorted(starts, offsets))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _PIECE, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = _BYTES.get(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((total[last] - total[first]) * down[first])
        a = b
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of ``width`` words inside one text, and each window's first word.

    Texts of fewer words have none.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORDS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    at = np.arange(n - width + 1)
    room = np.repeat(doc[1:], np.diff(doc))[: len(at)]
    at = at[at + width <= room]
    return mix((total[at + width] - total[at]) * down[at]), at


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned integers.

    Upper bits and place are sorted as one number, which is several times as fast as
    an indirect sort; where upper bits are equal and the rest isn't in order, it is put so.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n)
    keys = keys.astype(np.uint64, copy=False)
    low = np.uint64((n - 1).bit_length())
    mask = (np.uint64(1) << low) - np.uint64(1)
    up = np.uint64(64 - int(keys.max()).bit_length())
    packed = np.sort(((keys << up) & ~mask) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).view(np.int64)
    if 64 - up + low <= 64:
        return order
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        packed >>= low
        mine = np.flatnonzero(np.isin(packed, packed[wrong]))
        order[mine] = order[mine][np.argsort(found[mine], kind="stable")]
    return order


def order_by(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The stable order by small non-negative integers ``first``, and by ``then`` where those are equal."""
    order = order_of(then)
    first = first[order]
    return order[np.argsort(first.astype(np.uint16), kind="stable") if len(first) and first.max() < 1 << 16 else order_of(first)]


def shingles(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window hashes of every text, sorted by (text, hash), and the text of each.

    A text of 1 to ``width - 1`` words has one shingle, all its words; a text without words has none.
    """
    found, at = windows(hashes, doc, width)
    owner = np.searchsorted(doc, at, "right") - 1
    counts = np.diff(doc)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        found, owner = np.concatenate([found, whole_texts(hashes, doc)[short]]), np.concatenate([owner, short])
    order = order_by(owner, found)
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def whole_texts(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of all words of each text, in their order."""
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[doc[1:]] - total[doc[:-1]]) * down[doc[:-1]] + np.diff(doc).astype(np.uint64))
