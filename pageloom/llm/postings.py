"""Packed (hash, document) postings: what window counting and set joins shuffle.

A row for each window would cost more in row headers than in hashes.  So a map
task deals its hashes into buckets by their upper bits and sends one row of
packed arrays for each bucket; a bucket's task sorts them with numpy.  What it
finds goes back to the documents the same way, packed by chunk: documents are
dealt into chunks by a hash of ``doc_id``.  No document or hash is ever left out;
the numbers of buckets and chunks follow the size of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import wordhash

#: Hashes in one bucket, and in one chunk: what a task holds and sorts at once.
BUCKET = 2_000_000
#: Bytes of text that stand for one word when only byte lengths are known.
BYTES_PER_WORD = 6


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def estimated_words(docs: DataFrame) -> int:
    """About the number of words in all texts, from their byte lengths."""
    return text_size(docs) // BYTES_PER_WORD


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash's upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    return bucket_of(wordhash.mix(ids.astype(np.int64).view(np.uint64)), chunks)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and after the last one the length."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))


def stable_order(keys: np.ndarray, high: int) -> np.ndarray:
    """A stable order of small non-negative integers (radix sort where 16 bits do)."""
    return np.argsort(keys.astype(np.uint16) if high <= 1 << 16 else keys, kind="stable")


def read(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The packed arrays of a column, one after another."""
    blobs = [np.frombuffer(x.as_buffer(), kind) for x in table.column(column) if x.is_valid]
    return np.concatenate(blobs) if blobs else np.zeros(0, kind)


def squeeze(values: np.ndarray) -> bytes:
    """Integers, one byte each from 0 to 254; the others follow in a tail of 8 bytes each."""
    big = (values < 0) | (values >= 255)
    return len(values).to_bytes(4, "little") + np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype(np.int64).tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    out = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, np.int64, -1, 4 + n)
    return out


def read_squeezed(table: pa.Table, column: str, steps: bool = False) -> np.ndarray:
    """The numbers of a column of ``squeeze``; with ``steps`` each blob holds differences."""
    blobs = [unsqueeze(x.as_buffer()) for x in table.column(column) if x.is_valid]
    return np.concatenate([np.cumsum(b) for b in blobs] if steps else blobs) if blobs else np.zeros(0, np.int64)


def narrow(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers in their lower ``width`` bytes each."""
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(blob: bytes | pa.Buffer, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def read_narrow(table: pa.Table, column: str, width: int) -> np.ndarray:
    blobs = [widen(x.as_buffer(), width) for x in table.column(column) if x.is_valid]
    return np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
