"""Token-ID output: Arrow files of equal-length sequences and masks, for random access without copies.

Each task encodes its documents, joins them with an end-of-text id between, cuts
sequences of ``length`` ids and writes one Arrow IPC file: batches of ``batch``
sequences with the columns ``input_ids`` and ``mask``, both fixed-size lists and
uncompressed.  Mapped into memory, sequence i is a view of batch ``i // batch``.
Only a file's last sequence is padded (mask 0).  Nothing is shuffled.

A file is written under a name of its attempt and then renamed, so that a task that
fails or runs twice leaves one whole file.  The index of documents is a table
beside them, written in the same job.

Defined results: null, empty and untokenisable texts have 0 tokens, no end of text,
and an index row; rows without a doc_id are written and have a null in the index;
repeated rows are written as often as they occur; an empty table gives an empty
index and no sequences; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared, wordhash
from pageloom.llm.tokenization import TOKENIZER, shared_tokenizer

LENGTH = 2048
BATCH = 256

_INDEX = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("first_sequence", pa.int64()), ("first_position", pa.int32()), ("n_tokens", pa.int64())])


def schema(length: int, vocabulary: int, end: int) -> pa.Schema:
    ids = pa.uint16() if vocabulary < 1 << 16 else pa.uint32()
    return pa.schema([pa.field("input_ids", pa.list_(ids, length), False), pa.field("mask", pa.list_(pa.uint8(), length), False)], {"length": str(length), "end_of_text": str(end)})


class _Writer:
    """Fills sequences and writes them in batches of equal size."""

    def __init__(self, path: str, length: int, batch: int, vocabulary: int, end: int) -> None:
        self.schema, self.length, self.room = schema(length, vocabulary, end), length, length * batch
        self.kind = self.schema.field("input_ids").type.value_type.to_pandas_dtype()
        self.fs, self.path = shared.file_system(path)
        self.file = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.file, self.schema)
        self.buffer, self.used, self.done = np.zeros(self.room, self.kind), 0, 0

    def place(self) -> tuple[int, int]:
        return divmod(self.done + self.used, self.length)

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.room - self.used)
            self.buffer[self.used : self.used + n] = ids[at : at + n]
            self.used, at = self.used + n, at + n
            if self.used == self.room:
                self._write(self.room)

    def _write(self, size: int) -> None:
        mask = (np.arange(size) < self.used).astype(np.uint8)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((self.buffer[:size], mask), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.done, self.used = self.done + size, 0
        self.buffer = np.zeros(self.room, self.kind)

    def close(self) -> None:
        if self.used:
            self._write(-(-self.used // self.length) * self.length)
        self.out.close()
        self.file.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Writes the files ``path``/sequences/*.arrow and the table ``path``/index, and gives the index:
    (doc_id, file, first_sequence, first_position, n_tokens), where n_tokens counts the end of text."""
    spark = docs.sparkSession
    get = shared_tokenizer(spark, tokenizer)
    folder = f"{path}/sequences"
    where, local = shared.file_system(folder)
    where.create_dir(local)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.arrow"
        target = f"{folder}/.{name}.{context.taskAttemptId()}"
        out = None
        encode, end = get()
        for b in batches:
            for part in wordhash.slices(b):
                out = out or _Writer(target, length, batch, end + 1, end)
                found: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    ids = np.append(ids, end) if len(ids) else ids
                    found.append((doc_id, name, *out.place(), len(ids)))
                    out.add(ids)
                yield shared.rows(_INDEX, **dict(zip(_INDEX.names, map(list, zip(*found)))))
        if out:
            out.close()
            out.fs.move(out.path, f"{out.path.rsplit('/', 1)[0]}/{name}")

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts.mapInArrow(write, "doc_id long, file string, first_sequence long, first_position int, n_tokens long").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


class Sequences:
    """Random access to one file's sequences; arrays are read-only views of the mapped file."""

    def __init__(self, path: str) -> None:
        self.file = pa.ipc.open_file(pa.memory_map(path))
        self.length = int(self.file.schema.metadata[b"length"])
        self.end_of_text = int(self.file.schema.metadata[b"end_of_text"])
        batches = self.file.num_record_batches
        self.batch = self.file.get_batch(0).num_rows if batches else 1
        self.n = self.batch * (batches - 1) + self.file.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        b = self.file.get_batch(i // self.batch)
        at = i % self.batch * self.length
        return tuple(c.flatten().to_numpy(zero_copy_only=True)[at : at + self.length] for c in b.columns)

    def document(self, first_sequence: int, first_position: int, n_tokens: int) -> np.ndarray:
        """The ids of an index row, its end of text included (a copy if they lie in several sequences)."""
        parts = []
        while n_tokens > 0:
            ids = self[first_sequence][0][first_position : first_position + n_tokens]
            parts.append(ids)
            first_sequence, first_position, n_tokens = first_sequence + 1, 0, n_tokens - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)
