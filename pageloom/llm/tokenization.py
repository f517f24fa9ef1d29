"""Public tokenizers by the path of their file; tokenizers are never trained here.

The driver reads the file and broadcasts its bytes, so executors need no copy of it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import pairwise

import numpy as np
from pyspark.sql import SparkSession

#: Default of the parameter ``tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without the slow look-ahead, which leaves the last white space of a run to the next piece: so texts are cut there.
_FAST_PIECES = _PIECES.replace(r"\s+(?!\S)|", "")
#: Characters after which a longer text is cut, where the next word begins.
_PIECE_CHARS = 200_000
#: Where a word ends and another begins after one space: no token lies across.
_BETWEEN = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # as in the pieces' \s
_RUN = re.compile(f"[{_SPACE}]{{2,}}")
_ASCII_SPACE = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Encode:
    """Called with texts it gives the ids of each; ``lengths`` gives only their numbers."""

    def __init__(self, ids: Callable[[list[str]], list[np.ndarray]], lengths: Callable[[list[str]], list[int]] | None = None) -> None:
        self._ids, self._lengths = ids, lengths

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self._ids(texts)

    def lengths(self, texts: list[str]) -> list[int]:
        return self._lengths(texts) if self._lengths else list(map(len, self._ids(texts)))


def _cuts(text: str) -> list[str]:
    """Parts of a very long text, whose ids one after another are the text's; one without a place to cut is whole."""
    out, at = [], 0
    while len(text) - at > _PIECE_CHARS and (found := _BETWEEN.search(text, at + _PIECE_CHARS)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def _runs(text: str) -> list[int]:
    """The last place of each run of white space that something follows."""
    if b"  " not in text.encode("utf-8", "surrogatepass").translate(_ASCII_SPACE) and (text.isascii() or not any(c in text for c in _WIDE_SPACE)):
        return []
    return [run.end() - 1 for run in _RUN.finditer(text) if run.end() < len(text)]


def _tiktoken(raw: bytes) -> tuple[Encode, int]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    encode = tiktoken.Encoding("own", pat_str=_FAST_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def part(text: str) -> list[int]:
        at = [0, *_runs(text), len(text)]
        return encode(text) if len(at) == 2 else [i for begin, end in pairwise(at) for i in encode(text[begin:end])]

    def one(text: str) -> np.ndarray:
        return np.concatenate([np.array(part(p), np.uint32) for p in _cuts(text)])

    return Encode(lambda texts: list(map(one, texts)), lambda texts: [sum(len(part(p)) for p in _cuts(t)) for t in texts]), max(ranks.values()) + 1


def _tokenizers(raw: bytes) -> tuple[Encode, int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(raw.decode())
    t.encode_special_tokens = True
    return Encode(lambda texts: [np.array(e.ids, np.uint32) for e in t.encode_batch(texts, add_special_tokens=False)]), t.get_vocab_size(with_added_tokens=True)


def _sentencepiece(raw: bytes) -> tuple[Encode, int]:
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return Encode(lambda texts: [np.array(x, np.uint32) for x in t.encode(texts, num_threads=1)]), t.get_piece_size()


def load(path: str, raw: bytes) -> tuple[Encode, int]:
    """What encodes a list of texts, and the first free id, which serves as end of text."""
    kind = {"tiktoken": _tiktoken, "json": _tokenizers, "model": _sentencepiece}.get(path.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"not a .tiktoken, .json or .model file: {path}")
    return kind(raw)


def shared_tokenizer(spark: SparkSession, path: str) -> Callable[[], tuple[Encode, int]]:
    """What gives a task the tokenizer, loaded once in each task."""
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    ready: list[tuple[Encode, int]] = []

    def get() -> tuple[Encode, int]:
        if not ready:
            ready.append(load(path, held.value))
        return ready[0]

    return get
