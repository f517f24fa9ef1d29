"""Chunks of text for language models: paragraphs filled greedily, long ones by sentences, with overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.slices import slices

_SENTENCE = re.compile(r"[^.!?]+[.!?]+")
_BOUNDARY = re.compile(r"(?:^|\. )[A-Z]")
_URL, _CODE = re.compile(r"https?://[^ ]+"), re.compile(r"(?s)```.*?```")
#: All bytes but digits as blanks.
_DIGITS = bytes(c if chr(c) in "0123456789" else 32 for c in range(256))


def _flat(text: str) -> str:
    """With single blanks for white space and U+FEFF, those at the ends too."""
    text = text.replace("\ufeff", " ")
    inner = " ".join(text.split())
    if not inner:
        return " " if text else ""
    return " " * text[0].isspace() + inner + " " * text[-1].isspace()


def _numbers(text: str) -> int:
    """How many runs of digits there are."""
    return len(text.encode("ascii", "replace").translate(_DIGITS).split())


def _beyond(flat: str) -> tuple[int, int]:
    """How many characters are beyond ASCII and beyond 16 bits."""
    if flat.isascii():
        return 0, 0
    return len(flat) - len(flat.encode("ascii", "ignore")), len(flat.encode("utf-16-le", "surrogatepass")) // 2 - len(flat)


def estimate_tokens(text: str) -> int:
    """As ``functions.text.estimate_tokens``."""
    if not text:
        return 0
    flat = _flat(text).strip(" ")
    beyond, wide = _beyond(flat)
    urls = 5 * len(_URL.findall(flat)) if "://" in flat else 0
    code = 10 * len(_CODE.findall(flat)) if "```" in flat else 0
    return math.ceil((len(flat) + wide) / 4) + wide + urls + code + _numbers(flat) // 2 + beyond


def sentences(text: str) -> list[str]:
    """Sentences with their marks.  What follows the last mark is no sentence, and isn't looked at: the pattern would go
    through all of it from each of its characters."""
    return _SENTENCE.findall(text, 0, max(map(text.rfind, ".!?")) + 1)


def overlap(text: str, tokens: int) -> str:
    """The end of a text, about so many tokens, from a sentence's beginning if one is in it."""
    tail = text[-4 * tokens :] if text and tokens > 0 else ""
    found = _BOUNDARY.search(tail)
    return tail[found.start() + 2 :] if found and found.start() else tail


#: Of a text with single spaces: length, first and last character, numbers, characters beyond ASCII and beyond 16 bits.
_Stats = tuple[int, str, str, int, int, int]
_NONE: _Stats = (0, "", "", 0, 0, 0)


def _stats(text: str) -> _Stats:
    flat = _flat(text)
    return (len(flat), flat[:1], flat[-1:], _numbers(flat), *_beyond(flat))


def _joined(a: _Stats, b: _Stats) -> _Stats:
    if not a[0] or not b[0]:
        return a if a[0] else b
    edge = a[2] + b[1]
    return (a[0] + b[0] - (edge == "  "), a[1], b[2], a[3] + b[3] - (edge.isascii() and edge.isdigit()), a[4] + b[4], a[5] + b[5])


def _tokens(s: _Stats) -> int:
    n = s[0] - (s[1] == " ") - (s[2] == " " and s[0] > 1)
    return math.ceil((n + s[5]) / 4) + s[5] + s[4] + s[3] // 2


class _Filler:
    """Puts pieces together up to ``most`` tokens; (content, tokens, start, end) of what is full.

    Texts without URLs and code blocks are counted piece by piece, others as a whole each time.
    """

    def __init__(self, most: int, repeat: int, joint: str, trim: bool, whole: bool) -> None:
        self.most, self.repeat, self.joint, self.trim, self.whole = most, repeat, joint, trim, whole
        self.parts: list[str] = []
        self.known, self.tokens, self.start, self.at = _NONE, 0, 0, 0
        self.done: list[tuple[str, int, int, int]] = []

    def emit(self, end: int) -> str:
        text = "".join(self.parts)
        if text:
            self.done.append((text.strip() if self.trim else text, self.tokens, self.start, end))
        return text

    def clear(self) -> None:
        self.parts, self.known, self.tokens, self.start = [], _NONE, 0, self.at

    def _append(self, text: str, stats: _Stats) -> None:
        if text:
            self.parts.append(text)
            self.known = _joined(self.known, stats)

    def add(self, piece: str, gap: int, always: bool) -> None:
        stats = _stats(piece)
        if self.tokens + (estimate_tokens(piece) if self.whole else _tokens(stats)) > self.most and (self.parts or always):
            tail = overlap(self.emit(self.at), self.repeat)
            self.parts, self.known, self.start = [], _NONE, self.at - len(tail)
            self._append(tail, _stats(tail))
        elif self.parts and self.joint:
            self._append(self.joint, _stats(self.joint))
        self._append(piece, stats)
        self.tokens = estimate_tokens("".join(self.parts)) if self.whole else _tokens(self.known)
        self.at += len(piece) + gap


def chunk(text: str, most: int = 4000, repeat: int = 200) -> list[tuple[str, int, int, int]]:
    """(content, tokens, start, end) of each chunk; a last sentence without its mark is lost where sentences are used."""
    if not text:
        return []
    total = estimate_tokens(text)
    if total <= most:
        return [(text, total, 0, len(text))]
    whole = "http" in text or "```" in text
    out = _Filler(most, repeat, "\n\n", False, whole)
    for paragraph in re.split(r"\n\n+", text):
        if estimate_tokens(paragraph) <= most:
            out.add(paragraph, 2, True)
            continue
        out.emit(out.at)
        inner = _Filler(most, repeat, "", True, whole)
        for sentence in sentences(paragraph) or [paragraph]:
            inner.add(sentence, 0, False)
        inner.emit(len(paragraph))
        out.done += [(c, n, out.at + a, out.at + b) for c, n, a, b in inner.done]
        out.at += len(paragraph) + 2
        out.clear()
    out.emit(len(text))
    return out.done


def chunked(df: DataFrame, key: str, text: str = "text", most: int = 4000, repeat: int = 200) -> DataFrame:
    """(key, index, total, content, tokens, start_pos, end_pos): a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1)):
            out: list[list] = [[] for _ in range(7)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = chunk(t or "", most, repeat)
                for i, (content, tokens, a, b) in enumerate(found):
                    for column, x in zip(out, (k, i, len(found), content, tokens, a, b)):
                        column.append(x)
            types = (batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [batch.schema.names[0], "index", "total", "content", "tokens", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, index long, total long, content string, tokens long, start_pos long, end_pos long")
