"""Documents that are hard to handle, and small random corpora."""

from __future__ import annotations

import random
import re

import regex
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.wordhash import PLAIN_SEPARATOR

#: Documents' columns, then ones whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_lines string, Lines_Removed string, found_lines int, cut_at string, quality_score string, weak_label int, near_copy string, bucket int, part string, hashes binary, cluster string, size int, `group` int, block int, key string"
CLASHES = ("k", "L", 1, "c", "q", 2, "n", 3, "p", b"h", "c", 4, 5, 6, "y")
_SEPARATOR = regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PLAIN_SEPARATOR))

LINE = "The quick brown fox jumps over the lazy dog near the old mill at noon."
PASSAGE = " ".join(f"word{i}" for i in range(60))
#: Longer than any slice or piece that the operators take at once.
LONG = " ".join(f"tok{i % 4001}x{i % 7}" for i in range(600_000))


def hard_rows() -> list[tuple]:
    texts = [
        (1, f"{LINE}\nFirst own line here.\n{PASSAGE}"),
        (2, f"{LINE}\nSecond own line, with more.\n\n{PASSAGE}"),
        (2, f"{LINE}\nSecond own line, with more.\n\n{PASSAGE}"),
        (None, f"{LINE}\nNobody's line."),
        (4, None),
        (5, ""),
        (6, " \n\t \n"),
        (7, LONG),
        (8, "one"),
        (9, "one"),
        (10, "Ünïcödé — «ſtraße» İstanbul 漢字　かな\n\nzwei"),
        (11, PASSAGE + " " + PASSAGE),
        (12, "\n".join([LINE] * 3)),
    ]
    rows = [(i, t, "en", "s1", len(t) if t else None, *CLASHES) for i, t in texts]
    rows.append((13, LINE + " null columns", *[None] * (3 + len(CLASHES))))
    return rows


def hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hard_rows(), SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return [w for w in _SEPARATOR.split((text or "").lower()) if w]


def corpus(n: int = 60, seed: int = 1) -> list[tuple[int, str, str]]:
    """(doc_id, text, source): random documents, near and exact copies, shared lines and passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choices(vocabulary, k=k)).capitalize() + "."
    shared = [sentence(12) for _ in range(3)]
    passage = sentence(70)
    out: list[tuple[int, str, str]] = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            text = r.choice(out)[1]
        elif out and kind < 0.4:
            w = r.choice(out)[1].split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            lines = [sentence(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
            if r.random() < 0.4:
                lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
            if r.random() < 0.2:
                lines.append(passage)
            text = "\n".join(lines)
        out.append((i * 3 + 1, text, f"s{r.randrange(4)}"))
    return out


def frame(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
