"""Quality classifier: a weak-label model and a hashed linear scorer.

1. ``LABELLERS`` heuristics look at every document and vote good, bad or nothing.
   Only the counts of the vote patterns (at most 3 ** labellers) leave the tasks.
2. Expectation-maximisation over all documents' patterns estimates how often each
   labeller is right about good and about bad documents (the two-class form of
   Dawid and Skene, 1979), and from that each pattern's posterior.
3. About ``sample`` documents, taken by a hash of their id, train a logistic scorer
   on hashed features with their posteriors as soft labels.  This bound is the only
   one: counting, estimation and scoring are over all documents.
4. The scorer's value, 0 to 1, decides.

Features are hashed n-grams (1 to 4) of the text's character classes with runs
collapsed, so ``THE!!`` gives ``A!``, and of each word's recurrence among the eight
words before it.  No language is assumed.

Defined results: texts that are null, empty or white space have the score 0; a
corpus whose documents all vote alike is all of one quality, the labellers'
majority; rows without a doc_id count, are scored, and come back from
``keep_good``, but don't train; every row is scored on its own text, so
repeated rows have one score; an empty table gives an empty table; other columns,
whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import shared, wordhash
from pageloom.llm.postings import runs

BUCKETS = 1 << 14
SAMPLE = 12_000
THRESHOLD = 0.5
LABELLERS = ("symbols", "odd_endings", "capitals", "exclamations", "capital_words", "dominant_word", "repeated_words", "word_runs", "close_words", "recurring_words", "bars", "letterless_words", "word_length", "sentences")
GOOD, BAD, ABSTAIN = 1, 0, 2

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = ord("a")
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = ord("A")
_CLASS[[ord(c) for c in "0123456789"]] = ord("0")
_CLASS[[9, 11, 12, 13]] = ord(" ")
_CLASS[128:] = ord("a")
_PLAIN_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"-()aA0 \n"])
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of set flags in each range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


class Looks:
    """What labellers and features need to know of a column of texts."""

    def __init__(self, array: pa.Array) -> None:
        self.words = w = wordhash.words(array, "space")
        self.kinds = _CLASS[w.data]
        self.n = len(array)
        self.n_words = w.counts()
        owner = w.owner()
        recent = np.zeros(len(w.hashes), np.uint8)
        for k in range(8, 0, -1):
            same = (w.hashes[k:] == w.hashes[:-k]) & (owner[k:] == owner[:-k])
            recent[k:][same] = k
        self.recent, self.owner = recent, owner

    def sum_bytes(self, flags: np.ndarray) -> np.ndarray:
        return _within(flags, self.words.offsets[:-1], self.words.offsets[1:])

    def dominant(self) -> np.ndarray:
        """Occurrences of each text's most common word."""
        order = np.lexsort((self.words.hashes, self.owner))
        h, o = self.words.hashes[order], self.owner[order]
        out = np.zeros(self.n, np.int64)
        if len(h):
            cuts = np.append(np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))), len(h))
            np.maximum.at(out, o[cuts[:-1]], np.diff(cuts))
        return out

    def sum_words(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[flags], minlength=self.n)

    def votes(self) -> np.ndarray:
        """A row for each text, a column for each labeller."""
        k, w, n_words = self.kinds, self.words, np.maximum(self.n_words, 1)
        ink = np.maximum(self.sum_bytes((k != 32) & (k != 10)), 1)
        letters = np.maximum(self.sum_bytes((k == 97) | (k == 65)), 1)
        symbols, capitals = self.sum_bytes(~_PLAIN_MARKS[k]) / ink, self.sum_bytes(k == 65) / letters
        last = k[w.ends - 1]
        small, large, digits = (_within(k == c, w.starts, w.ends) for c in (97, 65, 48))
        ends = self.sum_bytes((k == 46) | (k == 63)) / n_words
        enough, few = self.n_words >= 8, self.n_words >= 4
        again = self.recent == 1
        runs_of_5 = again.copy()
        for back in range(1, 4):
            runs_of_5[back:] &= again[:-back]
            runs_of_5[:back] = False
        per_word = lambda flags: self.sum_words(flags) / n_words
        bad = lambda flags, when=enough: np.where(flags & when, BAD, ABSTAIN)
        both = lambda no, yes: np.where(no & few, BAD, np.where(yes & enough, GOOD, ABSTAIN))
        out = [
            both(symbols > 0.08, (symbols < 0.01) & (capitals < 0.12)),
            bad(per_word(~_PLAIN_MARKS[last]) > 0.3, few),
            bad(capitals > 0.5),
            bad(self.sum_bytes(k == 33) / n_words > 0.25),
            bad(per_word((small == 0) & (large > 1)) > 0.4),
            bad(self.dominant() / n_words > 0.2),
            bad(per_word(again) > 0.25),
            bad(self.sum_words(runs_of_5) > 0),
            bad(per_word((self.recent > 0) & (self.recent < 4)) > 0.4),
            bad(per_word(self.recent > 0) > 0.5),
            bad(self.sum_bytes(k == 124) / n_words > 0.1, few),
            bad(per_word(small + large + digits == 0) > 0.2, few),
            np.where((letters / n_words < 1.5) | (letters / n_words > 20), BAD, ABSTAIN),
            both((ends == 0) & (self.n_words >= 30), (ends > 0.01) & (ends < 0.6)),
        ]
        return np.stack(out, 1)

    def patterns(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(LABELLERS)))

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of all features, one group after another; texts ascend in each."""
        k, offsets = self.kinds, self.words.offsets
        begins = np.ones(len(k), bool)
        begins[1:] = k[1:] != k[:-1]
        edge = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[edge] = True
        at = np.flatnonzero(begins)
        kinds, owner = k[at].astype(np.uint64), np.searchsorted(offsets, at, "right") - 1
        yield from _grams(kinds, owner, 4, 1)
        yield from _grams(self.recent.astype(np.uint64), self.owner, 3, 2)


def _grams(symbols: np.ndarray, owner: np.ndarray, longest: int, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h = np.full(len(symbols), salt, np.uint64) * _GOLDEN
    for n in range(1, longest + 1):
        m = len(symbols) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ symbols[n - 1 :]) * _GOLDEN
        whole = owner[:m] == owner[n - 1 :]
        yield owner[:m][whole], (h[whole] >> np.uint64(50)).astype(np.int32)


@dataclass
class WeakModel:
    """Share of good documents, and P(vote | class, voted or not) as [labeller, class, vote]."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            log = np.log(self.votes)
            good, bad = np.full(len(patterns), np.log(self.prior)), np.full(len(patterns), np.log1p(-self.prior))
        for k in range(len(self.votes)):
            v = patterns // 3**k % 3
            good, bad = good + log[k, GOOD, v], bad + log[k, BAD, v]
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracy(self, labeller: int) -> float:
        """How often a vote of it is right."""
        p = self.votes[labeller] * np.array([[1 - self.prior], [self.prior]])
        return float((p[GOOD, GOOD] + p[BAD, BAD]) / p[:, :2].sum())


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> WeakModel:
    """Expectation-maximisation over counted vote patterns; it begins with "bad if any labeller says so"."""
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    good = np.where((votes == BAD).any(1), 0.02, 0.98)
    smooth = 0.5
    model = WeakModel(0.5, np.full((labellers, 2, 3), 1 / 3))
    for _ in range(rounds):
        prior = (counts @ good + smooth) / (counts.sum() + 2 * smooth)
        table = np.full((labellers, 2, 3), smooth)
        for v in range(3):
            table[:, GOOD, v] += (counts * good) @ (votes == v)
            table[:, BAD, v] += (counts * (1 - good)) @ (votes == v)
        model, old = WeakModel(prior, table / table.sum(2, keepdims=True)), model
        good = model.posterior(patterns)
        if np.abs(model.votes - old.votes).max() < 1e-7:
            break
    return model


def train(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by full-batch Adam."""
    w, n = np.zeros(BUCKETS + 1), len(label)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[bucket] * value, n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        g = np.append(np.bincount(bucket, error[doc] * value, BUCKETS), error.sum()) / max(n, 1) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return w


#: Frequencies are multiplied by this, so that weights stay small.
_SCALE = 4.0


def score(looks: Looks, weights: np.ndarray) -> np.ndarray:
    z = np.full(looks.n, weights[-1])
    for owner, bucket in looks.features():
        cuts = runs(owner)
        if len(owner):
            total = np.add.reduceat(weights[bucket], cuts[:-1])
            z[owner[cuts[:-1]]] += _SCALE * total / np.diff(cuts)
    out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    out[looks.n_words == 0] = 0
    return out


_COUNTED = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])
_SAMPLED = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32()), ("buckets", pa.binary()), ("values", pa.binary())])


def _count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wordhash.slices(batch):
            pattern, n = np.unique(Looks(part.column("text")).patterns(), return_counts=True)
            yield shared.rows(_COUNTED, pattern=pattern, n=n)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wordhash.slices(batch):
            looks = Looks(part.column("text"))
            doc, bucket, value = [], [], []
            for owner, b in looks.features():
                pair, n = np.unique(owner.astype(np.int64) * BUCKETS + b, return_counts=True)
                total = np.bincount(owner, minlength=looks.n)
                doc.append(pair // BUCKETS)
                bucket.append(pair % BUCKETS)
                value.append(_SCALE * n / total[pair // BUCKETS])
            doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(looks.n + 1))
            b, v = (np.concatenate(bucket)[order].astype(np.uint16), np.concatenate(value)[order].astype(np.float32)) if bucket else (np.zeros(0, np.uint16), np.zeros(0, np.float32))
            blob = lambda x: [x[i:j].tobytes() for i, j in zip(cut, cut[1:])]  # noqa: B023, E731
            yield shared.rows(_SAMPLED, doc_id=part.column("doc_id"), pattern=looks.patterns(), buckets=blob(b), values=blob(v))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[WeakModel, np.ndarray]:
    """The weak-label model of all documents, and the scorer's weights."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.select("text").mapInArrow(shared.freed(_count_votes), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64)
    if not len(patterns):
        return WeakModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), np.zeros(BUCKETS + 1)
    model = estimate(patterns, counts)
    share = int(min(1.0, sample / counts.sum()) * 2**31)
    chosen = texts.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share))
    # equal rows train once, however many there are
    rows = sorted(chosen.dropDuplicates().mapInArrow(shared.freed(_sample_features), "doc_id long, pattern int, buckets binary, values binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    buckets, values = ([np.frombuffer(r[k], t) for r in rows] for k, t in ((2, np.uint16), (3, np.float32)))
    if not rows:
        return model, np.append(np.zeros(BUCKETS), np.log(model.prior / (1 - model.prior)))
    doc = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
    label = model.posterior(np.array([r[1] for r in rows], np.int64))
    return model, train(doc, np.concatenate(buckets).astype(np.int64), np.concatenate(values).astype(np.float64), label)


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``weak_label`` (the votes' posterior) and ``quality_score``, both from 0 (bad) to 1 (good).

    If ``docs`` has columns of these names, the new ones' have leading underscores.
    """
    model, weights = fit(docs, sample)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch):
                looks = Looks(part.column("text"))
                label, value = model.posterior(looks.patterns()), score(looks, weights)
                label[looks.n_words == 0] = 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label), pa.array(value)], [*names, *new])

    new = [shared.free_name(n, docs) for n in ("weak_label", "quality_score")]
    return docs.mapInArrow(shared.freed(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in new)]))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is ``threshold`` or more, all columns."""
    out = scored(docs, sample)
    return out.where(F.col(out.columns[-1]) >= threshold).select(*docs.columns)
