"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text,
each after a stretch of common text that both share.  A window of text is
compressed with either, and the difference of the two lengths says which class
knows it better.  Windows are single words between two fixed strings, so a word's
distance is found once and remembered.  Words that aren't known yet are compressed
many at a time, sorted, by one dictionary after the other: each then stays in the
processor's cache, which halves the time and changes no distance.

What makes a text toxic is a small part of it, so the dictionaries are trained
in rounds: each fold's documents are measured with dictionaries that never saw
them, and the next round trains on the words that then lie nearest to the toxic
class, from toxic documents on one side and ordinary ones on the other.  The
distances of a document become a probability by a logistic model, fitted on
the same out-of-fold distances: its thresholds are calibrated for the share of
toxic documents among all labels.

The classifier is fitted on a sample of at most SAMPLE documents of each class,
chosen by a hash of doc_id; every document is scored over its whole text.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents of each class in the fitted sample: toxic, ordinary.
SAMPLE = (1200, 2400)
#: Words that a dictionary learns from at most, for each of its bytes: a bound on the sample, as the number of documents is.
WORDS_PER_BYTE = 50
#: Size of both dictionaries, round by round: wide at first, then only what tells the classes apart.
DICTIONARY = (65536, 32768, 16384, 16384)
SHARED = 65536
FOLDS = 2
#: Words of a document that go into the next round at most.
NEAREST = 6
LEVEL = 12
SEED = 7
#: Words whose distances a worker remembers, about; beyond that those go that weren't asked for since half as many others were.
KNOWN_WORDS = 1_000_000
#: Words that are looked up at a time, which bounds what is held beside the memory.
AT_ONCE = 100_000
#: What stands before and after a word; matches cannot begin in the last eight bytes of an input.
_BEFORE, _AFTER = b" 0123456789 abcdefghijklmnop ", b" zyxwvutsrqponmlk 9876543210 "
_STEPS = (1, 2, 3, 4, 5, 6, 7)


def windows(text: str | None) -> set[bytes]:
    """The distinct words of a text between white space, ASCII letters lower-cased."""
    return {*common.encoded(text).lower().split()}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content += _BEFORE + _AFTER
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    chosen = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=chosen)


def _content(words: list[bytes], size: int, rng: random.Random) -> bytes:
    """What a dictionary trained on the words holds; all of them where they are too few to train on."""
    words = sorted(words)
    rng.shuffle(words)
    words = words[: WORDS_PER_BYTE * size]
    lines = [b" " + b" ".join(words[k : k + 4]) + b" " for k in range(0, len(words), 4)]
    try:
        return zstandard.train_dictionary(size + 2048, lines, k=16, d=6, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(lines)[:size]


class Distances:
    """A word's distance by each pair of dictionaries: length by the ordinary one less length by the toxic one."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [(_compressor(ordinary).compress, _compressor(toxic).compress) for toxic, ordinary in pairs]
        self.recent: dict[bytes, tuple[int, ...]] = {}
        self.earlier: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Puts all of the words among the recent ones."""
        if len(self.recent) > KNOWN_WORDS // 2:
            self.earlier, self.recent = self.recent, {}
        wanted = {*words}.difference(self.recent)
        new = sorted(wanted.difference(self.earlier))
        self.recent.update((w, self.earlier[w]) for w in wanted.difference(new))
        data = [_BEFORE + w + _AFTER for w in new]
        found = zip(*(map(sub, *([len(compress(x)) for x in data] for compress in pair)) for pair in self.pairs), strict=True)
        # Few distances differ, so equal ones are held once.
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.recent.update((w, same.setdefault(d, d)) for w, d in zip(new, found, strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row for each word, a column for each pair."""
        out = np.zeros((len(words), len(self.pairs)), dtype=np.int64)
        for k in range(0, len(words), AT_ONCE):
            part = words[k : k + AT_ONCE]
            self._learn(part)
            out[k : k + AT_ONCE].flat = np.fromiter(chain.from_iterable(map(self.recent.__getitem__, part)), np.int64, len(part) * len(self.pairs))
        return out


def features(distances: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A row for each text, whose words' distances follow each other, as many as its size; without words it counts as one at 0."""
    n = np.maximum(sizes, 1)
    d = np.zeros(int(n.sum()), dtype=np.int64)
    d[np.repeat(np.array(sizes) > 0, n)] = distances
    starts = np.cumsum(n) - n
    over = np.stack([np.add.reduceat(d >= s, starts, dtype=np.int64) for s in _STEPS], axis=1)
    return np.c_[np.log1p(over), 10 * over / n[:, None], np.log(n), np.add.reduceat(d, starts) / n, np.maximum.reduceat(d, starts)]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    b, hold = np.zeros(z.shape[1]), np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (p - y) + np.r_[b[:-1], 0])
    return mean, spread, b


@dataclass
class Model:
    """Contents of each fold's dictionaries and the logistic weights; without pairs, every score is `share`."""

    pairs: list[tuple[bytes, bytes]]
    mean: np.ndarray | None
    spread: np.ndarray | None
    weights: np.ndarray | None
    shift: float
    share: float

    def distances(self) -> Distances:
        """Of this model, as far as the Python worker knows them already."""
        held = common.worker_state().__dict__.setdefault("distances", {})
        name = hashlib.sha256(b"".join(x for pair in self.pairs for x in pair)).digest()
        if name not in held:
            held.clear()
            held[name] = Distances(self.pairs)
        return held[name]

    def scores(self, known: Distances, texts: Iterable[str | None]) -> list[float]:
        """Of texts in their order; words are looked up for as many texts together as have AT_ONCE of them."""
        out, held, n = [], [], 0
        for text in texts:
            held.append(windows(text))
            n += len(held[-1])
            if n >= AT_ONCE:
                out += self._scores(known, held)
                held, n = [], 0
        return out + self._scores(known, held)

    def _scores(self, known: Distances, held: list[set[bytes]]) -> list[float]:
        if not self.pairs or not held:
            return [self.share] * len(held)
        found, sizes = known.of([*chain.from_iterable(held)]), [len(x) for x in held]
        z = []
        for k in range(len(self.pairs)):
            x = np.c_[(features(found[:, k], sizes) - self.mean) / self.spread, np.ones(len(held))]
            # Row by row: a product of matrices may round equal rows differently.
            z.append([row @ self.weights for row in x])
        return (1 / (1 + np.exp(-np.clip(np.mean(z, axis=0) + self.shift, -30, 30)))).tolist()

    def score(self, known: Distances, text: str | None) -> float:
        return self.scores(known, [text])[0]


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """share: of toxic documents among all that the sample stands for.  One class alone gives a constant score."""
    if len(toxic) < FOLDS or len(ordinary) < FOLDS:
        return Model([], None, None, None, 0.0, share)
    rng = random.Random(SEED)
    texts = [[common.encoded(t).lower().split() for t in x] for x in (toxic, ordinary)]
    sets = [[sorted({*t}) for t in x] for x in texts]
    shared = _content([w for k, t in enumerate(texts[1]) if k % 2 for w in t], SHARED, rng)
    chosen = [[[w for t in x[f::FOLDS] for w in t] for f in range(FOLDS)] for x in texts]
    for size in DICTIONARY:
        pairs = [tuple(shared + _content([w for g in range(FOLDS) if g != f for w in x[g]], size, rng) for x in chosen) for f in range(FOLDS)]
        rows, classes, nearest = [], [], [[], []]
        for f, pair in enumerate(pairs):
            known = Distances([pair])
            for k, own in enumerate(sets):
                picked, held = [], own[f::FOLDS]
                found, sizes = known.of([*chain.from_iterable(held)])[:, 0], [len(words) for words in held]
                rows.append(features(found, sizes))
                classes += [1 - k] * len(held)
                for words, d in zip(held, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
                    picked += [w for v, w in sorted(zip(d.tolist(), words, strict=True), reverse=True)[:NEAREST] if v > 0]
                nearest[k].append(picked)
        if all(len(x) for own in nearest for x in own):
            chosen = nearest
    mean, spread, weights = _logistic(np.concatenate(rows), np.array(classes))
    odds = len(toxic) / len(ordinary)
    return Model(pairs, mean, spread, weights, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6) / odds)), share)


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), learnt where crc32(doc_id) mod 5 is not 0.

    At most sample[0] toxic and sample[1] ordinary documents reach the driver, the least text of each where a doc_id repeats.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).distinct()
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    texts: dict[int, list[str]] = {}
    for k, n in ((1, sample[0]), (0, sample[1])):
        ids = marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id")
        held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        texts[k] = [r[1] for r in sorted(held.collect(), key=lambda r: (r[0], r[1]))]
    return fit(texts[1], texts[0], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs with score, 0 to 1, from its `text` alone.

    A null text counts as empty: it has no words and takes the score of a text
    without any.  Other columns stay (one named score is replaced); repeated
    rows have equal scores.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.drop("score")

    def run(batches):
        known = model.distances()
        for batch in batches:
            out = model.scores(known, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from the rows that aren't held out."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    scored = score(docs, fitted(docs, labels))
    # A null doc_id counts as an empty string, whose crc32 is 0: held out.
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
