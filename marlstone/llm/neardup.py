"""Near duplicates by Order MinHash.

A document is the sequence of its runs of five words.  Each of several sketches
hashes these shingles, labelled by occurrence, keeps the few of least hash and
puts them back in text order; two documents that share a sketch are candidates.
So a sketch agrees where content and its order agree.  Candidates are verified
by a banded alignment of the shingle sequences: with m shingles in a longest
common subsequence of sequences of lengths a and b, their similarity is
m / (a + b - m), and pairs of SIMILARITY or more are linked.  Classes are the
connected components of the links.

No pair list of a group is ever made.  Documents with equal words collapse
first.  Sketches link each document to one other of its bucket, and components
of those links are verified, each in one task with an index of rare shingles
and only between documents not yet in one class.  A component that is too large
for a task is split by hash; then buckets in which several classes are left
are verified with the documents outside their largest class in every part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches and their shingles for documents of 32 shingles or more: at similarity 0.8 all
#: 32 sketches miss with a probability of 0.00006, at 0.3 one of them hits with 0.02.
LONG = (32, 6)
#: The same for 39 shingles or fewer; lengths between have both, since similar lengths differ by a fifth at most.
SHORT = (16, 2)
LEAST_LONG, MOST_SHORT = 32, 39
#: Shingles that one verification task holds, about.
TASK_SHINGLES = 1_000_000


def _sketch(codes: np.ndarray, count: int, size: int, salt: int) -> list[int]:
    """Hashes of the least `size` labelled shingles under `count` orders, each read in text order."""
    own = hashing.labelled(codes)
    out, step = [], max(1, min(count, (1 << 21) // max(1, len(own))))
    for k in range(0, count, step):
        keys = np.arange(k, min(k + step, count), dtype=np.uint64)[:, None] + np.uint64(salt * 1000 + 1)
        h = (own[None, :] ^ hashing.mixed(keys)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = np.sort(np.argpartition(h, size - 1, axis=1)[:, :size], axis=1) if len(own) > size else np.broadcast_to(np.arange(len(own)), (len(h), len(own)))
        found = hashing.mixed(keys[:, 0])
        for j in range(at.shape[1]):
            found = hashing.mixed(found * np.uint64(31) + own[at[:, j]])
        out.extend(found.view(np.int64).tolist())
    return out


def sketches(codes: np.ndarray) -> list[int]:
    n = len(codes)
    return (_sketch(codes, *LONG, 1) if n >= LEAST_LONG else []) + (_sketch(codes, *SHORT, 2) if 0 < n <= MOST_SHORT else [])


def _codes(text: str | None) -> tuple[bytes, np.ndarray]:
    data = common.encoded(text).translate(common.WORD_TABLE)
    return data, hashing.shingles(hashing.word_hashes(data), SHINGLE)


def _prepare(batches):
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, codes = _codes(text)
            for column, x in zip(rows, (doc, hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest(), len(codes), sketches(codes)), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "sketch"])


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether a longest common subsequence of a and b has `need` elements or more.

    Then at most len(a) + len(b) - 2 * need elements are left out, so it lies in a
    band of that half width, and matches outside the band don't count.  The row of
    the alignment is one integer of a bit for each element of b, advanced for each
    element of a; blocks of rows touch only the bits of their part of the band.
    """
    slack = len(a) + len(b) - 2 * need
    if slack < 0:
        return False
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b, need = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist(), need - head - tail
    if need <= 0:
        return True
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    wide = {x: sum(1 << j for j in p) for x, p in places.items() if len(p) > 8}
    row, block = (1 << len(b)) - 1, 512
    for first in range(0, len(a), block):
        lo, hi = max(0, first - slack), min(len(b), first + block + slack + 1)
        if lo >= hi:
            break
        mask = (1 << (hi - lo)) - 1
        part = (row >> lo) & mask
        for i in range(first, min(len(a), first + block)):
            x = a[i]
            if x in wide:
                left = max(lo, i - slack)
                hits = ((wide[x] >> left) & ((1 << (min(hi, i + slack + 1) - left)) - 1)) << (left - lo) if min(hi, i + slack + 1) > left else 0
            else:
                hits = 0
                for j in places.get(x, ()):
                    if i - slack <= j <= i + slack and lo <= j < hi:
                        hits |= 1 << (j - lo)
            if hits := hits & part:
                part = ((part + hits) | (part - hits)) & mask
        row = (row & ~(mask << lo)) | (part << lo)
    return len(b) - row.bit_count() >= need


class Verifier:
    """Joins the classes of documents that align, each compared only outside its class."""

    def __init__(self, nodes: list[int], texts: list[str], classes: list[int] | None = None):
        self.nodes = nodes
        self.codes = [_codes(t)[1] for t in texts]
        self.own = [np.sort(hashing.labelled(c)) for c in self.codes]
        self.up = list(range(len(nodes)))
        first: dict[int, int] = {}
        for k, c in enumerate(classes or ()):
            self.join(first.setdefault(c, k), k)
        self._run()

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b, key=lambda k: (self.nodes[k], k))] = min(a, b, key=lambda k: (self.nodes[k], k))

    def alike(self, a: int, b: int) -> bool:
        n = len(self.own[a]) + len(self.own[b])
        need = -int(-(SIMILARITY / (1 + SIMILARITY) * n - 1e-9) // 1)
        if min(len(self.own[a]), len(self.own[b])) < need:
            return False
        if len(np.intersect1d(self.own[a], self.own[b], assume_unique=True)) < need:
            return False
        return aligned(self.codes[a], self.codes[b], need)

    def _run(self) -> None:
        everything, counts = np.unique(np.concatenate([*self.own, np.zeros(0, np.uint64)]), return_counts=True)
        index: dict[int, list[int]] = defaultdict(list)
        for k in sorted(range(len(self.nodes)), key=lambda k: (len(self.own[k]), self.nodes[k])):
            own = self.own[k]
            n = len(own)
            if not n:
                continue
            rare = own[np.argsort(counts[np.searchsorted(everything, own)], kind="stable")]
            seen: set[int] = set()
            prefix = rare[: n - -int(-(SIMILARITY * n - 1e-9) // 1) + 1].tolist()
            for code in prefix:
                for other in index[code]:
                    if other not in seen and self.find(other) != self.find(k):
                        seen.add(other)
                        if self.alike(other, k):
                            self.join(other, k)
            for code in prefix:
                index[code].append(k)

    def classes(self) -> list[int]:
        return [self.nodes[self.find(k)] for k in range(len(self.nodes))]


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("node")
    found = Verifier(rows["node"].tolist(), rows["text"].tolist(), rows["label"].tolist() if "label" in rows else None)
    return pd.DataFrame({"u": rows["node"], "v": found.classes()})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size (rows) and n_shingles, a row for each row of docs.

    Texts are compared by their lower-cased words.  A text without words, or null, is
    like no other and is a class of its own; so is a row without a doc_id, whose class_id
    is null.  Rows with one doc_id count as one document.  A text of fewer than five words
    is one shingle, so only equal ones are linked.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prepared = common.stored(docs.mapInArrow(_prepare, "doc_id long, key binary, n_shingles long, sketch array<long>"))
    worded = prepared.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = common.stored(worded.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    buckets = nodes.select("node", "n", F.explode("sketch").alias("h"))
    centres = buckets.groupBy("h").agg(F.min("node").alias("c"), F.max("node").alias("d")).filter("c <> d")
    groups = components(buckets.join(centres, "h").filter("node <> c").select(F.col("node").alias("u"), F.col("c").alias("v")))

    sized = groups.join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    parts = sized.groupBy("label").agg(F.ceil(F.sum("n") / TASK_SHINGLES).alias("parts"))
    dealt = common.stored(sized.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select("label", "part", "parts", "node"))
    # One text for each node, the least of the rows that share its doc_id.  The join moves the
    # texts at every size, so that its cost is in proportion to the input.
    texts = docs.join(dealt.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    texts = common.stored(texts.groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "node"))
    links = dealt.join(texts, "node").groupBy("label", "part").applyInPandas(lambda rows: _verify(rows.drop(columns="label")), "u long, v long")
    links = common.stored(links)
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    if dealt.filter("parts > 1").limit(1).count():
        links = links.union(_across(buckets, dealt, labels, texts))
        labels = components(links.filter("u <> v"))

    classes = nodes.select("key", "node", "copies").join(labels, "node", "left").select("key", "copies", F.coalesce("label", "node").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    classes = classes.join(sizes, "class_id").select("key", "class_id", "class_size")
    own = prepared.withColumn("key", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("key")))
    return own.join(classes, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "n_shingles")


def _across(buckets: DataFrame, dealt: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between parts of the components that were split, found bucket by bucket.

    Only buckets in which several classes are left take part.  In each, the members
    of its largest class are dealt to parts, and all others go to each part: whatever
    is compared is compared with all that it isn't joined to yet.
    """
    split = dealt.filter("parts > 1").select("node").distinct()
    held = buckets.join(split, "node", "left_semi").join(labels, "node").select("h", "node", "n", "label")
    by_class = held.groupBy("h", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    open_ = by_class.groupBy("h").agg(F.count("*").alias("classes"), F.max(F.struct("m", "label")).alias("top"), F.sum("n").alias("n")).filter("classes > 1")
    open_ = open_.select("h", F.col("top.label").alias("largest"), F.ceil(F.col("n") / TASK_SHINGLES).alias("parts"))
    rows = held.join(open_, "h").withColumn("to", F.when(F.col("label") == F.col("largest"), F.array(F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("h", "node", "label", F.explode("to").alias("part")).join(texts, "node")
    return rows.groupBy("h", "part").applyInPandas(_verify, "u long, v long").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id leads its class, each once; rows without a doc_id stay.

    Rows that share a leading doc_id but not the text all stay: only equal ones are copies.
    """
    kept = near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    found = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    mark = "_content"
    while mark in docs.columns:
        mark += "_"
    found = found.withColumn(mark, F.sha2("text", 256)).dropDuplicates(["doc_id", mark])
    return found.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates over the whole documents table."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
