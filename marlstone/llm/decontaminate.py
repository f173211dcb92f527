"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words.  A
window can only occur in a document that holds all of its shingles, so one
shingle is a sufficient prefix, and the rarest one over all documents is the
cheapest.  One pass over the documents counts each benchmark shingle; the
second looks up prefix shingles only, bounds a candidate by its position in
the window and the document's length, and verifies it word by word.

Documents are never shuffled.  The benchmark goes to the workers in blocks of
about `block_bytes` of text, one pass pair each, so a large benchmark costs
more passes, not more memory; copies of an item are spread over all blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20
#: No UTF-8 text holds this byte; it stands between the documents of a batch.
_FENCE = b"\xff"
_SPANS = "array<struct<start:long,stop:long>>"


class Index:
    """One block of benchmark items: word ids, windows, and the shingles of each window.

    A shingle is `shingle` words, or the whole window where that is shorter; its
    code is its word ids read as digits, kept apart by size.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {_FENCE: -1}
        windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            if item is None:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in common.words(text)]
            for k in range(max(0, len(ids) - window) + 1) if ids else ():
                windows[tuple(ids[k : k + window])].add(item)
        self.base = len(self.vocabulary) + 1
        while self.base**shingle >= 1 << 62:  # so many words that a code must be of fewer
            shingle -= 1
        self.windows = [np.array(w, dtype=np.int32) for w in windows]
        self.items = [sorted(x) for x in windows.values()]
        self.sizes = sorted({min(len(w), shingle) for w in windows})
        found: dict[int, set[int]] = {s: set() for s in self.sizes}
        for w in windows:
            s = min(len(w), shingle)
            found[s].update(self._code(w[k : k + s]) for k in range(len(w) - s + 1))
        self.codes = {s: np.array(sorted(x), dtype=np.int64) for s, x in found.items()}
        self.shingle = shingle
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def _code(self, ids) -> int:
        code = 0
        for i in ids:
            code = code * self.base + i
        return code

    def tokens(self, texts: list[str | None]) -> np.ndarray:
        """Word ids of all texts, 0 for words outside the benchmark, -1 after each text."""
        data = (b" " + _FENCE + b" ").join([*map(common.encoded, texts), b""]).translate(common.WORD_TABLE).split()
        return np.fromiter(map(self.vocabulary.get, data, repeat(0)), dtype=np.int32, count=len(data))

    def occurring(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of benchmark shingles of this size, and their indexes in codes[size]."""
        known, n, own = ids > 0, len(ids) - size + 1, self.codes[size]
        if n <= 0 or not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = known[:n].copy()
        for k in range(1, size):
            whole &= known[k : n + k]
        at = np.flatnonzero(whole)
        code = np.zeros(len(at), dtype=np.int64)
        for k in range(size):
            code = code * self.base + ids[at + k]
        where = np.minimum(np.searchsorted(own, code), len(own) - 1)
        same = own[where] == code
        return at[same], where[same]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Give each window its rarest shingle as prefix; windows with an absent shingle cannot occur."""
        self.prefix = {s: {} for s in self.sizes}
        place = {s: {int(c): k for k, c in enumerate(own)} for s, own in self.codes.items()}
        for number, w in enumerate(self.windows):
            s = min(len(w), self.shingle)
            ranked = [(counts.get((s, p), 0), p, k) for k in range(len(w) - s + 1) for p in [place[s][self._code(w[k : k + s].tolist())]]]
            if min(ranked)[0]:
                _, p, offset = min(ranked)
                self.prefix[s].setdefault(p, []).append((number, offset))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, window) of each occurrence, verified over the whole window."""
        for s in self.sizes:
            owners = self.prefix[s]
            wanted = np.zeros(len(self.codes[s]), dtype=bool)
            wanted[list(owners)] = True
            at, where = self.occurring(ids, s)
            keep = wanted[where]
            for p, code in zip(at[keep].tolist(), where[keep].tolist(), strict=True):
                for number, offset in owners[code]:
                    w, start = self.windows[number], p - offset
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        yield start, number


def _count(index: Index):
    def run(batches):
        totals = {s: np.zeros(len(c), dtype=np.int64) for s, c in index.codes.items()}
        for batch in batches:
            ids = index.tokens(batch.column(0).to_pylist())
            for s in index.sizes:
                totals[s] += np.bincount(index.occurring(ids, s)[1], minlength=len(totals[s]))
        for s, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["size", "place", "n"])

    return run


def _mark(index: Index):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = index.tokens(texts)
            ends = np.flatnonzero(ids == -1)
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            for start, number in index.occurrences(ids):
                row = int(np.searchsorted(ends, start))
                spans[row].append((start - int(starts[row]), start - int(starts[row]) + len(index.windows[number])))
                items[row].update(index.items[number])
            out = {n: batch.column(n) for n in batch.schema.names}
            old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist()
            for row, found in spans.items():
                old_spans[row] = merged([(x["start"], x["stop"]) for x in old_spans[row]] + found)
                old_items[row] = sorted(items[row].union(old_items[row]))
            kind = batch.schema.field("hit_spans").type
            out["hit_spans"] = pa.array([[x if isinstance(x, dict) else {"start": x[0], "stop": x[1]} for x in row] for row in old_spans], kind)
            out["items"] = pa.array(old_items, pa.list_(pa.int64()))
            out["n_words"] = pa.array((ends - starts).astype(np.int64))
            yield pa.RecordBatch.from_pydict(out)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of docs with n_words, hit_spans (disjoint word spans), items and contaminated.

    docs needs `text` and keeps its other columns but those four names, which are
    replaced; benchmark needs item_id and text.  A null or wordless text has no
    words and no hits.  Benchmark rows without words or without an id are ignored;
    repeated ids count once.  Repeated documents each get their own row.  An empty
    table on either side gives rows without hits, or no rows.
    """
    spark: SparkSession = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.drop("n_words", "hit_spans", "items", "contaminated")
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    kept = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(_SPANS), "items": F.array().cast("array<long>")})
    for k in range(blocks):
        own = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(r[0], r[1]) for r in own.toLocalIterator()], window, shingle)
        counts = docs.select("text").mapInArrow(_count(index), "size int, place int, n long").groupBy("size", "place").agg(F.sum("n").alias("n"))
        index.order({(r[0], r[1]): r[2] for r in counts.collect()})
        kept = kept.mapInArrow(_mark(index), kept.schema)
        if k < blocks - 1:  # one Python worker for a task, not one for each block
            kept = common.stored(kept)
    return kept.withColumn("contaminated", F.size("hit_spans") > 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of find_contamination over the whole documents table."""
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        "contaminated",
    )
