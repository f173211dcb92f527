"""Sum-of-squares packing of tokenized documents into sequences of bounded length.

A document's ids are cut into pieces only where it is longer than a sequence:
every piece but the first is a full sequence, and a full piece is packed as it is.  Shorter pieces are packed in shards of
about `shard_pieces`; each shard places a piece where the sum of squared
counts of open bins per residual gap becomes smallest.  The sequences that a
shard leaves at most half full then become units that are packed again, by
groups of shards, and what is still half empty by groups of groups, until one group is left, so no task ever sees more than a
shard and the waste doesn't grow with the number of shards.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
SHARD_PIECES = 50_000
#: Shards whose half-empty sequences meet in one task of the next round.
FAN_IN = 64
#: Parts of texts that a worker remembers the ids of from batch to batch.
KNOWN_PARTS = 50_000
#: Characters of texts that are encoded at once.
TOGETHER = 8 << 20
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts of other characters are left to the tokenizer itself.
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ÿ]*")
#: Stands between parts; no plain text holds it.
_FENCE = "\t"
#: The tokenizer's split for plain texts; without adjacent spaces its look-ahead has nothing to decide.
_PLAIN_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, as little-endian 32-bit words.

    Pre-tokens never reach over a single space that stands before and after
    something else than white space, so plain texts are split there and each
    part of a batch is encoded once, all new parts in one call; `ranks` is the
    same vocabulary for a library that encodes faster.  Parts are numbers from the split to the
    ids, which one indexing lays out for the whole batch, so nothing is done part by part in Python.  Other texts are encoded
    whole, by the tokenizer itself where they hold a special token's string.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [str(x.content) for x in self.whole.get_added_tokens_decoder().values()]
        self.parts = self.rest = None
        if ranks_path:
            import public_tokenizers

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.parts, self.rest = (tiktoken.Encoding("own", pat_str=x, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for x in (_PLAIN_PARTS, public_tokenizers.PATTERN))
        #: Parts whose ids, with a space before each, are remembered, and these ids one part after the other.
        self.known = pa.array([], pa.string())
        self.lengths, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        self.fence = self.one(_FENCE)

    def one(self, text: str) -> bytes:
        if self.rest and not any(s in text for s in self.special):
            return array("I", self.rest(text)).tobytes()
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n")) and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        plain = [k for k, t in enumerate(texts) if t and self.parts and self._plain(t)]
        out = [b"" if not t else None for t in texts]
        group = np.cumsum([0, *(len(texts[k]) for k in plain)])[:-1] // TOGETHER
        for own in np.split(np.array(plain, dtype=np.int64), np.flatnonzero(np.diff(group)) + 1):
            for k, found in zip(own.tolist(), self._split([texts[k] for k in own.tolist()]), strict=True):
                out[k] = found
        return [self.one(t) if x is None else x for x, t in zip(out, texts, strict=True)]

    def _split(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts."""
        if not texts:
            return
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, first = split.offsets.to_numpy()[1:], split.offsets.to_numpy()[:-1]
        parts = split.values.dictionary_encode()
        words = parts.dictionary.cast(pa.string())
        at = pc.index_in(words, self.known)
        new = words.filter(at.is_null())
        lengths, ids = self._several(new, " ")
        head_lengths, head_ids = self._several(split.values.take(pa.array(first)), "")

        # Known parts, then new ones, then the heads, each of which is a part of its own.
        k, n = len(self.known), len(self.known) + len(new)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = np.arange(k, n)
        number = place[parts.indices.to_numpy()]
        number[first] = np.arange(n, n + len(texts))
        all_lengths, all_ids = np.concatenate([self.lengths, lengths, head_lengths]), np.concatenate([self.ids, ids, head_ids])
        starts, own = (np.cumsum(all_lengths) - all_lengths)[number], all_lengths[number]
        stop = np.cumsum(own)
        data = all_ids[np.repeat(starts - stop + own, own) + np.arange(stop[-1])].tobytes()
        if k < KNOWN_PARTS:
            self.known, self.lengths, self.ids = pa.concat_arrays([self.known, new]), np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        e = (4 * stop[ends - 1]).tolist()
        yield from (data[x:y] for x, y in zip([0, *e[:-1]], e, strict=True))

    def _several(self, parts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, with `before` in front of it, and all ids."""
        if not len(parts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        text = before + (_FENCE + before).join(parts.to_numpy(zero_copy_only=False))
        ids = np.array(self.parts(text), dtype="<u4")
        fences = ids == np.frombuffer(self.fence, dtype="<u4")[0]
        return np.diff(np.flatnonzero(fences), prepend=-1, append=len(ids)) - 1, ids[~fences]


def encoder(tokenizer_path: str, ranks_path: str | None) -> Encoder:
    held = common.worker_state().__dict__.setdefault("encoders", {})
    key = (tokenizer_path, ranks_path)
    if key not in held:
        held[key] = Encoder(*key)
    return held[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity, if there are several."""
    first = n if n <= capacity else (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.  A null text counts as empty: one end id."""
    end = array("I", [END_ID]).tobytes()

    def run(batches):
        own = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, found in zip(batch.column(0).to_pylist(), own.batch(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(found + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(rows, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def sum_of_squares(sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the level of each bin.

    Sizes are placed one by one in the order given.  With N(g) open bins of
    gap g, moving a bin from gap g to g - size, or opening one, goes where the
    sum of N(g)^2 over g > 0 ends smallest; ties take the smaller gap left, so
    an existing bin before a new one.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    n_open = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    level: list[int] = []
    at, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    none = np.int64(1 << 40)
    for k, size in enumerate(sizes.tolist()):
        here = n_open[size:capacity]
        change = 2 * (n_open[: capacity - size] - here) + 2
        if size < capacity:
            change[0] = 1 - 2 * here[0]  # a full bin is no longer open
            change[here == 0] = none
            best = int(change.argmin())
            gap = size + best if change[best] <= 2 * n_open[capacity - size] + 1 else capacity
        else:
            gap = capacity
        if gap == capacity:
            b = len(level)
            level.append(0)
        else:
            b = bins[gap].pop()
            n_open[gap] -= 1
        at[k], offset[k] = b, level[b]
        level[b] += size
        if gap > size:
            bins[gap - size].append(b)
            n_open[gap - size] += 1
    return at, offset, np.array(level, dtype=np.int64)


def _pack_shard(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        at, offset, level = sum_of_squares(rows["length"], capacity)
        return rows.assign(bin=(rows["shard"].to_numpy() << 32) + at, offset=offset, level=level[at])

    return run


def _pack_units(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["level", "unit"], ascending=[False, True], kind="stable")
        at, offset, level = sum_of_squares(rows["level"], capacity)
        out = []
        for b, own in rows.assign(at=at, offset=offset).groupby("at"):
            members = [{"bin": m["bin"], "base": m["base"] + int(o)} for ms, o in zip(own["members"], own["offset"], strict=True) for m in ms]
            out.append((int(own["place"].iloc[0]), int(own["unit"].iloc[0]), int(level[b]), members))
        return pd.DataFrame(out, columns=["place", "unit", "level", "members"])

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Lengths lie between 1 and capacity.  A piece of full length is a sequence by itself and is packed nowhere.
    Repeated rows are packed each for itself, ties go by doc_id; an empty table gives an empty result.
    `pieces` is read several times and must be the same each time, as a stored table is.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") >= capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity).select(*names)
    shards = max(1, -(-short.count() // shard_pieces))
    # Rows that are alike are dealt out by their place in the table, so that no shard has all of them.
    dealt = short.withColumn("shard", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(shards)))
    kind = f"{_PIECES}, shard long, bin long, offset long, level long"
    placed = common.stored(dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), kind))
    if shards == 1:
        return placed.select(*names, F.col("bin").alias("sequence_id"), "offset").unionByName(full)

    units = placed.filter(F.col("level") <= capacity // 2).groupBy("bin").agg(F.first("level").alias("level"), F.first("shard").alias("place"))
    units = units.select("place", F.col("bin").alias("unit"), "level", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"))
    finished = None
    while shards > 1:
        shards = -(-shards // FAN_IN)
        units = units.withColumn("place", F.floor(F.col("place") / FAN_IN).cast("long"))
        units = common.stored(units.groupBy("place").applyInPandas(_pack_units(capacity), "place long, unit long, level long, members array<struct<bin:long,base:long>>"))
        done = units if shards == 1 else units.filter(F.col("level") > capacity // 2)
        finished = done if finished is None else finished.unionByName(done)
        units = units.filter(F.col("level") <= capacity // 2)
    moved = finished.select("unit", F.inline("members")).select(F.col("unit"), F.col("bin").alias("from_bin"), "base")
    joined = placed.join(moved, F.col("bin") == F.col("from_bin"), "left")
    return joined.select(*names, F.coalesce("unit", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")).unionByName(full)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = common.table(spark, sf_dir, "documents")
    return pack(common.stored(tokenized(docs, *paths())))
