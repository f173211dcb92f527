"""Repeated substrings by longest-previous-factor arrays, cut at a length and bucketed by anchors.

A string of `length` bytes starts elsewhere too if the longest previous factor
of one of its places is that long.  In suffix order, the suffixes that agree on
`length` bytes form a run; the previous and next smaller positions of a suffix
lie in its run unless it is the run's smallest, which is the first copy.  So the
factors cut at `length` follow from the runs of the suffix order.

To sort all suffixes in parts, each string is given to its anchor: the `gram`
bytes in it of least hash, the first of them.  Equal strings have equal anchors
at equal offsets, so a bucket holds the suffixes of one anchor's surroundings.
Its suffixes are sorted at offset 0 once; each step to the left refines that
order by the byte that comes before.  Only anchors that occur more than once
ship text, and equal surroundings of a task ship it once.  Anchors whose
surroundings are too many for one task's memory are split further, by the 128-bit hash
of each string, which gives the same runs.

Two lengths are matched at once: `length`, which is removed, and the shorter
`passage_bytes`, whose runs of over `passage_words` words are reported as passages.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

LENGTH = 400
#: A passage has over PASSAGE_WORDS words; in prose these have PASSAGE_BYTES bytes or more.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 220
GRAM = 64
#: Surroundings of one anchor that a task sorts at most; more are split by each string's hash.
BUCKET = 20_000
#: Surroundings that are sorted at once, whole buckets of them.
AT_ONCE = 8192
#: Starts that are hashed at once; must be below 2^20.
BLOCK = 1 << 19
#: Surroundings that a task remembers to ship once.
REMEMBERED = 100_000
#: A key with more than a share of 1 / SHARE of all rows is dealt to SALTS tasks; there are less than SHARE of them.
SHARE, SALTS = 500, 16
_ANCHOR = np.dtype([("h", "<i8"), ("pos", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("wide_lo", "<i4"), ("wide_hi", "<i4")])
_PLACE = "key binary, h long, pos long, lo int, hi int, wide_lo int, wide_hi int"


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours of v."""
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(v)] = v
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs_of(data: np.ndarray, ends: np.ndarray, first: int, count: int, length: int, h: np.ndarray, gram: int) -> np.ndarray:
    """(anchor, first start, last start) of the starts first to first + count whose string ends in their own text."""
    count = min(count, len(data) - length + 1 - first)
    if count <= 0:
        return np.zeros((0, 3), dtype=np.int64)
    n = count + length - gram
    # Equal strings have equal hashes at equal distances, so the place may break ties in the last 20 bits.
    ranked = (h[:n] & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
    at = (_least(ranked, length - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64) + first
    starts = np.arange(first, first + count)
    at[ends[starts] - starts < length] = -1
    turns = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.stack([at[turns], starts[turns], np.append(starts[turns][1:], first + count) - 1], axis=1)
    return out[out[:, 0] >= 0]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, passage_bytes: int = PASSAGE_BYTES) -> list[np.ndarray]:
    """Anchors of each text: hash, position, and offsets from it to the first and last start of a short and of a long string.

    A range whose first lies behind its last is empty.  An anchor may have several rows, of different ranges.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    found = []
    for first in range(0, max(0, len(data) - passage_bytes + 1), BLOCK):
        part = data[first : first + BLOCK + length - 1]
        at = np.arange(len(part) - gram + 1)
        h = hashing.substring_hashes(hashing.prefix_sums(part), at, at + gram)
        short = _runs_of(data, ends, first, BLOCK, passage_bytes, h, gram)
        wide = _runs_of(data, ends, first, BLOCK, length, h, gram)
        for runs, is_wide in ((short, False), (wide, True)):
            own = np.zeros(len(runs), dtype=_ANCHOR)
            own["h"], own["pos"] = h[runs[:, 0] - first].view(np.int64), runs[:, 0]
            own["hi"] = own["wide_hi"] = -length  # empty: from 0 to before that
            lo, hi = ("wide_lo", "wide_hi") if is_wide else ("lo", "hi")
            own[lo], own[hi] = runs[:, 1] - runs[:, 0], runs[:, 2] - runs[:, 0]
            found.append(own)
    every = np.concatenate([*found, np.zeros(0, dtype=_ANCHOR)])
    every = every[np.lexsort((every["wide_lo"], every["lo"], every["pos"]))]
    if len(every):
        # An anchor of a long string is one of short strings too: one row for both, where each has one range.
        starts = np.flatnonzero(np.concatenate([[True], every["pos"][1:] != every["pos"][:-1]]))
        count = np.diff(np.append(starts, len(every)))
        pair = starts[count == 2]
        a, b = every[pair], every[pair + 1]
        fits = ((a["lo"] <= a["hi"]) != (b["lo"] <= b["hi"])) & ((a["wide_lo"] <= a["wide_hi"]) != (b["wide_lo"] <= b["wide_hi"]))
        pair = pair[fits]
        for lo, hi in (("lo", "hi"), ("wide_lo", "wide_hi")):
            mine = every[lo][pair] <= every[hi][pair]
            every[lo][pair] = np.where(mine, every[lo][pair], every[lo][pair + 1])
            every[hi][pair] = np.where(mine, every[hi][pair], every[hi][pair + 1])
        every = np.delete(every, pair + 1)
    text = np.searchsorted(stops, every["pos"], side="right")
    every["pos"] -= (stops - sizes)[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _scan(length: int, gram: int, passage_bytes: int, words: int):
    def run(batches):
        for batch in batches:
            texts = [common.encoded(t) for t in batch.column("text").to_pylist()]
            keys = [hashlib.sha256(t).digest()[:16] for t in texts]
            packed = [x.tobytes() for x in anchors(texts, length, gram, passage_bytes)]
            many = [len(t.split()) > words for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("who"), pa.array(many, pa.bool_()), pa.array(packed, pa.binary())], ["key", "who", "many", "anchors"])

    return run


def _places(batches):
    """A row for each anchor of a text."""
    for batch in batches:
        keys, packed = batch.column("key").to_pylist(), batch.column("anchors").to_pylist()
        own = np.frombuffer(b"".join(packed), dtype=_ANCHOR)
        counts = np.array([len(x) // _ANCHOR.itemsize for x in packed], dtype=np.int64)
        key = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
        yield pa.RecordBatch.from_arrays([key, *(pa.array(np.ascontiguousarray(own[n])) for n in _ANCHOR.names)], ["key", *_ANCHOR.names])


def _surroundings(length: int, passage_bytes: int):
    """For each repeated anchor of a text a row with the name of the bytes around it, and a row with those bytes for each name."""
    names = ["key", "pos", "id", "h", "bytes", "before", "lo", "hi", "wide_lo", "wide_hi", "n", "place", "instance"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), *[pa.int32()] * 5, pa.int64(), pa.binary(), pa.bool_()]

    def told(held):
        n = len(held)
        columns = zip(*held.values(), strict=True) if n else [()] * 9
        own = [pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.array(list(held), kinds[2]), *(pa.array(c, k) for c, k in zip(columns, kinds[3:12], strict=True)), pa.array([False] * n)]
        held.clear()
        return pa.RecordBatch.from_arrays(own, names)

    def run(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            keys, texts, found = batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("anchors")
            cuts, every = found.offsets.to_numpy(), found.values
            h, pos, lo, hi, wide_lo, wide_hi = (pc.struct_field(every, n).to_numpy() for n in _ANCHOR.names)
            short, wide = lo <= hi, wide_lo <= wide_hi
            first = np.where(short & wide, np.minimum(lo, wide_lo), np.where(short, lo, wide_lo))
            last = np.where(short & wide, np.maximum(hi + passage_bytes, wide_hi + length), np.where(short, hi + passage_bytes, wide_hi + length))
            marks = np.stack([lo, hi, wide_lo, wide_hi], axis=1).astype("<i4").tobytes()
            starts, ends, at = (pos + first).tolist(), (pos + last).tolist(), pos.tolist()
            ids = []
            for key, text, a, b in zip(keys, texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                data = common.encoded(text)
                for j in range(a, b):
                    around = data[starts[j] : ends[j]]
                    name = hashlib.blake2b(around + marks[16 * j : 16 * j + 16], digest_size=16).digest()
                    ids.append(name)
                    own = held.get(name)
                    place = key + at[j].to_bytes(8, "big")
                    if own is None:
                        held[name] = [int(h[j]), around, -int(first[j]), int(lo[j]), int(hi[j]), int(wide_lo[j]), int(wide_hi[j]), 1, place]
                    else:
                        own[7] += 1
                        if place < own[8]:
                            own[8] = place
            n = len(ids)
            which = np.repeat(np.arange(len(keys)), np.diff(cuts))
            columns = [pa.array(keys, pa.binary()).take(pa.array(which)), pa.array(pos[cuts[0] : cuts[-1]]), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, k) for k in kinds[3:12]), pa.array([True] * n)], names)
            if len(held) > REMEMBERED:
                yield told(held)
        yield told(held)

    return run


def _filled(parts: list[bytes], width: int, fill: bytes) -> np.ndarray:
    return np.frombuffer(b"".join([x.ljust(width, fill) for x in parts]), dtype=np.uint8).reshape(len(parts), width)


def factors(rows: list[tuple], lengths: tuple[int, int]) -> list[tuple[bytes, bool, int, int, bool]]:
    """(id, long, from, to, first): offsets at which a row's string of a length occurs again.

    rows are (bucket, id, bytes, before, lo, hi, wide_lo, wide_hi, copies, place), `before` bytes of which
    stand before the anchor; lengths are the short and the long one.  `first` says that no
    equal string has a smaller place: its previous factor is shorter.  Bytes 0xFE and 0xFF, which no
    UTF-8 text holds, fill up; starts within a row's range never reach them.
    """
    rows = sorted(rows, key=lambda x: (x[0], x[2][x[3] :]))  # the suffix order at offset 0
    n, reach = len(rows), max(lengths)
    bucket = np.unique(np.array([x[0] for x in rows], dtype=np.int64), return_inverse=True)[1].ravel()
    right = _filled([x[2][x[3] :] for x in rows], reach, b"\xff")
    longest = max(x[3] for x in rows)
    left = _filled([x[2][: x[3]][::-1] for x in rows], max(1, longest), b"\xfe")
    same = right[1:] == right[:-1]
    agree = np.concatenate([[-1], np.where(same.all(axis=1), reach, same.argmin(axis=1))])
    agree[1:][bucket[1:] != bucket[:-1]] = -1
    ranges = [(np.array([x[4 + 2 * k] for x in rows]), np.array([x[5 + 2 * k] for x in rows])) for k in (0, 1)]
    begins = np.array([-x[3] for x in rows])
    copies = np.array([x[8] for x in rows], dtype=np.int64)
    place = np.empty(n, dtype=np.int64)
    place[sorted(range(n), key=lambda k: (rows[k][9], rows[k][1]))] = np.arange(n)
    live, group = np.arange(n), bucket.astype(np.int64)  # rows that reach so far to the left; equal so far
    found = []
    for offset in range(0, -longest - 1, -1):
        if offset:
            stays = begins[live] <= offset
            group = np.unique(group[stays] * 256 + left[live[stays], -offset - 1], return_inverse=True)[1].ravel()
            live, agree = live[stays], _thinned(agree, stays)
            alone = np.bincount(group, weights=copies[live])[group] < 2
            if alone.any():
                live, group, agree = live[~alone], group[~alone], _thinned(agree, ~alone)
        if not len(live):
            break
        for k, length in enumerate(lengths):
            lo, hi = ranges[k][0][live], ranges[k][1][live]
            here = np.flatnonzero((lo <= offset) & (offset <= hi))
            if not len(here):
                continue
            run = np.cumsum(agree < length + offset)[here]  # agree on the string's part from the anchor on
            code = group[here] * (n + 1) + run
            order = np.argsort(code, kind="stable")
            code, own = code[order], live[here][order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.append(starts, len(code)))
            twice = np.repeat(np.add.reduceat(copies[own], starts) > 1, size)
            least = np.repeat(np.minimum.reduceat(place[own], starts), size)
            own, least = own[twice], least[twice]
            found.append(np.stack([own, np.full(len(own), k), np.full(len(own), offset), place[own] == least], axis=1))
    if not found:
        return []
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    turn = np.ones(len(every), dtype=bool)
    turn[1:] = (every[1:, [0, 1, 3]] != every[:-1, [0, 1, 3]]).any(axis=1) | (every[1:, 2] != every[:-1, 2] + 1)
    starts = np.flatnonzero(turn)
    stops = np.append(starts[1:], len(every)) - 1
    return [(rows[a][1], bool(k), lo, hi, bool(first)) for (a, k, lo, first), hi in zip(every[starts].tolist(), every[stops, 2].tolist(), strict=True)]


def _thinned(agree: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Agreement of neighbours after rows were left out: the least of all between them."""
    kept = np.flatnonzero(stays)
    if not len(kept):
        return agree[:0]
    # A kept row's span reaches back to the row after the kept one before it.
    starts = np.concatenate([[0], kept[:-1] + 1])
    return np.minimum.reduceat(agree[: kept[-1] + 1], starts)


_MATCH = "id binary, wide boolean, from int, to int, first boolean, n long"


def _match(lengths: tuple[int, int]):
    """factors() of whole buckets, of rows that come sorted by bucket."""
    columns = ("h", "id", "bytes", "before", "lo", "hi", "wide_lo", "wide_hi", "n", "place")

    def run(batches):
        held: dict[bytes, list] = {}
        last = None

        def table():
            rows = list(held.values())
            held.clear()
            total = {x[1]: x[8] for x in rows}
            found = [(*x, total[x[0]]) for x in factors(rows, lengths)] if rows else []
            kinds = (pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 6, kinds, strict=True)], ["id", "wide", "from", "to", "first", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[0] != last and len(held) >= AT_ONCE:
                    yield table()
                last = row[0]
                own = held.get(row[1])
                if own is None:
                    held[row[1]] = list(row)
                else:  # the same surroundings from another task
                    own[8] += row[8]
                    own[9] = min(own[9], row[9])
        yield table()

    return run


def _strings(lengths: tuple[int, int]):
    """Each string of the surroundings of anchors that are split further, by its hash."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "bytes", "before", "lo", "hi", "wide_lo", "wide_hi", "n", "place")]
            for name, around, before, *ranges, n, place in zip(*columns, strict=True):
                rows = [(k == 1, o, hashlib.blake2b(around[before + o : before + o + lengths[k]] + b"%d,%d" % (k, o), digest_size=16).digest()) for k in (0, 1) for o in range(ranges[2 * k], ranges[2 * k + 1] + 1)]
                wide, offsets, digests = zip(*rows, strict=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.binary()), pa.array(wide), pa.array(offsets, pa.int32()), pa.array(digests, pa.binary()), pa.array([n] * m, pa.int64()), pa.array([place] * m, pa.binary())], ["id", "wide", "offset", "digest", "n", "place"])

    return run


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words of data between white space that lie in start..end as a whole."""
    n = len(data[start:end].split())
    space = b" \t\n\r\x0b\x0c"
    cut_off = [at for at in {start, end} if 0 < at < len(data) and data[at - 1] not in space and data[at] not in space]
    return max(0, n - len(cut_off))


def _covered(words: int):
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, passages, hashes = [], [], []
            found = batch.column("matches")
            cuts, every = found.offsets.to_pylist(), found.values
            starts, ends, wide = (pc.struct_field(every, n).to_numpy(zero_copy_only=False) for n in ("start", "end", "wide"))
            for text, a, b in zip(batch.column("text").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                data = common.encoded(text)
                long = a + np.flatnonzero(wide[a:b])
                out = _merged(starts[long], ends[long])
                kept, done = hashlib.sha256(), 0
                for start, end in out:
                    kept.update(data[done:start])
                    done = end
                kept.update(data[done:])
                spans.append([{"start": s, "end": e} for s, e in out])
                hashes.append(kept.hexdigest())
                passages.append([{"start": s, "end": e} for s, e in _merged(starts[a:b], ends[a:b]) if whole_words(data, s, e) > words])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind), pa.array(passages, kind), pa.array(hashes)], ["key", "spans", "passages", "kept_sha256"])

    return run


def _frequent(rows: DataFrame, key: str, n: str) -> DataFrame:
    """The keys that hold more than one row in SHARE: less than SHARE of them, whatever the input."""
    total = rows.agg(F.sum(n)).first()[0] or 0
    return rows.groupBy(key).agg(F.sum(n).alias("m")).filter(F.col("m") * SHARE > total).select(key)


def repeated_substrings(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, passage_bytes: int = PASSAGE_BYTES, passage_words: int = PASSAGE_WORDS, bucket: int = BUCKET, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, passages (start, end in UTF-8 bytes) and kept_sha256, a row for each row of docs.

    spans are the maximal runs of bytes that strings of `length` bytes cover that start in another place
    too, in the same text or another; kept_sha256 is of the bytes outside them.  passages are such runs for strings of
    passage_bytes (`length` where that is less), of more than passage_words whole words.  With keep_first the first of a string's places, in
    the order of text hash and position, is left out.  Equal texts of `length` bytes or more
    are removed whole, with keep_first all but one row: the one of least doc_id.  A null text
    is empty.  Repeated rows count as copies.  An empty table gives no rows.
    """
    common.bounded_batches(docs.sparkSession)
    passage_bytes = min(passage_bytes, length)
    lengths = (passage_bytes, length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A text's key is half of its SHA-256; `who` tells its rows apart, so that one of them ships the text.
    content = F.coalesce("text", F.lit("")).cast("binary")
    key = F.substring(F.unhex(F.sha2(content, 256)), 1, 16).alias("key")
    who = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("who")
    scanned = docs.select(who, "text").mapInArrow(_scan(length, gram, passage_bytes, passage_words), "key binary, who long, many boolean, anchors binary")
    texts_of = common.stored(scanned.groupBy("key").agg(F.count("*").alias("copies"), F.min("who").alias("who"), F.first("many").alias("many"), F.first("anchors").alias("anchors")))
    places = texts_of.select("key", "anchors").mapInArrow(_places, _PLACE)
    counted = places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    counted = common.stored(counted)
    # A common line's anchor may be in a large share of all rows: it is dealt to SALTS tasks.
    often = F.broadcast(_frequent(counted, "h", "n").withColumn("often", F.lit(True)))
    salts = F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    twice = counted.join(often, "h", "left").select("h", salts.alias("salt"))
    dealt = places.join(often, "h", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = dealt.join(twice, ["h", "salt"]).groupBy("key").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "wide_lo", "wide_hi")).alias("anchors"))
    repeated = repeated.join(texts_of.select("key", "who"), "key")
    held = common.stored(docs.select(key, who, "text").join(repeated, ["key", "who"]).dropDuplicates(["key", "who"]).select("key", "text", "anchors"))

    around = common.stored(held.mapInArrow(_surroundings(length, passage_bytes), "key binary, pos long, id binary, h long, bytes binary, before int, lo int, hi int, wide_lo int, wide_hi int, n long, place binary, instance boolean"), "instance")
    alike = around.filter("NOT instance").select("id", "h", "bytes", "before", "lo", "hi", "wide_lo", "wide_hi", "n", "place")
    large = alike.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > bucket).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    large = common.stored(large)
    salted = alike.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    matched = salted.join(large, ["h", "salt"], "left_anti").drop("salt").repartition("h").sortWithinPartitions("h").mapInArrow(_match(lengths), _MATCH)
    strings = salted.join(large, ["h", "salt"], "left_semi").groupBy("id").agg(*(F.first(c).alias(c) for c in ("bytes", "before", "lo", "hi", "wide_lo", "wide_hi")), F.sum("n").alias("n"), F.min("place").alias("place"))
    strings = strings.mapInArrow(_strings(lengths), "id binary, wide boolean, offset int, digest binary, n long, place binary")
    runs = strings.groupBy("digest").agg(F.sum("n").alias("all"), F.min("place").alias("least")).filter("all > 1")
    more = strings.join(runs, "digest").select("id", "wide", F.col("offset").alias("from"), F.col("offset").alias("to"), (F.col("place") == F.col("least")).alias("first"), "n")
    found = matched.union(more).groupBy("id").agg(F.max("n").alias("n"), F.collect_list(F.struct("wide", "from", "to", "first")).alias("runs"))
    least = around.filter("NOT instance").groupBy("id").agg(F.min("place").alias("place"))
    found = common.stored(found.join(least, "id"))

    # The surroundings that are most common go to all tasks, the others by their name.
    places_of = around.filter("instance").select("key", "pos", "id")
    often = F.broadcast(_frequent(found, "id", "n"))
    common_ = places_of.join(F.broadcast(found.join(often, "id")), "id")
    others = places_of.join(often, "id", "left_anti").join(found.join(often, "id", "left_anti"), "id")
    spots = common_.unionByName(others).select("key", "pos", "place", F.inline("runs"))
    if keep_first:
        spots = spots.filter(~(F.col("first") & (F.col("place") == F.concat("key", F.unhex(F.lpad(F.hex("pos"), 16, "0"))))))
    spots = spots.select("key", "wide", (F.col("pos") + F.col("from")).alias("start"), (F.col("pos") + F.col("to") + F.when(F.col("wide"), length).otherwise(passage_bytes)).alias("end"))
    by_text = spots.groupBy("key").agg(F.collect_list(F.struct("wide", "start", "end")).alias("matches"))
    span = "array<struct<start:long,end:long>>"
    cut = held.select("key", "text").join(by_text, "key").mapInArrow(_covered(passage_words), f"key binary, spans {span}, passages {span}, kept_sha256 string")
    none, whole = F.array().cast(span), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    copy = F.col("copies") > 1
    if keep_first:
        copy = copy & ~(who == F.col("least"))
    own = docs.select("doc_id", key, F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))
    rows = own.join(texts_of.select("key", "copies", "many", F.col("who").alias("least")), "key").join(cut, "key", "left")
    removed = copy & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(removed, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy & F.col("many"), whole).otherwise(F.coalesce("passages", none)).alias("passages"),
        F.when(removed, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def _total(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of repeated_substrings over the whole documents table, every copy removed; n_passage is the bytes of all passages."""
    found = repeated_substrings(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", _total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", _total("passages").alias("n_passage"))
