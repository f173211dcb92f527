"""Secrets: exact base patterns, and a randomness test battery for the tokens they miss.

A candidate is a run of `MIN_LENGTH` or more characters of the usual encodings, or, where
a run fits none of them as a whole, its parts between separators.
Its alphabet is inferred from its characters, and three tests ask whether its
symbols are uniform and independent: chi-squared over the alphabet, runs above
and below the alphabet's middle, and lag-one serial correlation.  Fisher's
statistic joins them; a low one looks random.

A candidate counts as a secret if ordinary text of its length so rarely looks
as random that, by Benjamini and Hochberg's rule, a share of at most `RATE` of
what is reported at that length would be ordinary text.  How ordinary text
behaves is counted over the whole of all texts: each is cut into windows of its own small
letters, anew for every length class.  Both counts are histograms of bounded size, so only
those reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
MIN_LENGTH = 20
RATE = 0.01
#: Length classes, by their least length; longer candidates belong to the last.
LENGTHS = (20, 24, 32, 40, 64)
#: Fisher's statistic in steps of 1/4, up to this many.
BINS = 400

#: Keyword and separator of an assignment.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}")
#: Alphabets that a token is tried against, the smallest first.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "LETTERS": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = [(frozenset(a), {c: k for k, c in enumerate(a)}) for a in ALPHABETS.values()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-12)


def symbols(token: str) -> tuple[np.ndarray, int] | None:
    """Symbol numbers in the smallest alphabet that holds the whole token, and its size."""
    own = set(token)
    for held, place in _SETS:
        if own <= held:
            return np.array([place[c] for c in token]), len(place)
    return None


def statistic(token: str) -> float | None:
    """Fisher's statistic of the three tests against uniform, independent symbols; None outside all alphabets."""
    found = symbols(token.rstrip("="))
    if found is None:
        return None
    x, k = found
    n = len(x)
    counts = np.bincount(x, minlength=k)
    chi2, free = float(((counts - n / k) ** 2).sum() * k / n), k - 1
    z = ((chi2 / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))  # Wilson and Hilferty
    ps = [max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)]
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        ps.append(_two_sided((runs - mean) / spread))
    else:
        ps.append(2.0 ** (1 - n) if n < 40 else 1e-12)
    d = x - (k - 1) / 2
    ps.append(_two_sided(float((d[1:] * d[:-1]).sum()) / max(float((d * d).sum()), 1e-9) * math.sqrt(n)))
    return -2 * sum(map(math.log, ps))


def length_class(n: int) -> int:
    return max(k for k, least in enumerate(LENGTHS) if n >= least)


def _bin(s: float) -> int:
    return min(BINS - 1, int(4 * s))


_SLASHED, _DASHED = re.compile(r"[^/]+"), re.compile(r"[^_-]+")


def _parts(run: str) -> list[tuple[int, int, float]]:
    """(start, end, statistic) of what is tested of a run, by start.

    A run outside all alphabets has both / or + and - or _.  It is split at / (and at - and _
    where that isn't enough) as well as at - and _ alone; of parts that overlap the more random one stays.
    """
    if (s := statistic(run)) is not None:
        return [(0, len(run), s)]
    spans = {m.span() for m in _DASHED.finditer(run)}
    for m in _SLASHED.finditer(run):
        spans |= {m.span()} if symbols(m[0].rstrip("=")) else {(m.start() + x.start(), m.start() + x.end()) for x in _DASHED.finditer(m[0])}
    tested = [(statistic(run[a:b]), a, b) for a, b in spans if len(run[a:b].rstrip("=")) >= MIN_LENGTH]
    kept: list[tuple[int, int, float]] = []
    for s, a, b in sorted(tested):
        if all(b <= start or end <= a for start, end, _ in kept):
            kept.append((a, b, s))
    return sorted(kept)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin) of the tokens outside all base spans."""
    found, k, done = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            done = max(done, base[k][2])
            k += 1
        if done > m.start():
            continue
        found += [(m.start() + a, m.start() + b, length_class(b - a), _bin(s)) for a, b, s in _parts(m[0])]
    return found


_NOT_SMALL = bytes(c for c in range(256) if not 0x61 <= c <= 0x7A)
#: Bytes of windows that are tested at once.
_AT_ONCE = 1 << 20


def _windows(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """(length class, windows one after the other) of the small letters of each text, all of them: the last window of a text ends with it."""
    held = [bytearray() for _ in LENGTHS]
    for text in texts:
        letters = common.encoded(text).translate(None, _NOT_SMALL)
        for k, n in enumerate(LENGTHS):
            whole = len(letters) // n * n
            for start in range(0, whole, _AT_ONCE // n * n):
                held[k] += letters[start : min(whole, start + _AT_ONCE // n * n)]
                if len(held[k]) >= _AT_ONCE:
                    yield k, bytes(held[k])
                    held[k].clear()
            if whole and whole < len(letters):
                held[k] += letters[-n:]
    yield from ((k, bytes(x)) for k, x in enumerate(held) if x)


def _letter_statistics(windows: bytes, n: int) -> np.ndarray:
    """statistic() of each n of the small letters."""
    x = np.frombuffer(windows, dtype=np.uint8).reshape(-1, n).astype(np.int64) - 0x61
    few = np.flatnonzero((x < 6).all(axis=1))  # a smaller alphabet holds these
    k, free, rows = 26, 25, len(x)
    counts = np.bincount((x + k * np.arange(rows)[:, None]).ravel(), minlength=k * rows).reshape(rows, k)
    chi2 = ((counts - n / k) ** 2).sum(axis=1) * k / n
    z = ((chi2 / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    total = np.log(np.maximum(0.5 * _erfc(z / math.sqrt(2)), 1e-12))
    high = x >= k / 2
    a = high.sum(axis=1)
    b = n - a
    runs, mean = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1), 1 + 2 * a * b / n
    z = (runs - mean) / np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    total += np.log(np.where((a > 0) & (b > 0), np.maximum(_erfc(np.abs(z) / math.sqrt(2)), 1e-12), 2.0 ** (1 - n) if n < 40 else 1e-12))
    d = x - (k - 1) / 2
    z = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-9) * math.sqrt(n)
    out = -2 * (total + np.log(np.maximum(_erfc(np.abs(z) / math.sqrt(2)), 1e-12)))
    for at in few.tolist():
        out[at] = statistic(windows[at * n : (at + 1) * n].decode())
    return out


def _erfc(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in z.tolist()])


def ordinary(texts: list[str | None]) -> Counter[tuple[int, int]]:
    """Windows of the texts' own small letters by (length class, bin)."""
    out: Counter[tuple[int, int]] = Counter()
    for k, windows in _windows(texts):
        bins = np.minimum(BINS - 1, (4 * _letter_statistics(windows, LENGTHS[k])).astype(np.int64))
        for b, n in zip(*np.unique(bins, return_counts=True), strict=True):
            out[k, int(b)] += int(n)
    return out


def _scan(batches):
    spot = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("bin", pa.int32())])
    plain = pa.struct([("length", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [])
        texts = batch.column("text").to_pylist()
        for text in texts:
            base = base_spans(text or "")
            columns[0].append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            columns[1].append([{"start": s, "end": e, "length": n, "bin": b} for s, e, n, b in candidates(text or "", base)])
            columns[2].append([])
        if texts:  # the first row of a batch has the counts of all its rows
            columns[2][0] = [{"length": k, "bin": b, "n": n} for (k, b), n in sorted(ordinary(texts).items())]
        kept = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (spot, token, plain), strict=True))], [*(n for n, _ in kept), "base", "candidates", "ordinary"])


def thresholds(tokens: dict[tuple[int, int], int], plain: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """For each length class the first bin that is no longer reported.

    The share of ordinary windows up to a bin, with one added, is that bin's p-value;
    a bin is reported if p times the candidates of the class is at most rate times
    the candidates up to it, the last such bin and all before it.
    """
    out = {}
    for k in range(len(LENGTHS)):
        m, total = sum(n for (c, _), n in tokens.items() if c == k), sum(n for (c, _), n in plain.items() if c == k)
        seen = usual = 0
        for b in range(BINS):
            seen += tokens.get((k, b), 0)
            usual += plain.get((k, b), 0)
            if seen and (usual + 1) / (total + 1) * m <= rate * seen:
                out[k] = b + 1
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The columns of docs but text, with secrets: array of (kind, start, end), by start, then kind.

    Kinds are those of KINDS and "random"; code points, end exclusive.  A null text
    counts as empty.  Repeated rows are handled each for itself; columns named base,
    candidates, ordinary or secrets are replaced.  Without documents nothing is found.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.drop("base", "candidates", "ordinary", "secrets")
    kept = docs.drop("text")
    shape = kept.withColumns({"base": F.array().cast("array<struct<kind:int,start:long,end:long>>"), "candidates": F.array().cast("array<struct<start:long,end:long,length:int,bin:int>>"), "ordinary": F.array().cast("array<struct<length:int,bin:int,n:long>>")}).schema
    scanned = common.stored(docs.mapInArrow(_scan, shape))
    counted = lambda column, n: {(r[0], r[1]): r[2] for r in scanned.select(F.inline(column)).groupBy("length", "bin").agg(n).collect()}
    cut = thresholds(counted("candidates", F.count("*")), counted("ordinary", F.sum("n")), rate)
    limit = F.array(*(F.lit(cut.get(k, 0)) for k in range(len(LENGTHS))))
    random = F.transform(F.filter("candidates", lambda x: x["bin"] < F.element_at(limit, x["length"] + 1)), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    every = F.transform(F.array_sort(F.concat(base, random)), lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.select(*kept.columns, every.alias("secrets"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of find_secrets over the whole documents table; n_spans counts all spans, of base patterns and of the battery."""
    found = find_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, common.of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))
