"""Personal data: exact base patterns and a semi-Markov conditional random field on top.

The base patterns give what must be found.  The model adds what they miss, such
as phone numbers without a plus sign or addresses written "name [at] host".  It
scores whole candidate segments of up to `MAX_TOKENS` tokens by features of the
whole span (its shape, digit count, checksum, borders, the words before it) and a
dynamic program chooses boundaries and kinds together.  It is trained here, on
`TRAIN_LINES` generated lines, by stochastic gradients of the exact conditional
likelihood; the seed is fixed, so each run has the same weights.

Each text is handled whole and by itself, so nothing is shuffled.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: A segment of the model has at most so many tokens.
MAX_TOKENS = 24
TRAIN_LINES = 160
EPOCHS = 6
SEED = 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match that fails from the first digit of a run fails from the others too, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    twice = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _octets(quad: str) -> bool:
    parts = [x.lstrip("0") or "0" for x in quad.split(".")]
    return all(len(x) < 4 and int(x) < 256 for x in parts)


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            at = done = m.end()
        else:
            at = done = at + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start; linear in the text's length."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= x <= "9" for x in m[0]) <= 15]
    return found


# The model.

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
#: Where the model looks: numbers of some length, and at signs, plain or bracketed.
_TRIGGER = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]|@|[\[(](?:at|AT)[\])]")
_AT = r"(?: ?[\[(](?:at|AT)[\])] ?|@)"
_DOT = r"(?: ?[\[(](?:dot|DOT)[\])] ?|\.)"
_SHAPES = {
    "mail": re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+"),
    "quad": re.compile(r"\d+\.\d+\.\d+\.\d+"),
    "groups": re.compile(r"\d{4}(?:([ -]?)\d{4})(?:\1\d{4})+|\d{4}[ -]?\d{6}[ -]?\d{5}"),
    "plus": re.compile(r"\+\d[ ().0-9-]+\d"),
    "local": re.compile(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"),
    "date": re.compile(r"\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{4}"),
}
_HINTS = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "mail": "mail", "email": "mail", "contact": "mail", "ip": "net", "server": "net", "host": "net", "card": "card", "visa": "card", "order": "other", "version": "other", "isbn": "other", "id": "other"}


def _border(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    x = text[at]
    return "space" if x.isspace() else "digit" if x.isdigit() else "letter" if x.isalpha() else "stop" if x in ".,;:!?" else "mark"


def span_features(text: str, start: int, end: int, hint: str) -> tuple[str, ...]:
    """Features of the whole span and its borders."""
    s = text[start:end]
    digits = "".join(x for x in s if "0" <= x <= "9")
    n = len(digits)
    out = [f"shape {k}" for k, p in _SHAPES.items() if p.fullmatch(s)] or ["shape none"]
    if "shape quad" in out:
        out.append(f"parts {_octets(s)}")
    if n >= 13:
        out.append(f"luhn {luhn(digits)}")
    out += [f"digits {0 if n == 0 else 1 if n < 7 else 2 if n < 9 else 3 if n < 13 else 4 if n < 20 else 5}", f"left {_border(text, start - 1)}", f"right {_border(text, end)}", f"hint {hint}", f"first {_border(s, 0)}", f"last {_border(s, len(s) - 1)}"]
    return tuple(out)


def _before(text: str, at: int) -> int:
    """The start of the last MAX_TOKENS tokens before a place, all of an entity that ends there."""
    width = 8 * MAX_TOKENS
    while True:
        lo = max(0, at - width)
        starts = [m.start() for m in _TOKEN.finditer(text, lo, at)]
        if lo == 0 or len(starts) > MAX_TOKENS:  # the first token may be cut off
            return starts[-MAX_TOKENS] if len(starts) > MAX_TOKENS else 0
        width *= 4


def _after(text: str, at: int) -> int:
    """The end of the first MAX_TOKENS tokens after a place."""
    return next(islice((m.end() for m in _TOKEN.finditer(text, at)), MAX_TOKENS - 1, None), len(text))


def _regions(text: str):
    """(start, end) around each trigger, as far as an entity can reach; regions that touch are one."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        lo, hi = m.span()
        if m[0] in "@" or m[0][1:-1].lower() == "at":
            lo = _before(text, lo) if end is None or lo > end else lo
            hi = _after(text, hi)
        elif sum("0" <= x <= "9" for x in m[0]) < 7:
            continue
        else:
            hi = min(len(text), hi + 1)
        if end is not None and lo <= end:
            start, end = min(start, lo), max(end, hi)
            continue
        if end is not None:
            yield start, end
        start, end = lo, hi
    if end is not None:
        yield start, end


def _hint(text: str, at: int) -> str:
    before = re.findall(r"[A-Za-z]+", text[max(0, at - 24) : at])[-2:]
    return next((_HINTS[x.lower()] for x in reversed(before) if x.lower() in _HINTS), "none")


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], tuple[str, ...]]]:
    """Tokens of text[lo:hi], and the features of each run of tokens that could be an entity."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    kind = ["d" if "0" <= text[s] <= "9" else "s" if text[s].isspace() else "a" if text[s].isalpha() else text[s] for s, _ in tokens]
    found = {}
    for i, (s, _) in enumerate(tokens):
        if kind[i] not in "da+(_%" or kind[i] == "a" and i and kind[i - 1] == "a":
            continue
        digits, letters, at = 0, kind[i] == "a", False
        hint = None
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, b = tokens[j]
            if kind[j] == "d":
                digits += b - a
            elif kind[j] == "a":
                letters = True
            elif kind[j] == "@":
                at = True
            elif text[a] == "\n" or kind[j] not in "s@.()[]+-_%":
                break
            at = at or text[a:b] in ("at", "AT") and j > 0 and text[a - 1] in "[("
            if kind[j] == "s" and letters and not at and text[b : b + 3] not in ("[at", "(at", "[AT", "(AT"):
                break
            if kind[j] in "da" and (at if letters else digits >= 7):
                hint = hint or _hint(text, s)
                found[i, j + 1] = span_features(text, s, b, hint)
    return tokens, found


class SemiCrf:
    """Weights of (feature, kind); a token outside all entities scores 0."""

    def __init__(self):
        self.weights: dict[tuple[str, int], float] = defaultdict(float)
        self.known: dict[tuple[str, ...], list[float]] = {}

    def scores(self, features: tuple[str, ...]) -> list[float]:
        if features not in self.known:
            self.known[features] = [sum(self.weights.get((f, k), 0.0) for f in features) for k in range(len(KINDS))]
        return self.known[features]

    def decode(self, n: int, found: dict) -> list[tuple[int, int, int]]:
        """The best segmentation: (kind, first token, token after)."""
        by_end = defaultdict(list)
        for (i, j), features in found.items():
            s = self.scores(features)
            k = max(range(len(KINDS)), key=lambda x: s[x])
            by_end[j].append((i, k, s[k]))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, k, s in by_end.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if back[j]:
                out.append((back[j][1], back[j][0], j))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def step(self, n: int, found: dict, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log likelihood of gold: (first token, token after, kind)."""
        self.known.clear()
        arcs = [(i, j, k, s) for (i, j), f in found.items() for k, s in enumerate(self.scores(f))]
        ends, starts = defaultdict(list), defaultdict(list)
        for arc in arcs:
            ends[arc[1]].append(arc)
            starts[arc[0]].append(arc)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, _, _, s in ends[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[j] + s for _, j, _, s in starts[i])])
        for i, j, k, s in arcs:
            share = ((i, j, k) in gold) - math.exp(ahead[i] + s + behind[j] - ahead[n])
            for f in found[i, j] if abs(share) > 1e-4 else ():
                self.weights[f, k] += rate * share


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("aeioustrnlmdhéü") for _ in range(rng.randint(2, 9)))


def _entity(rng: random.Random, kind: int) -> str:
    if kind == 0:
        host = ".".join([_word(rng).encode("ascii", "ignore").decode() + "x" for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org", "net"])])
        name = _word(rng).encode("ascii", "ignore").decode() + rng.choice(["", ".", "_", "."]) + rng.choice(["", "a", _digits(rng, 2)]) + "x"
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", ".")])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        n = rng.choice([16, 16, 16, 15, 13])
        digits = next(x for x in iter(lambda: _digits(rng, n), "") if luhn(x))
        return rng.choice([digits, " ".join(digits[k : k + 4] for k in range(0, n, 4)), "-".join(digits[k : k + 4] for k in range(0, n, 4))]) if n == 16 else digits
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"])


def _decoy(rng: random.Random) -> str:
    bad = next(x for x in iter(lambda: _digits(rng, 16), "") if not luhn(x))
    return rng.choice([bad, " ".join(bad[k : k + 4] for k in range(0, 16, 4)), f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", _digits(rng, rng.randint(7, 12)), _digits(rng, rng.randint(20, 30)), f"{rng.randint(256, 999)}.{rng.randint(1, 999)}.{rng.randint(256, 999)}.1", f"{_digits(rng, 3)} {_digits(rng, 4)} {_digits(rng, 2)}", f"@{_word(rng)} x", f"{rng.randint(1, 9)}.{rng.randint(10, 99)} {_digits(rng, 5)}-{_digits(rng, 3)}"])


def trained(lines: int = TRAIN_LINES, epochs: int = EPOCHS, seed: int = SEED) -> SemiCrf:
    """The model after `epochs` passes over `lines` generated lines; the same each time."""
    rng, data = random.Random(seed), []
    hints = {k: [w for w, x in _HINTS.items() if x == y] for k, y in enumerate(["mail", "net", "card", "phone", "other"])}
    for _ in range(lines):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(_word(rng) for _ in range(rng.randint(1, 4))) + " "
            kind = rng.randint(0, 6)
            if rng.random() < 0.3:
                text += rng.choice(hints[min(kind, 4)]) + " "
            if kind < 4:
                s = _entity(rng, kind)
                spans.append((len(text), len(text) + len(s), kind))
                text += s
            else:
                text += _decoy(rng)
            text += rng.choice([" ", ", ", ". ", " "])
        text += _word(rng)
        for lo, hi in _regions(text):
            tokens, found = segments(text, lo, hi)
            first, after = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            gold = {(first[s], after[e], k) for s, e, k in spans if s in first and e in after}
            data.append((len(tokens), found, {x for x in gold if x[:2] in found}))
    model = SemiCrf()
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, found, gold in data:
            if found:
                model.step(n, found, gold, 0.3 / (1 + epoch))
    model.known.clear()
    model.weights = dict(model.weights)
    return model


def model_spans(model: SemiCrf, text: str) -> list[tuple[int, int, int]]:
    found = []
    for lo, hi in _regions(text):
        tokens, own = segments(text, lo, hi)
        if own:
            found += [(k, tokens[i][0], tokens[j - 1][1]) for k, i, j in model.decode(len(tokens), own)]
    return found


def spans_of(model: SemiCrf, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all: the base and those of the model that touch none of it."""
    text = text or ""
    base = base_spans(text)
    held = sorted((s, e) for _, s, e in base)
    ends = [*accumulate((e for _, e in held), max)]
    more = []
    for k, s, e in model_spans(model, text):
        before = bisect_left(held, (e,))  # base spans that begin before this one ends
        if not before or ends[before - 1] <= s:
            more.append((k, s, e))
    return base, sorted({*base, *more})


def find_pii(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """Each row of docs with pii: array of (kind, start, end, base), in code points, end exclusive, by kind, then start.

    docs needs `text`; a null text counts as empty and has none.  Other columns
    stay (one named pii is replaced), repeated rows are handled each for itself.
    """
    common.bounded_batches(docs.sparkSession)
    model = model or trained()
    docs = docs.drop("pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = spans_of(model, text)
                own = set(base)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in every])
            model.known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "pii"])

    return docs.mapInArrow(run, docs.withColumn("pii", F.array().cast("array<struct<kind:string,start:long,end:long,base:boolean>>")).schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each covered stretch replaced by its first kind in angle brackets."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        end = -end
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """docs with all personal data in `text` replaced; a null text stays null."""
    common.bounded_batches(docs.sparkSession)
    model = model or trained()

    def run(batches):
        for batch in batches:
            new = [redacted(t, spans_of(model, t)[1]) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of find_pii over the whole documents table; n_spans counts all spans, of base patterns and of the model."""
    found = find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, common.of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
