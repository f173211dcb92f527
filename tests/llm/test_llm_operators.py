"""Each operator against a brute-force version on small tables, with nulls, repeats, empty tables and odd columns."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import common, components, decontaminate, extract, lattice, neardup, neighbours, packing, pii, secrets, substrings, toxicity

DOC = "doc_id long, text string"


def frame(spark, rows, schema=DOC):
    """Rows with columns that operators use for themselves under the same names."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit("x") for k in ("key", "label", "n", "pos", "extra") if k not in df.columns})


def test_words_follow_the_contract():
    r, rule = random.Random(1), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for _ in range(300):
        t = "".join(r.choice("aZé 9-_`\n\x7fß{日") for _ in range(30))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert [w.decode() for w in common.words(t)] == rule.findall(low)


def test_decontamination_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 3, 5, 12, 14]))) for k in range(9)] + [(50, None), (51, "!"), (None, text(4)), (3, text(11))]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)] + [(90, None), (91, ""), (None, items[4][1]), (3, docs_text := items[0][1]), (3, docs_text)]

    def brute(doc):
        w, hit, found = common.words(doc), set(), set()
        for item, t in items:
            x = common.words(t)
            for k in range(max(0, len(x) - 10) + 1) if x and item is not None else ():
                own = x[k : k + 10]
                for at in range(len(w) - len(own) + 1):
                    if w[at : at + len(own)] == own:
                        hit.update(range(at, at + len(own)))
                        found.add(item)
        return len(w), len(hit), sorted(found)

    expected = sorted(((i, *brute(t)) for i, t in docs), key=str)
    for block in (1 << 20, 40):
        out = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        got = sorted(((x.doc_id, x.n_words, sum(s.stop - s.start for s in x.hit_spans), sorted(x["items"])) for x in out.collect()), key=str)
        assert got == expected
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.find_contamination(frame(spark, docs), nothing).filter("contaminated").count()
    assert not decontaminate.find_contamination(frame(spark, []), nothing).count()


def test_ids_are_those_of_the_tokenizer():
    e = packing.Encoder(*packing.paths())
    texts = ["", "a", "\n", " ", "a\n\nb c", "it's 1\n2", " a b", "a ", "a  b", "é ñ", "日本 x", "<|endoftext|> a", "a\tb", "x\n\n\ny z", "'s 's", "½ a", "a\n\n", "x\n\n y", "　 a", None]
    assert e.batch(texts) == [array("I", e.whole.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]


def test_ids_of_groups_of_texts(monkeypatch):
    r = random.Random(12)
    texts = ["".join(r.choice("aZéß 1.,'s\n  ") for _ in range(r.choice([0, 1, 3, 30]))) for _ in range(400)]
    e = packing.Encoder(*packing.paths())
    want = [array("I", e.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    for together in (1, 100, 1 << 20):
        monkeypatch.setattr(packing, "TOGETHER", together)
        assert e.batch(texts) == want
        assert packing.Encoder(*packing.paths()).batch(texts) == want
    monkeypatch.setattr(packing, "KNOWN_PARTS", 10)
    e = packing.Encoder(*packing.paths())
    assert [x for k in range(0, 400, 50) for x in e.batch(texts[k : k + 50])] == want


def test_encoding_costs_less_than_a_lookup_for_each_part():
    r = random.Random(13)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(40_000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(1000)]
    e = packing.Encoder(*packing.paths())
    e.batch(texts)
    known = {w: b"12345678" for w in words}

    def by_lookups():
        split = [t.split(" ") for t in texts if e._plain(t)]
        fresh = set().union(*split) - known.keys()
        table = known | dict.fromkeys(fresh, b"")
        return [b"".join(map(table.__getitem__, x)) for x in split]

    def seconds(f):
        found = []
        for _ in range(5):
            start = time.process_time()
            f()
            found.append(time.process_time() - start)
        return min(found)

    assert seconds(lambda: e.batch(texts)) < 0.85 * seconds(by_lookups)


def test_packing_is_gapless_and_whole(spark):
    r = random.Random(3)
    docs = [(k, " ".join("word" for _ in range(r.choice([0, 3, 40, 300, 2100, 5000])))) for k in range(60)] + [(70, None), (None, "a"), (5, "b b"), (5, "b b")]
    pieces = packing.tokenized(frame(spark, docs), *packing.paths())
    for shard in (50_000, 20, 1):
        out = [x.asDict() for x in packing.pack(pieces, shard_pieces=shard).collect()]
        assert len(out) == pieces.count()
        bins: dict = {}
        for x in out:
            assert 1 <= x["length"] <= 2048
            bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(x["length"] for x in out) / 2048) + 3
    assert packing.pack(packing.tokenized(frame(spark, []), *packing.paths())).count() == 0
    assert [packing.cut(n, 4) for n in (1, 4, 5, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 1), (1, 4), (5, 4)]]


def test_full_and_repeated_pieces_are_dealt_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rows = [(k, 1, 7, 2048, 5) for k in range(200)] + [(1, 0, 0, 30, 9)] * 300 + [(2, 0, 0, 1500, 9)] * 40
    pieces = common.stored(spark.createDataFrame(rows, packing._PIECES))
    out = packing.pack(pieces, shard_pieces=17)
    bins = Counter()
    for x in out.collect():
        bins[x.sequence_id] += x.length
        seen.append((x.doc_id, x.piece, x.start, x.length, x.ids_crc32))
    assert sorted(seen) == sorted(rows) and max(bins.values()) <= 2048 and len(bins) <= 200 + 40 + 2


def test_sum_of_squares_picks_the_least_sum():
    r = random.Random(4)
    sizes = [r.randint(1, 12) for _ in range(200)]
    at, offset, level = packing.sum_of_squares(sizes, 12)
    gaps: list[int] = []
    for size, b, o in zip(sizes, at, offset, strict=True):
        def total(gs):
            return sum(v * v for g, v in Counter(gs).items() if g > 0)

        options = [total(gaps[:k] + [g - size] + gaps[k + 1 :]) for k, g in enumerate(gaps) if g >= size] + [total([*gaps, 12 - size])]
        if b == len(gaps):
            gaps.append(12)
        assert 12 - gaps[b] == o
        gaps[b] -= size
        assert total(gaps) == min(options)
    assert [12 - g for g in gaps] == level.tolist()


def _pii(t):
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(rules):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark):
    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice("a@.-1 23+(0)5_%Zé") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == _pii(t)
    model = pii.trained()
    base, every = pii.spans_of(model, "call (555) 123-4567 or joe [at] foo [dot] com, card 4111 1111 1111 1111, on 2024-01-05")
    assert [k for k, *_ in base] == [2] and [k for k, *_ in every] == [0, 2, 3]
    assert pii.spans_of(model, "about 2.0 of 1188 962 and 555-7713, 1234567890123456")[1] == []
    text = "mail a@b.co to 1.2.3.4"
    out = {x.doc_id: x for x in pii.find_pii(frame(spark, [(1, text), (2, None), (3, ""), (1, text)]), model).collect()}
    assert [(s.kind, s.start, s.end) for s in out[1].pii] == [("email", 5, 11), ("ip", 15, 22)] and out[2].pii == []
    assert sorted(x.text or "" for x in pii.redact(frame(spark, [(1, text), (2, None)]), model).collect()) == ["", "mail <EMAIL> to <IP>"]
    assert len(pii.spans_of(model, "1 " * 50_000 + "a@" * 20_000)[0]) == 0


def test_semi_markov_decoding_is_the_best_segmentation():
    model, r = pii.trained(20, 2), random.Random(6)
    for _ in range(20):
        text = " ".join(r.choice(["12-34", "5551234", "x@y.zz", "(555) 123", "+1 555 000 1111", "word"]) for _ in range(3))
        for lo, hi in pii._regions(text):
            tokens, found = pii.segments(text, lo, hi)
            best = {0: 0.0}
            for j in range(1, len(tokens) + 1):
                best[j] = max([best[j - 1]] + [best[i] + max(model.scores(f)) for (i, e), f in found.items() if e == j])
            got = model.decode(len(tokens), found)
            assert abs(sum(model.scores(found[i, j])[k] for k, i, j in got) - best[len(tokens)]) < 1e-9


def test_secrets(spark):
    rule = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    key = hashlib.sha256(b"1").hexdigest()
    texts = [f'Token = "{key[:40]}" and AKIA{"A1" * 8}', "password: short", "API_KEY='abcdefgh'", "", f"x {key} y", "ſecret=abcdefghi"]
    for t in texts:
        brute = [(0, m.start(), m.end()) for m in rule.finditer(t) if len(m[1]) >= 8] + [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets.base_spans(t) == sorted(brute, key=lambda x: (x[1], x[0]))
    r = random.Random(7)
    prose = lambda: " ".join("".join(r.choice(["the", "ing", "er", "an", "tion", "es"]) for _ in range(r.randint(1, 6))) for _ in range(120))
    blob = "".join(r.choice(secrets.ALPHABETS["base62"]) for _ in range(44))
    docs = [(k, prose()) for k in range(150)] + [(900 + k, f"{prose()} {''.join(r.choice(secrets.ALPHABETS['base62']) for _ in range(44))} x") for k in range(40)] + [(1000, f"a {blob} b"), (1001, None), (1002, ""), (None, texts[0])]
    out = {x.doc_id: x.secrets for x in secrets.find_secrets(frame(spark, docs)).collect()}
    assert [(s.kind, s.start, s.end) for s in out[1000]] == [("random", 2, 46)]
    assert not any(out[k] for k in range(150)) and out[1001] == [] and [s.kind for s in out[None]] == ["assign", "hex", "access"]
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_ordinary_windows_cover_all_text(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("etaoinshrdlu  ,.A") for _ in range(n)) for n in (0, 19, 30, 700, 5000)] + [None, "abcdef" * 20, "z" * 90]
    brute: Counter = Counter()
    for t in texts:
        letters = re.sub("[^a-z]", "", t or "")
        for k, n in enumerate(secrets.LENGTHS):
            whole = len(letters) // n * n
            brute.update((k, secrets._bin(secrets.statistic(letters[i : i + n]))) for i in [*range(0, whole, n), *([len(letters) - n] if whole and whole < len(letters) else [])])
    assert secrets.ordinary(texts) == brute
    blob = "".join(r.choice(secrets.ALPHABETS["base62"]) for _ in range(44))
    prose = lambda n: " ".join("".join(r.choice(["the", "ing", "er", "an", "tion", "es"]) for _ in range(r.randint(1, 6))) for _ in range(n))
    few = {x.doc_id: x.secrets for x in secrets.find_secrets(frame(spark, [(k, prose(1500)) for k in range(12)] + [(20, f"a {blob} b")])).collect()}
    assert [(x.kind, x.start, x.end) for x in few[20]] == [("random", 2, 46)] and not any(few[k] for k in range(12))


def test_runs_of_no_alphabet_are_split():
    r = random.Random(12)
    for alphabet, around in (("base62", ("/my-hook/", "/x_y")), ("base64url", ("/my-hook/", "/end")), ("base64", ("my-own_", "-x/y"))):
        blob = "".join(r.choice(secrets.ALPHABETS[alphabet]) for _ in range(42)) + "a" + secrets.ALPHABETS[alphabet][-1] + "Z9"
        text = f"see {around[0]}{blob}{around[1]} there"
        start = text.index(blob)
        assert [(a, b) for a, b, _, _ in secrets.candidates(text, [])] == [(start, start + len(blob))]
    assert secrets.candidates("see /some/path-of/many_short/parts+here", []) == []


def test_lattice_sums_all_segmentations():
    own = lattice.vocabulary(str(__import__("public_tokenizers").path("piece_bpe_32k.model")))
    weights, end = own.weights({5: 7}, 3)
    assert abs(sum(10**w for w in weights.values()) + 10**end - 1) < 1e-9
    model = lattice.Lattice(own, weights)

    def brute(text):
        if not text:
            return 1.0
        total = sum(math.exp(model.pieces[text[:k]]) * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in model.pieces)
        if text[0] not in model.pieces:
            total += math.exp(sum(model.bytes[b] for b in text[0].encode())) * brute(text[1:])
        return total

    for word in ("a", "thering", "ción", "x\U0001f600y"):
        assert abs(model.score(word) - math.log10(brute("▁" + word))) < 1e-9


def test_lattice_scores_do_not_depend_on_the_word_before():
    own = lattice.vocabulary(str(__import__("public_tokenizers").path("piece_bpe_32k.model")))
    weights, _ = own.weights({5: 7}, 3)
    r = random.Random(4)
    words = ["".join(r.choice("thé\U0001f600") for _ in range(r.randint(1, 6))) for _ in range(300)]
    shared = lattice.Lattice(own, weights)
    fresh = {}
    for w in words:
        shared.text, shared.ahead = "", [0.0]
        fresh[w] = shared.score(w)
    for order in (words, sorted(words), sorted(words, reverse=True)):
        assert [shared.score(w) for w in order] == [fresh[w] for w in order]
    # Sorted words look up less than words each for itself.
    class Counted(dict):
        n = 0

        def get(self, key):
            Counted.n += 1
            return super().get(key)

    shared.pieces = Counted(shared.pieces)
    for w in sorted(words):
        shared.score(w)
    found = Counted.n
    for w in sorted(words):
        shared.text, shared.ahead = "", [0.0]
        shared.score(w)
    assert 2 * found < Counted.n - found


def test_language_model_counts(spark):
    r = random.Random(8)
    docs = [(k, " ".join(r.choice(["The", "cat", "Sat", "sat.", "é", "mat x"]) for _ in range(r.randint(0, 9)))) for k in range(30)] + [(40, None), (41, "new words\there"), (5, "again"), (5, "again")]
    path = str(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    own = [(d, [*re.findall("[^\x20\x09-\x0d]+", low(t)), None], zlib.crc32(str(d).encode()) % 7 == 2) for d, t in docs]
    c = Counter(w for _, t, held in own if not held for w in t)
    n, v = sum(c.values()), len(c)
    expected = sorted((d, held, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 8)) for d, t, held in own)
    got = lattice.score_texts(frame(spark, docs), path).collect()
    assert sorted((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 8)) for x in got) == expected
    # The score by weights counted here: the marginal of each word's segmentations, and the end's weight.
    own_v = lattice.vocabulary(path)
    pieces = Counter(k for _, t, held in own if not held for w in t[:-1] for k in own_v.model.encode(w))
    weights, end = own_v.weights(pieces, c[None])
    marginal = lattice.Lattice(own_v, weights)
    expected = sorted((d, round(sum(marginal.score(w) for w in t[:-1]) + end, 8)) for d, t, _ in own)
    assert sorted((x.doc_id, round(x.score, 8)) for x in got) == expected
    assert lattice.score_texts(frame(spark, []), path).count() == 0


def test_language_model_rows_hold_one_document_or_word(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 50)), pa.array(texts[k : k + 50])], ["doc_id", "text"]) for k in range(0, 200, 50)]
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 3000)
    out = list(lattice._blocks(iter(batches)))
    assert max(len(x) for b in out for x in b.column("ids").to_pylist() if x is not None) == 4 * max(len(t.split()) for t in texts)
    rows = [x for b in out for x in b.to_pylist()]
    words = {(x["block"], x["number"]): x["word"] for x in rows if x["word"] is not None}
    docs = {x["doc_id"]: (x["block"], x["ids"]) for x in rows if x["ids"] is not None}
    assert len(words) + len(docs) == len(rows) and len({b for b, _ in words}) > 3
    for k, text in enumerate(texts):
        block, ids = docs[k]
        assert [words[block, x].decode() for x in memoryview(ids).cast("I")] == text.split()
    # Words are merged the same however the rows are cut into batches.
    held = [x for x in range(200) if lattice._held(x)]
    want = Counter(w for k, t in enumerate(texts) if k not in held for w in t.split())
    listed = pa.Table.from_pylist(sorted(({c: x[c] for c in ("word", "block", "number", "n")} for x in rows if x["word"] is not None), key=lambda x: x["word"]))
    for size in (1, 3, 1000):
        found = [x for b in lattice._gathered(iter(listed.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        assert {x["word"].decode(): x["c"] for x in found} == {w: want[w] for t in texts for w in t.split()} and len(found) == len({w for t in texts for w in t.split()})
        assert {(b, k): x["word"] for x in found for b, k in zip(x["blocks"], x["numbers"], strict=True)} == words


def test_language_model_rows_of_a_block_come_in_bounded_batches():
    n = 25_000
    texts = [" ".join(f"w{k}" for k in range(x, x + 2)) for x in range(n)]
    out = list(lattice._blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], ["doc_id", "text"])])))
    assert max(b.num_rows for b in out) <= 10_000 and {x for b in out for x in b.column("block").to_pylist()} == {0}
    rows = [x for b in out for x in b.to_pylist()]
    words = {x["number"]: x["word"].decode() for x in rows if x["word"] is not None}
    docs = {x["doc_id"]: x for x in rows if x["ids"] is not None}
    assert len(words) == n + 1 and len(docs) == n and len(rows) == 2 * n + 1
    for k, text in enumerate(texts):
        assert [words[x] for x in memoryview(docs[k]["ids"]).cast("I")] == text.split() and docs[k]["held_out"] == lattice._held(k)
    want = Counter(w for k, t in enumerate(texts) if not lattice._held(k) for w in t.split())
    assert {x["word"].decode(): x["n"] for x in rows if x["word"] is not None} == {w: want[w] for w in words.values()}


def test_language_model_of_texts_without_words(spark):
    path = str(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    out = lattice.score_texts(frame(spark, [(1, None), (2, " "), (None, "")]), path).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens) for x in out] == [(1, 1, len(out) - sum(x.held_out for x in out))] * 3


def _runs(d, length, counts):
    gone = bytearray(len(d))
    for k in range(len(d) - length + 1):
        if counts[d[k : k + length]] > 1:
            gone[k : k + length] = b"\1" * length
    return gone, [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]


def _substrings(rows, length, short, words):
    data = [(t or "").encode() for _, t in rows]
    counts, few = (Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1)) for n in (length, short))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone, spans = _runs(d, length, counts)
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        inside = [(s, e) for s, e in _runs(d, short, few)[1] if sum(s <= m.start() and m.end() <= e for m in re.finditer(rb"[^ ]+", d)) > words]
        if data.count(d) > 1 and len(d.split()) > words:
            inside = [(0, len(d))]
        out.append((doc, len(d), spans, inside, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [20_000, 0])
def test_substrings_against_brute_force(spark, bucket, monkeypatch):
    r = random.Random(bucket)
    monkeypatch.setattr(substrings, "AT_ONCE", 40)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(10, 80))) for _ in range(12)]
    rows = [(k, "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("xyzw") for _ in range(9)) for _ in range(r.randint(0, 5)))) for k in range(50)]
    rows += [(100, None), (None, rows[3][1]), (3, rows[3][1]), (101, "a" * 100), (102, "ab" * 40), (103, "a" * 30), (5, "zz"), (104, " a b" * 30), (105, "a b c d"), (106, "a b c d")]
    rows += [(200 + k, r.choice("uvw") * r.randint(0, 20) + "the same long line " * 3 + r.choice("uvw") * r.randint(0, 20)) for k in range(60)]
    out = substrings.repeated_substrings(frame(spark, rows), length=24, gram=6, passage_bytes=13, passage_words=2, bucket=bucket).collect()
    assert sorted(((x.doc_id, x.n_bytes, [tuple(s) for s in x.spans], [tuple(s) for s in x.passages], x.kept_sha256) for x in out), key=str) == _substrings(rows, 24, 13, 2)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(19)
    texts = ["".join(r.choice("ab ") for _ in range(r.choice([0, 5, 30, 300, 2000]))).encode() for _ in range(12)] + [b"x" * 500]
    starts = lambda found, a, b: [sorted((int(x["h"]), int(x["pos"]), s) for x in own for s in range(x["pos"] + x[a], x["pos"] + x[b] + 1)) for own in found]
    whole = substrings.anchors(texts, 40, 6, 20)
    monkeypatch.setattr(substrings, "BLOCK", 64)
    parts = substrings.anchors(texts, 40, 6, 20)
    for a, b, n in (("lo", "hi", 20), ("wide_lo", "wide_hi", 40)):
        assert starts(whole, a, b) == starts(parts, a, b)
        assert [sorted(s for _, _, s in x) for x in starts(whole, a, b)] == [list(range(max(0, len(t) - n + 1))) for t in texts]


def test_first_copies_stay_on_request(spark):
    r = random.Random(9)
    shared = "".join(r.choice("abcdefgh") for _ in range(60))
    rows = [(1, "x" + shared + "1"), (2, "yy" + shared), (3, shared + "z"), (4, "q" * 5), (6, "copy of a whole text here"), (7, "copy of a whole text here")]
    out = {x.doc_id: sum(s.end - s.start for s in x.spans) for x in substrings.repeated_substrings(frame(spark, rows), length=20, gram=5, keep_first=True).collect()}
    assert sorted(out[k] for k in (1, 2, 3)) == [0, 60, 60] and out[4] == 0 and out[6] == 0 and out[7] == 25
    assert substrings.repeated_substrings(frame(spark, [])).count() == 0


def test_factors_are_longest_previous_factors_cut_at_a_length():
    r = random.Random(10)
    for length in (3, 9):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(12)]
        at = [(t, p) for t, d in enumerate(texts) for p in range(len(d) - 1)]
        # One bucket for each two bytes: the suffixes that begin there, with what stands before them in reach.
        rows = []
        for t, p in at:
            d, lo, hi = texts[t], max(-1, -p), min(0, len(texts[t]) - p - length)
            if lo <= hi:
                rows.append((int.from_bytes(d[p : p + 2], "big"), b"%d,%d" % (t, p), d[p + lo : p + hi + length], -lo, 0, -99, lo, hi, 1, bytes([t, p])))
        marks = {}
        for name, wide, lo, hi, first in substrings.factors(rows, (2, length)):
            t, p = map(int, name.split(b","))
            for o in range(lo, hi + 1) if wide else ():
                marks[t, p, o] = first
        for _, name, _, _, _, _, lo, hi, _, _ in rows:
            t, p = map(int, name.split(b","))
            for o in range(lo, hi + 1):
                own = texts[t][p + o : p + o + length]
                same = [x for _, x, b, before, _, _, a, z, _, _ in rows if texts[t][p : p + 2] == b[before : before + 2] and a <= o <= z and b[before + o : before + o + length] == own]
                earlier = [x for x in same if tuple(map(int, x.split(b","))) < (t, p)]  # a previous factor of `length`
                assert marks.get((t, p, o)) == (None if len(same) < 2 else not earlier)


def test_extraction(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>m<li>n</ul></nav><div class="ad">buy</div><article><h1>Head &amp; Shoulders</h1><p><b>One<br>two</b><p>three \n four</p><div id="comments"><p>no</p></div></article><footer>f</footer><script>var a="</p>";</script></body></html>'
    assert extract.main_text(page) == "Head & Shoulders\nOne two\nthree four"
    assert extract.main_text('<div class="sidebar">x</div><p>Hello <i>big</i>\n world<p>a &lt;b&gt; 3 < 4<ul><li>a<li>b</ul><form>q</form>') == "Hello big world\na <b> 3 < 4\na\nb"
    assert [extract.main_text(x) for x in (None, "", "plain", "<p>", "a<b")] == ["", "", "plain", "", "a"]
    site = [(k, f"http://u@WWW.Ex.org:80/{k}", f"<body><div><p>Always the same words here</p></div><section><p>Article number {k} speaks of {k * 7}</p></section></body>") for k in range(20)]
    odd = [(50, None, None), (51, "x", ""), (51, "x", ""), (52, "http://other.org/", "<p>Always the same words here</p>")]
    out = {x.page_id: x.text for x in extract.extract(frame(spark, site + odd, "page_id long, url string, html string")).collect()}
    assert out[3] == "Article number 3 speaks of 21" and out[50] == "" and out[52] == "Always the same words here"
    assert extract.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_toxicity_learns_what_marks_a_class(spark):
    r = random.Random(11)
    parts = ["th", "er", "ing", "on", "an", "re", "tion", "es"]
    prose = lambda n: ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 1
        words = prose(60) + ([r.choice(["vilexos", "quombag", "zarfull"]) for _ in range(4)] if toxic else [])
        r.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(700, None), (701, ""), (None, "the"), (3, rows[3][1])]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [(None, 1), (702, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, marks)
    out = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(out[k] >= 0.5) == (k % 5 == 1) for k in held]) > 0.95
    assert out[700] == out[701] and all(0 <= x <= 1 for x in out.values())
    assert toxicity.score(frame(spark, []), toxicity.fitted(docs, marks.limit(0))).count() == 0


def test_toxicity_compresses_a_frequent_word_once_and_by_one_dictionary_after_the_other(monkeypatch):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(7, 9)))
    common_words, bad = sorted({word() for _ in range(400)}), ["vilexos", "quombag", "zarfull"]
    ordinary = [" ".join(r.sample(common_words, 40)) for _ in range(60)]
    model = toxicity.fit([f"{t} {r.choice(bad)} {r.choice(bad)}" for t in ordinary[:20]], ordinary, 0.25)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 1000)
    plain, known, calls = toxicity.Distances(model.pairs).pairs, toxicity.Distances(model.pairs), []

    def counted(name, compress):
        return lambda data: calls.append((name, data)) or compress(data)

    known.pairs = [tuple(counted((k, side), compress) for side, compress in enumerate(pair)) for k, pair in enumerate(known.pairs)]
    texts = [" ".join(common_words + [f"{word()}{k}" for _ in range(150)] + bad[: k % 3]) for k in range(12)] + [None, "", "zarfull"]
    scores, switches = [], 0
    for text in texts:
        before = len(calls)
        scores.append(model.score(known, text))
        switches += sum(a[0] != b[0] for a, b in zip(calls[before:], calls[before + 1 :], strict=False))
    of_common = Counter(data for _, data in calls if data in {toxicity._BEFORE + w.encode() + toxicity._AFTER for w in common_words})
    assert len(of_common) == 400 and set(of_common.values()) == {4}
    assert switches <= 3 * len(texts)

    def wanted(text):
        z = []
        for k, (by_ordinary, by_toxic) in enumerate(plain):
            data = [toxicity._BEFORE + w + toxicity._AFTER for w in toxicity.windows(text)]
            d = np.array([len(by_ordinary(x)) - len(by_toxic(x)) for x in data] or [0])
            over = [int((d >= s).sum()) for s in range(1, 8)]
            x = np.array([*np.log1p(over), *(10 * np.array(over) / len(d)), np.log(len(d)), d.mean(), d.max()])
            z.append(((x - model.mean) / model.spread) @ model.weights[:-1] + model.weights[-1])
        return 1 / (1 + np.exp(-(np.mean(z) + model.shift)))

    assert scores == pytest.approx([wanted(t) for t in texts], rel=1e-9)
    monkeypatch.setattr(toxicity, "AT_ONCE", 700)
    assert model.scores(toxicity.Distances(model.pairs), texts) == scores and model.scores(known, []) == []


def _classes(rows):
    sets = {}
    for d, t in rows:
        w = common.words(t)
        k = min(5, len(w))
        c = Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else Counter()
        sets[d] = {(x, n) for x, m in c.items() for n in range(m)}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("size", [1_000_000, 3000])
def test_near_duplicates_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "TASK_SHINGLES", size)
    r = random.Random(12)
    rows = []
    for _ in range(14):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([6, 30, 120, 400]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two!"), (505, "a " * 3000), (506, "a " * 3001)]
    out = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert {d: x.class_id for d, x in out.items()} == _classes(rows)
    sizes = Counter(x.class_id for x in out.values())
    assert all(x.class_size == sizes[x.class_id] for x in out.values())
    kept = sorted(x.doc_id for x in neardup.one_of_each(frame(spark, [*rows, rows[0], (None, "q")])).collect() if x.doc_id is not None)
    assert kept == sorted(set(_classes(rows).values()))


def test_alignment_is_a_longest_common_subsequence():
    r = random.Random(13)
    for _ in range(300):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            b.insert(r.randint(0, len(b)), r.randint(0, 6)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        for need in range(len(a) + 2):
            assert neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), need) == (row[-1] >= need)


def test_components(spark):
    r = random.Random(14)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_nearest_neighbours(spark):
    r = np.random.default_rng(15)
    rows = [(int(k), [float(x) for x in r.normal(size=16)]) for k in range(700)]
    rows += [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (801, [1.0, None]), (None, rows[0][1]), (900, rows[0][1]), (901, rows[0][1]), (950, [1.0, 2.0]), (951, [2.0, 4.0])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for x in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    usable = [(k, np.array(v)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for q, v in usable:
        if q % 50:
            continue
        scores = sorted(((-float(np.dot(v / np.linalg.norm(v), u / np.linalg.norm(u))), k) for k, u in usable if k != q and len(u) == len(v)))[:5]
        hits += len({k for _, k in scores} & {k for k, _ in got[q]})
        total += len(scores)
        assert [k for k, _ in got[q]] == [k for k, _ in sorted(got[q], key=lambda x: (-x[1], x[0]))]
    assert hits / total >= 0.9 and [k for k, _ in got[950]] == [951]
    assert [k for k, _ in got[0]][:2] == [900, 901]
    assert neighbours.nearest(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_of_many_copies_and_of_vectors_within_a_byte(spark):
    r = np.random.default_rng(4)
    copy, close = r.normal(size=16), r.normal(size=16)
    ids = [int(k) for k in r.permutation(200)]
    vectors = [copy * 2.0 ** (k % 3) for k in range(100)] + [close + r.normal(size=16) * 1e-5 for _ in range(60)] + [r.normal(size=16) for _ in range(40)]
    rows = [(k, [float(x) for x in v]) for k, v in zip(ids, vectors, strict=True)]
    units = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in zip(ids, vectors, strict=True)}
    got: dict = {}
    for x in neighbours.nearest(frame(spark, rows, "vec_id long, embedding array<double>"), divisor=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {q: [k for _, k in sorted((-float(np.dot(units[q], u)), k) for k, u in units.items() if k != q)[:5]] for q in ids if q % 10 == 0}


def test_hilbert_neighbours_are_adjacent_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_queries_are_registered():
    from marlstone.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
    assert json.dumps(queries.ORACLES) == "{}"
