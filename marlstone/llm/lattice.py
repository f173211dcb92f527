"""Language-model scores: the marginal likelihood of all subword segmentations.

A unigram model over the pieces of an existing vocabulary gives a word the sum
of the probabilities of all its segmentations, found by a forward recursion in
log space.  A piece's weight joins its score in the vocabulary, read as a rank,
and how often the vocabulary's own segmentation of the training words has it.  A text's end
is one more piece, and all weights sum to one.  White space parts words, each begins with the mark that
the vocabulary has for that, and no piece crosses it, so a text's likelihood is the product of those of its words
and of its end: the marginal probability over all segmentations of the whole text.

Texts are read once, into blocks of about BLOCK_BYTES that hold each distinct
word once and the tokens as numbers.  A row is one document or one word of a block, so that
no reader, writer or batch holds more blocks than it must.  Words go to one place by one shuffle, are counted
and stored there with the blocks that have them, and their values go back in pieces of SENT, so what is shuffled is a row for each
block and distinct word, not for each token, and no table is broadcast but the
weights of the vocabulary's pieces.
"""

from __future__ import annotations

import math
import zlib
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 8 << 20
#: Rows of words or documents in one Arrow batch that a task sends back.
ROWS = 10_000
#: Values of words that a task collects before it sends them to their blocks.
SENT = 1 << 20
FOLDS, HELD_OUT = 7, 2
#: Occurrences that the vocabulary's own scores count for, per piece on average.
PRIOR = 1.0
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_START = "▁"


def tokens(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line and page breaks, with ASCII letters lower-cased."""
    return common.encoded(text).translate(_LOWER).split()


def _held(doc) -> bool:
    return zlib.crc32(b"" if doc is None else b"%d" % doc) % FOLDS == HELD_OUT


_ROWS = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary())])


def _blocks(batches):
    """Rows of a block's words, by number and with how often its training documents have them, and rows of its documents, as word numbers."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 32
    numbers: dict[bytes, int] = {}
    docs, held, lengths, ids, size = [], [], [], [], 0

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)) if f.name == "block" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)

    def whole():
        data, ends = np.array(ids, dtype="<u4"), np.cumsum([0, *lengths])
        train = np.bincount(data[~np.repeat(np.array(held, dtype=bool), lengths)], minlength=len(numbers))
        for k, own in enumerate(batched(numbers, ROWS)):
            at = np.arange(k * ROWS, k * ROWS + len(own))
            yield rows(number=at, word=own, n=train[at])
        for at in batched(range(len(docs)), ROWS):
            part = slice(at[0], at[-1] + 1)
            yield rows(doc_id=docs[part], held_out=held[part], ids=[data[ends[k] : ends[k + 1]].tobytes() for k in at])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = tokens(text)
            for w in own:
                ids.append(numbers.setdefault(w, len(numbers)))
            docs.append(doc)
            held.append(_held(doc))
            lengths.append(len(own))
            size += len(text or "")
            if size >= BLOCK_BYTES:
                yield from whole()
                numbers.clear()
                docs, held, lengths, ids, size = [], [], [], [], 0
                block += 1
    if docs:
        yield from whole()


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for each run of a word: the sum of n, and where it stands."""
    table = pa.Table.from_batches(parts).combine_chunks()
    word, block, number, n = (table.column(c).chunk(0) for c in ("word", "block", "number", "n"))
    runs = pc.run_end_encode(word)
    at = np.concatenate([[0], runs.run_ends.to_numpy()]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (block, number)]
    return pa.RecordBatch.from_arrays([runs.values, pa.array(np.add.reduceat(n.to_numpy(), at[:-1])), *lists], ["word", "c", "blocks", "numbers"])


def _gathered(batches):
    """Rows sorted by word, merged to one for each word; the last word of a batch waits for what follows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, words = pc.run_end_encode(batch.column("word")).run_ends, batch.column("word")
        last = ends[len(ends) - 2].as_py() if len(ends) > 1 else 0
        if held and not last and held[0].column("word")[0] == words[0]:
            held.append(batch)
            continue
        if held or last:
            yield _merged([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield _merged(held)


class Vocabulary:
    """The pieces of a sentencepiece file that text can be made of, in the file's order."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        usable = [not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)) and m.get_score(k) > -1e8 for k in range(n)]
        self.pieces = {m.id_to_piece(k): k for k in range(n) if usable[k]}
        self.ranks = {k: max(0.0, -m.get_score(k)) for k in self.pieces.values()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def weights(self, counts: dict[int, int], ends: int = 0, prior: float = PRIOR) -> tuple[dict[int, float], float]:
        """log10 probabilities of all pieces and of the end: counts, and prior pieces each shared out by 1 / (rank + 3); the end has one."""
        share = {k: 1 / (r + 3) for k, r in self.ranks.items()}
        scale = prior * len(share) / sum(share.values())
        mass = {k: counts.get(k, 0) + scale * x for k, x in share.items()}
        total = math.log10(sum(mass.values()) + ends + 1)
        return {k: math.log10(x) - total for k, x in mass.items()}, math.log10(ends + 1) - total


def vocabulary(path: str) -> Vocabulary:
    held = common.worker_state().__dict__.setdefault("vocabularies", {})
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


class Lattice:
    """log10 of the summed probability of all segmentations of a word.

    Sums up to each place depend only on what stands before it, so a word takes over those of its common beginning with the
    word before; sorted words have to compute only their ends.
    """

    def __init__(self, own: Vocabulary, weights: dict[int, float]):
        self.pieces = {p: weights[k] * math.log(10) for p, k in own.pieces.items() if not (p.startswith("<0x") and k in own.bytes)}
        self.bytes = [weights[k] * math.log(10) for k in own.bytes]
        self.longest = max(map(len, self.pieces))
        self.text, self.ahead = "", [0.0]

    def score(self, word: str) -> float:
        text = _START + word
        get, exp, longest = self.pieces.get, math.exp, self.longest
        same = next((k for k, (a, b) in enumerate(zip(text, self.text)) if a != b), min(len(text), len(self.text)))
        ahead = self.ahead[: same + 1]
        for j in range(same + 1, len(text) + 1):
            terms = []
            for i in range(max(0, j - longest), j):
                w = get(text[i:j])
                if w is not None:
                    terms.append(ahead[i] + w)
            if text[j - 1] not in self.pieces:  # spelled in bytes
                terms.append(ahead[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode("utf-8", "replace")))
            top = max(terms)
            ahead.append(top if len(terms) == 1 else top + math.log(sum([exp(t - top) for t in terms])))
        self.text, self.ahead = text, ahead
        return ahead[-1] / math.log(10)


def _count_pieces(path: str):
    def run(batches):
        own = vocabulary(path)
        totals = np.zeros(own.model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            found = own.model.encode(words, num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in found])
            totals += np.bincount([k for ids in found for k in ids], weights=times, minlength=len(totals)).astype(np.int64)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], ["piece", "n"])

    return run


def _score_words(path: str, weights: dict[int, float]):
    def sent(parts):
        block, number, c, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(block, kind="stable")
        block, number, c, score = block[order], number[order].astype("<u4"), c[order].astype("<i8"), score[order].astype("<f8")
        at = np.flatnonzero(np.diff(block, prepend=-1))
        data = [number[s:e].tobytes() + c[s:e].tobytes() + score[s:e].tobytes() for s, e in zip(at, [*at[1:], len(block)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(data, pa.binary())], ["block", "data"])

    def run(batches):
        lattice = Lattice(vocabulary(path), weights)
        parts, size = [], 0
        for batch in batches:
            score = np.array([lattice.score(w.decode("utf-8", "replace")) for w in batch.column("word").to_pylist()])
            block, number = batch.column("blocks"), batch.column("numbers").flatten().to_numpy()
            times = pc.list_value_length(block).to_numpy()
            parts.append((block.flatten().to_numpy(), number, np.repeat(batch.column("c").to_numpy(), times), np.repeat(score, times)))
            size += len(number)
            if size >= SENT:
                yield sent(parts)
                parts, size = [], 0
        if size:
            yield sent(parts)

    return run


def _received(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and scores of a block's words, by number, from pieces of number, c and score."""
    sizes = [len(x) // 20 for x in data]
    counts, scores = np.zeros(sum(sizes)), np.zeros(sum(sizes))
    for x, k in zip(data, sizes, strict=True):
        number = np.frombuffer(x, "<u4", k)
        counts[number] = np.frombuffer(x, "<i8", k, 4 * k)
        scores[number] = np.frombuffer(x, "<f8", k, 12 * k)
    return counts, scores


def _sum_up(known_end: bool, end_base: float, end_score: float, train_tokens: int, total: int):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        counts, scores = _received(values.column("data").to_pylist())
        base = np.log10((counts + 1) / total)
        n, known, bases, sums = [], [], [], []
        for ids in docs.column("ids").to_pylist():
            own = np.frombuffer(ids, dtype="<u4")
            n.append(len(own) + 1)
            known.append(int((counts[own] > 0).sum()) + known_end)
            bases.append(math.fsum(base[own].tolist()) + end_base)
            sums.append(math.fsum(scores[own].tolist()) + end_score)
        columns = [*(pa.array(x, pa.int64()) for x in (n, known, [train_tokens] * len(n))), *(pa.array(x, pa.float64()) for x in (bases, sums))]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, vocabulary_path: str, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    Counts come from the documents that aren't held out, by crc32 of doc_id; a null doc_id
    counts as an empty string there.  A null or empty text has the end token alone.
    score is the lattice's marginal likelihood, base_score that of add-one counts of whole words.  Repeated rows count each time.  Without training documents every count is 0 and the
    vocabulary's own scores decide.  An empty table gives no rows.
    """
    common.bounded_batches(docs.sparkSession)
    kind = "block long, number int, word binary, n long, doc_id long, held_out boolean, ids binary"
    rows = common.stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, kind))
    listed = rows.filter("word is not null").select("word", "block", "number", "n")
    words = common.stored(listed.repartition("word").sortWithinPartitions("word").mapInArrow(_gathered, "word binary, c long, blocks array<long>, numbers array<int>"))
    texts = rows.filter("ids is not null").select("block", "doc_id", "held_out", "ids")
    c_end = texts.agg(F.count_if(~F.col("held_out"))).first()[0]
    known, total = words.agg(F.count_if(F.col("c") > 0), F.sum("c")).first()
    n, v = (total or 0) + c_end, known + (c_end > 0)
    counts = {r[0]: r[1] for r in words.filter("c > 0").select("word", "c").mapInArrow(_count_pieces(vocabulary_path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    own = vocabulary(vocabulary_path)
    weights, end = own.weights(counts, c_end, prior)
    values = words.mapInArrow(_score_words(vocabulary_path, weights), "block long, data binary")
    run = _sum_up(c_end > 0, math.log10((c_end + 1) / (n + v + 1)), end, n, n + v + 1)
    return texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents with the public subword vocabulary."""
    import public_tokenizers

    return score_texts(common.table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
