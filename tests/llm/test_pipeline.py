"""The corpus pipeline's stages against plain versions, on a table with nulls, repeats, ties, copies and extra columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from marlstone.llm import common, packing, pii, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, score string, key string"
STAGES = dict(corpus_pipeline.STAGES)


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 7, "x", None) for d, t in rows], DOC)


def _texts(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(61)
    parts = ["th", "er", "ing", "on", "an", "re", "tion", "es", "in", "at"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    marks = ["vilexos", "quombag", "zarfull"]
    rows, labels = [], []
    for k in range(400):
        words = prose(70).split()
        if k % 5 == 1:
            words[10:10] = [r.choice(marks) for _ in range(4)]
        rows.append((k, " ".join(words)))
        labels.append((k, k % 2, int(k % 5 == 1)))
    item = prose(14)
    rows += [(500, None), (501, ""), (None, prose(20)), (None, prose(20)), (502, rows[2][1]), (503, rows[2][1] + " " + word()), (504, prose(30) + " " + item), (505, item), (506, "write to a.b@ex.org or +1 555 123 4567 please"), (7, rows[7][1]), (7, prose(40)), (507, prose(5000))]
    path = tmp_path_factory.mktemp("corpus")
    _frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_toxic_documents_go(spark, table):
    path, rows, _ = table
    docs = common.table(spark, path, "documents")
    out = STAGES["toxicity"](spark, docs, path)
    assert out.columns == docs.columns
    model = toxicity.fitted(docs.select("doc_id", "text"), common.table(spark, path, "labels"))
    known = toxicity.Distances(model.pairs)
    want = [(d, t) for d, t in rows if model.score(known, t) < 0.5]
    assert _texts(out) == sorted(want, key=str)
    kept = {d for d, _ in want}
    assert sum(k % 5 == 1 and k not in kept for k in range(400)) >= 76 and all(k in kept for k in range(400) if k % 5 != 1)


def _runs(text):
    w = common.words(text)
    n = min(5, len(w))
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if w else []


def _alike(a, b):
    x, y = _runs(a), _runs(b)
    row = [0] * (len(y) + 1)
    for p in x:  # the longest common subsequence
        last = 0
        for j, q in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if p == q else max(row[j + 1], row[j])
    m = row[-1]
    return bool(x and y) and m >= 0.8 * (len(x) + len(y) - m) - 1e-9


def test_one_of_each_class_stays(spark):
    r = random.Random(62)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = [prose(40) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, t + " " + prose(1)) for k, t in enumerate(base[:4])] + [(20, base[0]), (21, None), (22, ""), (23, "!?"), (None, base[1]), (None, None), (5, base[5]), (6, prose(30)), (30, "two words"), (31, "Two  words!")]
    docs = _frame(spark, rows)
    out = STAGES["near duplicates"](spark, docs, "")
    assert out.columns == docs.columns
    named = [(d, t) for d, t in rows if d is not None]
    up = {d: d for d, _ in named}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in named:
        for b, y in named:
            if a < b and _alike(x, y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    want = {(d, t) for d, t in named if find(d) == d}  # equal rows once, different texts of one id all
    assert _texts(out) == sorted([*want, (None, base[1]), (None, None)], key=str)
    assert STAGES["near duplicates"](spark, _frame(spark, []), "").count() == 0


def test_contaminated_documents_go(spark, table):
    path, rows, item = table
    out = STAGES["decontamination"](spark, common.table(spark, path, "documents"), path)
    own = common.words(item)
    windows = {tuple(own[k : k + 10]) for k in range(len(own) - 9)}
    holds = lambda t: any(tuple(w[k : k + 10]) in windows for w in [common.words(t)] for k in range(len(w)))
    assert _texts(out) == sorted([(d, t) for d, t in rows if not holds(t)], key=str) and sum(holds(t) for _, t in rows) == 2


def test_personal_data_is_replaced(spark, table):
    path, rows, _ = table
    docs = common.table(spark, path, "documents")
    out = STAGES["personal data"](spark, docs, path)
    model = pii.trained()
    want = [(d, pii.redacted(t, pii.spans_of(model, t)[1])) for d, t in rows]
    assert _texts(out) == sorted(want, key=str) and out.columns == docs.columns
    assert any(t == "write to <EMAIL> or <PHONE> please" for _, t in want)
    assert all(x.text is None or x.n_chars == len(x.text) for x in out.collect())


def test_all_tokens_are_packed(spark, table):
    path, rows, _ = table
    out = STAGES["packing"](spark, common.table(spark, path, "documents"), path).collect()
    own = packing.encoder(*packing.paths())
    total = Counter()
    for d, t in rows:
        total[d] += len(own.one(t or "")) // 4 + 1 if t else 1
    got, bins = Counter(), Counter()
    for x in out:
        got[x.doc_id] += x.length
        bins[x.sequence_id] += x.length
    assert got == total and max(bins.values()) <= 2048 and len(bins) <= sum(total.values()) / 2048 + 3


def test_the_stages_joined(spark, table):
    path, rows, _ = table
    docs = common.table(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, path))
    key = lambda df: sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in df.collect()), key=str)
    assert key(corpus_pipeline.run(spark, path)) == key(docs) and docs.count() > 300


def test_empty_tables_pass_through(spark, tmp_path):
    _frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
