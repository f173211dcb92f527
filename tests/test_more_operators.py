"""Ranks, signatures, gates and files against plain versions."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import statistics
from marlstone.operators import audit, detection, geometry, grouping, ranking, similarity
from marlstone.plans import quality
from marlstone.sources import annotations, config


def test_signatures_of_pixels(spark):
    r = np.random.default_rng(1)
    grey = r.integers(0, 255, size=(8, 9)).astype(float)
    image = r.uniform(0, 255, size=(32, 32))
    df = spark.createDataFrame([(grey.ravel().tolist(), image.ravel().tolist())], "g array<double>, p array<double>")
    row = df.select(similarity.dhash(F.col("g")).alias("d"), similarity.low_frequencies(F.col("p")).alias("c"), similarity.phash(similarity.low_frequencies(F.col("p"))).alias("h")).first()
    assert row.d == "".join("1" if x else "0" for x in (grey[:, 1:] > grey[:, :-1]).ravel())
    basis = np.array([[math.sqrt((2 if u else 1) / 32) * math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(32)])
    low = (basis @ image @ basis.T)[:8, :8].ravel()
    assert np.allclose(row.c, low) and len(row.h) == 63
    assert row.h == "".join("1" if x > np.median(low[1:]) else "0" for x in low[1:])


def test_correlation_is_centred(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(40, 6)) + 5
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").select("id", similarity.unit(similarity.centred(F.col("v"))).alias("v"))
    c = np.corrcoef(v)
    want = {(a, b): round(1 - c[a, b] - (0.05 if b - a <= 3 else 0), 9) for a in range(40) for b in range(a + 1, 40)}
    for block in (2048, 7):
        similarity.BLOCK, old = block, similarity.BLOCK
        found = {(x.a, x.b): x.dist for x in similarity.near_pairs(rows, 0.6, 0.05, 3).collect()}
        similarity.BLOCK = old
        assert found.keys() == {k for k, x in want.items() if x <= 0.6} and all(abs(found[k] - want[k]) < 1e-8 for k in found)
    near = {x.id: x.other for x in similarity.nearest_other(rows.filter("id < 10"), rows.filter("id >= 10"), similarity.dot_distance).collect()}
    assert near == {a: 10 + int(np.argmax(c[a, 10:])) for a in range(10)}
    assert similarity.near_pairs(rows.limit(0), 0.6, 0.0, 0).count() == 0


def test_blocks_meet_all_pairs_once(spark):
    rows = spark.range(50).select("id", F.col("id").alias("v"))
    import pandas as pd

    pairs = similarity.blocks(rows, rows, "id", lambda x, y: pd.DataFrame([(a, b) for a in x["id"] for b in y["id"]], columns=["a", "b"]), "a long, b long", block=9)
    assert sorted((x.a, x.b) for x in pairs.collect()) == [(a, b) for a in range(50) for b in range(50)]


def test_ranks_over_range_partitions(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([0.1, 0.2, r.random()]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "c string, score double, id long")
    for keys in ([], ["c"]):
        found = {x.id: x["rank"] for x in ranking.ranked(df, keys, [F.desc("score"), F.asc("id")]).collect()}
        for c in "ab" if keys else [None]:
            order = sorted((x for x in rows if c in (None, x[0])), key=lambda x: (-x[1], x[2]))
            assert [found[x[2]] for x in order] == list(range(1, len(order) + 1))
    assert ranking.ranked(df.limit(0), [], [F.asc("id")]).count() == 0


def test_rolling_sums_by_what_enters_and_leaves(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice([None, 0, *range(-300, 300)]), r.choice([None, None, 5, -7, r.randrange(10**12)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "c string, s long, u long")
    for span in (0, 40):
        found = {(x.c, x.s): (x.n, x.u) for x in ranking.rolling(df, ["c"], "s", span, ["u"]).collect()}
        frame = lambda c, s: [x[2] for x in rows if x[0] == c and (x[1] is None if s is None else x[1] is not None and s - span <= x[1] <= s)]  # noqa: B023, E731
        total = lambda us: sum(u for u in us if u is not None) if any(u is not None for u in us) else None
        assert found == {(c, s): (len(frame(c, s)), total(frame(c, s))) for c, s, _ in rows}
    assert ranking.rolling(df.limit(0), ["c"], "s", 40, ["u"]).count() == 0


def test_rolling_24h_reads_no_frame_row_by_row(spark, tmp_path):
    """A day of one type and one full second, with missing types, times and values: the rows of the SQL, and no sliding frame in the plan."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 50 = 0 THEN NULL WHEN i < 1000 THEN TIMESTAMP '1969-12-31 12:00:00.5' ELSE TIMESTAMP '1969-12-30 00:00:00' + to_milliseconds(i * 40000) END AS ts,
        CASE WHEN i % 31 = 0 THEN NULL WHEN i % 7 = 0 THEN 'view' ELSE 'click' END AS event_type, CASE WHEN i % 11 = 0 OR i BETWEEN 4000 AND 7000 THEN NULL ELSE (i * 37 % 1000) / 10 + i / 100 END AS value FROM range(20000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = quality.q_rolling_24h(spark, str(tmp_path))
    want = con.sql(quality.ORACLES["q_rolling_24h"])
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(want.fetchall()) != []
    assert "RangeFrame" not in found._jdf.queryExecution().toString()


def test_precision_recall_curve_and_best_f1(spark):
    r = random.Random(4)
    rows = [(r.choice([0, 1]), k, r.choice([0.5, round(r.random(), 2)]), int(r.random() < 0.6)) for k in range(400)]
    flags = spark.createDataFrame(rows, "cls int, det_id long, score double, tp int")
    counts = spark.createDataFrame([(0, 150), (1, 130), (2, 9)], "cls int, n_gt long")
    out = {(x.cls, x.det_id): x for x in detection.pr_curve(flags, counts, ["cls"]).collect()}
    for c, n in ((0, 150), (1, 130)):
        order = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1]))
        hits = np.cumsum([x[3] for x in order])
        precision = hits / np.arange(1, len(order) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        for k, x in enumerate(order):
            got = out[c, x[1]]
            assert got["rank"] == k + 1 and abs(got.recall - hits[k] / n) < 1e-12 and abs(got.envelope - envelope[k]) < 1e-12
    best = {x.cls: x for x in detection.best_f1(detection.pr_curve(flags, counts, ["cls"]), ["cls"], counts).collect()}
    assert (best[2].precision, best[2].recall, best[2].f1) == (0.0, 0.0, 0.0) and best[0].f1 > 0


def test_latency_from_ranks(spark):
    r = random.Random(5)
    rows = [(k, r.choice([1.0, r.random()])) for k in "aab" * 40] + [("c", 3.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    out = {x.k: x for x in statistics.latency(spark.createDataFrame(rows, "k string, ms double"), "k", "ms").collect()}
    for k in "ab":
        own = sorted(x for c, x in rows if c == k)
        assert (out[k].n, out[k].median, out[k].p95) == (len(own), round(float(np.median(own)), 6), own[int(len(own) * 0.95) - 1])
    assert out["c"].p95 is None and out["c"].median == 3.0 and out["d"].median is None and (out["e"].median, out["e"].p95) == (1.5, 1.0)


def test_overlaps_suppression_and_malformed_boxes(spark):
    rows = [(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.8, 0.0, 0.0, 10.0, 5.0), (1, 0, 3, 0.7, 10.0, 0.0, 2.0, 10.0)]
    det = spark.createDataFrame(rows, "img int, cls int, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert {x.det_id for x in detection.suppressed(det.filter("det_id < 3"), iou=0.5).collect()} == {1, 2}
    assert {x.det_id for x in detection.suppressed(det.filter("det_id < 3"), iou=0.49999, strict=True).collect()} == {1}
    gate = audit.gate(detection.malformed(det), "det").first()
    assert not gate.passed and gate.n_violations == 1 and audit.gate(detection.malformed(det.filter("det_id < 3")), "det").first().passed
    pair = spark.createDataFrame([(5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 2.0)], "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    assert pair.select(geometry.iou("a_", "b_", clamp=True).alias("x")).first().x == 0.0
    cut = spark.range(1).select(*(c.alias(k) for k, c in geometry.drawn({"x": F.lit(-1.7), "y": F.lit(3.9)}, least=0).items())).first()
    assert (cut.x, cut.y) == (0, 3)
    bands = spark.createDataFrame([(0.05,), (0.5,), (2.0,)], "x double").select(audit.verdict(F.col("x"), [(0.1, "low"), (1.0, "mid")], "high").alias("v"))
    assert [x.v for x in bands.collect()] == ["low", "mid", "high"]


def test_violations_and_gates(spark):
    rows = [("a", 1, 0, 0.5, 0.5, 0.2, 0.2, None), ("a", 2, 7, 1.5, 0.5, 0.0, -0.1, None), ("b", 1, 1, 0.5, 0.5, 0.01, 0.01, None), ("b", 2, None, None, None, None, None, "field count")]
    found = audit.label_violations(spark.createDataFrame(rows, "key string, line_no int, cls int, cx double, cy double, w double, h double, error string"))
    assert sorted((x.rule, x.hard, x.key, x.line_no, x.detail) for x in found.collect()) == [("degenerate box", True, "a", 2, "w,h"), ("invalid class", True, "a", 2, "7"), ("out of range", True, "a", 2, "cx,h"), ("tiny box", False, "b", 1, "w,h"), ("unreadable line", True, "b", 2, "field count")]
    ids = spark.createDataFrame([(1,), (2,)], "k int")
    assert [x.k for x in audit.unknown(spark.createDataFrame([(2,), (9,)], "k int"), ids, "k").collect()] == [9]
    assert sorted(x.k for x in audit.uncovered(spark.createDataFrame([(2,), (9,)], "k int"), ids, "k").collect()) == [1, 9]
    audit.check_fractions(0.7, 0.2, 0.1)
    with pytest.raises(ValueError):
        audit.check_fractions(0.7, 0.2, 0.2)
    paths = spark.createDataFrame([("a/Val/x",), ("a/valerie/x",), ("a/train/x",)], "p string")
    refused, split = audit.evaluation_path(F.col("p"))
    assert [(x[0], x[1]) for x in paths.select(refused, split).collect()] == [(True, True), (True, False), (False, False)]
    sizes = spark.createDataFrame([("s", 20), ("t", 2)], "scene string, size long")
    assert sorted((x.scene or "", x.size) for x in audit.size_warnings(sizes, "scene", "size", most=12, scenes=(10, 60)).collect()) == [("", 2), ("s", 20)]


def test_splits_by_file_and_the_bound_of_a_fold(spark, monkeypatch):
    files = spark.range(101).select(F.col("id").cast("string").alias("f"))
    n = {x.split: x["count"] for x in grouping.file_split(files, "f", 0.25).groupBy("split").count().collect()}
    assert n == {"train": 76, "val": 25}
    monkeypatch.setattr(grouping, "MOST_GROUPS", 3)
    with pytest.raises(ValueError):
        grouping.greedy_split(spark.createDataFrame([(str(k), 1) for k in range(4)], "s string, n long"), "s", "n", 0.3, 0.2)


def test_reconciled_boxes_and_points_outside(spark):
    kind = "img int, cls int, {} long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 4.0, 4.0), (2, 0, 2, 0.0, 0.0, 1.0, 1.0)], kind.format("gt_id"))
    b = spark.createDataFrame([(1, 1, 7, 0.0, 1.0, 4.0, 4.0), (1, 1, 8, 3.0, 0.0, 4.0, 4.0), (1, 0, 6, 0.0, 1.0, 4.0, 4.0)], kind.format("det_id"))
    out = {x.gt_id: (x.det_id, x.other_cls, x.diff, x.close) for x in geometry.reconciled(a, b, 1.0).collect()}
    assert out == {1: (6, 0, 1.0, True), 2: (None, None, None, False)}
    points = spark.createDataFrame([(1, 4.0, 4.0), (1, 4.1, 4.0), (3, 0.0, 0.0)], "img int, x double, y double")
    assert sorted((x.img, x.x) for x in geometry.outside(points, a).collect()) == [(1, 4.1), (3, 0.0)]


def test_scene_maps_quote_names_and_hashes_gate(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"\\', "x.jpg"), ("c", "y\n.jpg"), ("c", "z.jpg")], "scene string, image_name string")
    text = annotations.scene_map_json(rows, reviewed=True).first().scene_map
    assert json.loads(text) == {"reviewed": True, "n_clusters": 2, "scenes": {'a "b"\\': ["x.jpg"], "c": ["y\n.jpg", "z.jpg"]}}
    (tmp_path / "m.json").write_text(text)
    assert annotations.scene_map(spark, str(tmp_path / "m.json")).count() == 3
    h = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert sorted(x.path for x in annotations.mismatched(h, spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], h.schema)).collect()) == ["b", "c"]
    (tmp_path / "c.csv").write_text("label_name,bbox_x,bbox_y,bbox_width,bbox_height,image_name,image_width,image_height\nn,1,2,3,4,a.jpg,10,20\nn,1,2,3,4,a.jpg,11,21\n")
    x = annotations.csv_dimensions(spark, str(tmp_path / "c.csv")).first()
    assert (x.image_width, x.image_height, x.n_sizes) == (11, 21, 2)


def test_dataset_files(spark, tmp_path):
    text = "# head\npath: dataset\ntrain: 'images/train'  # comment\nnames:\n  0: first\n  1: second\nsizes: [640, 1.5]\nlist:\n  - a\n  - 2\nlast: true\nnone:\n"
    assert config.parse(text) == {"path": "dataset", "train": "images/train", "names": {0: "first", 1: "second"}, "sizes": [640, 1.5], "list": ["a", 2], "last": True, "none": {}}
    (tmp_path / "d.yaml").write_text(text)
    found = config.dataset(spark, str(tmp_path / "d.yaml"))
    assert found["path"] == f"{tmp_path}/dataset" and json.loads(config.dumped(found))["names"] == {"0": "first", "1": "second"}
    with pytest.raises(ValueError):
        config.parse("just words")
