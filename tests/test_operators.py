"""Analytics operators on hand-made rows, the readers, and every query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marlstone.functions import statistics
from marlstone.operators import audit, detection, geometry, grouping, similarity
from marlstone.plans import catalogue, common
from marlstone.sources import annotations
from marlstone.streaming import drift

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_letterbox(spark):
    golden = {(640, 640): (1.0, 640, 640, 0, 0, 0, 0, 0, 0), (1080, 1920): (1 / 3, 640, 360, 0, 140, 140, 140, 0, 0), (1920, 1080): (1 / 3, 360, 640, 140, 0, 0, 0, 140, 140), (480, 1280): (0.5, 640, 240, 0, 200, 200, 200, 0, 0), (721, 1279): (640 / 1279, 640, 361, 0, 139.5, 139, 140, 0, 0), (1280, 960): (0.5, 480, 640, 80, 0, 0, 0, 80, 80)}
    df = spark.createDataFrame([(float(h), float(w)) for h, w in golden], "h double, w double")
    for x in df.withColumns(geometry.letterbox(F.col("w"), F.col("h"), 640)).collect():
        assert (x.gain, x.new_w, x.new_h, x.pad_w, x.pad_h, x.top, x.bottom, x.left, x.right) == pytest.approx(golden[int(x.h), int(x.w)])


def test_iou(spark):
    cases = [((0, 0, 10, 10), (0, 0, 10, 10), 1), ((0, 0, 100, 100), (500, 500, 600, 600), 0), ((0, 0, 10, 10), (20, 0, 30, 10), 0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((1000, 1000, 1010, 1010), (1005, 1000, 1015, 1010), 1 / 3)]
    rows = [(*map(float, a), *map(float, b), float(v)) for a, b, v in cases]
    df = spark.createDataFrame(rows, [*(f"a{k}" for k in geometry.CORNERS), *(f"b{k}" for k in geometry.CORNERS), "want"])
    for x in df.select("want", geometry.iou("a", "b").alias("iou")).collect():
        assert x.iou == pytest.approx(x.want, abs=1e-6)


def _det(spark, rows):
    return spark.createDataFrame(rows, "img long, cls int, det_id long, score double, x1 double, y1 double, x2 double, y2 double")


def test_suppression_is_by_class(spark):
    for classes, kept in (((0, 1), 2), ((0, 0), 1)):
        rows = [(1, classes[0], 1, 0.9, 0.0, 0.0, 100.0, 100.0), (1, classes[1], 2, 0.8, 10.0, 10.0, 110.0, 110.0)]
        assert detection.suppressed(_det(spark, rows), iou=0.5, score=0.25).count() == kept


def _ap(flags, n):
    area = 0.0
    for k, t in enumerate(flags):
        if t:
            area += max(sum(flags[: j + 1]) / (j + 1) for j in range(k, len(flags)))
    return area / n if n else 0.0


def test_average_precision(spark):
    r = random.Random(1)
    cases = [([1, 0, 1, 1], 5), ([1, 1, 1], 3), ([0, 0], 2), ([0, 1, 1, 0, 1], 4), ([1], 0)] + [([r.randint(0, 1) for _ in range(r.randint(1, 30))], 30) for _ in range(30)]
    flags = spark.createDataFrame([(k, -float(i), i, t) for k, (f, _) in enumerate(cases) for i, t in enumerate(f)], "cls int, score double, det_id long, tp int")
    counts = spark.createDataFrame([(k, n) for k, (_, n) in enumerate(cases)], "cls int, n_gt long")
    got = {x.cls: x.ap for x in detection.average_precision(detection.pr_curve(flags, counts, ["cls"]), ["cls"]).collect()}
    assert [got[k] for k in range(4)] == pytest.approx([0.5, 1.0, 0.0, 0.4833333333])
    assert all(got[k] == pytest.approx(_ap(f, n)) for k, (f, n) in enumerate(cases))


def test_greedy_matching_is_one_to_one(spark):
    gt = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.0, 0.0, 10.0, 9.0)], "img long, cls int, gt_id long, x1 double, y1 double, x2 double, y2 double")
    det = _det(spark, [(1, 0, 7, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 8, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 0, 9, 0.7, 0.0, 0.0, 10.0, 10.0)])
    hits = {(x.det_id, round(x.thr, 2)): x.tp for x in detection.matched(gt, det).collect()}
    assert (hits[7, 0.5], hits[8, 0.5], hits[9, 0.5]) == (1, 1, 0) and (hits[7, 0.95], hits[8, 0.95]) == (1, 0)


def test_knee_and_percentile(spark):
    counts = [84, 40, 16, 7, 5, 4, 3, 3] + [1] * 8
    scan = spark.createDataFrame([(0.05 * (k + 1), n) for k, n in enumerate(counts)], "thr double, n long")
    assert similarity.knee(scan).first().thr == pytest.approx(0.10)
    x = statistics.latency(spark.range(1, 201).select(F.lit("m").alias("k"), F.col("id").cast("double").alias("ms")), "k", "ms").first()
    assert (x.p95, x["median"]) == (190.0, 100.5) and x["std"] == pytest.approx(57.879185)
    assert statistics.latency(spark.createDataFrame([("m", 1.0)], "k string, ms double"), "k", "ms").first().p95 is None


def test_label_rules_and_modes(spark, tmp_path):
    lines = ["0 .5 .5 .2 .2", "2 .5 .5 .2 .2", "0 1.01 .5 .2 .2", "1 .5 .5 0 .2", "0.0 .5 .5 .2 .2", "0 .5 .5 .2", "   ", "x .5 .5 .2 .2", "0 .5 nan .2 .2"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("")
    strict = annotations.label_rows(spark, str(tmp_path))
    errors = {x.line_no: x.error for x in strict.collect()}
    assert errors == {1: None, 2: None, 3: None, 4: None, 5: "non-numeric field", 6: "field count", 7: "non-numeric field", 8: None}
    rules = {x.rule: x.n for x in audit.label_rules(strict.filter("error IS NULL")).collect()}
    assert rules == {"invalid class": 1, "out of range": 2, "degenerate box": 1, "tiny box": 0}
    assert annotations.label_rows(spark, str(tmp_path), "lenient").count() == 6
    assert annotations.label_rows(spark, str(tmp_path), "count").count() == 8


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"generated_by": "x",\n "reviewed": true, "scenes": {"s1": ["a.jpg", "b.jpg"], "s2": ["c.jpg"]}}')
    assert sorted((x.scene, x.image_name) for x in annotations.scene_map(spark, str(tmp_path / "m.json")).collect()) == [("s1", "a.jpg"), ("s1", "b.jpg"), ("s2", "c.jpg")]
    (tmp_path / "u.json").write_text('{"generated_by": "x", "scenes": {"s1": ["a.jpg"]}}')
    assert annotations.scene_map(spark, str(tmp_path / "u.json")).count() == 0
    for text in ('{"test_scenes": ["s1", "s2"]}', '["s1", "s2"]'):
        (tmp_path / "h.json").write_text(text)
        assert sorted(x.scene for x in annotations.held_out(spark, str(tmp_path / "h.json")).collect()) == ["s1", "s2"]
    (tmp_path / "v.xml").write_text("<annotation><filename>a.jpg</filename><size><width>10</width><height>20</height><depth>3</depth></size><object><name>n</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>m</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    assert sorted((x.name, x.xmin, x.ymax) for x in annotations.voc_boxes(spark, str(tmp_path / "v.xml")).collect()) == [("m", 5, 8), ("n", 1, 4)]
    (tmp_path / "c.csv").write_text("label_name,bbox_x,bbox_y,bbox_width,bbox_height,image_name,image_width,image_height\nn,1,2,3,4,a.jpg,10,20\n")
    assert annotations.csv_boxes(spark, str(tmp_path / "c.csv")).first().bbox_height == 4
    (tmp_path / "p").mkdir()
    for name in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / "p" / name).write_bytes(b"12")
    files = annotations.images(spark, str(tmp_path / "p"))
    assert sorted(x.stem for x in files.collect()) == ["a", "b"] and annotations.folder_size(files).first().bytes == 4
    ms = spark.createDataFrame([("IMG_20260901_145008700_MP",), ("x",)], "n string").select(annotations.capture_ms(F.col("n")).alias("ms")).collect()
    assert [x.ms for x in ms] == [((14 * 60 + 50) * 60 + 8) * 1000 + 700, None]
    assert annotations.markdown(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), ["k"]).first().report == "| k | v |\n|---|---|\n| 1 | - |\n| 2 | b |"


def test_splits_keep_groups_whole(spark):
    sizes = [59, 25, 16, 10, 3, 2, 2] + [1] * 33
    g = spark.createDataFrame([(f"s{k:02d}", n) for k, n in enumerate(sizes)], "scene string, size long")
    out = {x.split: x.n for x in grouping.greedy_split(g, "scene", "size", 0.33, 0.2).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert sum(out.values()) == 150 and out["test"] <= 50 * 1.1 and out["val"] <= 20 * 1.1 + 1
    n = {x.split: x["count"] for x in grouping.fraction_split(g, "scene", 0.7, 0.15).groupBy("split").count().collect()}
    assert n == {"train": 28, "val": 6, "test": 6}


def test_first_fit_takes_the_whole_table(spark, tmp_path):
    r = random.Random(3)
    vectors = {k: [r.gauss(0, 1) for _ in range(8)] for k in r.sample(range(1000), 230)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    centred = {k: [x - sum(v) / 8 for x in v] for k, v in vectors.items()}
    units = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in centred.items()}  # dot products are correlations
    brute, founders = {}, []
    for k in sorted(units):
        brute[k] = next((f for f in founders if sum(a * b for a, b in zip(units[f], units[k], strict=True)) > 0.25), k)
        founders += [k] if brute[k] == k else []
    assert {x.id: x.rep for x in catalogue.QUERIES["q_first_fit_groups"](spark, str(tmp_path)).collect()} == brute
    items = spark.createDataFrame(list(units.items()), "id long, v array<double>")
    assert {x.id: x.rep for x in grouping.first_fit(items, 0.25, fold=7).collect()} == brute
    assert grouping.first_fit(items.limit(0), 0.25).count() == 0


def test_boxes_and_orphans_take_whole_tables(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, k % 4, [r.gauss(0, 0.05) for _ in range(9)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, ids in (("documents", range(0, 9)), ("labels", range(3, 12))):
        spark.createDataFrame([(k,) for k in ids], "doc_id long").write.parquet(f"{tmp_path}/{name}.parquet")
    gt, det = common.boxes(spark, str(tmp_path))
    assert sorted(x.gt_id for x in gt.collect()) == sorted(x.det_id for x in det.collect()) == list(range(30))
    assert {x.det_id for x in catalogue.QUERIES["q_greedy_match"](spark, str(tmp_path)).collect()} == set(range(30))
    orphans = {(x.doc_id, x.rule) for x in catalogue.QUERIES["q_orphans"](spark, str(tmp_path)).collect()}
    assert orphans == {(k, "document without label") for k in range(3)} | {(k, "label without document") for k in range(9, 12)}


def test_gate_and_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(1, 1.5), (3, 2.0)], "k int, b double")
    x = audit.parity(a, b, "k", 0.1).first()
    assert (x.n, x.n_unpaired, x.worst, x.passed, x.paired) == (3, 2, 0.5, False, False)
    assert audit.gate(a.filter("k > 9"), "g").first().passed


def test_streamed_days_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = drift.daily(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda df: sorted((x.event_type, x.window.start, x.n, round(x["mean"], 9)) for x in df.collect())
    assert rows(spark.table("days")) == rows(drift.daily(events)) != []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([float(r[k]) if isinstance(r[k], float) else r[k] for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    sql = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(sql.fetchall(), sql.columns)
