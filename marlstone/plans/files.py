"""Readers and writers of files: each query writes a table in a format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.storage import shared_folder
from ..sources import annotations, config
from .common import e, table


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.round(0.5 + 2 * e(k), 4)
    v = table(spark, d, "embeddings")
    return v.select(F.concat(F.lit("img"), F.expr("vec_id div 16")).alias("stem"), "vec_id", "label", side(1).alias("cx"), side(2).alias("cy"), side(3).alias("w"), side(4).alias("h"))


def q_label_files(spark: SparkSession, d: str) -> DataFrame:
    """Label files, one for each image, written and read in the strict mode."""
    path = _folder(spark, "labels")
    annotations.write_labels(_boxes(spark, d).withColumn("cls", F.col("label")), path)
    rows = annotations.label_rows(spark, f"{path}/*")
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.round(F.sum(F.round(F.col("cx") * 10000)), 0).alias("cx_sum"), F.max("line_no").cast("long").alias("most_lines"))


def q_csv_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A CSV export written and read: the last size given for each image, and how many it has."""
    path = _folder(spark, "csv")
    whole = lambda k: F.round(F.col(k) * 1000).cast("int")
    rows = _boxes(spark, d).select(F.concat(F.lit("c"), "label").alias("label_name"), whole("cx").alias("bbox_x"), whole("cy").alias("bbox_y"), whole("w").alias("bbox_width"), whole("h").alias("bbox_height"), F.concat("stem", F.lit(".jpg")).alias("image_name"), F.lit(640).alias("image_width"), (480 + F.expr("vec_id div 16") % 7).cast("int").alias("image_height"))
    rows.write.option("header", True).csv(path)
    sizes = annotations.csv_dimensions(spark, path)
    boxes = annotations.csv_boxes(spark, path).groupBy("image_name").agg(F.count("*").alias("n"), F.sum("bbox_x").alias("x_sum"))
    return boxes.join(sizes, "image_name")


def q_voc_boxes(spark: SparkSession, d: str) -> DataFrame:
    """XML annotations written and read: a row for each object."""
    path = _folder(spark, "voc")
    whole = lambda k: F.round(F.col(k) * 1000).cast("long")
    one = F.struct(F.concat(F.lit("c"), "label").alias("name"), F.lit("Unspecified").alias("pose"), F.lit(0).alias("truncated"), (F.col("label") % 2).cast("int").alias("difficult"), F.struct(whole("cx").alias("xmin"), whole("cy").alias("ymin"), whole("w").alias("xmax"), whole("h").alias("ymax")).alias("bndbox"))
    rows = _boxes(spark, d).groupBy(F.concat("stem", F.lit(".jpg")).alias("filename")).agg(F.collect_list(one).alias("object"))
    rows.withColumn("size", F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(3).alias("depth"))).write.format("xml").option("rowTag", "annotation").save(path)
    found = annotations.voc_boxes(spark, path)
    return found.groupBy("name", "pose", "truncated", "difficult").agg(F.count("*").alias("n"), F.count_distinct("filename").alias("n_images"), F.sum("xmin").alias("x_sum"), F.max("width").alias("width"))


def q_scene_map_files(spark: SparkSession, d: str) -> DataFrame:
    """Scene maps written and read: one that was audited, one that nobody vouches for and that gives no rows; and held-out ids in both of their forms."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.trim("r_name").alias("scene"), F.trim("n_name").alias("image_name"))
    out = None
    for name, by in (("audited", "leakage-audit"), ("unknown", None)):
        path = _folder(spark, "scenes")
        annotations.scene_map_json(rows, by).write.text(path)
        read = annotations.scene_map(spark, path)
        own = read.agg(F.lit(name).alias("file"), F.count_distinct("scene").alias("n_scenes"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    for name, of in (("held out", lambda x: F.to_json(F.struct(x.alias("test_scenes")))), ("bare list", F.to_json)):
        path = _folder(spark, "held")
        rows.agg(of(F.sort_array(F.collect_set("scene"))).alias("value")).write.text(path)
        out = out.unionByName(annotations.held_out(spark, path).agg(F.lit(name).alias("file"), F.count_distinct("scene").alias("n_scenes"), F.count("*").alias("n")))
    return out


def q_hash_gate(spark: SparkSession, d: str) -> DataFrame:
    """Files written, listed and hashed: the gate passes against their own hashes and not against others."""
    path = _folder(spark, "files")
    table(spark, d, "region").select(F.trim("r_name").alias("value"), F.concat("r_regionkey", F.lit(".JPG")).alias("name")).write.partitionBy("name").text(path)
    found = annotations.file_hashes(spark, f"{path}/*")
    other = found.withColumn("sha256", F.when(F.col("path").contains("name=0"), F.lit("0")).otherwise(F.col("sha256")))
    gates = audit.gate(annotations.mismatched(found, found), "same").unionByName(audit.gate(annotations.mismatched(found, other), "other"))
    size = annotations.folder_size(spark.read.format("binaryFile").load(f"{path}/*"))
    return gates.crossJoin(F.broadcast(size.select(F.col("n").alias("n_files"), "bytes")))


def q_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of regions as one Markdown table."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return annotations.markdown(table(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.trim("r_name").alias("r_name"), "n"), ["r_regionkey"])


def q_dataset_config(spark: SparkSession, d: str) -> DataFrame:
    """A dataset file written and read, with its root resolved against its own folder; the dump says what a job ran with."""
    path = _folder(spark, "config")
    lines = "path: dataset  # beside this file\ntrain: images/train\nval: images/val\nnames:\n  0: first\n  1: 'second one'\nsizes: [640, 320]"
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    found = config.dataset(spark, path)
    found["path"] = found["path"].removeprefix(shared_folder(spark)).rsplit("/", 1)[-1]
    return spark.createDataFrame([(config.dumped(found),)], "config string")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_B = "b AS (SELECT vec_id, label, 'img' || (vec_id // 16) AS stem, round(0.5 + 2 * embedding[1]::DOUBLE, 4) AS cx, round(0.5 + 2 * embedding[2]::DOUBLE, 4) AS cy, vec_id // 16 AS img FROM embeddings)"

ORACLES = {
    "q_label_files": f"WITH {_B}, n AS (SELECT stem, count(*) AS n FROM b GROUP BY 1) , m AS (SELECT label AS cls, count(*) AS n, 0::BIGINT AS n_errors, round(sum(round(cx * 10000)), 0) AS cx_sum FROM b GROUP BY 1), l AS (SELECT label, max(k) AS most_lines FROM (SELECT label, row_number() OVER (PARTITION BY stem ORDER BY line) AS k FROM (SELECT label, stem, label || ' ' || cx AS line FROM b)) GROUP BY 1) SELECT cls, n, n_errors, cx_sum, most_lines FROM m JOIN l ON l.label = m.cls",
    "q_csv_boxes": f"WITH {_B} SELECT stem || '.jpg' AS image_name, count(*) AS n, sum(round(cx * 1000)::BIGINT)::BIGINT AS x_sum, 640 AS image_width, (480 + img % 7)::INT AS image_height, 1::BIGINT AS n_sizes FROM b GROUP BY stem, img",
    "q_voc_boxes": f"WITH {_B} SELECT 'c' || label AS name, 'Unspecified' AS pose, 0 AS truncated, (label % 2)::INT AS difficult, count(*) AS n, count(DISTINCT stem) AS n_images, sum(round(cx * 1000)::BIGINT)::BIGINT AS x_sum, 640::BIGINT AS width FROM b GROUP BY label",
    "q_scene_map_files": "WITH s AS (SELECT count(DISTINCT r_name) AS a, count(*) AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT 'audited' AS file, a AS n_scenes, b AS n FROM s UNION ALL SELECT 'unknown', 0, 0 UNION ALL SELECT 'held out', a, a FROM s UNION ALL SELECT 'bare list', a, a FROM s",
    "q_hash_gate": "WITH s AS (SELECT count(*) AS n_files, sum(length(trim(r_name)) + 1)::BIGINT AS bytes FROM region) SELECT 'same' AS gate, true AS passed, 0::BIGINT AS n_violations, n_files, bytes FROM s UNION ALL SELECT 'other', false, 1, n_files, bytes FROM s",
    "q_report": "WITH n AS (SELECT r_regionkey AS k, trim(r_name) AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2) SELECT '| r_regionkey | r_name | n |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || k || ' | ' || name || ' | ' || n || ' |', chr(10) ORDER BY k) AS report FROM n",
    "q_dataset_config": """SELECT '{"path": "dataset", "train": "images/train", "val": "images/val", "names": {"0": "first", "1": "second one"}, "sizes": [640, 320]}' AS config""",
}
