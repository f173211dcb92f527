"""Tables, and the boxes that stand in for annotations: the driver's data has none, so vectors give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def e(k: int):
    """The k-th element of a vector, from 1, in double precision."""
    return F.col("embedding")[k - 1].cast("double")


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth and detections in 2 classes, one of each for every row and sixteen rows an image; misses come from the jitter."""
    v = table(spark, sf_dir, "embeddings")
    image = [F.expr("vec_id div 16").alias("img"), (F.col("label") % 2).alias("cls")]
    cx, cy, w, h = 320 + 600 * e(1), 320 + 600 * e(2), 40 + 400 * F.abs(e(3)), 40 + 400 * F.abs(e(4))
    gt = v.select(*image, F.col("vec_id").alias("gt_id"), *(c.alias(k) for k, c in geometry.corners(cx, cy, w, h).items()))
    moved = geometry.corners(cx + 60 * e(6), cy + 60 * e(7), w * (1 + e(8)), h * (1 + e(9)))
    det = v.select(*image, F.col("vec_id").alias("det_id"), F.abs(e(5)).alias("score"), *(c.alias(k) for k, c in moved.items()))
    return gt, det


#: The same in SQL.
BOXES = """
v AS (SELECT vec_id, label, vec_id // 16 AS img, label % 2 AS cls, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT *, 320 + 600 * e[1] AS cx, 320 + 600 * e[2] AS cy, 40 + 400 * abs(e[3]) AS w, 40 + 400 * abs(e[4]) AS h FROM v),
m AS (SELECT vec_id, img, cls, abs(e[5]) AS score, cx + 60 * e[6] AS cx, cy + 60 * e[7] AS cy, w * (1 + e[8]) AS w, h * (1 + e[9]) AS h FROM c),
gt AS (SELECT img, cls, vec_id AS gt_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM c),
det AS (SELECT img, cls, vec_id AS det_id, score, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM m),
meet AS (SELECT g.img, g.cls, g.gt_id, d.det_id, d.score,
  (least(g.x2, d.x2) - greatest(g.x1, d.x1)) * (least(g.y2, d.y2) - greatest(g.y1, d.y1)) AS inter,
  (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (d.x2 - d.x1) * (d.y2 - d.y1) AS da
  FROM gt g JOIN det d ON g.img = d.img AND g.cls = d.cls AND g.x1 < d.x2 AND d.x1 < g.x2 AND g.y1 < d.y2 AND d.y1 < g.y2),
pairs AS (SELECT img, cls, gt_id, det_id, score, inter / (ga + da - inter + 1e-9) AS iou FROM meet)
"""
