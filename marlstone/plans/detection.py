"""Overlaps, suppression, matching, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, detection, geometry
from ..operators.geometry import iou_pairs
from .common import BOXES, boxes, e, table


def q_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return iou_pairs(*boxes(spark, d)).select("img", "cls", "gt_id", "det_id", F.round("iou", 9).alias("iou"))


def q_decode_argmax(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 5, 8), lambda x: x.cast("double")).alias("scores"))
    top, cls = detection.best_class(F.col("scores"))
    return v.select("vec_id", cls.alias("cls"), top.alias("score")).filter(F.col("score") >= 0.1)


def q_nms(spark: SparkSession, d: str) -> DataFrame:
    _, det = boxes(spark, d)
    return detection.suppressed(det, iou=0.45, score=0.01).select("img", "cls", "det_id")


def q_strict_nms(spark: SparkSession, d: str) -> DataFrame:
    """Suppression where only an overlap below the threshold survives; det_id is the row's own number."""
    _, det = boxes(spark, d)
    return detection.suppressed(det, iou=0.3, strict=True).select("cls", "det_id", F.round("score", 6).alias("score"))


def q_malformed_gate(spark: SparkSession, d: str) -> DataFrame:
    """Boxes must have their corners in order; those whose jittered side turned negative have not."""
    gt, det = boxes(spark, d)
    return audit.gate(detection.malformed(gt), "ground truth").unionByName(audit.gate(detection.malformed(det), "detections"))


def q_outside_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Centres of detections that lie in no box of their image, of either class."""
    gt, det = boxes(spark, d)
    points = det.select("img", "det_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return geometry.outside(points, gt).select("img", "det_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def q_nearest_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Each box with the detection of its image whose corners are nearest, whatever its class: the classes that two exports call alike."""
    gt, det = boxes(spark, d)
    return geometry.reconciled(gt, det, 12.0).select("gt_id", "det_id", "cls", "other_cls", F.round("diff", 6).alias("diff"), "close")


def q_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Corners as they are drawn, in whole pixels and cut off toward zero, and the width of the lines."""
    _, det = boxes(spark, d)
    corners = geometry.drawn({k: F.col(k) for k in geometry.CORNERS}, least=0)
    return det.select("det_id", *(c.alias(k) for k, c in corners.items()), geometry.thickness(F.lit(480) + F.col("img") * 97).alias("line"))


def q_flip(spark: SparkSession, d: str) -> DataFrame:
    """Centre boxes of images that are mirrored left to right."""
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(geometry.flipped(0.5 + 2 * e(1)), 9).alias("cx"), F.round(0.5 + 2 * e(2), 9).alias("cy"))


def q_suppression_monitor(spark: SparkSession, d: str) -> DataFrame:
    _, det = boxes(spark, d)
    n = det.groupBy("img").agg(F.count("*").alias("n_before"))
    kept = detection.suppressed(det, iou=0.45).groupBy("img").agg(F.count("*").alias("n_after"))
    ratio = n.join(kept, "img").withColumn("ratio", F.col("n_after") / F.col("n_before"))
    all_ = ratio.agg(F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("sd"))
    return ratio.crossJoin(F.broadcast(all_)).select("img", "n_before", "n_after", F.round("ratio", 6).alias("ratio"), (F.abs(F.col("ratio") - F.col("m")) > 1.5 * F.col("sd")).alias("alert"))


def q_miss_fp_rank(spark: SparkSession, d: str) -> DataFrame:
    gt, det = boxes(spark, d)
    missed, false = detection.misses(gt, det, 0.5)
    n = missed.select("img", F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(false.select("img", F.lit(0).alias("m"), F.lit(1).alias("f"))).groupBy("img").agg(F.sum("m").alias("misses"), F.sum("f").alias("false_positives"))
    n = n.withColumn("errors", F.col("misses") + F.col("false_positives"))
    return n.orderBy(F.desc("errors"), F.desc("misses"), F.desc("false_positives"), F.desc("img")).limit(5)


def q_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return detection.matched(*boxes(spark, d)).select("det_id", "img", "cls", F.round("thr", 2).alias("thr"), "tp")


def _label_flags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    flags = docs.select(F.col("toxic").alias("cls"), F.col("doc_id").alias("det_id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("tp"))
    return flags, flags.groupBy("cls").agg(F.sum("tp").alias("n_gt"))


def q_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = detection.pr_curve(*_label_flags(spark, d), ["cls"])
    return curve.select("cls", "rank", "det_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("envelope", 9).alias("envelope"))


def q_ap(spark: SparkSession, d: str) -> DataFrame:
    ap = detection.average_precision(detection.pr_curve(*_label_flags(spark, d), ["cls"]), ["cls"])
    return ap.select("cls", F.round("ap", 6).alias("ap"))


def q_best_f1(spark: SparkSession, d: str) -> DataFrame:
    flags, counts = _label_flags(spark, d)
    best = detection.best_f1(detection.pr_curve(flags, counts, ["cls"]), ["cls"], counts)
    return best.select("cls", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def q_map(spark: SparkSession, d: str) -> DataFrame:
    """AP at 0.5 and over the grid, by class and as a mean over all classes, those without boxes too."""
    gt, det = boxes(spark, d)
    counts = gt.groupBy("cls").agg(F.count("*").alias("n_gt"))
    curve = detection.pr_curve(detection.matched(gt, det), counts, ["cls", "thr"])
    ap = detection.average_precision(curve, ["cls", "thr"])
    classes = spark.range(2).select(F.col("id").cast("int").alias("cls")).join(F.broadcast(counts), "cls", "left").withColumn("n_gt", F.coalesce("n_gt", F.lit(0)).cast("long"))
    grid = classes.withColumn("thr", F.explode(detection.grid())).join(ap, ["cls", "thr"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    by = grid.groupBy("cls").agg(F.max("n_gt").alias("n_gt"), F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("a"), F.avg("ap").alias("m"))
    rows = by.select(F.col("cls").cast("string").alias("cls"), "n_gt", "a", "m").unionByName(by.agg(F.lit("all").alias("cls"), F.sum("n_gt").alias("n_gt"), F.avg("a").alias("a"), F.avg("m").alias("m")))
    return rows.select("cls", "n_gt", F.round("a", 6).alias("ap50"), F.round("m", 6).alias("ap50_95"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_KEPT = """ord AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, det_id) AS k FROM det WHERE {least}),
o AS (SELECT a.img, a.cls, a.k AS i, b.k AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM ord a JOIN ord b ON a.img = b.img AND a.cls = b.cls AND a.k < b.k),
hide AS (SELECT img, cls, j, list(i) AS by FROM o WHERE inter / (aa + ba - inter + 1e-9) {over}::DOUBLE GROUP BY ALL),
step AS (SELECT img, cls, 0::BIGINT AS k, []::BIGINT[] AS kept, max(k) AS n FROM ord GROUP BY img, cls
  UNION ALL SELECT s.img, s.cls, s.k + 1, CASE WHEN h.by IS NULL OR NOT list_has_any(h.by, s.kept) THEN list_append(s.kept, s.k + 1) ELSE s.kept END, n FROM step s LEFT JOIN hide h ON h.img = s.img AND h.cls = s.cls AND h.j = s.k + 1 WHERE s.k < s.n),
nms AS (SELECT ord.img, ord.cls, det_id FROM step JOIN ord ON ord.img = step.img AND ord.cls = step.cls AND list_contains(kept, ord.k) WHERE step.k = step.n)"""
_LOOSE = _KEPT.replace("{least}", "true").replace("{over}", "> 0.45")
_MATCH = """opt AS (SELECT img, cls, det_id, max(score) AS score, list_sort(list({'iou': iou, 'g': gt_id}), 'DESC') AS options FROM pairs WHERE iou >= 0.5 GROUP BY ALL),
ord AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, det_id) AS k FROM opt),
thr AS (SELECT 0.5::DOUBLE + i * 0.05::DOUBLE AS thr FROM range(10) t(i)),
step AS (SELECT img, cls, thr, 0::BIGINT AS k, max(k) AS n, []::BIGINT[] AS used, []::BIGINT[] AS hit FROM ord, thr GROUP BY img, cls, thr
  UNION ALL SELECT img, cls, thr, k, n, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, CASE WHEN g IS NULL THEN hit ELSE list_append(hit, det_id) END
  FROM (SELECT s.img, s.cls, s.thr, s.k + 1 AS k, s.n, s.used, s.hit, o.det_id, list_filter(o.options, lambda x: x.iou >= s.thr AND NOT list_contains(s.used, x.g))[1].g AS g FROM step s JOIN ord o ON o.img = s.img AND o.cls = s.cls AND o.k = s.k + 1)),
hits AS (SELECT thr, unnest(hit) AS det_id FROM step WHERE k = n),
flags AS (SELECT det.det_id, det.img, det.cls, det.score, thr.thr, CASE WHEN hits.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM det CROSS JOIN thr LEFT JOIN hits ON hits.det_id = det.det_id AND hits.thr = thr.thr)"""
_FLAGS = "f AS (SELECT toxic AS cls, doc_id AS det_id, n_chars::DOUBLE AS score, quality AS tp FROM labels JOIN documents USING (doc_id)), n AS (SELECT cls, sum(tp)::BIGINT AS n_gt FROM f GROUP BY 1)"
_CURVE = "a AS (SELECT f.*, n_gt, row_number() OVER w AS rank, sum(tp) OVER w AS hits FROM f JOIN n ON f.cls = n.cls WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, hits::DOUBLE / rank AS precision, hits::DOUBLE / nullif(n_gt, 0) AS recall FROM a), cv AS (SELECT *, max(precision) OVER (PARTITION BY {keys} ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p)"
_DOCS = _FLAGS + ", " + _CURVE.format(keys="f.cls").replace("(PARTITION BY f.cls ORDER BY score DESC, det_id ROWS BETWEEN", "(PARTITION BY cls ORDER BY score DESC, det_id ROWS BETWEEN")

ORACLES = {
    "q_iou_pairs": f"WITH {BOXES} SELECT img, cls, gt_id, det_id, round(iou, 9) AS iou FROM pairs",
    "q_decode_argmax": "WITH s AS (SELECT vec_id, list_transform(embedding[5:12], lambda x: x::DOUBLE) AS s FROM embeddings) SELECT vec_id, (list_position(s, list_max(s)) - 1)::INT AS cls, list_max(s) AS score FROM s WHERE list_max(s) >= 0.1::DOUBLE",
    "q_nms": f"WITH RECURSIVE {BOXES}, {_LOOSE.replace('true', 'score > 0.01::DOUBLE')} SELECT img, cls, det_id FROM nms",
    "q_strict_nms": f"WITH RECURSIVE {BOXES}, {_KEPT.replace('{least}', 'true').replace('{over}', '>= 0.3')} SELECT nms.cls, nms.det_id, round(det.score, 6) AS score FROM nms JOIN det ON det.det_id = nms.det_id",
    "q_malformed_gate": f"WITH {BOXES} SELECT 'ground truth' AS gate, count(*) = 0 AS passed, count(*) AS n_violations FROM gt WHERE NOT (x1 <= x2 AND y1 <= y2) UNION ALL SELECT 'detections', count(*) = 0, count(*) FROM det WHERE NOT (x1 <= x2 AND y1 <= y2)",
    "q_outside_boxes": f"WITH {BOXES}, p AS (SELECT img, det_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM det) SELECT img, det_id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.img = p.img AND p.x BETWEEN gt.x1 AND gt.x2 AND p.y BETWEEN gt.y1 AND gt.y2)",
    "q_nearest_reconcile": f"WITH {BOXES}, x AS (SELECT g.gt_id, d.det_id, g.cls, d.cls AS other_cls, greatest(abs(g.x1 - d.x1), abs(g.y1 - d.y1), abs(g.x2 - d.x2), abs(g.y2 - d.y2)) AS diff FROM gt g LEFT JOIN det d ON g.img = d.img), r AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY diff, det_id) AS k FROM x) SELECT gt_id, det_id, cls, other_cls, round(diff, 6) AS diff, coalesce(diff <= 12.0::DOUBLE, false) AS close FROM r WHERE k = 1",
    "q_drawn": f"WITH {BOXES} SELECT det_id, greatest(0, trunc(x1)::INT) AS x1, greatest(0, trunc(y1)::INT) AS y1, greatest(0, trunc(x2)::INT) AS x2, greatest(0, trunc(y2)::INT) AS y2, greatest(2, (480 + img * 97) // 400)::INT AS line FROM det",
    "q_flip": "SELECT vec_id, round(1 - (0.5 + 2 * embedding[1]::DOUBLE), 9) AS cx, round(0.5 + 2 * embedding[2]::DOUBLE, 9) AS cy FROM embeddings",
    "q_suppression_monitor": f"WITH RECURSIVE {BOXES}, {_LOOSE}, r AS (SELECT img, count(*) AS n_before FROM det GROUP BY 1), q AS (SELECT img, count(*) AS n_after FROM nms GROUP BY 1), z AS (SELECT r.img, n_before, n_after, n_after::DOUBLE / n_before AS ratio FROM r JOIN q ON r.img = q.img) SELECT img, n_before, n_after, round(ratio, 6) AS ratio, abs(ratio - (SELECT avg(ratio) FROM z)) > 1.5::DOUBLE * (SELECT stddev_samp(ratio) FROM z) AS alert FROM z",
    "q_miss_fp_rank": f"WITH {BOXES}, h AS (SELECT * FROM pairs WHERE iou >= 0.5::DOUBLE), e AS (SELECT img, 1 AS m, 0 AS f FROM gt WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.gt_id = gt.gt_id) UNION ALL SELECT img, 0, 1 FROM det WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.det_id = det.det_id)) SELECT img, sum(m)::BIGINT AS misses, sum(f)::BIGINT AS false_positives, (sum(m) + sum(f))::BIGINT AS errors FROM e GROUP BY 1 ORDER BY errors DESC, misses DESC, false_positives DESC, img DESC LIMIT 5",
    "q_greedy_match": f"WITH RECURSIVE {BOXES}, {_MATCH} SELECT det_id, img, cls, round(thr, 2) AS thr, tp FROM flags",
    "q_pr_curve": f"WITH {_DOCS} SELECT cls, rank, det_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(envelope, 9) AS envelope FROM cv",
    "q_ap": f"WITH {_DOCS} SELECT cls, round(coalesce(sum(CASE WHEN tp = 1 THEN envelope ELSE 0 END) / nullif(max(n_gt), 0), 0), 6) AS ap FROM cv GROUP BY 1",
    "q_best_f1": f"WITH {_DOCS}, s AS (SELECT cls, rank, precision, coalesce(recall, 0) AS recall, 2 * precision * coalesce(recall, 0) / (precision + coalesce(recall, 0) + 1e-9) AS f1 FROM cv), t AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, rank) AS k FROM s) SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM t WHERE k = 1",
    "q_map": f"""WITH RECURSIVE {BOXES}, {_MATCH}, n AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY 1), f AS (SELECT * FROM flags),
        {_CURVE.format(keys='f.cls, thr').replace('(PARTITION BY f.cls, thr ORDER BY score DESC, det_id ROWS BETWEEN', '(PARTITION BY cls, thr ORDER BY score DESC, det_id ROWS BETWEEN')},
        ap AS (SELECT cls, thr, coalesce(sum(CASE WHEN tp = 1 THEN envelope ELSE 0 END) / nullif(max(n_gt), 0), 0) AS ap FROM cv GROUP BY 1, 2),
        k AS (SELECT x::INT AS cls FROM range(2) t(x)), g AS (SELECT k.cls, thr.thr, coalesce(n.n_gt, 0) AS n_gt, coalesce(ap.ap, 0) AS ap FROM k CROSS JOIN thr LEFT JOIN n ON n.cls = k.cls LEFT JOIN ap ON ap.cls = k.cls AND ap.thr = thr.thr),
        b AS (SELECT cls, max(n_gt) AS n_gt, max(ap) FILTER (thr = 0.5) AS a, avg(ap) AS m FROM g GROUP BY 1)
        SELECT cls::VARCHAR AS cls, n_gt::BIGINT AS n_gt, round(a, 6) AS ap50, round(m, 6) AS ap50_95 FROM b UNION ALL SELECT 'all', sum(n_gt)::BIGINT, round(avg(a), 6), round(avg(m), 6) FROM b""",
}
