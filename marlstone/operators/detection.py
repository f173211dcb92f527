"""Detections: decoding, suppression, matching and average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import CORNERS, iou_pairs
from .ranking import before, sliced
from .storage import kept


def grid():
    """The overlap thresholds, 0.50 to 0.95 in steps of 0.05."""
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lit(0.5) + i * F.lit(0.05))


def best_class(scores: Column) -> tuple[Column, Column]:
    """The largest score and the first class that has it."""
    top = F.array_max(scores)
    return top, (F.array_position(scores, top) - 1).cast("int")


def malformed(det: DataFrame) -> DataFrame:
    """Boxes whose corners are out of order, for audit.gate()."""
    return det.filter(~((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))))


def suppressed(det: DataFrame, *, iou: float = 0.45, score: float | None = None, strict: bool = False) -> DataFrame:
    """Greedy non-maximum suppression by image and class, best score first, ties by det_id.

    A box is kept if its overlap with each kept one is at most iou; strict asks for less than iou.  One group is one
    image's detections of a class, which a fold over a sorted array can hold.
    """
    over = ">=" if strict else ">"
    rows = det if score is None else det.filter(F.col("score") > score)
    box = F.struct((-F.col("score")).alias("o"), "det_id", *CORNERS)
    ordered = rows.groupBy("img", "cls").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return ordered.selectExpr(
        "img",
        "cls",
        f"""explode(aggregate(boxes, slice(boxes, 1, 0), (kept, b) ->
            if(exists(kept, k ->
                greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1))
                / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
                   - greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1)) + 1e-9D) {over} {iou!r}D),
               kept, concat(kept, array(b))))) AS b""",
    ).select("img", "cls", "b.det_id", (-F.col("b.o")).alias("score"), *(F.col(f"b.{k}") for k in CORNERS))


def matched(gt: DataFrame, det: DataFrame) -> DataFrame:
    """det_id, img, cls, score, thr and tp: one-to-one greedy matches at each threshold of grid().

    Detections in score order, ties by det_id, each take the free box of their image and
    class with the largest overlap of at least thr, ties to the larger gt_id.
    """
    pairs = iou_pairs(gt, det, 0.5)
    found = pairs.groupBy("img", "cls", "det_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("iou", "gt_id")), asc=False).alias("options"))
    lists = found.groupBy("img", "cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "det_id", "options"))).alias("dets"))
    taken = lists.withColumn("thr", F.explode(grid())).selectExpr(
        "thr",
        """aggregate(dets, named_struct('used', cast(array() AS array<bigint>), 'hit', cast(array() AS array<bigint>)), (a, d) ->
            aggregate(filter(d.options, x -> x.iou >= thr AND NOT array_contains(a.used, x.gt_id)), cast(NULL AS bigint), (b, x) -> coalesce(b, x.gt_id),
              g -> if(g IS NULL, a, named_struct('used', concat(a.used, array(g)), 'hit', concat(a.hit, array(d.det_id)))))).hit AS hit""",
    )
    hits = taken.select("thr", F.explode("hit").alias("det_id"), F.lit(1).alias("tp"))
    every = det.select("det_id", "img", "cls", "score").withColumn("thr", F.explode(grid()))
    return every.join(hits, ["det_id", "thr"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def pr_curve(flags: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """flags (keys, score, det_id, tp) with rank, precision, recall and envelope; counts has keys' boxes as n_gt.

    envelope is the largest precision at this rank or later.  Ranks end ties by det_id.  Rows are
    dealt out by slices of the score; each slice carries on the counts of those before it
    and the largest precision of those after it, so no task holds a whole class.
    """
    order = [F.desc("score"), F.asc("det_id")]
    rows = sliced(kept(flags.withColumn("score", F.col("score").cast("double"))), "score", descending=True)
    inside = Window.partitionBy("_part", *keys)
    parts = before(rows.groupBy(*keys, "_part").agg(F.count("*").alias("n"), F.sum("tp").alias("hits")), keys, ["n", "hits"])
    down = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [k for k in keys if k in counts.columns]
    own = rows.withColumns({"rank": F.count("*").over(down), "hits": F.sum("tp").over(down)}).join(parts, [*keys, "_part"])
    own = own.withColumns({"rank": F.col("rank") + F.col("_n"), "hits": F.col("hits") + F.col("_hits")}).join(counts, on, "left")
    own = own.withColumn("n_gt", F.coalesce("n_gt", F.lit(0)).cast("long"))
    own = own.withColumns({"precision": F.col("hits") / F.col("rank"), "recall": F.try_divide(F.col("hits"), F.col("n_gt"))})
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.groupBy(*keys, "_part").agg(F.max("precision").alias("p")).select(*keys, "_part", F.max("p").over(later).alias("_after"))
    # From the last rank to the first a running maximum: one pass, where a frame to the end would be one for each row.
    up = inside.orderBy(F.asc("score"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("envelope", F.max("precision").over(up)).join(after, [*keys, "_part"])
    return out.withColumn("envelope", F.greatest("envelope", "_after")).drop("_part", "_n", "_hits", "_after")


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """All-point average precision: the envelope summed over true positives, by the number of boxes; 0 without any."""
    total = F.sum(F.when(F.col("tp") == 1, F.col("envelope")).otherwise(0.0))
    return curve.groupBy(*keys).agg(F.coalesce(F.try_divide(total, F.max("n_gt")), F.lit(0.0)).alias("ap"))


def best_f1(curve: DataFrame, keys: list[str], every: DataFrame | None = None) -> DataFrame:
    """Precision and recall where 2pr / (p + r + 1e-9) is largest, the first rank of such.

    `every` has a row for each of the keys; those without detections have zeros.
    """
    p, r = F.col("precision"), F.coalesce("recall", F.lit(0.0))
    scored = curve.withColumns({"recall": r, "f1": 2 * p * r / (p + r + F.lit(1e-9))})
    top = F.min(F.struct((-F.col("f1")).alias("o"), "rank", "precision", "recall"))
    best = scored.groupBy(*keys).agg(top.alias("t")).select(*keys, F.col("t.precision").alias("precision"), F.col("t.recall").alias("recall"), (-F.col("t.o")).alias("f1"))
    return best if every is None else every.select(*keys).distinct().join(best, keys, "left").na.fill(0.0, ["precision", "recall", "f1"])


def misses(gt: DataFrame, det: DataFrame, thr: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Boxes without any detection of overlap thr or more, and detections without any such box; not one to one."""
    pairs = iou_pairs(gt, det, thr)
    return gt.join(pairs, ["img", "cls", "gt_id"], "left_anti"), det.join(pairs, ["img", "cls", "det_id"], "left_anti")
