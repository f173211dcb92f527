"""Boxes: coordinate conversions, letterboxing and overlap, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> dict[str, Column]:
    """Corner columns of a centre box, scaled by an image size and not clipped."""
    width, height = (x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    return {"x1": (cx - w / 2) * width, "y1": (cy - h / 2) * height, "x2": (cx + w / 2) * width, "y2": (cy + h / 2) * height}


def drawn(columns: dict[str, Column], least: int | None = None) -> dict[str, Column]:
    """Whole pixels, cut off toward zero; least bounds them from below."""
    cut = {k: v.cast("int") for k, v in columns.items()}
    return cut if least is None else {k: F.greatest(F.lit(least), v) for k, v in cut.items()}


def letterbox(w: Column, h: Column, size: int) -> dict[str, Column]:
    """gain, resized sides, pads and whole-pixel borders of an image fitted into a square; halves round to even."""
    gain = F.least(F.lit(float(size)) / h, F.lit(float(size)) / w)
    new_w, new_h = F.bround(w * gain), F.bround(h * gain)
    pad_w, pad_h = (size - new_w) / 2, (size - new_h) / 2
    return {"gain": gain, "new_w": new_w, "new_h": new_h, "pad_w": pad_w, "pad_h": pad_h, "top": F.bround(pad_h - 0.1), "bottom": F.bround(pad_h + 0.1), "left": F.bround(pad_w - 0.1), "right": F.bround(pad_w + 0.1)}


def to_original(x: Column, pad: Column, gain: Column, limit: Column) -> Column:
    """A letterbox coordinate in the original image, clipped to it."""
    return F.greatest(F.lit(0.0), F.least(limit, (x - pad) / gain))


def by_applied_scale(x: Column, border: Column, new_side: Column, side: Column) -> Column:
    """A letterbox coordinate in the original image by the scale and whole-pixel border that were applied in fact, not clipped."""
    return (x - border) / (new_side / side)


def thickness(h: Column) -> Column:
    """The width of lines drawn on an image of a height."""
    return F.greatest(F.lit(2), F.floor(h / 400)).cast("int")


def to_letterbox(x: Column, pad: Column, gain: Column) -> Column:
    return x * gain + pad


def flipped(cx: Column) -> Column:
    """The centre of a box, as a share of the width, in the image mirrored left to right."""
    return 1 - cx


def resized(w: Column, h: Column, long_edge: int) -> tuple[Column, Column]:
    """Sides after shrinking the longer one to long_edge; smaller images stay."""
    scale = F.lit(float(long_edge)) / F.greatest(w, h)
    return tuple(F.when(scale < 1, F.bround(x * scale).cast("int")).otherwise(x.cast("int")) for x in (w, h))


def iou(a: str, b: str, clamp: bool = False) -> Column:
    """Intersection over union of boxes in columns with the prefixes a and b; clamp keeps inverted areas at zero."""
    c = {s: {k: F.col(f"{s}{k}") for k in CORNERS} for s in (a, b)}
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c[a][hi], c[b][hi]) - F.greatest(c[a][lo], c[b][lo]))
    inter = side("x1", "x2") * side("y1", "y2")
    edge = lambda s, lo, hi: F.greatest(F.lit(0.0), c[s][hi] - c[s][lo]) if clamp else c[s][hi] - c[s][lo]
    area = lambda s: edge(s, "x1", "x2") * edge(s, "y1", "y2")
    return inter / (area(a) + area(b) - inter + F.lit(1e-9))


def iou_pairs(gt: DataFrame, det: DataFrame, least: float | None = None) -> DataFrame:
    """Overlapping boxes of the same image and class: img, cls, gt_id, det_id, score, iou.

    An equi-join on image and class with an overlap condition, so no pair without
    a common area leaves the join.
    """
    g = gt.select("img", "cls", "gt_id", *(F.col(k).alias(f"g_{k}") for k in CORNERS))
    d = det.select("img", "cls", "det_id", "score", *(F.col(k).alias(f"d_{k}") for k in CORNERS))
    meets = (F.col("g_x1") < F.col("d_x2")) & (F.col("d_x1") < F.col("g_x2")) & (F.col("g_y1") < F.col("d_y2")) & (F.col("d_y1") < F.col("g_y2"))
    out = g.join(d, ["img", "cls"]).filter(meets).select("img", "cls", "gt_id", "det_id", "score", iou("g_", "d_").alias("iou"))
    return out if least is None else out.filter(F.col("iou") >= least)


def outside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (img, x, y) that lie in no box of their image; a border is inside."""
    b = boxes.select(F.col("img").alias("_img"), *(F.col(k).alias(f"_{k}") for k in CORNERS))
    inside = (F.col("img") == F.col("_img")) & F.col("x").between(F.col("_x1"), F.col("_x2")) & F.col("y").between(F.col("_y1"), F.col("_y2"))
    return points.join(b, inside, "left_anti")


def reconciled(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """For each box of a (img, cls, gt_id) the box of b (img, cls, det_id) in its image whose corners differ least, ties to the smaller id.

    gt_id, det_id, cls, other_cls, diff (the largest difference of a corner) and close, whether that is within tolerance;
    a box without any in its image keeps its row.
    """
    other = b.select("img", "det_id", F.col("cls").alias("other_cls"), *(F.col(k).alias(f"_{k}") for k in CORNERS))
    diff = F.greatest(*(F.abs(F.col(k) - F.col(f"_{k}")) for k in CORNERS))
    best = a.join(other, "img", "left").groupBy("gt_id", "cls").agg(F.min(F.when(F.col("det_id").isNotNull(), F.struct(diff.alias("diff"), "det_id", "other_cls"))).alias("m"))
    return best.select("gt_id", "m.det_id", "cls", "m.other_cls", "m.diff", F.coalesce(F.col("m.diff") <= tolerance, F.lit(False)).alias("close"))
