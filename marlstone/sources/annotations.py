"""Box annotations in text, CSV, XML and JSON, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Image suffixes, and the columns of the CSV export.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
CSV_SCHEMA = "label_name string, bbox_x int, bbox_y int, bbox_width int, bbox_height int, image_name string, image_width int, image_height int"
VOC_SCHEMA = "filename string, size struct<width:bigint,height:bigint,depth:bigint>, object array<struct<name:string,pose:string,truncated:int,difficult:int,bndbox:struct<xmin:bigint,ymin:bigint,xmax:bigint,ymax:bigint>>>"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, image_name, stem and length of the images of one folder, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    return files.filter(suffix.isin(*suffixes)).select("path", F.element_at(F.split("path", "/"), -1).alias("image_name"), stem(F.col("path")).alias("stem"), "length")


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def label_rows(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    """Rows of the label files of a folder: stem, line_no (from 1, blank lines not counted) and what the mode asks for.

    strict: cls, cx, cy, w, h and error, null for good rows; lenient: only rows of five
    numbers, class cut to a whole number; count: cls from the first field of every row.
    """
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("stem"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.regexp_replace(x, r"\s+", "") != "")
    rows = text.select("stem", F.posexplode(lines).alias("at", "line")).select("stem", (F.col("at") + 1).alias("line_no"), F.split("line", r"\s+").alias("f"))
    whole = F.regexp_like(F.col("f")[0], F.lit(r"^[+-]?\d+$"))
    numbers = [F.expr(f"try_cast(f[{k}] AS double)") for k in range(5)]
    if mode == "count":
        return rows.select("stem", "line_no", F.when(whole, F.expr("try_cast(f[0] AS int)")).alias("cls"))
    five = F.size("f") == 5
    sized = rows.withColumn("f", F.when(five, F.col("f")))
    good = F.lit(True)
    for x in numbers[1:]:
        good = good & x.isNotNull()
    columns = [x.alias(n) for x, n in zip(numbers[1:], ("cx", "cy", "w", "h"), strict=True)]
    if mode == "lenient":
        return sized.filter(five & numbers[0].isNotNull() & good).select("stem", "line_no", numbers[0].cast("int").alias("cls"), *columns)
    error = F.when(~five, "field count").when(~(whole & good), "non-numeric field")
    return rows.withColumns({"error": error, "f": F.when(five, F.col("f"))}).select("stem", "line_no", F.when(F.regexp_like(F.col("f")[0], F.lit(r"^[+-]?\d+$")), F.expr("try_cast(f[0] AS int)")).alias("cls"), *columns, "error")


def csv_boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CSV_SCHEMA)


def csv_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """image_name, image_width and image_height, those of an image's last row in file order, and n_sizes, how many different ones it has."""
    rows = csv_boxes(spark, path).select("image_name", "image_width", "image_height", F.monotonically_increasing_id().alias("at"))
    last = rows.groupBy("image_name").agg(F.max(F.struct("at", "image_width", "image_height")).alias("m"), F.count_distinct("image_width", "image_height").alias("n_sizes"))
    return last.select("image_name", "m.image_width", "m.image_height", "n_sizes")


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """filename, width, height, name, pose, truncated, difficult and corners: a row for each object."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    return rows.select("filename", "size.width", "size.height", F.explode("object").alias("o")).select("filename", "width", "height", "o.name", "o.pose", "o.truncated", "o.difficult", "o.bndbox.*")


def scene_map(spark: SparkSession, path: str) -> DataFrame:
    """scene and image_name of a reviewed or audited scene map; others give no rows."""
    kind = "generated_by string, validated_by string, reviewed boolean, n_clusters int, scenes map<string,array<string>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    trusted = raw.filter(F.coalesce("reviewed", F.lit(False)) | (F.coalesce("validated_by", F.lit("")) == "leakage-audit"))
    return trusted.select(F.explode("scenes").alias("scene", "names")).select("scene", F.explode("names").alias("image_name"))


def held_out(spark: SparkSession, path: str) -> DataFrame:
    """Scene ids of {"test_scenes": [...]} or of a bare list."""
    text = spark.read.text(path, wholetext=True)
    ids = F.coalesce(F.from_json("value", "test_scenes array<string>")["test_scenes"], F.from_json("value", "array<string>"))
    return text.select(F.explode(ids).alias("scene"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def mismatched(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of hashes (path, sha256) that expected (path, sha256) knows otherwise, and expected ones that are missing, for audit.gate()."""
    want = expected.select("path", F.col("sha256").alias("wanted"))
    return want.join(hashes.select("path", "sha256"), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("wanted")))


#: Fixed value: how cameras name a picture by the time it was taken.
_TAKEN = r"^IMG_(\d{8})_(\d{2})(\d{2})(\d{2})(\d{3})"


def capture_ms(name: Column) -> Column:
    """Milliseconds of the day from a name such as IMG_20260901_145008700, null for others."""
    part = lambda k: F.expr("1") * F.regexp_extract(name, _TAKEN, k).try_cast("bigint")
    return ((part(2) * 60 + part(3)) * 60 + part(4)) * 1000 + part(5)


def write_labels(boxes: DataFrame, path: str, confidence: bool = False) -> None:
    """One text file part for each image: class, centre and size, and the confidence as a sixth field on request."""
    fields = ["cls", "cx", "cy", "w", "h", *(["score"] if confidence else [])]
    lines = boxes.select("stem", F.concat_ws(" ", *(F.col(f).cast("string") for f in fields)).alias("value"))
    lines.repartition("stem").sortWithinPartitions("stem", "value").write.partitionBy("stem").text(path)


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """A report-sized table as one Markdown string."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns)), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    listed = df.select(F.struct(*order, cells.alias("_line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return listed.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["_line"]), "\n")).alias("report"))


def write_splits(rows: DataFrame, path: str) -> None:
    """Rows with a `split`, in one folder for each split; split=train and so on are read back as a column."""
    rows.write.partitionBy("split").parquet(path)


def scene_map_json(rows: DataFrame, validated_by: str | None = None, reviewed: bool | None = None) -> DataFrame:
    """One row, scene_map: rows (scene, image_name) as the JSON that scene_map() reads; of a size that people review."""
    scenes = rows.groupBy("scene").agg(F.sort_array(F.collect_set("image_name")).alias("names"))
    listed = scenes.agg(F.sort_array(F.collect_list(F.struct("scene", "names"))).alias("s"))
    told = [F.lit(x).alias(k) for k, x in (("validated_by", validated_by), ("reviewed", reviewed)) if x is not None]
    return listed.select(F.to_json(F.struct(*told, F.size("s").alias("n_clusters"), F.map_from_entries("s").alias("scenes"))).alias("scene_map"))
