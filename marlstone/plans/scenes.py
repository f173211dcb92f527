"""Similarity audits, clusters, splits and their manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, grouping, similarity
from ..operators.ranking import ranked
from ..operators.storage import kept, shared_folder
from ..sources import annotations
from .common import table


def _signed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    split = F.when(F.substring(grouping.seeded("vec_id"), 1, 1) < "b", "train").otherwise("eval")
    return v.select("vec_id", split.alias("split"), similarity.sign_bits(F.col("embedding"), 64).alias("bits"))


def q_sign_hamming_nn(spark: SparkSession, d: str) -> DataFrame:
    """The nearest training row of each evaluation row; those within 16 bits are flagged."""
    s = _signed(spark, d)
    side = lambda k: s.filter(F.col("split") == k).select(F.col("vec_id").alias("id"), F.col("bits").alias("v"))
    near = similarity.nearest_other(side("eval"), side("train"), similarity.bit_distance)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("train_id"), F.col("dist").cast("int").alias("dist"), (F.col("dist") <= 16).alias("flagged"))


def q_closest_cross_split(spark: SparkSession, d: str) -> DataFrame:
    return q_sign_hamming_nn(spark, d).orderBy("dist", "vec_id", "train_id").limit(10).select("vec_id", "train_id", "dist")


def q_exact_dup_across_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    split = F.when(F.substring(grouping.seeded("doc_id"), 1, 1) < "b", "train").otherwise("eval")
    own = docs.select("doc_id", split.alias("split"), F.sha2(F.col("text"), 256).alias("hash"))
    return own.groupBy("hash").agg(F.count("*").alias("n_docs"), F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("hash", "n_docs")


def _vectors(spark: SparkSession, d: str, centre: bool) -> DataFrame:
    """(id, v): vectors of length one, less their mean where the dot product is to be a correlation."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.unit(similarity.centred(v) if centre else v).alias("v"))


def _edges(spark: SparkSession, d: str, limit: float) -> DataFrame:
    """Pairs by correlation distance, less a bonus where the ids are near in time: (a, b, dist)."""
    return similarity.near_pairs(_vectors(spark, d, True), limit, 0.05, 3)


def q_corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, 0.6)


def q_cosine_audit(spark: SparkSession, d: str) -> DataFrame:
    first = lambda k: F.substring(grouping.seeded(k), 1, 1) < "b"
    found = similarity.near_pairs(_vectors(spark, d, False), 0.65, 0.0, 0)
    return found.filter(first("a") != first("b")).select("a", "b", F.round(1 - F.col("dist"), 6).alias("cosine"))


def q_corr_audit(spark: SparkSession, d: str) -> DataFrame:
    """The leakage audit by a second metric: for each evaluation row the training row of least correlation distance."""
    s = _vectors(spark, d, True)
    train = F.substring(grouping.seeded("id"), 1, 1) < "b"
    near = similarity.nearest_other(s.filter(~train), s.filter(train), similarity.dot_distance, 9)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("train_id"), F.round("dist", 6).alias("dist"), (F.col("dist") <= 0.5).alias("flagged"))


def q_dhash(spark: SparkSession, d: str) -> DataFrame:
    """Difference signatures of 8 rows of 9 values."""
    v = table(spark, d, "embeddings")
    return v.select("vec_id", similarity.dhash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("bits"))


def q_phash(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the 15 lowest frequencies of 8 x 8 values."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", similarity.phash(F.transform(similarity.low_frequencies(F.col("v"), 8, 4), lambda x: F.round(x, 9))).alias("bits"))


def q_brightness(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each row's values, as of an image's grey pixels."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(total / F.size("embedding"), 9).alias("brightness"))


def q_cc_cluster(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return similarity.clusters(nodes, _edges(spark, d, 0.6)).select("id", "label")


STEPS = (0.50, 0.525, 0.55, 0.575, 0.60, 0.625, 0.65)


def q_threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    edges = kept(_edges(spark, d, STEPS[-1]))
    out = None
    for t in STEPS:
        n = similarity.clusters(nodes, edges.filter(F.col("dist") <= t)).agg(F.count_distinct("label").alias("n")).select(F.lit(t).alias("thr"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def q_knee(spark: SparkSession, d: str) -> DataFrame:
    return similarity.knee(q_threshold_scan(spark, d)).select("thr", "n", "bend")


def q_renumbered(spark: SparkSession, d: str) -> DataFrame:
    sizes = q_cc_cluster(spark, d).groupBy("label").agg(F.count("*").alias("size")).filter("size > 1")
    return ranked(sizes, [], [F.asc("label")]).select(F.format_string("scene%02d", "rank").alias("scene"), "label", "size")


def q_first_fit_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the correlation with their founder."""
    return grouping.first_fit(_vectors(spark, d, True), 0.25)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("scene")).agg(F.count("*").alias("size"))


def q_fraction_split(spark: SparkSession, d: str) -> DataFrame:
    return grouping.fraction_split(_groups(spark, d), "scene", 0.7, 0.15).select("scene", "size", "split")


def q_reserved_split(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    return grouping.reserved_split(g, g.filter("scene LIKE 'fr/%'"), "scene", 0.6, 0.2).select("scene", "size", "split")


def q_greedy_split(spark: SparkSession, d: str) -> DataFrame:
    return grouping.greedy_split(_groups(spark, d), "scene", "size", 0.33, 0.2).select("scene", "size", "split")


def q_file_split(spark: SparkSession, d: str) -> DataFrame:
    return grouping.file_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2).select("doc_id", "split")


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, scene and split of every document: by whole scenes, and each for itself."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("scene"))
    return docs.join(q_greedy_split(spark, d).select("scene", "split"), "scene"), docs.join(q_file_split(spark, d), "doc_id")


def q_split_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scenes in more than one split, of a split by scenes, which passes, and one by documents, which doesn't."""
    out = None
    for name, rows in zip(("by scene", "by document"), _assigned(spark, d), strict=True):
        spread = rows.groupBy("scene").agg(F.min("split").alias("a"), F.max("split").alias("b"))
        own = spread.agg(F.lit(name).alias("gate"), F.count("*").alias("n_scenes"), F.count_if(F.col("a") != F.col("b")).alias("n_spread"), (F.count_if(F.col("a") != F.col("b")) == 0).alias("passed"))
        out = own if out is None else out.unionByName(own)
    return out


def q_coverage_gates(spark: SparkSession, d: str) -> DataFrame:
    """Held-out ids that are no scene, and documents that a split leaves out or adds: of labels, and of both ways to split."""
    docs = table(spark, d, "documents").select("doc_id")
    held = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    by_scene, by_file = _assigned(spark, d)
    out = audit.gate(audit.unknown(held, docs, "doc_id"), "held out")
    for name, rows in (("by scene", by_scene), ("by document", by_file), ("train alone", by_file.filter("split = 'train'"))):
        out = out.unionByName(audit.gate(audit.uncovered(rows, docs, "doc_id"), name))
    return out


def q_fraction_gate(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of a split must add up to one within a millionth; a row for each region's shares of customers by a third of the nations."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return n.select("n_regionkey", audit.adds_up(F.lit(0.5), F.col("n") / 20, F.lit(0.25)).alias("passed"))


def q_size_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of unlikely size, and an unlikely number of them."""
    return audit.size_warnings(_groups(spark, d), "scene", "size", most=12, scenes=(10, 60))


def q_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of each language's scenes, largest first, as one line."""
    sizes = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sizes.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), " ").alias("sizes"))


def q_calibration_guard(spark: SparkSession, d: str) -> DataFrame:
    """Paths that hold val or test anywhere are refused, and which of these only look like an evaluation split."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("images/"), F.when(F.col("page_id") % 5 == 0, "test").when(F.col("page_id") % 7 == 0, "retrieval").otherwise("train"), F.lit("/"), "page_id").alias("path"))
    refused, split = audit.evaluation_path(F.col("path"))
    return p.select("page_id", refused.alias("refused"), (refused & ~split).alias("over_matched"))


def q_manifest_json(spark: SparkSession, d: str) -> DataFrame:
    own = q_fraction_split(spark, d).groupBy("split").agg(F.sort_array(F.collect_list("scene")).alias("scenes"))
    return own.select("split", F.to_json(F.struct(F.lit(42).alias("seed"), "split", "scenes")).alias("manifest"))


def q_scene_map_json(spark: SparkSession, d: str) -> DataFrame:
    """A scene map of regions and their nations, as scene_map() reads it."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.trim("r_name").alias("scene"), F.trim("n_name").alias("image_name"))
    return annotations.scene_map_json(rows, "leakage-audit").select("scene_map")


def q_materialised_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by split and read again: rows and characters of each part."""
    path = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").withColumn("scene", F.concat_ws("/", "lang", "source")).join(q_greedy_split(spark, d).select("scene", "split"), "scene")
    annotations.write_splits(docs.select("doc_id", "text", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_SIGNED = "s AS (SELECT vec_id, substr(md5('42:' || vec_id), 1, 1) < 'b' AS train, list_reduce(list_prepend(0::BIGINT, list_transform(range(63), lambda i: CASE WHEN embedding[i + 2] > embedding[i + 1] THEN 1::BIGINT << i ELSE 0::BIGINT END)), lambda a, b: a | b) AS bits FROM embeddings), x AS (SELECT a.vec_id, b.vec_id AS train_id, bit_count(xor(a.bits, b.bits))::INT AS dist FROM s a, s b WHERE NOT a.train AND b.train), m AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, train_id) AS k FROM x), nn AS (SELECT vec_id, train_id, dist FROM m WHERE k = 1)"
_PLAIN = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_CENTRED = "w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS mean FROM w), v AS (SELECT vec_id, list_transform(v, lambda x: x - mean) AS v FROM m)"
_DIST = "n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v), e AS (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n) - {bonus}, 9) AS dist FROM n a JOIN n b ON a.vec_id < b.vec_id)"
_NEAR = _CENTRED + ", " + _DIST.format(bonus="CASE WHEN abs(a.vec_id - b.vec_id) <= 3 THEN 0.05::DOUBLE ELSE 0::DOUBLE END")
#: Each round takes the least label of a node's neighbours and its own; so many are more than any path is long here.
_ROUNDS = 60
_CLOSE = f"u AS (SELECT a, b FROM e WHERE dist <= 0.6::DOUBLE UNION ALL SELECT b, a FROM e WHERE dist <= 0.6::DOUBLE UNION ALL SELECT vec_id, vec_id FROM embeddings), r AS (SELECT 0 AS k, vec_id AS id, vec_id AS label FROM embeddings UNION ALL SELECT max(r.k) + 1, u.a, min(r.label) FROM r JOIN u ON u.b = r.id WHERE r.k < {_ROUNDS} GROUP BY u.a), c AS (SELECT id, label FROM r WHERE k = {_ROUNDS})"
_SCAN = f"t(thr) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in STEPS)}), u AS (SELECT thr, a, b FROM e, t WHERE dist <= thr UNION ALL SELECT thr, b, a FROM e, t WHERE dist <= thr UNION ALL SELECT thr, vec_id, vec_id FROM embeddings, t), r AS (SELECT 0 AS k, thr, vec_id AS id, vec_id AS label FROM embeddings, t UNION ALL SELECT max(r.k) + 1, u.thr, u.a, min(r.label) FROM r JOIN u ON u.b = r.id AND u.thr = r.thr WHERE r.k < {_ROUNDS} GROUP BY u.thr, u.a), c AS (SELECT thr, id, label FROM r WHERE k = {_ROUNDS}), z AS (SELECT thr, count(DISTINCT label) AS n FROM c GROUP BY 1)"
_GROUPS = "g AS (SELECT lang || '/' || source AS scene, count(*) AS size FROM documents GROUP BY 1)"
_FRACTION = "o AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || scene), scene) AS k, count(*) OVER () AS n FROM {src}), f AS (SELECT scene, size, CASE WHEN k <= round_even(n * {a}::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * {a}::DOUBLE, 0) + round_even(n * {b}::DOUBLE, 0) THEN 'val' ELSE '{rest}' END AS split FROM o)"
_GREEDY = """o AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5('42:' || scene), scene) AS k FROM g), q AS (SELECT 0.33::DOUBLE * sum(size) AS tt, 0.2::DOUBLE * (sum(size) - 0.33::DOUBLE * sum(size)) AS vv FROM g),
step AS (SELECT 0::BIGINT AS k, tt AS t, vv AS v, tt, vv, ''::VARCHAR AS scene, 0::BIGINT AS size, ''::VARCHAR AS split FROM q
 UNION ALL SELECT k, CASE WHEN w = 'test' THEN t - size ELSE t END, CASE WHEN w = 'val' THEN v - size ELSE v END, tt, vv, scene, size, w FROM (SELECT o.k, s.t, s.v, s.tt, s.vv, o.scene, o.size,
  CASE WHEN (s.t > 0 AND o.size <= s.t + 0.1::DOUBLE * s.tt) AND (NOT (s.v > 0 AND o.size <= s.v + 0.1::DOUBLE * s.vv) OR s.t >= s.v) THEN 'test' WHEN s.v > 0 AND o.size <= s.v + 0.1::DOUBLE * s.vv THEN 'val' ELSE 'train' END AS w FROM step s JOIN o ON o.k = s.k + 1))"""

_FILES = "fo AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents), fs AS (SELECT doc_id, CASE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM fo)"

ORACLES = {
    "q_sign_hamming_nn": f"WITH {_SIGNED} SELECT vec_id, train_id, dist, dist <= 16 AS flagged FROM nn",
    "q_closest_cross_split": f"WITH {_SIGNED} SELECT vec_id, train_id, dist FROM nn ORDER BY dist, vec_id, train_id LIMIT 10",
    "q_exact_dup_across_split": "WITH h AS (SELECT sha256(text) AS hash, CASE WHEN substr(md5('42:' || doc_id), 1, 1) < 'b' THEN 'train' ELSE 'eval' END AS split FROM documents) SELECT hash, count(*) AS n_docs FROM h GROUP BY 1 HAVING min(split) <> max(split)",
    "q_corr_pairs": f"WITH {_NEAR} SELECT a, b, dist FROM e WHERE dist <= 0.6::DOUBLE",
    "q_cosine_audit": f"WITH {_PLAIN}, {_DIST.format(bonus='0::DOUBLE')} SELECT a, b, round(1 - dist, 6) AS cosine FROM e WHERE dist <= 0.65::DOUBLE AND (substr(md5('42:' || a), 1, 1) < 'b') <> (substr(md5('42:' || b), 1, 1) < 'b')",
    "q_cc_cluster": f"WITH RECURSIVE {_NEAR}, {_CLOSE} SELECT id, label FROM c",
    "q_threshold_scan": f"WITH RECURSIVE {_NEAR}, {_SCAN} SELECT thr, n FROM z",
    "q_knee": f"WITH RECURSIVE {_NEAR}, {_SCAN}, k AS (SELECT thr, n, lag(n) OVER (ORDER BY thr) - 2 * n + lead(n) OVER (ORDER BY thr) AS bend FROM z) SELECT thr, n, bend FROM k WHERE bend IS NOT NULL ORDER BY bend DESC, thr LIMIT 1",
    "q_renumbered": f"WITH RECURSIVE {_NEAR}, {_CLOSE}, z AS (SELECT label, count(*) AS size FROM c GROUP BY 1 HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (ORDER BY label) AS k FROM z) SELECT 'scene' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS scene, label, size FROM k",
    "q_first_fit_groups": f"WITH RECURSIVE {_CENTRED}, n AS (SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, row_number() OVER (ORDER BY vec_id) AS k FROM v), p AS (SELECT a.id AS x, b.id AS r, b.k AS rk, a.k AS k FROM n a JOIN n b ON b.k < a.k AND list_dot_product(a.v, b.v) > 0.25::DOUBLE), o AS (SELECT k, list(r ORDER BY rk) AS near FROM p GROUP BY 1), step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS reps, 0::BIGINT AS id, 0::BIGINT AS rep UNION ALL SELECT k, CASE WHEN f IS NULL THEN list_append(reps, id) ELSE reps END, id, coalesce(f, id) FROM (SELECT n.k, s.reps, n.id, list_filter(coalesce(o.near, []), lambda y: list_contains(s.reps, y))[1] AS f FROM step s JOIN n ON n.k = s.k + 1 LEFT JOIN o ON o.k = n.k)) SELECT id, rep FROM step WHERE k > 0",
    "q_fraction_split": f"WITH {_GROUPS}, {_FRACTION.format(src='g', a=0.7, b=0.15, rest='test')} SELECT * FROM f",
    "q_reserved_split": f"WITH {_GROUPS}, h AS (SELECT * FROM g WHERE scene NOT LIKE 'fr/%'), {_FRACTION.format(src='h', a=repr(0.6 / (0.6 + 0.2)), b=0.0, rest='val')} SELECT * FROM f UNION ALL SELECT scene, size, 'test' FROM g WHERE scene LIKE 'fr/%'",
    "q_greedy_split": f"WITH RECURSIVE {_GROUPS}, {_GREEDY} SELECT scene, size, split FROM step WHERE k > 0",
    "q_corr_audit": f"WITH {_CENTRED}, n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, substr(md5('42:' || vec_id), 1, 1) < 'b' AS train FROM v), x AS (SELECT a.vec_id, b.vec_id AS train_id, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS dist FROM n a JOIN n b ON NOT a.train AND b.train), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, train_id) AS k FROM x) SELECT vec_id, train_id, round(dist, 6) AS dist, dist <= 0.5::DOUBLE AS flagged FROM r WHERE k = 1",
    "q_dhash": "WITH p AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS p FROM embeddings) SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN p[i // 8 * 9 + i % 8 + 2] > p[i // 8 * 9 + i % 8 + 1] THEN '1' ELSE '0' END), '') AS bits FROM p",
    "q_phash": f"WITH c AS (SELECT {similarity.cosine_basis(8, 4)!r}::DOUBLE[][] AS c), t AS (SELECT vec_id, list_transform(range(16), lambda k: round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * c[k // 4 + 1][i // 8 + 1] * c[k % 4 + 1][i % 8 + 1])), 9)) AS t FROM embeddings, c), l AS (SELECT vec_id, t[2:16] AS t, list_median(t[2:16]) AS m FROM t) SELECT vec_id, array_to_string(list_transform(t, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits FROM l",
    "q_brightness": "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS brightness FROM embeddings",
    "q_file_split": f"WITH {_FILES} SELECT doc_id, split FROM fs",
    "q_split_gate": f"WITH RECURSIVE {_GROUPS}, {_GREEDY}, {_FILES}, x AS (SELECT 'by scene' AS gate, doc_id, lang || '/' || source AS scene, split FROM documents JOIN (SELECT scene, split FROM step WHERE k > 0) s ON s.scene = lang || '/' || source UNION ALL SELECT 'by document', documents.doc_id, lang || '/' || source, fs.split FROM documents JOIN fs ON fs.doc_id = documents.doc_id), y AS (SELECT gate, scene, min(split) <> max(split) AS spread FROM x GROUP BY 1, 2) SELECT gate, count(*) AS n_scenes, count(*) FILTER (spread) AS n_spread, count(*) FILTER (spread) = 0 AS passed FROM y GROUP BY 1",
    "q_coverage_gates": f"WITH RECURSIVE {_GROUPS}, {_GREEDY}, {_FILES}, s AS (SELECT doc_id FROM documents JOIN (SELECT scene FROM step WHERE k > 0) z ON z.scene = lang || '/' || source), h AS (SELECT doc_id * 2 AS doc_id FROM labels), x AS (SELECT 'held out' AS gate, (SELECT count(*) FROM h WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n UNION ALL SELECT 'by scene', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)) + (SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'by document', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fs)) + (SELECT count(*) FROM fs WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'train alone', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fs WHERE split = 'train'))) SELECT gate, n = 0 AS passed, n AS n_violations FROM x",
    "q_fraction_gate": "SELECT n_regionkey, abs(0.5::DOUBLE + count(*) / 20 + 0.25::DOUBLE - 1) <= 1e-6 AS passed FROM nation GROUP BY 1",
    "q_size_warnings": f"WITH {_GROUPS} SELECT scene, size, 'more than 12 in a scene' AS warning FROM g WHERE size > 12 UNION ALL SELECT NULL, n, 'number of scenes outside 10 to 60' FROM (SELECT count(*) AS n FROM g) WHERE n NOT BETWEEN 10 AND 60",
    "q_group_sizes": "WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, string_agg(n::VARCHAR, ' ' ORDER BY n DESC) AS sizes FROM s GROUP BY 1",
    "q_calibration_guard": "WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'test' WHEN page_id % 7 = 0 THEN 'retrieval' ELSE 'train' END AS s FROM pages) SELECT page_id, s IN ('test', 'retrieval') AS refused, s = 'retrieval' AS over_matched FROM p",
    "q_scene_map_json": """WITH s AS (SELECT trim(r_name) AS scene, list(trim(n_name) ORDER BY trim(n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT '{"validated_by":"leakage-audit","n_clusters":' || count(*) || ',"scenes":{' || string_agg('"' || scene || '":["' || array_to_string(names, '","') || '"]', ',' ORDER BY scene) || '}}' AS scene_map FROM s""",
    "q_materialised_split": f"WITH RECURSIVE {_GROUPS}, {_GREEDY} SELECT split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents JOIN (SELECT scene, split FROM step WHERE k > 0) s ON s.scene = lang || '/' || source GROUP BY 1",
    "q_manifest_json": f"""WITH {_GROUPS}, {_FRACTION.format(src='g', a=0.7, b=0.15, rest='test')} SELECT split, '{{"seed":42,"split":"' || split || '","scenes":["' || string_agg(scene, '","' ORDER BY scene) || '"]}}' AS manifest FROM f GROUP BY 1""",
}
