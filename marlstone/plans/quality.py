"""Label checks, distributions, sessions, samples and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import statistics
from ..operators import audit, geometry, grouping
from ..operators.ranking import rolling
from .common import e, table

#: Borders of the shares of an image that a box may cover.
EDGES = (0.0, 0.001, 0.005, 0.01, 0.05, 0.10, 0.25, 1.01)


def q_label_qa(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return audit.label_rules(_label_rows(v))


def _label_rows(v: DataFrame) -> DataFrame:
    return v.select(F.expr("vec_id div 16").alias("key"), (F.col("vec_id") % 16 + 1).alias("line_no"), (F.col("label") % 3).alias("cls"), (0.5 + 2 * e(1)).alias("cx"), (0.5 + 2 * e(2)).alias("cy"), (0.2 + e(3)).alias("w"), (0.2 + e(4)).alias("h"))


def q_label_violations(spark: SparkSession, d: str) -> DataFrame:
    """Each broken rule with the file and line that breaks it."""
    return audit.label_violations(_label_rows(table(spark, d, "embeddings")))


def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    labels = table(spark, d, "labels").select("doc_id")
    return audit.orphans(docs, labels, "doc_id", "document without label", "label without document")


def q_area_hist(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(table(spark, d, "lineitem").select((F.col("l_discount") * F.col("l_tax")).alias("area")), "area", EDGES)


def q_items_per_group(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").count()
    return n.agg(F.count("*").alias("n_groups"), F.round(F.avg("count"), 6).alias("mean_items"), F.min("count").alias("min_items"), F.max("count").alias("max_items"))


def _with_split(events: DataFrame) -> DataFrame:
    first = F.substring(grouping.seeded("event_id"), 1, 1)
    return events.withColumn("split", F.when(first < "b", "train").when(first < "d", "val").otherwise("test"))


def q_split_class_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "purchase", "scroll", "signup", "view"]
    events = _with_split(table(spark, d, "events"))
    return events.groupBy("split").agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds), F.count_if(~F.col("event_type").isin(kinds)).alias("n_other"))


def q_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    s = grouping.sessions(ev, "user_id", ["s", "event_id"], "s", 6 * 3600.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.round(F.max("s") - F.min("s"), 3).alias("span_s"))


def q_latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.latency(table(spark, d, "events").filter("event_id >= 20"), "event_type", "value")


def q_speedup(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "events").groupBy().agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return means.select(F.round(F.col("a") / F.col("b"), 6).alias("speedup"))


def q_variation_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("n_chars > 0").withColumn("x", F.col("n_chars").cast("double"))
    return docs.agg(
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_pop("x"), 4).alias("std"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.median("x").alias("median"),
        F.round(F.max("x") / F.greatest(F.min("x"), F.lit(1e-9)), 6).alias("span"),
        F.count_if(F.col("x") >= 1000).alias("n_portrait"),
    )


def q_brightness_hist(spark: SparkSession, d: str) -> DataFrame:
    return statistics.equal_width(table(spark, d, "lineitem").select((F.col("l_quantity") * 5.1).alias("b")), "b", 0.0, 255.0, 8)


def q_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.substring(grouping.seeded("doc_id"), 1, 1) < "b").select("doc_id", "lang", "n_chars")
    return grouping.sample(docs, "doc_id", 50, 7)


def q_letterbox_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumns({"w": F.lit(640.0) + F.col("vec_id") % 700, "h": F.lit(480.0) + F.col("label") * 97.0})
    v = v.withColumns(geometry.letterbox(F.col("w"), F.col("h"), 640)).withColumns({"x": F.abs(e(1)) * F.col("w"), "y": F.abs(e(2)) * F.col("h")})
    out = {}
    for axis, side, border in (("x", "w", "left"), ("y", "h", "top")):
        pad, gain = F.col(f"pad_{side}"), F.col("gain")
        out[f"{axis}_err"] = F.abs(geometry.to_original(geometry.to_letterbox(F.col(axis), pad, gain), pad, gain, F.col(side)) - F.col(axis))
        back = geometry.by_applied_scale(geometry.to_letterbox(F.col(axis), pad, gain), F.col(border), F.col(f"new_{side}"), F.col(side))
        out[f"{axis}_drift"] = F.abs(back - F.col(axis))
    v = v.withColumns(out)
    return v.select("vec_id", F.round("gain", 9).alias("gain"), "new_w", "new_h", "pad_w", "pad_h", "top", "bottom", "left", "right", (F.round("x_err", 6) + 0.0).alias("x_err"), (F.round("y_err", 6) + 0.0).alias("y_err"), F.round("x_drift", 6).alias("x_drift"), F.round("y_drift", 6).alias("y_drift"))


def q_resized(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 61).alias("w"), (F.col("p_partkey") % 900 + 100).cast("int").alias("h"))
    w, h = geometry.resized(F.col("w"), F.col("h"), 1280)
    return p.select("p_partkey", w.alias("new_w"), h.alias("new_h"), F.when(F.col("h") >= F.col("w"), "portrait").otherwise("landscape").alias("orientation"))


def q_dims_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars", F.char_length("text").alias("n")), table(spark, d, "labels").select("doc_id")
    return labels.join(docs, "doc_id", "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("n") != F.col("n_chars")).alias("n_mismatch"), (F.count_if(F.col("n").isNull()) == 0).alias("passed"))


def q_parity_diff(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    other = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).join(own, "key").filter(F.col("cents") > 0)
    a, b = own.select("key", (F.col("cents") / 100).alias("a")), other.select("key", F.round(F.col("cents") / 100).alias("b"))
    return audit.parity(a, b, "key", 0.45)


def q_rank_parity(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    by = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    side = lambda k, n: ev.filter(f"event_type = '{k}'").withColumn("rank", F.row_number().over(by)).select("user_id", "rank", F.col("value").alias(n))
    both = side("click", "a").join(side("view", "b"), ["user_id", "rank"], "full")
    diff = F.when(F.count("a") == F.count("b"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6)).otherwise(F.lit(float("inf")))
    return both.groupBy("user_id").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), diff.alias("worst"))


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("cents"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"))
    both = orders.join(lines, "key", "left").withColumn("diff", F.abs(F.col("total") - F.col("cents") / 100))
    return both.agg(F.count("*").alias("n_orders"), F.count_if(F.col("cents").isNull()).alias("n_unmatched"), F.count_if(F.col("diff") <= 0.01 * F.col("total")).alias("n_close"), F.round(F.min("diff"), 4).alias("least_diff"), F.round(F.max("diff"), 4).alias("most_diff"), (F.count_if(F.col("cents").isNull()) == 0).alias("passed"))


def q_name_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    part = lambda k: F.regexp_extract("url", r"^(https?)://([^/]+)/([a-z]{2})/([0-9]+)", k)
    number = F.expr("try_cast(nullif(regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 4), '') AS BIGINT)")
    ms = number % 86400000
    return p.select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("lang"), number.alias("number"), ms.alias("ms")).withColumn("clock", F.format_string("%02d:%02d.%03d", (F.col("ms") / 60000).cast("int") % 60, (F.col("ms") / 1000).cast("int") % 60, F.col("ms") % 1000))


def q_drift_rolling(spark: SparkSession, d: str) -> DataFrame:
    return audit.rolling_alert(_daily(spark, d), days=7, baseline=10, sigmas=2.0)


def q_drift_islands(spark: SparkSession, d: str) -> DataFrame:
    return audit.drift_islands(_daily(spark, d), baseline=10, share=0.02, least=3)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    return ev.groupBy(F.col("event_type").alias("key"), "day").agg((F.sum(F.round(F.col("value") * 1e6).cast("long")) / F.count("*") / 1e6).alias("x"))


def q_rolling_24h(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.round(F.col("value") * 1e6).cast("long").alias("u"))
    base = ev.groupBy("event_type").agg((F.sum("u") / F.count("*") / 1e6).alias("m"), F.stddev_samp("u").alias("sd"))
    rolled = rolling(ev, ["event_type"], "s", 86400, ["u"]).withColumn("mean", F.col("u") / F.col("n") / 1e6)
    off = rolled.join(base, "event_type").filter(F.abs(F.col("mean") - F.col("m")) > 0.1 * F.col("sd") / 1e6)
    at = off.select(F.col("event_type").alias("_type"), F.col("s").alias("_s"), "n", "mean")
    out = ev.join(at, (F.col("event_type") == F.col("_type")) & F.col("s").eqNullSafe(F.col("_s")))
    return out.select("event_id", "event_type", "n", F.round("mean", 6).alias("mean"))


def q_disagreement(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("a"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("b"))
    both = o.join(li, "l_orderkey", "full")
    same = (F.col("a") == "N") == (F.col("b") == "O")
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(~same, F.lit(True))).alias("n_differ"), F.round(F.count_if(F.coalesce(~same, F.lit(True))) / F.count("*"), 6).alias("rate"))


def q_low_conf_rate(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return ev.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5.0).alias("n_low"), F.round(F.count_if(F.col("value") < 5.0) / F.count("*"), 6).alias("rate"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_QA = "r AS (SELECT vec_id // 16 AS key, vec_id % 16 + 1 AS line_no, label % 3 AS cls, 0.5 + 2 * embedding[1]::DOUBLE AS cx, 0.5 + 2 * embedding[2]::DOUBLE AS cy, 0.2 + embedding[3]::DOUBLE AS w, 0.2 + embedding[4]::DOUBLE AS h FROM embeddings)"
_BINS = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
_DAILY = "d AS (SELECT event_type AS key, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, sum(round(value * 1e6)::BIGINT)::DOUBLE / count(*) / 1e6 AS x FROM events GROUP BY ALL), b AS (SELECT key, avg(x) AS m, stddev_samp(x) AS sd FROM d WHERE day < 10 GROUP BY key)"

ORACLES = {
    "q_label_qa": f"""WITH {_QA}, f AS (SELECT cls NOT IN (0, 1) AS a, NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1) AS b, (w <= 0 OR h <= 0) AS c, (w > 0 AND h > 0 AND w * h < 0.001) AS t FROM r)
        SELECT 'invalid class' AS rule, true AS hard, count(*) FILTER (a) AS n FROM f UNION ALL SELECT 'out of range', true, count(*) FILTER (b) FROM f UNION ALL SELECT 'degenerate box', true, count(*) FILTER (c) FROM f UNION ALL SELECT 'tiny box', false, count(*) FILTER (t) FROM f""",
    "q_label_violations": f"""WITH {_QA}, f AS (SELECT key, line_no, cls, w, h, concat_ws(',', CASE WHEN cx NOT BETWEEN 0 AND 1 THEN 'cx' END, CASE WHEN cy NOT BETWEEN 0 AND 1 THEN 'cy' END, CASE WHEN w NOT BETWEEN 0 AND 1 THEN 'w' END, CASE WHEN h NOT BETWEEN 0 AND 1 THEN 'h' END) AS outside, concat_ws(',', CASE WHEN w <= 0 THEN 'w' END, CASE WHEN h <= 0 THEN 'h' END) AS flat FROM r)
        SELECT 'invalid class' AS rule, true AS hard, key, line_no, cls::VARCHAR AS detail FROM f WHERE cls NOT IN (0, 1) UNION ALL SELECT 'out of range', true, key, line_no, outside FROM f WHERE outside <> '' UNION ALL SELECT 'degenerate box', true, key, line_no, flat FROM f WHERE flat <> '' UNION ALL SELECT 'tiny box', false, key, line_no, 'w,h' FROM f WHERE w > 0 AND h > 0 AND w * h < 0.001""",
    "q_orphans": "WITH a AS (SELECT doc_id FROM documents) SELECT doc_id, 'document without label' AS rule FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label without document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM a)",
    "q_area_hist": f"WITH b(bin, lo, hi) AS (VALUES {_BINS}), x AS (SELECT l_discount * l_tax AS area FROM lineitem) SELECT bin::INT AS bin, lo, hi, count(area) AS n FROM b LEFT JOIN x ON area >= lo AND area < hi GROUP BY ALL",
    "q_items_per_group": "SELECT count(*) AS n_groups, round(avg(c), 6) AS mean_items, min(c) AS min_items, max(c) AS max_items FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)",
    "q_split_class_pivot": "WITH s AS (SELECT *, substr(md5('42:' || event_id), 1, 1) AS f FROM events) SELECT CASE WHEN f < 'b' THEN 'train' WHEN f < 'd' THEN 'val' ELSE 'test' END AS split, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "purchase", "scroll", "signup", "view")) + ", count(*) FILTER (event_type NOT IN ('click', 'purchase', 'scroll', 'signup', 'view')) AS n_other FROM s GROUP BY 1",
    "q_gap_sessions": "WITH a AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s FROM events), b AS (SELECT *, CASE WHEN s - lag(s) OVER w > 21600 THEN 1 ELSE 0 END AS f FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b) SELECT user_id, session, count(*) AS n_events, round(max(s) - min(s), 3) AS span_s FROM c GROUP BY 1, 2",
    "q_latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, list_sort(list(value))[floor(count(*) * 0.95)::INT] AS p95, round(stddev_samp(value), 6) AS std FROM events WHERE event_id >= 20 GROUP BY 1",
    "q_speedup": "SELECT round(avg(value) FILTER (event_id % 2 = 0) / avg(value) FILTER (event_id % 2 = 1), 6) AS speedup FROM events",
    "q_variation_report": "SELECT round(avg(n_chars::DOUBLE), 6) AS mean, round(stddev_pop(n_chars::DOUBLE), 4) AS std, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most, median(n_chars::DOUBLE) AS median, round(max(n_chars)::DOUBLE / greatest(min(n_chars)::DOUBLE, 1e-9), 6) AS span, count(*) FILTER (n_chars >= 1000) AS n_portrait FROM documents WHERE n_chars > 0",
    "q_brightness_hist": "WITH b(bin) AS (SELECT unnest(range(8))::INT), x AS (SELECT least(floor(l_quantity * 5.1::DOUBLE / 31.875::DOUBLE), 7)::INT AS bin FROM lineitem WHERE l_quantity * 5.1::DOUBLE BETWEEN 0 AND 255) SELECT b.bin, count(x.bin) AS n FROM b LEFT JOIN x ON b.bin = x.bin GROUP BY 1",
    "q_seeded_sample": "SELECT doc_id, lang, n_chars FROM documents WHERE substr(md5('42:' || doc_id), 1, 1) < 'b' ORDER BY md5('7:' || doc_id), doc_id LIMIT 50",
    "q_letterbox_roundtrip": """WITH v AS (SELECT vec_id, 640.0::DOUBLE + vec_id % 700 AS w, 480.0::DOUBLE + label * 97.0::DOUBLE AS h, abs(embedding[1]::DOUBLE) AS a, abs(embedding[2]::DOUBLE) AS b FROM embeddings),
        g AS (SELECT *, least(640::DOUBLE / h, 640::DOUBLE / w) AS gain, a * w AS x, b * h AS y FROM v), n AS (SELECT *, round_even(w * gain, 0) AS new_w, round_even(h * gain, 0) AS new_h FROM g),
        p AS (SELECT *, (640 - new_w) / 2 AS pad_w, (640 - new_h) / 2 AS pad_h FROM n),
        q AS (SELECT *, round_even(pad_h - 0.1::DOUBLE, 0) AS top, round_even(pad_h + 0.1::DOUBLE, 0) AS bottom, round_even(pad_w - 0.1::DOUBLE, 0) AS "left", round_even(pad_w + 0.1::DOUBLE, 0) AS "right" FROM p)
        SELECT vec_id, round(gain, 9) AS gain, new_w, new_h, pad_w, pad_h, top, bottom, "left", "right",
        round(abs(greatest(0, least(w, ((x * gain + pad_w) - pad_w) / gain)) - x), 6) + 0 AS x_err, round(abs(greatest(0, least(h, ((y * gain + pad_h) - pad_h) / gain)) - y), 6) + 0 AS y_err,
        round(abs(((x * gain + pad_w) - "left") / (new_w / w) - x), 6) AS x_drift, round(abs(((y * gain + pad_h) - top) / (new_h / h) - y), 6) AS y_drift FROM q""",
    "q_resized": "WITH p AS (SELECT p_partkey, p_size * 61 AS w, (p_partkey % 900 + 100)::INT AS h FROM part), s AS (SELECT *, 1280::DOUBLE / greatest(w, h) AS sc FROM p) SELECT p_partkey, CASE WHEN sc < 1 THEN round_even(w * sc, 0)::INT ELSE w::INT END AS new_w, CASE WHEN sc < 1 THEN round_even(h * sc, 0)::INT ELSE h END AS new_h, CASE WHEN h >= w THEN 'portrait' ELSE 'landscape' END AS orientation FROM s",
    "q_dims_mismatch": "SELECT count(*) AS n_rows, count(*) FILTER (d.text IS NULL) AS n_missing, count(*) FILTER (length(d.text) <> d.n_chars) AS n_mismatch, count(*) FILTER (d.text IS NULL) = 0 AS passed FROM labels l LEFT JOIN documents d USING (doc_id)",
    "q_parity_diff": "WITH o AS (SELECT l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS c FROM lineitem GROUP BY 1), x AS (SELECT l_suppkey, abs(c / 100 - b) AS d FROM o LEFT JOIN (SELECT s_suppkey, round(c / 100) AS b FROM supplier JOIN o ON l_suppkey = s_suppkey WHERE c > 0) p ON p.s_suppkey = o.l_suppkey) SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS n_unpaired, round(max(d), 6) AS worst, (SELECT l_suppkey FROM x WHERE d IS NOT NULL ORDER BY round(d, 6) DESC, l_suppkey LIMIT 1) AS worst_key, round(avg(d), 6) AS mean_diff, max(d) <= 0.45 AS passed, count(*) FILTER (d IS NULL) = 0 AS paired FROM x",
    "q_rank_parity": "WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events), a AS (SELECT user_id, rank, value AS a FROM r WHERE event_type = 'click'), b AS (SELECT user_id, rank, value AS b FROM r WHERE event_type = 'view'), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a, b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.rank = b.rank) SELECT user_id, count(a) AS n_a, count(b) AS n_b, CASE WHEN count(a) = count(b) THEN round(max(abs(a - b)), 6) ELSE 'Infinity'::DOUBLE END AS worst FROM j GROUP BY 1",
    "q_reconcile": "WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::DOUBLE AS c FROM lineitem GROUP BY 1), j AS (SELECT o_totalprice AS t, c, abs(o_totalprice - c / 100) AS d FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) SELECT count(*) AS n_orders, count(*) FILTER (c IS NULL) AS n_unmatched, count(*) FILTER (d <= 0.01::DOUBLE * t) AS n_close, round(min(d), 4) AS least_diff, round(max(d), 4) AS most_diff, count(*) FILTER (c IS NULL) = 0 AS passed FROM j",
    "q_name_parse": r"WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 3) AS lang, try_cast(nullif(regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 4), '') AS BIGINT) AS number FROM pages) SELECT *, number % 86400000 AS ms, CASE WHEN number IS NULL THEN 'null:null.null' ELSE lpad((((number % 86400000) // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad((((number % 86400000) // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad(((number % 86400000) % 1000)::VARCHAR, 3, '0') END AS clock FROM p",
    "q_drift_rolling": f"WITH {_DAILY}, r AS (SELECT key, day, avg(x) OVER (PARTITION BY key ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolled FROM d) SELECT r.key, day, round(rolled, 6) AS rolled, round(m, 6) AS base, rolled < m - 2 * sd AS alert FROM r JOIN b ON r.key = b.key",
    "q_drift_islands": f"WITH {_DAILY}, o AS (SELECT d.key, day, row_number() OVER (PARTITION BY d.key ORDER BY day) AS k FROM d JOIN b ON d.key = b.key WHERE abs(x - m) > 0.02::DOUBLE * m) SELECT key, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM o GROUP BY key, day - k HAVING count(*) >= 3",
    "q_rolling_24h": "WITH v AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS s, round(value * 1e6)::BIGINT AS u FROM events), r AS (SELECT *, count(*) OVER w AS n, sum(u) OVER w::DOUBLE / count(*) OVER w / 1e6 AS mean FROM v WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)), b AS (SELECT event_type, sum(u)::DOUBLE / count(*) / 1e6 AS m, stddev_samp(u) AS sd FROM v GROUP BY 1) SELECT event_id, r.event_type, n, round(mean, 6) AS mean FROM r JOIN b ON r.event_type = b.event_type WHERE abs(mean - m) > 0.1::DOUBLE * sd / 1e6",
    "q_disagreement": "WITH a AS (SELECT l_orderkey, max(l_returnflag) AS a FROM lineitem GROUP BY 1), j AS (SELECT coalesce((a = 'N') <> (o_orderstatus = 'O'), true) AS x FROM orders FULL JOIN a ON o_orderkey = l_orderkey) SELECT count(*) AS n, count(*) FILTER (x) AS n_differ, round(count(*) FILTER (x) / count(*), 6) AS rate FROM j",
    "q_low_conf_rate": "SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (value < 5) AS n_low, round(count(*) FILTER (value < 5) / count(*), 6) AS rate FROM events GROUP BY 1",
}
