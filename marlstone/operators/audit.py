"""Rules, gates, parity and drift reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 0.001


def label_rules(rows: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """rule, hard and n of rows (cls, cx, cy, w, h): a row may break several; tiny boxes only warn.

    NaN is in no range, and it is not degenerate.
    """
    sides = [F.col(k) for k in ("cx", "cy", "w", "h")]
    inside = F.lit(True)
    for c in sides:
        inside = inside & c.between(0, 1) & ~F.isnan(c)
    w, h = F.col("w"), F.col("h")
    rules = {
        ("invalid class", True): ~F.col("cls").isin(*classes),
        ("out of range", True): ~inside,
        ("degenerate box", True): (w <= 0) | (h <= 0),
        ("tiny box", False): (w > 0) & (h > 0) & (w * h < TINY),
    }
    counts = rows.agg(*(F.count_if(c).alias(str(k)) for k, c in enumerate(rules.values())))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(hard).alias("hard"), F.col(str(k)).alias("n")) for k, (r, hard) in enumerate(rules)))))


def label_violations(rows: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """rule, hard, key, line_no and detail: a row for each rule that a row (key, line_no, cls, cx, cy, w, h) breaks.

    The detail names the class or the fields at fault.  A row with an `error` breaks that rule alone.
    """
    fields = ("cx", "cy", "w", "h")
    named = lambda test, names: F.concat_ws(",", *(F.when(test(F.col(c)), F.lit(c)) for c in names))
    out = named(lambda x: ~x.between(0, 1) | F.isnan(x), fields)
    flat = named(lambda x: x <= 0, ("w", "h"))
    w, h = F.col("w"), F.col("h")
    found = [
        ("invalid class", True, ~F.col("cls").isin(*classes), F.col("cls").cast("string")),
        ("out of range", True, out != "", out),
        ("degenerate box", True, flat != "", flat),
        ("tiny box", False, (w > 0) & (h > 0) & (w * h < TINY), F.lit("w,h")),
    ]
    rule = lambda name, hard, detail: F.struct(F.lit(name).alias("rule"), F.lit(hard).alias("hard"), detail.alias("detail"))
    broken = F.array_compact(F.array(*(F.when(test, rule(name, hard, detail)) for name, hard, test, detail in found)))
    if "error" in rows.columns:
        broken = F.when(F.col("error").isNotNull(), F.array(rule("unreadable line", True, F.col("error")))).otherwise(broken)
    return rows.select("key", "line_no", F.inline(broken)).select("rule", "hard", "key", "line_no", "detail")


def unknown(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ids whose key stands in no row of known."""
    return ids.join(known.select(key), key, "left_anti").select(key)


def uncovered(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys that the parts lack of the whole, or have beyond it: none where their union is the whole."""
    return unknown(whole, parts, key).unionByName(unknown(parts, whole, key))


def adds_up(*fractions: Column) -> Column:
    """Whether fractions of a split add up to one, within a millionth."""
    return F.abs(sum(fractions[1:], fractions[0]) - 1) <= 1e-6


def check_fractions(*fractions: float) -> None:
    """The same for a job's own parameters."""
    if abs(sum(fractions) - 1) > 1e-6:
        raise ValueError(f"fractions add up to {sum(fractions)}, not to 1")


def size_warnings(groups: DataFrame, key: str, size: str, *, most: int, scenes: tuple[int, int]) -> DataFrame:
    """key, size and warning: groups of more than `most`, and with a null key the number of groups where that is outside of scenes."""
    large = groups.filter(F.col(size) > most).select(key, F.col(size).cast("long").alias(size), F.lit(f"more than {most} in a scene").alias("warning"))
    odd = groups.agg(F.count("*").alias(size)).filter(~F.col(size).between(*scenes))
    return large.unionByName(odd.select(F.lit(None).cast("string").alias(key), size, F.lit(f"number of scenes outside {scenes[0]} to {scenes[1]}").alias("warning")))


def evaluation_path(path: Column) -> tuple[Column, Column]:
    """Whether a path holds val or test anywhere, which calibration refuses, and whether a folder of it is named so."""
    low = F.lower(path)
    return low.contains("val") | low.contains("test"), F.exists(F.split(low, "/"), lambda x: x.isin("val", "test"))


def orphans(a: DataFrame, b: DataFrame, key: str, only_a: str, only_b: str) -> DataFrame:
    """Keys that stand on one side only, with the rule they break."""
    return a.join(b, key, "left_anti").select(key, F.lit(only_a).alias("rule")).unionByName(b.join(a, key, "left_anti").select(key, F.lit(only_b).alias("rule")))


def gate(violations: DataFrame, name: str) -> DataFrame:
    """gate, passed and n_violations: one row that a job's exit can follow."""
    return violations.agg(F.lit(name).alias("gate"), (F.count("*") == 0).alias("passed"), F.count("*").alias("n_violations"))


def parity(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Of a (key, a) and b (key, b): rows, unpaired rows, worst and mean difference, the least key of the worst, and two gates: passed and paired."""
    both = a.join(b, key, "full").withColumn("d", F.abs(F.col("a") - F.col("b")))
    unpaired = F.count_if(F.col("a").isNull() | F.col("b").isNull())
    return both.agg(F.count("*").alias("n"), unpaired.alias("n_unpaired"), F.round(F.max("d"), 6).alias("worst"), F.min(F.when(F.col("d").isNotNull(), F.struct((-F.round("d", 6)).alias("o"), key)))[key].alias("worst_key"), F.round(F.avg("d"), 6).alias("mean_diff"), (F.max("d") <= tolerance).alias("passed"), (unpaired == 0).alias("paired"))


def verdict(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first band whose upper bound the value lies under."""
    out = F.when(value < bands[0][0], bands[0][1])
    for bound, name in bands[1:]:
        out = out.when(value < bound, name)
    return out.otherwise(otherwise)


def _baseline(daily: DataFrame, days: int) -> DataFrame:
    return daily.filter(F.col("day") < days).groupBy("key").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))


def rolling_alert(daily: DataFrame, *, days: int, baseline: int, sigmas: float) -> DataFrame:
    """daily (key, day, x): the mean of the last `days` days against that of the first `baseline` days, less sigmas deviations."""
    w = Window.partitionBy("key").orderBy("day").rangeBetween(-(days - 1), 0)
    rolled = daily.withColumn("rolled", F.avg("x").over(w)).join(_baseline(daily, baseline), "key")
    return rolled.select("key", "day", F.round("rolled", 6).alias("rolled"), F.round("m", 6).alias("base"), (F.col("rolled") < F.col("m") - sigmas * F.col("sd")).alias("alert"))


def drift_islands(daily: DataFrame, *, baseline: int, share: float, least: int) -> DataFrame:
    """Runs of at least `least` days in a row whose x is off the baseline by more than a share of it."""
    off = daily.join(_baseline(daily, baseline), "key").filter(F.abs(F.col("x") - F.col("m")) > share * F.col("m"))
    run = F.col("day") - F.row_number().over(Window.partitionBy("key").orderBy("day"))
    return off.withColumn("run", run).groupBy("key", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).filter(F.col("n_days") >= least).drop("run")
