"""Histograms and distribution statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """bin, lo, hi and n of half-open bins [lo, hi), empty ones included; values outside count nowhere."""
    x = F.col(column)
    bins = list(zip(edges, edges[1:], strict=False))
    which = F.coalesce(*(F.when((x >= lo) & (x < hi), F.lit(k)) for k, (lo, hi) in enumerate(bins)))
    counted = df.select(which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(bins)], "bin int, lo double, hi double")
    return every.join(F.broadcast(counted), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """bin and n of n equal bins over [lo, hi], the last one closed, empty ones included."""
    x = F.col(column)
    which = F.least(F.floor((x - lo) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("int")
    counted = df.filter((x >= lo) & (x <= hi)).select(which.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def latency(df: DataFrame, key: str, ms: str) -> DataFrame:
    """n, mean, median, p95 and sample deviation by key; p95 is the value of rank floor(0.95 n), null for n < 2.

    Median and p95 are read off ranks over slices of the values, so no key's values are gathered.
    """
    own = df.select(key, F.col(ms).alias("_x")).filter(F.col("_x").isNotNull())
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.count(ms).alias("_known"), F.round(F.avg(ms), 6).alias("mean"), F.round(F.stddev_samp(ms), 6).alias("std"))
    rows = ranked(own, [key], [F.asc("_x")], ascending="_x").join(sums.select(key, "n", "_known"), key)
    n, rank = F.col("_known"), F.col("rank")
    middle = F.round((F.max(F.when(rank == F.floor((n + 1) / 2), F.col("_x"))) + F.max(F.when(rank == F.floor(n / 2) + 1, F.col("_x")))) / 2, 6)
    at = rows.groupBy(key).agg(middle.alias("median"), F.max(F.when(rank == F.floor(F.col("n") * F.lit(0.95)), F.col("_x"))).alias("p95"))
    return sums.join(at, key, "left").select(key, "n", "mean", "median", "p95", "std")
