"""Splits by whole groups, seeded order, sessions and first-fit groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import kept

#: Groups that greedy_split folds in one task at most; splits are by scenes, sites or sources, not by rows.
MOST_GROUPS = 20_000


def seeded(key: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order of keys that every engine with MD5 can repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement in seeded order, or all if they are fewer."""
    return df.withColumn("_o", seeded(key, seed)).orderBy("_o", key).limit(n).drop("_o")


def sessions(df: DataFrame, key: str, order: list[str], seconds: str, gap: float) -> DataFrame:
    """df with a session number by key: a new one where the time to the row before is more than gap."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(seconds) - F.lag(seconds).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fraction_split(groups: DataFrame, key: str, train: float, val: float, seed: int = 42, order: Column | None = None) -> DataFrame:
    """groups with a split by seeded rank: round(n * train) of them, round(n * val), the rest test; halves to even."""
    n = groups.count()
    a, b = round(n * train), round(n * val)
    at = F.col("_rank")
    rows = ranked(groups.withColumn("_order", seeded(key, seed) if order is None else order), [], [F.asc("_order"), F.asc(key)], "_rank")
    return rows.withColumn("split", F.when(at <= a, "train").when(at <= a + b, "val").otherwise("test")).drop("_rank", "_order")


def file_split(files: DataFrame, key: str, val: float, seed: int = 42) -> DataFrame:
    """files with a split of their own, whatever group they belong to: round(n * val) of them in seeded order are val, the rest train."""
    return fraction_split(files, key, 0.0, val, seed).withColumn("split", F.when(F.col("split") == "val", "val").otherwise("train"))


def reserved_split(groups: DataFrame, held: DataFrame, key: str, train: float, val: float, seed: int = 42) -> DataFrame:
    """The groups of held are the test split; the others are shared out by train : val."""
    rest = groups.join(held.select(key), key, "left_anti")
    part = train / (train + val)
    return fraction_split(rest, key, part, 1 - part, seed).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("val")).unionByName(groups.join(held.select(key), key, "left_semi").withColumn("split", F.lit("test")))


def greedy_split(groups: DataFrame, key: str, size: str, test: float, val: float, seed: int = 42, order: Column | None = None) -> DataFrame:
    """key, size and split: largest groups first, each to the split it fits whose deficit is largest, else to train.

    A group fits if the deficit is positive and its size at most that plus a tenth of the
    target; equal deficits go to test.  One fold over the list of groups, in seeded order, of MOST_GROUPS at most.
    """
    if (n := groups.count()) > MOST_GROUPS:
        raise ValueError(f"{n} groups are more than one fold holds ({MOST_GROUPS})")
    order = seeded(key, seed) if order is None else order
    listed = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("o"), order.alias("r"), F.col(key).alias("k")))).alias("g"), F.sum(size).cast("double").alias("n"))
    fits = "(a.{0} > 0 AND -x.o <= a.{0} + 0.1D * {1})"
    to_test, to_val = fits.format("t", "tt"), fits.format("v", "vv")
    step = f"""aggregate(g, named_struct('t', tt, 'v', vv, 'out', cast(array() AS array<struct<k:string,o:bigint,split:string>>)), (a, x) ->
        CASE WHEN {to_test} AND (NOT {to_val} OR a.t >= a.v) THEN named_struct('t', a.t + x.o, 'v', a.v, 'out', concat(a.out, array(named_struct('k', cast(x.k AS string), 'o', cast(x.o AS bigint), 'split', 'test'))))
             WHEN {to_val} THEN named_struct('t', a.t, 'v', a.v + x.o, 'out', concat(a.out, array(named_struct('k', cast(x.k AS string), 'o', cast(x.o AS bigint), 'split', 'val'))))
             ELSE named_struct('t', a.t, 'v', a.v, 'out', concat(a.out, array(named_struct('k', cast(x.k AS string), 'o', cast(x.o AS bigint), 'split', 'train')))) END).out"""
    targets = listed.withColumn("tt", F.lit(float(test)) * F.col("n")).withColumn("vv", F.lit(float(val)) * (F.col("n") - F.col("tt")))
    return targets.selectExpr(f"inline({step})").select(F.col("k").alias(key), (-F.col("o")).alias(size), "split")


#: Items that one fold of first_fit holds.
FOLD = 256


def first_fit(items: DataFrame, threshold: float, fold: int = FOLD) -> DataFrame:
    """id and rep: each item joins the first group, in order of founding, whose founder correlates above threshold, or founds one.

    items: (id, v) with vectors of length one, an id a row; rows without an id take no part.
    A fold in order of id over the first `fold` items gives the first founders; all later
    items are held against those, and the ones that join none begin again.  Founders of a later
    fold come later in order of id, so the first that fits is the same as one by one.
    """
    step = f"""aggregate(g, named_struct('reps', slice(g, 1, 0), 'out', cast(array() AS array<struct<id:bigint,rep:bigint>>)), (a, x) ->
        aggregate(a.reps, cast(NULL AS bigint), (f, r) -> coalesce(f, if(aggregate(zip_with(r.v, x.v, (p, q) -> p * q), 0D, (s, y) -> s + y) > {threshold!r}D, r.id, NULL)),
          f -> if(f IS NULL, named_struct('reps', concat(a.reps, array(x)), 'out', concat(a.out, array(named_struct('id', x.id, 'rep', x.id)))),
                             named_struct('reps', a.reps, 'out', concat(a.out, array(named_struct('id', x.id, 'rep', f)))))))"""
    joined = f"aggregate(a.reps, cast(NULL AS bigint), (f, r) -> coalesce(f, if(aggregate(zip_with(r.v, v, (p, q) -> p * q), 0D, (s, y) -> s + y) > {threshold!r}D, r.id, NULL)))"
    left = items.select(F.col("id").cast("long").alias("id"), "v").filter("id IS NOT NULL")
    done = None
    while True:
        last = left.select("id").orderBy("id").limit(fold).agg(F.max("id")).first()[0]
        if last is None:
            return left.select("id", F.col("id").alias("rep")) if done is None else done
        folded = kept(left.filter(F.col("id") <= last).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("g")).selectExpr(f"{step} AS a"))
        later = kept(left.filter(F.col("id") > last).crossJoin(F.broadcast(folded)).selectExpr("id", "v", f"{joined} AS rep"))
        out = folded.selectExpr("inline(a.out)").unionByName(later.filter("rep IS NOT NULL").select("id", "rep"))
        done = out if done is None else done.unionByName(out)
        left = later.filter("rep IS NULL").select("id", "v")
