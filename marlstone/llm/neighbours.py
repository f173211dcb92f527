"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors of length one are projected on CURVES random subspaces of DIMENSIONS
dimensions; each projection, shifted by its own offset, is a grid cell whose
place on a Hilbert curve is the vector's key.  Spark range-partitions all keys of
all curves at once, which ranks each vector on each curve, and a curve falls
into blocks of BLOCK vectors.  A query is compared with its own block and the
ones beside it on every curve; the best of all its windows meet.  While that still
raises the k-th best score of a query, its windows are made twice as wide, and only what is new in them
is looked at.  What is left is ranked again by the exact cosine.

So the work for a query depends on how well the curves keep its neighbours together, not on the number
of rows.  Data without structure in many dimensions has no order that does, and windows grow to a share of all rows there.

Vectors of one direction are searched as one and stand for all their rows afterwards, the
smallest vec_id first, however many they are.

Blocks hold vectors as bytes, a component each.  A vector's error is how far its bytes are from it, so two errors bound
what a cosine of bytes is off; whatever may be among the k best within that bound is ranked exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CURVES = 32
DIMENSIONS = 8
BITS = 7
#: Neighbours on a curve that are searched together.
BLOCK = 256
#: What a cosine in single precision may be off.
SLACK = 1e-5
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of cells, whole numbers of `bits` bits each.

    Gray code and rotations are undone from the highest bit down, as Skilling (2004) describes.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint64)
    k, zero = len(x), np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        low = q - np.uint64(1)
        for i in range(k):
            high = (x[i] & q) != 0
            x[0] ^= np.where(high, low, zero)
            swap = np.where(high, zero, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, k):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        flip ^= np.where((x[k - 1] & q) != 0, q - np.uint64(1), zero)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(k):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def _projections(dim: int, curves: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, curves, dimensions])
    axes = [np.linalg.qr(rng.normal(size=(dim, min(dim, dimensions))))[0] for _ in range(curves)]
    return np.stack(axes), rng.uniform(0, 1, size=(curves, min(dim, dimensions)))


def _usable(vector) -> np.ndarray | None:
    """The vector in double precision; None for one that is null, empty or zero, or holds a null, infinity or NaN."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _prepare(divisor: int):
    """Usable rows with a byte per component, the error of those, a digest of the direction and whether the row is a query."""

    def run(batches):
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.bool_())
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for vec, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = _usable(vector)
                if vec is None or v is None:
                    continue
                u = _unit(v)
                code = np.rint(u * (127 / np.abs(u).max())).astype(np.int8)
                rounded = code.astype(np.float64)
                off = float(np.linalg.norm(rounded / np.linalg.norm(rounded) - u))
                same = hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest()  # -0.0 becomes 0.0
                for column, x in zip(rows, (vec, v, len(v), code.tobytes(), off, same, vec % divisor == 0), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["vec_id", "vector", "dim", "code", "off", "same", "query"])

    return run


def _keys(curves: int, dimensions: int, bits: int):
    """A row for each vector and curve."""

    def run(batches):
        for batch in batches:
            dims, codes = np.array(batch.column("dim").to_pylist()), batch.column("code").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                u = np.frombuffer(b"".join(codes[k] for k in at), dtype=np.int8).reshape(len(at), dim).astype(np.float64)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                axes, shifts = _projections(dim, curves, dimensions)
                own = batch.take(pa.array(at))
                for t in range(curves):
                    spread = 3 / np.sqrt(dim)  # three standard deviations of a component in no special direction
                    y = np.clip((u @ axes[t] / spread + 1) / 2 * (1 - 1 / 8) + shifts[t] / 8, 0, 1 - 1e-9)
                    key = hilbert_keys((y * (1 << bits)).astype(np.int64), bits)
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()), pa.array(key), own.column("uid"), own.column("query"), own.column("code"), own.column("off")], ["dim", "curve", "key", "uid", "query", "code", "off"])

    return run


def _numbered(batches):
    """Rows as they come, with the partition and the place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "at"])
        at += n


def _best(k: int):
    """Of one block: for each query the rows that may be among its k of largest cosine, with the cosine of the bytes and what that may be off."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        queries, held = rows[asks], rows[~asks]
        if not len(queries) or not len(held):
            return pd.DataFrame({"query": [], "uid": [], "near": [], "off": []})
        units = []
        for part in (queries, held):
            x = np.frombuffer(b"".join(part["code"]), dtype=np.int8).reshape(len(part), -1).astype(np.float32)
            units.append(x / np.linalg.norm(x, axis=1, keepdims=True))
        asked, ids = queries["uid"].to_numpy(), held["uid"].to_numpy()
        ask_off, off = queries["off"].to_numpy(), held["off"].to_numpy() + SLACK
        out = []
        for start in range(0, len(asked), 512):
            near = units[0][start : start + 512] @ units[1].T
            near[asked[start : start + 512, None] == ids[None, :]] = -9
            # The query's own error is in all its bounds alike.
            least = np.partition(near - off, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k), None]
            i, j = np.nonzero((near + off >= least - 2 * ask_off[start : start + 512, None]) & (near > -8))
            out.append(pd.DataFrame({"query": asked[start + i], "uid": ids[j], "near": near[i, j].astype(np.float64), "off": ask_off[start + i] + off[j]}))
        return pd.concat(out)

    return run


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.dot(_unit(np.asarray(x)), _unit(np.asarray(y)))) for x, y in zip(a, b, strict=True)])


def _searched(placed: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query, uid, near, off): what may be among the k best of each query, of windows that widened while its k-th best still rose."""
    asks = placed.filter("query").drop("query")
    best = None
    least, reach = 0, 1
    while True:
        # Blocks at a distance of least to reach on either side; nearer ones were looked at.
        sides = F.array_distinct(F.concat(F.sequence(F.col("block") - reach, F.col("block") - least), F.sequence(F.col("block") + least, F.col("block") + reach)))
        asking = asks.select("dim", "curve", F.explode(sides).alias("block"), "uid", "code", "off", F.lit(True).alias("asks"))
        held = placed.drop("query").join(asking.select("dim", "curve", "block").distinct(), ["dim", "curve", "block"], "left_semi").withColumn("asks", F.lit(False))
        found = held.unionByName(asking).groupBy("dim", "curve", "block").applyInPandas(_best(k), "query long, uid long, near double, off double")
        if best is not None:
            found = found.unionByName(best.select("query", "uid", "near", "off"))
        found = found.groupBy("query", "uid").agg(F.max("near").alias("near"), F.max("off").alias("off"))
        found = found.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.col("near") - F.col("off")))))
        found = found.withColumn("kth", F.max(F.when(F.col("n") == k, F.col("near") - F.col("off"))).over(W.partitionBy("query")))
        found = common.stored(found.filter(F.col("kth").isNull() | (F.col("near") + F.col("off") >= F.col("kth"))).select("query", "uid", "near", "off", "kth"))
        now = found.groupBy("query").agg(F.max("kth").alias("kth"))
        open_ = now if best is None else now.join(best.groupBy("query").agg(F.max("kth").alias("before")), "query", "left").filter(F.col("kth").isNull() | F.col("before").isNull() | (F.col("kth") > F.col("before")))
        best = found
        # A query whose windows have not met any row yet is open too.
        rest = asks.join(open_.select(F.col("query").alias("uid")), "uid", "left_semi").unionByName(asks.join(now.select(F.col("query").alias("uid")), "uid", "left_anti"))
        if reach >= blocks or rest.limit(1).count() == 0:
            return best.select("query", "uid", "near", "off")
        asks = common.stored(rest)
        least, reach = reach + 1, 2 * reach + 1


def nearest(vectors: DataFrame, *, k: int = 5, divisor: int = 50, curves: int = CURVES, block: int = BLOCK, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is a multiple of divisor its k nearest others.

    vectors needs vec_id and embedding, an array of numbers.  Rows without a vec_id take no
    part, nor do vectors that are null, empty or zero or hold a null, NaN or infinity.
    Vectors are only compared with those of their own length.  Equal scores go to the smaller
    vec_id.  Rows that repeat a vec_id are rows of their own, each a candidate of the others.
    A query's windows grow until that finds nothing better, at most to all rows; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_prepare(divisor), "vec_id long, vector array<double>, dim int, code binary, off double, same binary, query boolean")
    rows = common.stored(usable.withColumn("uid", F.monotonically_increasing_id()))
    # A row for each direction, under the least uid; the vectors of a direction differ in length only.
    ways = common.stored(rows.groupBy("same").agg(F.min("uid").alias("uid"), F.first("dim").alias("dim"), F.first("code").alias("code"), F.first("off").alias("off"), F.max("query").alias("query")))
    dims = {r[0]: r[1] for r in ways.groupBy("dim").count().collect()}
    keyed = ways.select("dim", "code", "off", "uid", "query").mapInArrow(_keys(curves, dimensions, bits), "dim int, curve int, key long, uid long, query boolean, code binary, off double")
    total = sum(dims.values()) * curves
    parts = max(1, -(-total // 200_000), min(total // 20_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = keyed.repartitionByRange(parts, "dim", "curve", "key", "uid").sortWithinPartitions("dim", "curve", "key", "uid")
    dealt = common.stored(ranged.mapInArrow(_numbered, "dim int, curve int, key long, uid long, query boolean, code binary, off double, part int, at long"))
    # A row for each partition and curve: where its first row stands on the curve.
    runs = dealt.groupBy("dim", "curve", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("dim", "curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("dim", "curve", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = common.stored(dealt.join(runs, ["dim", "curve", "part"]).select("dim", "curve", F.floor((F.col("at") + F.col("shift")) / block).cast("long").alias("block"), "uid", "query", "code", "off"))
    found = _searched(placed, k, max((-(-n // block) for n in dims.values()), default=0)).select("query", "uid")

    # Directions by the exact cosine, each direction's own among them; then their rows: no more than k + 1 of one can be needed.
    asked = ways.filter("query").select(F.col("uid").alias("query"))
    vectors = ways.select("uid", "same").join(rows.select("uid", "vector"), "uid")
    scored = found.unionByName(asked.select("query", F.col("query").alias("uid"))).join(vectors.select("uid", F.col("same").alias("theirs"), F.col("vector").alias("b")), "uid")
    scored = scored.join(vectors.select(F.col("uid").alias("query"), "same", F.col("vector").alias("a")), "query").select("same", "theirs", _cosine("a", "b").alias("score"))
    first = F.row_number().over(W.partitionBy("same").orderBy("vec_id", "uid"))
    members = rows.select("same", "vec_id", "uid").withColumn("n", first).filter(F.col("n") <= k + 1).select(F.col("same").alias("theirs"), "vec_id", "uid")
    place = F.row_number().over(W.partitionBy("same").orderBy(F.desc("score"), "vec_id", "uid"))
    best = scored.join(members, "theirs").withColumn("place", place).filter(F.col("place") <= k + 1).select("same", "place", "vec_id", "uid", "score")
    listed = best.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("place", "uid", "vec_id", "score"))).alias("best"))
    answers = rows.filter("query").select("same", F.col("uid").alias("own"), F.col("vec_id").alias("query_id")).join(listed, "same")
    others = F.slice(F.filter("best", lambda x: x["uid"] != F.col("own")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, against all rows."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
