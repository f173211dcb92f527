"""What the operators of this package share: reading tables, cutting lineage,
the word rule and state that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import kept as stored

__all__ = ["bounded_batches", "encoded", "of_kind", "stored", "table", "words", "worker_state"]

#: Rows in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000

_LETTERS = bytes(range(0x41, 0x5B))
_GAPS = bytes(sorted({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}))
#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
WORD_TABLE = bytes.maketrans(_LETTERS + _GAPS, _LETTERS.lower() + b" " * len(_GAPS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, read by Spark alone."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def encoded(text: str | None) -> bytes:
    """UTF-8; lone surrogates, which Spark cannot hold, would become question marks."""
    return (text or "").encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and any non-ASCII characters."""
    return encoded(text).translate(WORD_TABLE).split()


def worker_state() -> types.ModuleType:
    """A module that lives as long as the Python worker, for caches that later tasks reuse."""
    return sys.modules.setdefault("_marlstone_worker", types.ModuleType("_marlstone_worker"))


def of_kind(kind: str):
    """A condition for spans, by kind."""
    return lambda x: x["kind"] == kind
