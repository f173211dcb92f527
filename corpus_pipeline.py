"""A corpus pipeline over `documents`: each stage works on all that the one before kept.

Toxic documents go, one document of each class of near duplicates stays, documents
that hold benchmark passages go, personal data is replaced in the text, and what is
left is packed into sequences.  All stages but the last return the columns of
documents.  Each result is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, decontaminate, neardup, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model learnt from the labelled ones."""
    model = toxicity.fitted(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of least doc_id; rows that share it but not their text all stay."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    new = pii.redact(docs)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return new.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences: a row for each piece."""
    return packing.pack(common.stored(packing.tokenized(docs, *packing.paths())))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_pii),
    ("packing", pack_sequences),
]

#: None: neither compression distances nor alignments have a form in SQL; tests hold each stage against a plain version, and run them joined.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table of a data folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
