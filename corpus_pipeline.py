"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
repeated passages go, and the rest is packed into sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read as the next stage's docs.
All but the last return the columns of documents; n_chars follows the text. A stage's rules for nulls, empty texts,
ties and repeated rows are those of its operator; a document whose text goes wholly stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import line_dedup, near_dup, packing, passages, toxicity
from tracelens.llm.common import discard, saved, ship, table
from tracelens.llm.queries import tokenizer_path


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out_col="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of runs of three lines."""
    ship(spark)
    return _same_columns(line_dedup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near-duplicates."""
    ship(spark)
    found = near_dup.near_duplicates(docs)
    gone = saved(found.where("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of passages of 50 words or more."""
    ship(spark)
    return _same_columns(passages.dedup_passages(docs), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("passage_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL can't express the classifier, the tokeniser or the packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        given, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(given)
    return docs
