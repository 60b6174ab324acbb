"""The corpus pipeline: documents, cleaned and deduplicated, without personal data, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the folder
that all machines share and reads it again for the next one. All stages but the last return the columns of documents.
A stage works on every document that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.near_duplicates import first_of_each
from patchloom.llm.packing import pack_documents
from patchloom.llm.pii import mask_personal_data
from patchloom.llm.quality_rules import clean_documents
from patchloom.llm.queries import tokenizer_path
from patchloom.llm.saved import saved
from patchloom.llm.suffix_dedup import remove_repeats


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents in their order, with n_chars as long as the text is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    return _counted(clean_documents(docs, drop_lines=True), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those that share 80 % and more of their shingles are linked."""
    return first_of_each(docs, 80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that an earlier one holds too."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = remove_repeats(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row_rest")), with_text=True)
    return _counted(left.select("doc_id", "text", *[F.col(f"row_rest.`{c}`").alias(c) for c in rest]), docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _counted(mask_personal_data(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("pii", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
