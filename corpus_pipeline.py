"""A corpus from raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import stored, table
from lexmill.llm.decontamination import decontaminated
from lexmill.llm.jaccard_join import one_of_each
from lexmill.llm.line_templates import deduplicated
from lexmill.llm.packing import packed_documents
from lexmill.llm.passages import without_shared_passages
from lexmill.llm.repetition import without_repetitive


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition limits reject go: among them null, empty and blank texts, whatever their id; repeated rows are judged alike."""
    return without_repetitive(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines, and lines that agree with a recurring template at most places, go from all documents but each template's first.

    Documents left without a word go too. Rows with a null doc_id or text, and columns of any name, stay as they are.
    """
    return deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard links connect, the document with the least doc_id stays; rows that repeat it, have a null doc_id or no words stay too."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters or more of a benchmark item go; items without text or id, and documents without them, are not compared."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of at most 1024 tokens, with one copy of the passages that these documents still share.

    Null and empty texts are their end token alone; null and repeated doc_ids are packed like others.
    """
    return packed_documents(stored(without_shared_passages(docs)))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("best_fit_packing", packing)]
#: Suffix arrays and a tokenizer's ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
