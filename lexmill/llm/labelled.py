"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learns, bound: int) -> DataFrame:
    """text and y of up to about `bound` labelled documents of each class, by a hash of doc_id.

    labels: doc_id and `label` (0 or 1; null: no label). learns: condition on doc_id for rows that may be learned from. The labels
    taken are at most 3 * bound rows for each class, which is what is broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learns)
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [own.where((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, counts.get(y, 0)))) < bound)).limit(3 * bound) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
