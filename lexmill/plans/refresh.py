"""The table of all datasets' entries, of which a refresh rewrites only the datasets whose texts or mapping changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.catalog import headword_or_number
from lexmill.operators.mapping import Mapping
from lexmill.plans.dictionary import dictionary_to_tei
from lexmill.sources.store import deleted, exists, stored
from lexmill.sources.xml import shred

ENTRIES, MARKS = "entries", "fingerprints"


def fingerprints(docs: DataFrame, mappings: DataFrame) -> DataFrame:
    """dsid, spec, mark of each dataset with a mapping: mark changes with the mapping's text, and with any document's id or text.

    docs: dsid, doc_id, raw; mappings: dsid, spec (JSON), one for each dataset. The order of documents plays no part.
    """
    each = F.xxhash64("doc_id", "raw").cast("decimal(38,0)")
    texts = docs.groupBy("dsid").agg(F.count("*").alias("n"), F.sum(each).alias("s"), F.sum(F.crc32(F.coalesce("raw", F.lit("")))).alias("c"))
    return mappings.join(texts, "dsid", "left").select("dsid", "spec", F.sha2(F.concat_ws("|", "spec", F.col("n").cast("string"), F.col("s").cast("string"), F.col("c").cast("string")), 256).alias("mark"))


def refresh(docs: DataFrame, mappings: DataFrame, path: str, title: str = "dict") -> list[int]:
    """Brings path/entries (doc_id, entry, xml_id, headword, pos, n_senses, tei, entry_text; partitioned by dsid) up to date; the dsids touched.

    Datasets whose fingerprint is the stored one keep their files. The others' partitions are replaced as wholes, and those of datasets that have
    no entries or are gone are deleted. Headwords are numbered within a dataset; an entry without one is 'Entry n', from 0. doc_ids are
    unique across datasets. Fingerprints are written last, so a refresh that failed is done again. The driver holds the changed dsids
    and their distinct mappings.
    """
    spark = docs.sparkSession
    now = stored(fingerprints(docs, mappings))
    marks = f"{path}/{MARKS}"
    known = spark.read.parquet(marks) if exists(spark, marks) else now.select("dsid", "mark").where("false")
    known = stored(known.select("dsid", "mark"))
    changed = stored(now.join(known, ["dsid", "mark"], "left_anti"))
    gone = [r["dsid"] for r in known.join(now, "dsid", "left_anti").collect()]
    ids = [r["dsid"] for r in changed.select("dsid").collect()]
    filled: set[int] = set()
    for r in changed.select("spec").distinct().collect():
        own = docs.join(changed.where(F.col("spec") == r["spec"]).select("dsid"), "dsid")
        of = own.select("doc_id", "dsid")
        out = dictionary_to_tei(stored(shred(own)), Mapping.of(r["spec"]), title, datasets=of).join(of, "doc_id")
        rows = stored(headword_or_number(out, ["doc_id", "entry"], "dsid"))
        filled |= {x["dsid"] for x in rows.select("dsid").distinct().collect()}
        rows.repartition("dsid", F.pmod(F.xxhash64("doc_id", "entry"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dsid").parquet(f"{path}/{ENTRIES}")
    for dsid in {*ids, *gone} - filled:
        deleted(spark, f"{path}/{ENTRIES}/dsid={dsid}")
    if ids or gone:
        now.select("dsid", "mark").write.mode("overwrite").parquet(marks)
    return sorted({*ids, *gone})


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all datasets as the last refresh left them."""
    return spark.read.parquet(f"{path}/{ENTRIES}")
