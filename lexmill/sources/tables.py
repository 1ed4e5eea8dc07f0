"""Dictionaries and maps that come as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import UNIVERSAL_POS


def read_dictionary(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV or (by its name) TSV dictionary with lemma, pos, definition and perhaps entry_id, sense_id.

    Quoted fields may hold line ends and doubled quotes, so one file is one task; give large dictionaries as several files.
    """
    rows = spark.read.csv(path, header=True, sep=sep or ("\t" if path.endswith(".tsv") else ","), multiLine=True, quote='"', escape='"')
    missing = {"lemma", "pos", "definition"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return rows


def dictionary_errors(rows: DataFrame) -> DataFrame:
    """error, value, n: parts of speech that aren't universal, sense ids that repeat, entry ids of several lemmas, lemmas of several entry ids."""
    wrong = rows.where(~F.upper("pos").isin(UNIVERSAL_POS)).groupBy(F.col("pos").alias("value")).agg(F.count("*").alias("n")).select(F.lit("pos").alias("error"), "value", "n")
    if "sense_id" in rows.columns:
        again = rows.where("sense_id is not null").groupBy(F.col("sense_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
        wrong = wrong.unionByName(again.select(F.lit("sense_id").alias("error"), "value", "n"))
    if "entry_id" in rows.columns:
        several = rows.where("entry_id is not null").groupBy(F.col("entry_id").alias("value")).agg(F.count_distinct("lemma").alias("n")).where("n > 1")
        wrong = wrong.unionByName(several.select(F.lit("entry_id").alias("error"), "value", "n"))
        split = rows.where("lemma is not null").groupBy(F.col("lemma").alias("value")).agg(F.count_distinct("entry_id").alias("n")).where("n > 1")
        wrong = wrong.unionByName(split.select(F.lit("lemma").alias("error"), "value", "n"))
    return wrong


def read_pos_map(spark: SparkSession, path: str) -> DataFrame:
    """original, mapped of a map file: the value is what follows a line's last comma, so the key may hold commas."""
    lines = spark.read.text(path).where("value <> 'original_pos,tei_pos'")
    return lines.select(F.regexp_extract("value", "^(.*),([^,]*)$", 1).alias("original"), F.regexp_extract("value", "^(.*),([^,]*)$", 2).alias("mapped")).where("original <> ''")


def repository_record(records: DataFrame) -> DataFrame:
    """id, title, creators, publisher, licence of metadata records (id, raw), by local names; '' where a record lacks one."""
    first = lambda name: F.xpath_string("raw", F.lit(f'//*[local-name()="{name}"]')).alias(name)
    names = [F.xpath("raw", F.lit(f'//*[local-name()="creator"]//*[local-name()="{n}"]/text()')) for n in ("firstName", "lastName")]
    people = F.zip_with(*names, lambda a, b: F.concat_ws(" ", a, b)).alias("creators")
    return records.select("id", first("title"), people, first("publisher"), first("licence"))


def write_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, its keys in order; null fields are left out."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_dictionary(rows: DataFrame, path: str) -> None:
    """CSV that read_dictionary() reads back: quoted fields with doubled quotes."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_levels(levels: dict[str, DataFrame], path: str) -> None:
    """A tagger's sequences, a folder of JSON lines for each level (level_1, ..., unlabelled): one sequence a line, with features and perhaps labels."""
    for name, rows in levels.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def read_levels(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The levels that write_levels() or a tagger wrote: features (lists of lists of text) and labels, null where a level has none."""
    schema = "features array<array<string>>, labels array<string>"
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name in names}
