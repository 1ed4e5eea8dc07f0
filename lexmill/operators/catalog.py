"""Stored entries, datasets, mappings and errors as tables: lookups, pages, searches and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.runs import in_runs
from lexmill.operators.sequences import places


def datasets_with_mappings(datasets: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every dataset with its mappings; display is dataset/mapping."""
    joined = datasets.join(mappings.withColumnRenamed("name", "mapping"), "dsid", "left")
    return joined.withColumn("display", F.concat_ws("/", "name", "mapping"))


def newest(rows: DataFrame, time: str, ascending: bool = False) -> DataFrame:
    return rows.orderBy(F.col(time).asc() if ascending else F.col(time).desc())


def entry_page(entries: DataFrame, page: int, order: list[str], size: int = 100) -> DataFrame:
    """A page of the entries in an order without ties, counted from 1; a page past the end is the last one, and so is one below 1.

    Entries get their places by ranges, so no task reads all pages before.
    """
    n = entries.count()
    last = max(1, -(-n // size))
    page = page if 1 <= page <= last else last
    return places(entries, order).where(F.col("place").between((page - 1) * size + 1, page * size)).orderBy("place").drop("place")


def page_after(entries: DataFrame, order: list[str], last: list, size: int = 100) -> DataFrame:
    """The entries that follow the one whose `order` columns have the values of `last`, at most `size`; an empty list begins at the first.

    A reader who turns pages needs no places: each task keeps `size` rows.
    """
    if last:
        entries = entries.where(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last)]))
    return entries.orderBy(*order).limit(size)


def prefix_search(entries: DataFrame, column: str, prefix: str, order: list[str], top: int = 100) -> DataFrame:
    """The first `top` entries whose text begins with `prefix`, taken literally."""
    return entries.where(F.col(column).startswith(prefix)).orderBy(*order).limit(top)


def without_dataset(table: DataFrame, dsids: DataFrame) -> DataFrame:
    """What remains of a table when datasets are deleted."""
    return table.join(dsids.select("dsid").distinct(), "dsid", "left_anti")


def remapped(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """rows with a column translated by table (original, mapped), values that it lacks unchanged."""
    one = table.groupBy("original").agg(F.min("mapped").alias("mapped"))
    return rows.join(one, rows[column] == one["original"], "left").withColumn(column, F.coalesce("mapped", column)).drop("original", "mapped")


def refreshed_map(values: DataFrame, old: DataFrame) -> DataFrame:
    """original, mapped for the values met now, keeping what the old map has for them; new ones map to themselves."""
    now = values.select(F.col("value").alias("original")).distinct()
    return now.join(old.select("original", F.col("mapped").alias("kept")), "original", "left").select("original", F.coalesce("kept", "original").alias("mapped"))


def headword_or_number(entries: DataFrame, order: list[str], key: str) -> DataFrame:
    """entries with entry_text: the headword, or 'Entry <n>', n the place among its key's entries from 0; a key's entries are numbered by many tasks."""
    n = F.col("place__") - 1
    return in_runs(entries, [key], order, count="place__").withColumn("entry_text", F.coalesce("headword", F.concat(F.lit("Entry "), n.cast("string")))).drop("place__")


def first_entries(entries: DataFrame, n: int, order: list[str], key: str = "doc_id") -> DataFrame:
    """The first n entries of each document, exactly n where it has as many; tasks keep n of a key before the shuffle."""
    return entries.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= n).drop("k")


def errors_with_datasets(errors: DataFrame, datasets: DataFrame) -> DataFrame:
    """Logged errors with their dataset's columns; errors of no known dataset are left out."""
    return errors.join(datasets, "dsid")


def entries_of_file(entries: DataFrame, files: DataFrame, key: str, file_key: str) -> DataFrame:
    """Entries with their file's columns, where one side keeps the file's id as text and the other as a number; what isn't a number meets nothing."""
    text = lambda c: F.try_to_number(F.trim(F.col(c).cast("string")), F.lit("9" * 19)).cast("long")
    return entries.withColumn("file__", text(key)).join(files.withColumn("file__", text(file_key)), "file__").drop("file__")


def stored_values(known: DataFrame, element: str, attribute: str | None, found: DataFrame) -> DataFrame:
    """element, attribute, value, n: the list of values kept for an element and attribute, or, where `known` has none for them, the one found now.

    found: value, n of discover.value_inventory(); it is not computed where a list is kept.
    """
    own = known.where((F.col("element") == element) & F.col("attribute").eqNullSafe(F.lit(attribute)))
    if not own.isEmpty():
        return own.select("element", "attribute", "value", "n")
    return found.select(F.lit(element).alias("element"), F.lit(attribute).cast("string").alias("attribute"), "value", "n")


def graph_of(graphs: DataFrame, dsid: int) -> DataFrame:
    """tag, parents, children of one dataset's stored tag graph; no rows for an unknown one."""
    return graphs.where(F.col("dsid") == dsid).select("tag", "parents", "children")
