"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, join_ids, stored, words_of

WIDTH = 5
#: Sketches of up to so many rows (16 bytes each) are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _codes(words: str, width: int) -> Column:
    """The 64-bit codes of all runs of `width` words."""
    nothing = F.array().cast("array<long>")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, runs).otherwise(nothing)


def item_sets(items: DataFrame) -> DataFrame:
    """item_id, width, codes (distinct) of each item that has words; one of fewer than five words is one run of that width."""
    words = items.select(F.col("item_id").cast("long"), words_of(ascii_lower(F.col("text").cast("string"))).alias("w")).where("size(w) > 0 and item_id is not null")
    codes = F.when(F.size("w") >= WIDTH, _codes("w", WIDTH)).otherwise(F.array(F.xxhash64("w")))
    return words.select("item_id", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), F.array_sort(F.array_distinct(codes)).alias("codes"))


def _needed(n: Column, percent: int) -> Column:
    """The least count that is `percent` of n or more."""
    return F.floor((n * percent + 99) / 100)


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """Each item's least hash values, as many as its size partition asks for.

    Partitions are powers of two of the set size n. A document that holds at least c, `percent` of n, of the set lacks at most
    the rest, so of the n - c + 1 least values it holds one at least: the search misses nothing. A
    partition's sketch size is that of its largest member.
    """
    n = F.size("codes")
    sized = sets.withColumn("part", F.floor(F.log2(n)))
    most = sized.groupBy("part").agg(F.max(n - _needed(n, percent) + 1).alias("k"))
    return sized.join(F.broadcast(most), "part").select("set_id", F.explode(F.slice("codes", 1, F.col("k").cast("int"))).alias("code"))  # 31 partitions at most


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found for each document that holds `percent` or more of an item's distinct word shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A-Z are lower-cased, words are cut at ASCII white space.
    Null, empty and blank texts hold nothing and are held by nothing, rows without an id are not reported. Rows that repeat an id, as
    documents or items, are each compared; of those that reach `percent`, the pair with the most found counts, of equals the one
    with the larger item. Documents aren't shuffled by the search: their codes under the sketches' largest value are
    looked up, and only documents with a candidate are read for the exact check.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    sets = stored(item_sets(items).withColumn("set_id", F.monotonically_increasing_id()))
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect())  # 1 to 5
    sketch = stored(sketches(sets, percent))
    about = sketch.agg(F.count("*").alias("n"), F.max("code").alias("top")).first()
    words = docs.select("doc_id", words_of(ascii_lower("text")).alias("w"))
    codes = F.concat(*[_codes("w", k) for k in widths]) if widths else F.array().cast("array<long>")
    low = words.select("doc_id", F.explode(F.filter(codes, lambda c: c <= F.lit(about["top"] or 0))).alias("code"))
    pairs = stored(low.join(F.broadcast(sketch) if about["n"] <= BROADCAST_ROWS else sketch, "code").select("doc_id", "set_id").distinct())

    own = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("row", F.xxhash64("text")).dropDuplicates(["doc_id", "row"])
    held = own.select("doc_id", "row", words_of(ascii_lower("text")).alias("w")).select("doc_id", "row", F.explode(F.array_distinct(codes)).alias("code"))
    parts = stored(sets.select("set_id", "item_id", F.size("codes").alias("n"), F.explode("codes").alias("code")))
    of_items = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    found = held.join(of_items, "code").groupBy("doc_id", "row", "item_id", "set_id", "n").agg(F.count("*").alias("m")).where(F.col("m") >= _needed(F.col("n"), percent))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("m").alias("n_found"), F.col("n").cast("long").alias("n_shingles"))).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_found")


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """docs without those that hold `percent` or more of an item, with all their columns; rows with a null doc_id stay."""
    return join_ids(docs, contaminated(docs, items, percent).select("doc_id").distinct(), "left_anti")
