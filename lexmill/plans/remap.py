"""A TEI dictionary whose parts of speech are remapped and whose entries and senses get new identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators.pieces import inner_text
from lexmill.operators.runs import in_runs
from lexmill.operators.select import select
from lexmill.sources.store import stored

#: Where the old identifier is kept.
OLD_ID = "xml:orig_id"


def remapped_pos(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """The node table with the text of gram[@type='pos'] under gramGrp looked up in table (original, mapped); @orig keeps the trimmed old text.

    What the table lacks stays; a gram without text has 'pos' as @orig. Repeated originals: the least mapped value.
    """
    one = table.groupBy(strip(F.col("original")).alias("key__")).agg(F.min(strip(F.col("mapped"))).alias("mapped__"))
    own = (F.col("tag") == "gram") & (F.col("attrs")["type"] == "pos") & (F.try_element_at("path", F.lit(-2)) == "gramGrp")
    key = F.when(own, strip(F.coalesce("text", F.lit(""))))
    joined = nodes.withColumn("key__", key).join(one, "key__", "left")
    old = F.when(F.col("key__") == "", F.lit("pos")).otherwise(F.col("key__"))
    attrs = F.when(F.col("key__").isNotNull(), F.map_concat(F.map_filter("attrs", lambda k, v: k != "orig"), F.create_map(F.lit("orig"), old))).otherwise(F.col("attrs"))
    return joined.withColumn("attrs", attrs).withColumn("text", F.coalesce("mapped__", "text")).select(nodes.columns)


def _renamed(attrs: Column, new: Column) -> Column:
    kept = F.map_filter(attrs, lambda k, v: ~k.isin("xml:id", OLD_ID))
    old = F.try_element_at(attrs, F.lit("xml:id"))
    return F.map_concat(kept, F.when(old.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit(OLD_ID), old)), F.create_map(F.lit("xml:id"), new))


def new_identifiers(nodes: DataFrame, acronym: str = "ACRO") -> DataFrame:
    """The node table with xml:id ACRONYM_headword_n_pos for each entry and the same with _k for each sense in it; old ids go to xml:orig_id.

    n counts a document's entries, k an entry's senses (of nested entries, the innermost's). The headword is the first orth in a form, the part of
    speech the first gram in a gramGrp; without one they are '' and 'pos'.
    """
    own = select(nodes, ".//entry").drop("ctx")
    keys = stored(in_runs(own.select("doc_id", "pre"), ["doc_id"], ["pre"], count="n").withColumnRenamed("pre", "entry"))
    def first(path: str, name: str) -> DataFrame:
        found = select(nodes, path, own)
        texts = inner_text(nodes, found, False).join(found.select("doc_id", "pre", "ctx"), ["doc_id", "pre"])
        return texts.groupBy("doc_id", F.col("ctx").alias("entry")).agg(F.min_by("value", "pre").alias(name))

    named = keys.join(first(".//form/orth", "hw"), ["doc_id", "entry"], "left").join(first(".//gramGrp/gram", "pos"), ["doc_id", "entry"], "left")
    pos = F.when(F.coalesce("pos", F.lit("")) == "", "pos").otherwise(F.col("pos"))
    named = stored(named.select("doc_id", "entry", F.concat_ws("_", F.lit(acronym), F.coalesce("hw", F.lit("")), F.col("n").cast("string"), pos).alias("id__")))
    senses = nodes.where("tag = 'sense'").select("doc_id", "pre", F.explode("ancestors").alias("entry")).join(keys, ["doc_id", "entry"]).groupBy("doc_id", "pre").agg(F.max("entry").alias("entry"))
    senses = in_runs(senses, ["doc_id", "entry"], ["pre"], count="k").join(named, ["doc_id", "entry"]).select("doc_id", "pre", F.concat_ws("_", "id__", F.col("k").cast("string")).alias("id__"))
    ids = named.withColumnRenamed("entry", "pre").unionByName(senses)
    joined = nodes.join(ids, ["doc_id", "pre"], "left")
    return joined.withColumn("attrs", F.when(F.col("id__").isNull(), F.col("attrs")).otherwise(_renamed(F.col("attrs"), F.col("id__")))).select(nodes.columns)
