"""Whole jobs: a dictionary to TEI Lex-0, tables to TEI, and the XML that driver tables stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import acronym, element, escaped
from lexmill.operators.assemble import leftover_owners, tei_entries
from lexmill.operators.catalog import first_entries
from lexmill.operators.mapping import Mapping, found, nearest, role_matches, taken_spans, with_languages
from lexmill.operators.moves import adoptions_of, moved
from lexmill.operators.pieces import inner_text, segments, spans_in_pieces
from lexmill.operators.select import around, entries, names_of, selected
from lexmill.operators.sequences import places
from lexmill.sources.store import stored


def dictionary_to_tei(nodes: DataFrame, mapping: Mapping, title: str = "dict", keep_scrap: bool = False, max_entries: int | None = None, datasets: DataFrame | None = None) -> DataFrame:
    """doc_id, entry, xml_id, headword, pos, n_senses, tei of every entry of a node table.

    Nested entries come as entries of their own, after the one around them, in document order, and what they hold is theirs alone.
    Selectors see the whole document, so paths that lead out of an entry are followed. What a mapping's adoptSelectors select moves with
    its matches under the adopter, so it comes after the adopter's match and in its sense. max_entries: of each document, only so many
    entries, the first ones; text of the others is nobody's. datasets: doc_id, dsid, if headwords are to be numbered in each dataset by itself.
    nodes are read many times: give a stored() table.
    """
    own = entries(nodes, mapping.entry)
    own = own if max_entries is None else first_entries(own, max_entries, ["pre"])
    own = nearest(nodes, own, found(nodes, mapping.slots["entry_lang"]), "lang") if "entry_lang" in mapping.slots else own.withColumn("lang", F.lit(None).cast("string"))
    own = stored(own)
    nested = own.where("not is_top")
    some = not nested.isEmpty()
    matches = with_languages(nodes, mapping, role_matches(nodes, mapping, own, chain=some))
    if some:
        deeper = stored(nested.select("doc_id", F.col("pre").alias("inner"), F.explode("ancestors").alias("entry")))  # few as a rule, and then a join with them deals out no matches
        inside = matches.join(deeper.select("doc_id", "entry").distinct(), ["doc_id", "entry"], "left_semi").select("doc_id", "entry", "pre", F.explode(F.concat("above", F.array("pre"))).alias("inner")).join(deeper, ["doc_id", "entry", "inner"]).select("doc_id", "entry", "pre").distinct()
        matches = matches.join(stored(inside), ["doc_id", "entry", "pre"], "left_anti")
    senses = selected(nodes, mapping.sense, own, names_of(mapping.entry)) if mapping.sense else own.where("false").withColumn("ctx", F.col("pre"))
    senses = senses.select("doc_id", F.col("ctx").alias("entry"), "pre", "post", around(names_of(mapping.sense)).alias("ancestors"))
    scrap = leftover(nodes, matches, own) if keep_scrap else None
    moves = adoptions_of(nodes, mapping, own)
    if moves is not None:
        now = moved(nodes, moves)
        at = stored(now.select("doc_id", F.col("was").alias("pre"), F.col("pre").alias("now"), F.col("post").alias("now_post"), F.col("ancestors").alias("now_above")))
        holder = at.select("doc_id", F.col("pre").alias("entry"), F.col("now").alias("now_entry"))
        there = lambda rows, *more: rows.drop("post", "ancestors").join(at.select("doc_id", "pre", "now", *more), ["doc_id", "pre"]).drop("pre").withColumnsRenamed({"now": "pre", "now_post": "post", "now_above": "ancestors"})
        within = lambda rows: rows.join(holder, ["doc_id", "entry"]).drop("entry").withColumnRenamed("now_entry", "entry")
        matches, senses, own = stored(within(there(matches.drop("above")))), within(there(senses, "now_post", "now_above")), there(own)
        scrap = None if scrap is None else within(scrap)
    return tei_entries(matches, own, senses, acronym(F.lit(title)), keep_scrap, scrap, datasets)


def leftover(nodes: DataFrame, matches: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, entry, at, off, piece: all text that no match takes, with the entry that keeps it.

    A match takes the characters of its element's text that it matched, wherever in the elements below they stand; matches of attributes
    and constants take none. Text in an entry is the innermost one's, text outside all goes as leftover_owners() says. Together with
    what the matches take this is all text of the documents that have entries.
    """
    rest = stored(segments(nodes, spans_in_pieces(nodes, taken_spans(matches))).where("not taken").select("doc_id", "at", "off", "piece", "around"))
    keys = own.select("doc_id", F.col("pre").alias("entry"))
    inside = rest.select("doc_id", "at", "off", F.explode("around").alias("entry")).join(keys, ["doc_id", "entry"]).groupBy("doc_id", "at", "off").agg(F.max("entry").alias("entry"))
    held = rest.join(inside, ["doc_id", "at", "off"], "left").select("doc_id", "entry", "at", "off", "piece")
    outside = leftover_owners(held.where("entry is null").drop("entry"), own).where("owner is not null")
    return held.where("entry is not null").unionByName(outside.select("doc_id", F.col("owner").alias("entry"), "at", "off", "piece"))


def tei_parts(nodes: DataFrame, entries: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, place, tei: whole TEI documents as pieces that follow each other by place.

    entries: doc_id, entry, tei of dictionary_to_tei(); headers: id (the doc_id), tei. A document without entries has all its text in one
    seg. A document stays many rows, so none is gathered in one task.
    """
    roots = nodes.where("parent is null").select("doc_id", "pre")
    opening = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0">'), F.coalesce("tei", F.lit("<teiHeader/>")), F.lit("<text><body>"))
    first = roots.select("doc_id").join(headers.select(F.col("id").alias("doc_id"), "tei"), "doc_id", "left").select("doc_id", F.lit(-1).cast("long").alias("place"), opening.alias("tei"))
    last = roots.select("doc_id", F.lit(2**63 - 1).alias("place"), F.lit("</body></text></TEI>").alias("tei"))
    bare = roots.join(entries.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = inner_text(nodes, bare).select("doc_id", F.lit(0).cast("long").alias("place"), element("seg", escaped(F.col("value"))).alias("tei"))
    return first.unionByName(entries.select("doc_id", F.col("entry").alias("place"), "tei")).unionByName(whole).unionByName(last)


def write_tei(parts: DataFrame, path: str) -> None:
    """A folder for each document; its files, in the order of their names, are the document, with a line for each piece."""
    parts.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "tei").write.mode("overwrite").partitionBy("doc_id").text(path)


def grouped_senses(rows: DataFrame) -> DataFrame:
    """lemma, pos, senses: rows (lemma, pos, definition) by entry, definitions in order and numbered from 1; null keys make no entry."""
    found_ = rows.where("lemma is not null and pos is not null").groupBy("lemma", "pos").agg(F.array_sort(F.collect_list("definition")).alias("senses"))
    return found_


def table_to_tei(rows: DataFrame) -> DataFrame:
    """lemma, pos, tei of a tabular dictionary; text is escaped."""
    senses = F.array_join(F.transform("senses", lambda d, i: F.concat(F.lit('<sense n="'), (i + 1).cast("string"), F.lit('">'), element("def", escaped(d)), F.lit("</sense>"))), "")
    form = F.concat(F.lit('<form type="lemma">'), element("orth", escaped(F.col("lemma"))), F.lit("</form><gramGrp>"), element("gram", escaped(F.col("pos")), type=F.lit("pos")), F.lit("</gramGrp>"))
    return grouped_senses(rows).select("lemma", "pos", element("entry", F.concat(form, senses)).alias("tei"))


def table_parts(rows: DataFrame, header: str = "<teiHeader/>") -> DataFrame:
    """doc_id (0), place, tei: a tabular dictionary as one TEI document in rows that follow each other by place, entries by lemma and part of speech.

    Entries are numbered by ranges, so no task holds them all; write_tei() writes them.
    """
    entries = places(table_to_tei(rows), ["lemma", "pos"]).select(F.col("place"), "tei")
    spark = rows.sparkSession
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0">' + header + "<text><body>"), (2**63 - 1, "</body></text></TEI>")]
    return entries.unionByName(spark.createDataFrame(frame, "place long, tei string")).select(F.lit(0).cast("long").alias("doc_id"), "place", "tei")


def batched(docs: DataFrame, key: Column, order: str, root: str) -> DataFrame:
    """doc_id, raw: rows (order, xml) put into documents by key."""
    each = docs.groupBy(key.alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "xml"))), lambda s: s["xml"]), "\n").alias("body"))
    return each.select("doc_id", F.concat(F.lit(f"<{root}>"), "body", F.lit(f"</{root}>")).alias("raw"))
