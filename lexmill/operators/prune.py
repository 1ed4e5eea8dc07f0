"""Leftover elements taken out of a node table: which of them may go, and the table without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, seamed
from lexmill.operators.assemble import allowed
from lexmill.operators.pieces import inner_text, text_pieces
from lexmill.operators.runs import in_runs
from lexmill.sources.store import stored

SCRAP = ["seg", "dictScrap"]
#: The output elements that may hold text of their own.
TEXTUAL = ["seg", "def", "orth", "gram", "dictScrap", "note", "gloss", "usg", "gramGrp"]


def strippable(nodes: DataFrame) -> DataFrame:
    """doc_id, pre of scrap elements that hold only scrap and text, where the element around may hold text or theirs is blank.

    These are what a bottom-up removal takes: scrap may hold text, so scrap within scrap always goes first. Document elements stay.
    """
    other = nodes.where(~F.col("tag").isin(SCRAP)).select("doc_id", F.explode("ancestors").alias("pre")).distinct()
    own = nodes.where(F.col("tag").isin(SCRAP) & F.col("parent").isNotNull()).join(other, ["doc_id", "pre"], "left_anti")
    free = F.try_element_at("path", F.lit(-2)).isin(TEXTUAL)
    blank = inner_text(nodes, own.where(~free)).where(is_blank(F.col("value")))
    return own.where(free).select("doc_id", "pre").unionByName(blank.select("doc_id", "pre"))


def thorough(nodes: DataFrame, level: int = 2) -> tuple[DataFrame, DataFrame]:
    """Which scrap a thorough clean-up takes, and the node table that it leaves for unwrapped(): (nodes, removed (doc_id, pre)).

    From the deepest level up: scrap goes if all children that it has by then may be children of the element around it, and that may hold
    text unless the scrap has only blanks. At level 3, scrap without children goes with its text too, unless it lies in xr. The document
    element stays. A round for each level of depth that has scrap; each moves the children and texts of what goes to the element around.
    """
    if level not in (2, 3):
        raise ValueError(f"level {level}")
    scrap = stored(nodes.where(F.col("tag").isin(SCRAP) & F.col("parent").isNotNull()).select("doc_id", "pre", "parent", "depth", F.try_element_at("path", F.lit(-2)).alias("around")))
    levels = sorted((r["depth"] for r in scrap.select("depth").distinct().collect()), reverse=True)  # no more than documents are deep
    kids = stored(nodes.where("parent is not null").select("doc_id", "pre", "tag", F.col("parent").alias("holder")))
    texts = stored(text_pieces(nodes).select("doc_id", "at", F.col("owner").alias("holder"), (~is_blank(F.col("piece"))).alias("says")))
    removed = emptied = None
    for depth in levels:
        own = scrap.where(F.col("depth") == depth).select("doc_id", F.col("pre").alias("holder"), "parent", "around")
        fits = kids.join(own, ["doc_id", "holder"]).groupBy("doc_id", "holder").agg(F.bool_and(allowed(F.col("tag"), F.col("around"))).alias("fit"))
        says = texts.join(own.select("doc_id", "holder"), ["doc_id", "holder"]).groupBy("doc_id", "holder").agg(F.bool_or("says").alias("says"))
        judged = own.join(fits, ["doc_id", "holder"], "left").join(says, ["doc_id", "holder"], "left")
        whole = F.lit(level == 3) & F.col("fit").isNull() & (F.col("around") != "xr")
        loose = F.coalesce("fit", F.lit(True)) & (F.col("around").isin(TEXTUAL) | ~F.coalesce("says", F.lit(False)))
        gone = stored(judged.withColumn("whole", whole).where(F.col("whole") | loose).select("doc_id", F.col("holder").alias("pre"), "parent", "whole"))
        removed = gone if removed is None else removed.unionByName(gone)
        to = gone.select("doc_id", F.col("pre").alias("holder"), F.col("parent").alias("to"), "whole")
        after = lambda rows: rows.join(to, ["doc_id", "holder"], "left")
        lost = after(texts).where("whole").select("doc_id", "at")
        emptied = lost if emptied is None else emptied.unionByName(lost)
        texts = stored(after(texts).where("whole is null or not whole").select("doc_id", "at", F.coalesce("to", "holder").alias("holder"), "says"))
        kids = stored(after(kids.join(gone.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti")).select("doc_id", "pre", "tag", F.coalesce("to", "holder").alias("holder")))
    if removed is None:
        return nodes, nodes.select("doc_id", "pre").where("false")
    blank = stored(emptied).withColumn("void", F.lit(True))
    left = nodes.join(blank.withColumnRenamed("at", "pre"), ["doc_id", "pre"], "left").withColumn("text", F.when(F.col("void"), "").otherwise(F.col("text"))).drop("void")
    left = left.join(blank.withColumnRenamed("at", "post"), ["doc_id", "post"], "left").withColumn("tail", F.when(F.col("void"), "").otherwise(F.col("tail"))).drop("void")
    return left.select(*nodes.columns), removed.select("doc_id", "pre")


def stripped(nodes: DataFrame, level: int = 1) -> DataFrame:
    """The node table after a clean-up of scrap: 0 none, 1 scrap without children, 2 and 3 as thorough() says."""
    if not level:
        return nodes
    if level == 1:
        return unwrapped(nodes, strippable(nodes))
    nodes = stored(nodes)
    return unwrapped(*thorough(nodes, level))


def unwrapped(nodes: DataFrame, removed: DataFrame, spaced: bool = True) -> DataFrame:
    """The node table without the removed elements (doc_id, pre): their children and text take their place, other rows keep pre and post.

    A document is a sequence of events (an element opens or ends), and text belongs to the last one before it of an element that
    stays; a document's events are dealt by ranges. Document elements stay. spaced: text that comes together is kept apart by a space.
    """
    gone = removed.select("doc_id", "pre").distinct().withColumn("gone", F.lit(True))
    marked = stored(nodes.join(gone, ["doc_id", "pre"], "left").withColumn("gone", F.col("gone").isNotNull() & F.col("parent").isNotNull()))
    event = lambda at, text: marked.select("doc_id", F.col(at).alias("at"), F.coalesce(text, F.lit("")).alias("piece"), F.when(~F.col("gone"), F.struct("pre", F.lit(text == "text").alias("inside"))).alias("slot"))
    events = in_runs(event("pre", "text").unionByName(event("post", "tail")).withColumnRenamed("slot", "own"), ["doc_id"], ["at"], last={"slot": F.col("own")})
    pieces = lambda inside: F.transform(F.array_sort(F.collect_list(F.when(F.col("slot.inside") == inside, F.struct("at", "piece")))), lambda s: s["piece"])
    join = seamed if spaced else (lambda x: F.array_join(x, ""))
    texts = events.groupBy("doc_id", F.col("slot.pre").alias("pre")).agg(join(pieces(True)).alias("text"), join(pieces(False)).alias("tail"))
    lost = marked.where("not gone").select("doc_id", "pre", F.explode("ancestors").alias("up")).join(marked.where("gone").select("doc_id", F.col("pre").alias("up")), ["doc_id", "up"])
    lost = lost.groupBy("doc_id", "pre").agg(F.collect_set("up").alias("lost"))  # as many as the element is deep
    kept = marked.where("not gone").drop("text", "tail", "gone").join(lost, ["doc_id", "pre"], "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<long>")))
    stays = lambda x, i: (i >= F.size("ancestors")) | ~F.array_contains("lost", F.get("ancestors", i))
    kept = kept.withColumn("path", F.filter("path", stays)).withColumn("ancestors", F.array_except("ancestors", "lost")).drop("lost")
    kept = kept.withColumn("parent", F.try_element_at("ancestors", F.lit(-1))).withColumn("depth", F.size("ancestors"))
    kept = in_runs(kept.drop("sib"), ["doc_id", "parent"], ["pre"], count="sib").withColumn("sib", (F.col("sib") - 1).cast("int"))
    return kept.join(texts, ["doc_id", "pre"]).select(*nodes.columns)
