"""The character data of a node table: pieces of text, their places in the elements around them, and spans of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_pieces(nodes: DataFrame) -> DataFrame:
    """doc_id, at, owner, piece, around: each run of text, the tick after which it stands, the element that holds it, and all that do, outermost first."""
    head = nodes.where("text <> ''").select("doc_id", F.col("pre").alias("at"), F.col("pre").alias("owner"), F.col("text").alias("piece"), F.concat("ancestors", F.array("pre")).alias("around"))
    tail = nodes.where("tail <> '' and parent is not null").select("doc_id", F.col("post").alias("at"), F.col("parent").alias("owner"), F.col("tail").alias("piece"), F.col("ancestors").alias("around"))
    return head.unionByName(tail)


def inner_text(nodes: DataFrame, of: DataFrame, recursive: bool = True) -> DataFrame:
    """doc_id, pre, value: an element's own text and its children's tails, or all text inside it, in document order.

    Pieces of text join the elements around them by (doc_id, pre); a group holds one element's pieces.
    """
    wanted = of.select("doc_id", "pre").distinct()
    joined = _held(nodes, wanted, recursive)
    text = joined.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x")).select("doc_id", "pre", F.array_join(F.transform("x", lambda s: s["piece"]), "").alias("value"))
    return wanted.join(text, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("value", F.lit("")).alias("value"))


def _held(nodes: DataFrame, of: DataFrame, recursive: bool) -> DataFrame:
    holders = F.col("around") if recursive else F.array("owner")
    return text_pieces(nodes).select("doc_id", "at", "piece", F.explode(holders).alias("pre")).join(of.select("doc_id", "pre").distinct(), ["doc_id", "pre"])


def offsets(nodes: DataFrame, of: DataFrame, recursive: bool = True) -> DataFrame:
    """doc_id, pre, at, lo, hi: which characters of an element's inner text each of its pieces is, from lo up to but not hi.

    Prefix sums of the pieces' lengths within the element; a task sorts the pieces of one element at a time.
    """
    size, before = F.length("piece"), Window.partitionBy("doc_id", "pre").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return _held(nodes, of, recursive).withColumn("lo", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")).select("doc_id", "pre", "at", "lo", (F.col("lo") + size).alias("hi"))


def spans_in_pieces(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (doc_id, pre, recursive, start, end of an element's inner text) as doc_id, at, lo, hi of pieces, with the spans' other columns.

    An element's spans meet its own pieces alone, so a span becomes as many rows as it has pieces; empty spans none.
    """
    rest = [c for c in spans.columns if c not in ("doc_id", "pre", "recursive", "start", "end")]
    out = None
    for deep in (True, False):
        own = spans.where(F.col("recursive") == deep)
        met = own.join(offsets(nodes, own, deep), ["doc_id", "pre"]).where("start < hi and lo < end")
        one = met.select("doc_id", "at", (F.greatest("start", "lo") - F.col("lo")).alias("lo"), (F.least("end", "hi") - F.col("lo")).alias("hi"), *rest)
        out = one if out is None else out.unionByName(one)
    return out


def segments(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, at, off, piece, taken, owner, around: every piece cut where spans (doc_id, at, lo, hi) begin and end.

    In the order of (at, off) the segments are the document's text; taken ones lie in a span. A piece's spans are merged in one row.
    """
    by = spans.where("lo < hi").groupBy("doc_id", "at").agg(F.array_sort(F.collect_set(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))).alias("cuts"))
    pieces = text_pieces(nodes).join(by, ["doc_id", "at"], "left")
    part = lambda a, b, taken: F.struct(a.alias("off"), F.substring(F.col("piece"), (a + 1).cast("int"), (b - a).cast("int")).alias("piece"), F.lit(taken).alias("taken"))
    empty = F.array().cast("array<struct<off:bigint,piece:string,taken:boolean>>")
    start = F.struct(F.lit(0).cast("long").alias("done"), empty.alias("out"))

    def add(state: Column, cut: Column) -> Column:
        lo = F.greatest(state["done"], cut["lo"])
        free = F.when(lo > state["done"], F.array(part(state["done"], lo, False))).otherwise(empty)
        own = F.when(cut["hi"] > lo, F.array(part(lo, cut["hi"], True))).otherwise(empty)
        return F.struct(F.greatest(state["done"], cut["hi"]).alias("done"), F.concat(state["out"], free, own).alias("out"))

    whole = F.length("piece").cast("long")
    end = lambda state: F.concat(state["out"], F.when(state["done"] < whole, F.array(part(state["done"], whole, False))).otherwise(empty))
    cuts = F.coalesce("cuts", F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    return pieces.select("doc_id", "at", "owner", "around", F.explode(F.aggregate(cuts, start, add, end)).alias("s")).select("doc_id", "at", "s.off", "s.piece", "s.taken", "owner", "around")
