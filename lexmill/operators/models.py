"""Node tables held against content models: an element's children in order run through the automaton of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, result_message
from lexmill.operators.pieces import text_pieces
from lexmill.sources.schema import ANY, Model

#: The attribute namespaces that validation leaves in place, the second as attributes are named in a node table.
KEPT_NAMESPACES = ["{http://www.tei-c.org/ns/1.0}", "xml:"]


def _map(pairs: list[tuple[Column, Column]], kind: str) -> Column:
    return F.create_map(*[x for p in pairs for x in p]) if pairs else F.create_map().cast(kind)


def content_errors(nodes: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, pre, tag, kind, place, name, message: where elements break the models; no rows for valid documents.

    kind: 'unknown' (no such element), 'child' (the child at place, from 1, may not come there), 'end' (children are missing after the last, at
    place), 'text' (text where none may be), 'attribute' (name is missing). Only the first wrong child of an element is told where the
    order counts, each where it doesn't. Where a name alone says whether a child may come, children are looked at one by one; the others
    are gathered by parent, in order.
    """
    free = [t for t, m in models.items() if m.free]
    known = nodes.where(F.col("tag").isin(*models)) if models else nodes.where("false")
    out = nodes.where(~F.col("tag").isin(*models)) if models else nodes
    out = out.select("doc_id", "pre", "tag", F.lit("unknown").alias("kind"), F.lit(None).cast("int").alias("place"), F.col("tag").alias("name"))
    kids = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("pre"), "sib", F.col("tag").alias("name"), F.try_element_at("path", F.lit(-2)).alias("tag"))
    loose = kids.where(F.col("tag").isin(*free)) if free else kids.where("false")
    table = _map([(F.lit(t), F.array(*[F.lit(n) for n in models[t].steps[0]]).cast("array<string>")) for t in free], "map<string,array<string>>")
    may = F.array_contains(F.element_at(table, F.col("tag")), F.col("name")) | F.array_contains(F.element_at(table, F.col("tag")), F.lit(ANY))
    out = out.unionByName(loose.where(~may).select("doc_id", "pre", "tag", F.lit("child").alias("kind"), (F.col("sib") + 1).cast("int").alias("place"), "name"))
    some = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("pre")).distinct()
    needy = [t for t in free if not models[t].final[0]]
    bare = known.where(F.col("tag").isin(*needy)).join(some, ["doc_id", "pre"], "left_anti") if needy else known.where("false")
    out = out.unionByName(bare.select("doc_id", "pre", "tag", F.lit("end").alias("kind"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("name")))
    strict = [t for t in models if t not in free]
    if strict:
        own = known.where(F.col("tag").isin(*strict)).select("doc_id", "pre", "tag")
        rows = kids.where(F.col("tag").isin(*strict)).groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("sib", "name"))), lambda s: s["name"]).alias("names"))
        rows = own.join(rows, ["doc_id", "pre"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        key = lambda tag, state, name: F.concat_ws(" ", tag, state.cast("string"), name)
        steps = _map([(F.lit(f"{t} {i} {n}"), F.lit(j)) for t in strict for i, s in enumerate(models[t].steps) for n, j in s.items()], "map<string,int>")
        final = F.array(*[F.lit(f"{t} {i}") for t in strict for i, ok in enumerate(models[t].final) if ok])
        start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("place"), F.lit(0).alias("wrong"))

        def step(at: Column, name: Column) -> Column:
            go = F.coalesce(F.try_element_at(steps, key(F.col("tag"), at["state"], name)), F.try_element_at(steps, key(F.col("tag"), at["state"], F.lit(ANY))))
            place = at["place"] + 1
            return F.when(at["wrong"] > 0, at).otherwise(F.struct(F.coalesce(go, at["state"]).alias("state"), place.alias("place"), F.when(go.isNull(), place).otherwise(0).alias("wrong")))

        ran = rows.withColumn("r", F.aggregate("names", start, step))
        bad = ran.where("r.wrong > 0").select("doc_id", "pre", "tag", F.lit("child").alias("kind"), F.col("r.wrong").alias("place"), F.get("names", F.col("r.wrong") - 1).alias("name"))
        short = ran.where((F.col("r.wrong") == 0) & ~F.array_contains(final, F.concat_ws(" ", "tag", F.col("r.state").cast("string"))))
        out = out.unionByName(bad).unionByName(short.select("doc_id", "pre", "tag", F.lit("end").alias("kind"), F.col("r.place").alias("place"), F.lit(None).cast("string").alias("name")))
    silent = [t for t, m in models.items() if not m.text]
    if silent:
        says = text_pieces(nodes).where(~is_blank(F.col("piece"))).select("doc_id", F.col("owner").alias("pre")).distinct()
        out = out.unionByName(known.where(F.col("tag").isin(*silent)).join(says, ["doc_id", "pre"], "left_semi").select("doc_id", "pre", "tag", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("name")))
    asked = [(t, a) for t, m in models.items() for a in m.required]
    if asked:
        table = _map([(F.lit(t), F.array(*[F.lit(a) for a in m.required])) for t, m in models.items() if m.required], "map<string,array<string>>")
        lacking = known.where(F.col("tag").isin(*{t for t, _ in asked})).select("doc_id", "pre", "tag", F.explode(F.array_except(F.element_at(table, F.col("tag")), F.map_keys("attrs"))).alias("name"))
        out = out.unionByName(lacking.select("doc_id", "pre", "tag", F.lit("attribute").alias("kind"), F.lit(None).cast("int").alias("place"), "name"))
    said = F.when(F.col("kind") == "unknown", F.concat(F.lit("no element "), "tag")).when(F.col("kind") == "child", F.concat(F.lit("element "), "name", F.lit(" not expected in "), "tag")).when(F.col("kind") == "end", F.concat(F.lit("children missing in "), "tag")).when(F.col("kind") == "text", F.concat(F.lit("text not expected in "), "tag")).otherwise(F.concat(F.lit("attribute "), "name", F.lit(" missing in "), "tag"))
    return out.withColumn("message", result_message(F.col("pre").cast("string"), F.coalesce("place", F.lit(0)).cast("string"), F.lit("ERROR"), F.col("kind"), said))


def without_foreign_attributes(nodes: DataFrame, kept: list[str] = KEPT_NAMESPACES) -> DataFrame:
    """The node table as validation sees it: attributes of a namespace stay only if their name begins with one of `kept`; plain ones all stay."""

    def stays(name: Column, _: Column) -> Column:
        out = ~name.contains(":")
        for k in kept:
            out = out | name.startswith(k)
        return out

    return nodes.withColumn("attrs", F.map_filter("attrs", stays))


def validated(nodes: DataFrame, models: dict[str, Model]) -> DataFrame:
    """content_errors() of the node table without foreign attributes."""
    return content_errors(without_foreign_attributes(nodes), models)
