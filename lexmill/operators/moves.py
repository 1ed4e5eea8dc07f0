"""Subtrees that move to another place of their document: adoption, legal parents, and wrappers, as joins on the node table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.assemble import PARENTS, allowed
from lexmill.operators.mapping import Mapping, adopted, found_all, leaves
from lexmill.sources.store import stored

MOVES = "doc_id long, within long, pre long, above array<long>, names array<string>, pos long, k long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("within", pa.int64()), ("pre", pa.int64()), ("above", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("pos", pa.int64()), ("k", pa.int64())])
#: Sorts after all children that stay.
LAST = 2**62


def _possible(pairs: list[tuple[int, int, list, list, list, list]]) -> Iterator[tuple[int, list[int], list[str]]]:
    """Of (adopter, adoptee, their chains from the root, their paths) in order: each adoptee that can move, with its new chain and path.

    An adopter inside its adoptee, as things stand after the moves before, can't adopt it, so there are no cycles.
    """
    parent, tag, moved = {}, {}, []
    for adopter, adoptee, chain_1, chain_2, path_1, path_2 in pairs:
        for chain, path in ((chain_1, path_1), (chain_2, path_2)):
            tag.update(zip(chain, path))
            for a, b in zip(chain, chain[1:]):
                parent.setdefault(b, a)
    up = lambda x: [x, *up(parent[x])] if x in parent else [x]
    for adopter, adoptee, *_ in pairs:
        if adopter not in up(adoptee) and adoptee not in up(adopter):
            parent[adoptee] = adopter
            moved.append(adoptee)
    for adoptee in moved:
        chain = up(parent[adoptee])[::-1]
        yield adoptee, chain, [tag[x] for x in chain]


def adoptions(nodes: DataFrame, pairs: DataFrame, scopes: DataFrame) -> DataFrame:
    """MOVES rows of adopted() pairs (doc_id, adoptee, adopter): adoptees become their adopter's last children, in document order.

    scopes: doc_id, pre of the elements within which adoption works (outermost entries); a pair whose two ends aren't in the same one is
    left out. The pairs of one scope are looked at together, in the adopters' order.
    """
    chains = nodes.select("doc_id", "pre", F.concat("ancestors", F.array("pre")).alias("chain"), "path")
    ends = pairs.join(chains.toDF("doc_id", "adopter", "chain_1", "path_1"), ["doc_id", "adopter"]).join(chains.toDF("doc_id", "adoptee", "chain_2", "path_2"), ["doc_id", "adoptee"])
    inside = ends.select("*", F.explode(F.array_intersect("chain_1", "chain_2")).alias("within")).join(scopes.select("doc_id", F.col("pre").alias("within")), ["doc_id", "within"])
    inside = inside.where("adoptee <> within").select("doc_id", "within", "adopter", "adoptee", "chain_1", "chain_2", "path_1", "path_2")

    def accept(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["adopter"], r["adoptee"]))
        first = rows[0]
        out = [(first["doc_id"], first["within"], pre, chain, names, LAST, k) for k, (pre, chain, names) in enumerate(_possible([(r["adopter"], r["adoptee"], r["chain_1"], r["chain_2"], r["path_1"], r["path_2"]) for r in rows]), 1)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return inside.groupBy("doc_id", "within").applyInArrow(accept, MOVES)


def adoptions_of(nodes: DataFrame, mapping: Mapping, own: DataFrame) -> DataFrame | None:
    """The moves that a mapping's adoptSelectors ask for within the outermost entries; None if it has none."""
    asking = [leaf for slot in mapping.slots.values() for leaf in leaves(slot) if leaf.get("adoptSelector")]
    if not asking:
        return None
    pairs = None
    for leaf in asking:
        adopters = found_all(nodes, [leaf], own).select("doc_id", "pre").distinct()
        one = adopted(nodes, leaf["adoptSelector"], adopters)
        pairs = one if pairs is None else pairs.unionByName(one)
    first = pairs.groupBy("doc_id", "adoptee").agg(F.min("adopter").alias("adopter"))
    return adoptions(nodes, first, own.where("is_top"))


def moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """The node table after the moves (MOVES rows), with was: the pre that a row had before.

    above and names are the new ancestors and their names; among their new parent's children, moved elements come by (pos, k, pre), as a
    child that stays has its own pre and 0. Each scope keeps its range of ticks, so nothing outside one changes. What stood after a moved element
    stays where it stood. A scope's elements are sorted by one task.
    """
    moves, given = stored(moves), nodes.columns
    chain = F.concat("ancestors", F.array("pre"))
    scopes = moves.select("doc_id", "within").distinct()
    inside = nodes.select("*", F.explode(chain).alias("within")).join(scopes, ["doc_id", "within"])
    roots = moves.select("doc_id", "within", F.col("pre").alias("root"), "above", "names")
    nearest = inside.select("doc_id", "within", "pre", F.explode(chain).alias("root")).join(roots, ["doc_id", "within", "root"]).groupBy("doc_id", "within", "pre").agg(F.max_by(F.struct("root", "above", "names"), "root").alias("r"))
    own = inside.join(nearest, ["doc_id", "within", "pre"], "left").withColumn("chain", chain)
    own = own.withColumn("from", F.array_position("chain", F.col("r.root")).cast("int"))
    rest = lambda c: F.slice(c, F.col("from"), F.size(c))
    own = own.withColumn("path", F.when(F.col("r").isNull(), F.col("path")).otherwise(F.concat("r.names", rest("path"))))
    own = own.withColumn("chain", F.when(F.col("r").isNull(), F.col("chain")).otherwise(F.concat("r.above", rest("chain")))).drop("r", "from")
    spots = moves.groupBy("doc_id", "within").agg(F.map_from_entries(F.collect_list(F.struct("pre", F.struct("pos", "k")))).alias("spots"))
    below = F.slice("chain", (F.array_position("chain", F.col("within")) + 1).cast("int"), F.size("chain"))
    place = lambda c: F.struct(F.coalesce(F.col("spots")[c]["pos"], c).alias("pos"), F.coalesce(F.col("spots")[c]["k"], F.lit(0)).alias("k"), c.alias("pre"))
    own = own.join(spots, ["doc_id", "within"]).withColumn("key", F.transform(below, place)).drop("spots")
    own = stored(own.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "within").orderBy("key")) - 1))
    held = own.select("doc_id", "within", F.explode("chain").alias("pre")).groupBy("doc_id", "within", "pre").agg(F.count("*").alias("held"))
    ticks = own.join(held, ["doc_id", "within", "pre"]).withColumn("new", F.col("within") + 2 * F.col("i") - F.size("key"))
    ticks = ticks.withColumn("post", F.when(F.col("pre") == F.col("within"), F.col("post")).otherwise(F.col("new") + 2 * F.col("held") - 1)).withColumn("new", F.when(F.col("pre") == F.col("within"), F.col("pre")).otherwise(F.col("new")))
    ticks = stored(ticks)
    names = ticks.select("doc_id", "within", F.col("pre").alias("up"), F.col("new").alias("up_new"))
    around = ticks.select("doc_id", "within", "pre", F.posexplode("chain").alias("at", "up")).join(names, ["doc_id", "within", "up"], "left")
    around = around.groupBy("doc_id", "within", "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("up_new", "up").alias("up")))), lambda s: s["up"]).alias("chain_new"))
    done = ticks.join(around, ["doc_id", "within", "pre"]).withColumn("ancestors", F.slice("chain_new", 1, F.size("chain_new") - 1))
    done = done.withColumn("parent", F.try_element_at("ancestors", F.lit(-1))).withColumn("depth", F.size("ancestors")).withColumn("was", F.col("pre")).withColumn("pre", F.col("new"))
    sib = F.when(F.col("was") == F.col("within"), F.col("sib")).otherwise(F.row_number().over(Window.partitionBy("doc_id", "within", "parent").orderBy("pre")) - 1)
    done = done.withColumn("sib", sib).drop("text", "tail").join(_texts(inside, moves), ["doc_id", "was"])
    others = nodes.join(inside.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti").withColumn("was", F.col("pre"))
    return done.select(*given, "was").unionByName(others.select(*given, "was"))


def _texts(inside: DataFrame, moves: DataFrame) -> DataFrame:
    """doc_id, was, text, tail: the text after a moved element goes to the sibling before it that stays, else to the parent's own text; the text
    after an element that others now follow comes after these."""
    gone = moves.select("doc_id", "pre", F.lit(True).alias("gone"))
    marked = inside.select("doc_id", "within", "pre", "parent", "text", "tail").join(gone, ["doc_id", "pre"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    touched = marked.where("gone").select("doc_id", "parent").distinct()
    beside = marked.join(touched, ["doc_id", "parent"], "left_semi").withColumn("to", F.last(F.when(~F.col("gone"), F.col("pre")), ignorenulls=True).over(Window.partitionBy("doc_id", "parent").orderBy("pre")))
    lost = beside.where("gone and tail <> ''").select("doc_id", F.coalesce("to", "parent").alias("pre"), F.col("to").isNull().alias("own"), F.struct(F.col("pre").alias("at"), F.col("tail").alias("piece")).alias("s"))
    joined = lambda own: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("own") == own, F.col("s")))), lambda s: s["piece"]), "")
    more = lost.groupBy("doc_id", "pre").agg(joined(True).alias("more_text"), joined(False).alias("more_tail"))
    out = marked.join(more, ["doc_id", "pre"], "left")
    tail = F.when(F.col("gone"), "").otherwise(F.concat(F.coalesce("tail", F.lit("")), F.coalesce("more_tail", F.lit(""))))
    out = out.select("doc_id", F.col("pre").alias("was"), F.concat(F.coalesce("text", F.lit("")), F.coalesce("more_text", F.lit(""))).alias("text"), tail.alias("tail"), "gone")
    heirs = moves.where(F.col("pos") < LAST).groupBy("doc_id", F.col("pos").alias("was")).agg(F.max(F.struct("k", "pre"))["pre"].alias("heir"))
    given = out.where("not gone").join(heirs, ["doc_id", "was"]).select("doc_id", F.col("heir").alias("was"), F.col("tail").alias("given"))
    out = out.join(heirs, ["doc_id", "was"], "left").join(given, ["doc_id", "was"], "left")
    return out.select("doc_id", "was", "text", F.when(F.col("heir").isNotNull() & ~F.col("gone"), "").otherwise(F.concat("tail", F.coalesce("given", F.lit("")))).alias("tail"))


def climbs(nodes: DataFrame) -> DataFrame:
    """MOVES rows that bring each element to its nearest ancestor that the content model allows as its parent; an entry takes anything.

    It comes right after the ancestor that kept it from there. Level by level from the top, an element's ancestors are those that its
    parent has got; the last allowed one wins. Elements without such an ancestor stay. Scopes are the documents' own elements.
    """
    slim = stored(nodes.select("doc_id", "pre", "parent", "depth", "tag"))
    deepest = slim.agg(F.max("depth")).first()[0] or 0
    node = F.struct("pre", "tag")
    level = slim.where("depth = 0").select("doc_id", "pre", F.col("pre").alias("within"), F.array(node).alias("chain"))
    out = None
    for depth in range(1, deepest + 1):
        up = level.select("doc_id", F.col("pre").alias("parent"), "within", F.col("chain").alias("above"))
        own = slim.where(F.col("depth") == depth).join(up, ["doc_id", "parent"])
        fits = F.transform("above", lambda x: (x["tag"] == "entry") | allowed(F.col("tag"), x["tag"]))
        own = own.withColumn("n", F.size("above") - F.coalesce(F.array_position(F.reverse(fits), F.lit(True)).cast("int"), F.lit(0)) + 1)
        own = own.withColumn("n", F.when(F.col("n") > F.size("above"), F.size("above")).otherwise(F.col("n")))  # none fits: stays
        own = own.withColumn("after", F.get("above", F.col("n"))["pre"]).withColumn("chain", F.concat(F.slice("above", 1, F.col("n")), F.array(node)))
        level = stored(own.select("doc_id", "pre", "within", "chain", "after"))
        one = level.where("after is not null")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return slim.sparkSession.createDataFrame([], MOVES)
    above = F.slice("chain", 1, F.size("chain") - 1)
    return out.select("doc_id", "within", "pre", F.transform(above, lambda x: x["pre"]).alias("above"), F.transform(above, lambda x: x["tag"]).alias("names"), F.col("after").alias("pos"), F.lit(1).cast("long").alias("k"))


def wrapped(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """The node table with a new element around each element of at (doc_id, pre, tag); what follows an element then follows its wrapper.

    Ticks are spread by a factor of 3, so that a wrapper's lie just before and after its element's; numbers keep their order.
    """
    around = at.groupBy("doc_id", "pre").agg(F.min("tag").alias("wrap"))
    marked = stored(nodes.join(around, ["doc_id", "pre"], "left"))
    wraps = marked.where("wrap is not null").select("doc_id", F.col("pre").alias("up"), "wrap")
    outer = marked.select("doc_id", "pre", F.posexplode("ancestors").alias("at", "up")).join(wraps, ["doc_id", "up"], "left")
    chain = F.array_sort(F.collect_list(F.struct("at", "up", "wrap")))
    outer = outer.groupBy("doc_id", "pre").agg(chain.alias("chain"))
    each = lambda plain, wrap: F.flatten(F.transform("chain", lambda s: F.when(s["wrap"].isNull(), F.array(plain(s))).otherwise(F.array(wrap(s), plain(s)))))
    spread = lambda c: c * 3 + 1
    names = F.transform("path", lambda x, i: x)
    joined = marked.join(outer, ["doc_id", "pre"], "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<struct<at:int,up:bigint,wrap:string>>")))
    joined = joined.withColumn("ancestors", each(lambda s: spread(s["up"]), lambda s: spread(s["up"]) - 1))
    joined = joined.withColumn("path", F.concat(each(lambda s: F.element_at(names, s["at"] + 1), lambda s: s["wrap"]), F.array("tag"))).drop("chain")
    joined = joined.withColumn("pre", spread(F.col("pre"))).withColumn("post", spread(F.col("post")))
    new = joined.where("wrap is not null").withColumn("pre", F.col("pre") - 1).withColumn("post", F.col("post") + 1).withColumn("tag", F.col("wrap")).withColumn("text", F.lit("")).withColumn("attrs", F.create_map().cast("map<string,string>"))
    new = new.withColumn("path", F.concat(F.slice("path", 1, F.size("path") - 1), F.array("wrap"))).withColumn("prefix", F.lit("")) if "prefix" in nodes.columns else new.withColumn("path", F.concat(F.slice("path", 1, F.size("path") - 1), F.array("wrap")))
    inner = F.col("wrap").isNotNull()
    own = joined.withColumn("ancestors", F.when(inner, F.concat("ancestors", F.array(F.col("pre") - 1))).otherwise(F.col("ancestors")))
    own = own.withColumn("path", F.when(inner, F.concat(F.slice("path", 1, F.size("path") - 1), F.array("wrap", "tag"))).otherwise(F.col("path"))).withColumn("tail", F.when(inner, "").otherwise(F.col("tail"))).withColumn("sib", F.when(inner, 0).otherwise(F.col("sib")))
    both = own.unionByName(new).withColumn("parent", F.try_element_at("ancestors", F.lit(-1))).withColumn("depth", F.size("ancestors"))
    return both.select(*nodes.columns)


#: What an element that an entry can't hold is put into there.
WRAPPERS = {"quote": "cit"}


def legalised(nodes: DataFrame) -> DataFrame:
    """The node table with every element where the content model allows it, if its document is an entry or lies in one.

    Names that the model doesn't have become seg, and a seg right under an entry dictScrap; then elements climb(), and what an entry can't
    hold itself is wrapped there. No text is lost or moved out of order within an element.
    """
    known = list(PARENTS)
    up = F.try_element_at("path", F.lit(-2))
    renamed = lambda tag, parent: F.when((tag == "seg") & (parent == "entry"), "dictScrap").otherwise(tag)
    plain = F.transform("path", lambda x: F.when(x.isin(known), x).otherwise("seg"))
    nodes = nodes.withColumn("path", plain)
    fixed = nodes.withColumn("path", F.transform("path", lambda x, i: renamed(x, F.get("path", i - 1)))).withColumn("tag", F.element_at("path", -1))
    lifted = moved(fixed, climbs(fixed)).drop("was")
    # what climbed to an entry may be a seg again
    lifted = lifted.withColumn("path", F.transform("path", lambda x, i: renamed(x, F.get("path", i - 1)))).withColumn("tag", F.element_at("path", -1))
    wrong = lifted.where((up == "entry") & ~allowed(F.col("tag"), F.lit("entry")))
    tag = F.lit("dictScrap")
    for child, wrapper in WRAPPERS.items():
        tag = F.when(F.col("tag") == child, wrapper).otherwise(tag)
    return wrapped(lifted, wrong.select("doc_id", "pre", tag.alias("tag")))
