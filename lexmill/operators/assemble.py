"""Entries as TEI Lex-0 markup: identifiers, order, leftover text, header and content-model checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import element, escaped, is_blank, name_safe, seamed, strip
from lexmill.operators.runs import in_runs
from lexmill.sources.store import stored

#: The parents that each output element may have.
PARENTS = {
    "seg": ("seg", "entry", "orth", "def", "gram", "cit", "dictScrap", "sense", "usg", "gloss", "note", "xr"),
    "ref": ("seg", "entry", "orth", "def", "gram", "cit", "dictScrap", "sense", "usg", "gloss", "note", "xr"),
    "def": ("sense", "dictScrap"),
    "orth": ("sense", "dictScrap", "entry", "form"),
    "gram": ("sense", "dictScrap", "entry", "gramGrp"),
    "cit": ("sense", "dictScrap", "entry", "cit", "seg", "usg", "gloss", "note", "xr"),
    "sense": ("sense", "dictScrap", "entry"),
    "entry": ("entry", "body"),
    "dictScrap": ("entry", "dictScrap"),
    "note": ("gloss", "cit", "note", "quote", "def", "dictScrap", "entry", "form", "gram", "gramGrp", "orth", "usg", "seg", "xr"),
    "gloss": ("cit", "gloss", "note", "quote", "def", "dictScrap", "form", "gram", "gramGrp", "orth", "sense", "usg", "seg", "xr"),
    "usg": ("dictScrap", "entry", "form", "gramGrp", "sense"),
    "xr": ("cit", "gloss", "note", "gram", "gramGrp", "def", "dictScrap", "entry", "orth", "sense", "xr", "seg"),
    "form": ("entry", "form"),
    "gramGrp": ("entry", "form", "sense"),
    "quote": ("cit",),
}


def allowed(tag: Column, parent: Column) -> Column:
    """Whether an output element may be a child of another; names that PARENTS lacks may not."""
    table = F.create_map(*[x for child, parents in PARENTS.items() for x in (F.lit(child), F.array(*[F.lit(p) for p in parents]))])
    return F.coalesce(F.array_contains(F.try_element_at(table, tag), parent), F.lit(False))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """n for rows (entry, hw, ...): the running number of the entry among those that show its headword, entries and senses together.

    Each pair of containing entry and headword counts once, where it is first met in document order (`order`). A headword that most entries
    share is numbered by many tasks.
    """
    place = F.struct(*order)
    firsts = rows.groupBy("entry", "hw").agg(F.min(place).alias("first"))
    n = in_runs(firsts, ["hw"], ["first", "entry"], count="n")
    return rows.join(n.select("entry", "hw", "n"), ["entry", "hw"])


def entry_identifier(acronym: Column, hw: Column, n: Column, pos: Column) -> Column:
    """ACR_headword_n_pos, with stand-ins for a missing headword or part of speech."""
    part = lambda c, other: F.when(is_blank(c), F.lit(other)).otherwise(name_safe(c))
    return F.concat_ws("_", acronym, part(hw, "headword"), n.cast("string"), part(pos, "pos"))


def sense_identifier(entry_id: Column, k: Column) -> Column:
    return F.concat_ws("_", entry_id, k.cast("string"))


#: Elements of one entry and name that a task counts; they are added up by buckets of hashes, all of a larger bucket are dealt by ranges.
LARGE, BUCKETS = 100_000, 1 << 20


def other_identifiers(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """nodes (entry_id, tag, doc_id, pre, own_id, ...) with xml_id: own_id where it is free, else entry_tag_k with the next free k.

    used: id, those of entries and senses. An own_id that several elements have is the first one's, in document order; a number is free if
    no id in `used` or kept here has it. Elements without an own_id (null) get a number too. Numbers are counted along each entry and
    name; the k-th free one lies as many further on as used ones come before it. nodes are read several times, and elements without an own_id
    shuffled once: give a table that is cheap to read. Those of an entry and name are counted in one task up to LARGE, larger groups by ranges.
    """
    taken = used.select(F.col("id").alias("own_id")).where("own_id is not null").distinct()
    owned = stored(nodes.where("own_id is not null"))
    firsts = owned.groupBy("own_id").agg(F.min(F.struct("doc_id", "pre")).alias("first")).join(taken, "own_id", "left_anti")
    keeps = stored(firsts.select("own_id", "first.doc_id", "first.pre").withColumn("keeps", F.lit(True)))
    marked = owned.join(keeps, ["own_id", "doc_id", "pre"], "left").select(*nodes.columns, "keeps")
    number = r"^(.*)_([1-9][0-9]{0,17})$"
    ids = taken.unionByName(keeps.select("own_id"))
    gaps = ids.where(F.col("own_id").rlike(number)).select(F.regexp_extract("own_id", number, 1).alias("stem"), F.regexp_extract("own_id", number, 2).cast("long").alias("u"))
    gaps = in_runs(gaps, ["stem"], ["u"], count="j").groupBy("stem").agg(F.array_sort(F.collect_list(F.col("u") - F.col("j"))).alias("gaps"))  # as many as an entry has of a name
    rest = nodes.where("own_id is null").unionByName(marked.where("keeps is null").drop("keeps")).withColumn("stem", F.concat_ws("_", "entry_id", "tag"))
    bucket = F.pmod(F.xxhash64("stem"), F.lit(BUCKETS))
    large = stored(rest.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("bucket"))  # a row for LARGE elements at most
    few = rest
    if not large.isEmpty():
        dealt = lambda how: rest.withColumn("bucket", bucket).join(F.broadcast(large), "bucket", how).drop("bucket")
        few, many = dealt("left_anti"), in_runs(dealt("left_semi"), ["stem"], ["doc_id", "pre"], count="k")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("doc_id", "pre")).cast("long"))
    counted = few.join(gaps, "stem", "left")  # dealt as for the window
    if not large.isEmpty():
        counted = counted.unionByName(many.join(gaps, "stem", "left"))
    k = F.col("k") + F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("k"))), F.lit(0))
    made = counted.select(*nodes.columns, F.concat_ws("_", "stem", k.cast("string")).alias("xml_id"))
    return marked.where("keeps").select(*nodes.columns, F.col("own_id").alias("xml_id")).unionByName(made)


def first_of_senses(matches: DataFrame, senses: DataFrame) -> DataFrame:
    """doc_id, entry, sense, headword, pos: the first of each in a sense, or, with a null sense, in the whole entry; null where there is none.

    matches: rows of role_matches with above; senses: doc_id, entry, pre. A match counts for every sense around it.
    """
    own = matches.where("role in ('hw', 'pos')").select("doc_id", "entry", "pre", "role", "final", F.concat("above", F.array("pre")).alias("chain"))
    held = own.select("*", F.explode("chain").alias("sense")).drop("chain").join(senses.select("doc_id", "entry", F.col("pre").alias("sense")), ["doc_id", "entry", "sense"])
    rows = held.unionByName(own.drop("chain").withColumn("sense", F.lit(None).cast("long")))
    empty = senses.select("doc_id", "entry", F.col("pre").alias("sense"))
    for name, kind in (("pre", "long"), ("role", "string"), ("final", "string")):
        empty = empty.withColumn(name, F.lit(None).cast(kind))
    first = lambda role: F.min_by("final", F.when(F.col("role") == role, F.col("pre")))
    return rows.unionByName(empty).groupBy("doc_id", "entry", "sense").agg(first("hw").alias("headword"), first("pos").alias("pos"))


def leftover_owners(pieces: DataFrame, entries: DataFrame) -> DataFrame:
    """Which entry keeps text outside all entries: pieces (doc_id, at, piece, ...), entries (doc_id, pre, post), both in document order.

    Text before the first entry goes to the first; other text to the entry that ended last before it, on its left. Adds owner and side.
    A document's pieces and ends of entries are dealt by ranges, so none is in one task.
    """
    rest = [c for c in pieces.columns if c not in ("doc_id", "at")]
    own = pieces.withColumn("place__", F.row_number().over(Window.partitionBy("doc_id", "at").orderBy("off")) if "off" in rest else F.lit(1))
    marks = entries.select("doc_id", F.col("post").alias("at"), F.lit(0).alias("place__"), F.col("pre").alias("mark__"))
    both = own.withColumn("mark__", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    found = in_runs(both, ["doc_id"], ["at", "place__"], last={"before__": F.col("mark__")}).where("place__ > 0")
    first = entries.groupBy("doc_id").agg(F.min("pre").alias("first__"))
    owned = found.join(first, "doc_id", "left")
    return owned.select("doc_id", "at", *rest, F.coalesce("before__", "first__").alias("owner"), F.when(F.col("before__").isNull(), "left").otherwise("right").alias("side"))


def role_markup(role: Column, final: Column, matched: Column, lang: Column) -> Column:
    """One match as output markup."""
    text = escaped(final)
    simple = lambda tag, **a: element(tag, text, **a)
    lit = F.lit
    cit = lambda kind: F.concat(lit(f'<cit type="{kind}">'), element("quote", text, xml__lang=lang), lit("</cit>"))
    form = lambda kind: F.concat(lit(f'<form type="{kind}">'), simple("orth"), lit("</form>"))
    out = F.when(role == "hw", form("lemma")).when(role == "sec_hw", form("simple")).when(role == "variant", form("variant")).when(role == "inflected", form("inflected"))
    out = out.when(role == "pos", F.concat(lit("<gramGrp>"), simple("gram", type=lit("pos"), orig=matched), lit("</gramGrp>")))
    out = out.when(role == "hw_tr", cit("translationEquivalent")).when(role == "ex", cit("example")).when(role == "ex_tr", cit("translation"))
    out = out.when(role == "usg", simple("usg", type=lit("hint"))).when(role == "xr", F.concat(lit('<xr type="related">'), simple("ref", type=lit("reference")), lit("</xr>")))
    return out.when(role == "def", simple("def")).when(role == "note", simple("note")).otherwise(simple("gloss"))


def senses_around(senses: DataFrame) -> DataFrame:
    """senses (doc_id, entry, pre, post, ancestors) with around: pre and post of the entry's other senses that one lies in, null if none. ancestors
    need hold only those elements that may be senses; where there is none, which one job looks up, nothing is joined."""
    key = ["doc_id", "entry"]
    inner = senses.select(*key, "pre", F.explode("ancestors").alias("up"))
    if inner.isEmpty():
        return senses.withColumn("around", F.lit(None).cast("array<struct<pre:bigint,post:bigint>>"))
    holders = senses.select(*key, F.col("pre").alias("up"), F.col("post").alias("end"))
    met = inner.join(holders, [*key, "up"]).groupBy(*key, "pre").agg(F.collect_list(F.struct(F.col("up").alias("pre"), F.col("end").alias("post"))).alias("around"))
    return senses.join(met, [*key, "pre"], "left")


def tei_entries(matches: DataFrame, entry_nodes: DataFrame, senses: DataFrame, acronym: Column, keep_scrap: bool = False, scrap: DataFrame | None = None, datasets: DataFrame | None = None) -> DataFrame:
    """doc_id, entry, xml_id, headword, pos, n_senses, tei: one row for each entry, nested ones too, each by itself.

    matches: rows of role_matches with lang; senses: doc_id, entry, pre, post, ancestors (those that may be senses). A match belongs to its nearest
    sense in the entry, if any; definitions outside get a sense of their own. Order is document order throughout. scrap: doc_id, entry, at, off,
    piece of text that no match took, which `keep_scrap` appends as dictScrap; blank pieces alone make none. datasets: doc_id, dsid, within which
    headwords are numbered. An entry's rows are dealt out once, and numbers come from entries and headwords alone.
    """
    key, role = ["doc_id", "entry"], F.col("role")
    final = F.struct("pre", "final")
    own = matches.select(*key, "pre", "rank", (role == "def").alias("loose"), F.when(role == "pos", final).alias("pos"), role_markup(role, F.col("final"), F.col("matched"), F.col("lang")).alias("markup"))
    marks = senses_around(stored(senses.select(*key, "pre", "post", "ancestors"))).select(*key, "pre", "post", "around")
    bare = entry_nodes.select("doc_id", F.col("pre").alias("entry"), "pre", "lang", F.lit(True).alias("bare"))
    rows = own.unionByName(marks, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True).repartition(*key)  # for all that follows
    up_to = Window.partitionBy(*key).orderBy("pre", "rank").rowsBetween(Window.unboundedPreceding, 0)  # a sense comes before its element's matches
    sense = F.col("post").isNotNull()
    rows = rows.withColumn("last", F.last(F.when(sense, F.struct("pre", "post", "around")), ignorenulls=True).over(up_to))
    begun = F.concat(F.array(F.struct("last.pre", "last.post")), F.coalesce("last.around", F.array()))  # a sense that is open lies around the one that began last, or is it
    nearest = F.array_max(F.transform(F.filter(begun, lambda s: s["post"] > F.col("pre")), lambda s: s["pre"]))
    itself = sense | (F.col("loose") & nearest.isNull())
    rows = rows.withColumn("sense", F.when(F.col("bare"), F.lit(None)).when(itself, F.col("pre")).otherwise(nearest))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("markup").isNotNull(), F.struct("pre", "rank", "markup")))), lambda s: s["markup"]), "")
    parts = rows.groupBy(*key, "sense").agg(inside.alias("inside"), F.min("pos").alias("pos"), F.max("lang").alias("lang"), F.max("bare").alias("bare"))
    each = parts.groupBy(*key).agg(F.max(F.when(F.col("sense").isNull(), F.col("inside"))).alias("outside"), F.array_sort(F.collect_list(F.when(F.col("sense").isNotNull(), F.struct("sense", "inside")))).alias("senses"), F.count("sense").alias("n_senses"), F.min("pos")["final"].alias("pos"), F.max("lang").alias("lang"), F.max("bare").alias("bare")).where("bare").drop("bare")
    heads = matches.where(role == "hw").groupBy(*key).agg(F.min(final)["final"].alias("headword"))
    named = entry_nodes.select("doc_id", F.col("pre").alias("entry")).join(heads, key, "left")
    safe = F.when(is_blank(F.col("headword")), F.lit("headword")).otherwise(name_safe(F.col("headword")))
    named, by = named.withColumn("safe", safe), ["safe"]
    if datasets is not None:
        named, by = named.join(datasets.select("doc_id", F.col("dsid").alias("within")), "doc_id"), ["within", "safe"]
    each = each.join(in_runs(named, by, key, count="n").drop(*by), key)
    each = each.withColumn("xml_id", entry_identifier(acronym, F.col("headword"), F.col("n"), F.col("pos")))
    bodies = F.array_join(F.transform("senses", lambda s, i: element("sense", s["inside"], xml__id=sense_identifier(F.col("xml_id"), i + 1))), "")
    content = F.concat(F.coalesce("outside", F.lit("")), bodies)
    if keep_scrap and scrap is not None:
        rest = scrap.groupBy(*key).agg(strip(seamed(F.transform(F.array_sort(F.collect_list(F.struct("at", "off", "piece"))), lambda s: s["piece"]))).alias("rest")).where("rest <> ''")
        each = each.join(rest, key, "left")
        content = F.concat(content, F.when(F.col("rest").isNotNull(), element("dictScrap", escaped(F.col("rest")))).otherwise(""))
    return each.select(*key, "xml_id", "headword", "pos", "n_senses", element("entry", content, xml__id=F.col("xml_id"), xml__lang=F.col("lang")).alias("tei"))


def stripped_attributes(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """attribute, n: attributes that a clean-up to those in `kept` drops, and how often."""
    return nodes.select(F.explode(F.map_keys(F.map_filter("attrs", lambda k, v: ~k.isin(kept)))).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))


def model_errors(nodes: DataFrame) -> DataFrame:
    """doc_id, pre, tag, parent_tag: elements where the content model allows them not, and names that it doesn't have (parent_tag null)."""
    up = F.try_element_at("path", F.lit(-2))
    return nodes.where(~allowed(F.col("tag"), F.coalesce(up, F.lit("body")))).select("doc_id", "pre", "tag", up.alias("parent_tag"))


def header(metadata: DataFrame) -> DataFrame:
    """id, tei: a teiHeader for each row (id, title, creators, contributors, publisher, licence, created, identifier, extent, source; all may be null)."""
    each = lambda c, tag, inner: F.coalesce(F.array_join(F.transform(c, inner), ""), F.lit(""))
    maybe = lambda c, tag, **a: F.when(~is_blank(F.col(c)), element(tag, escaped(F.col(c)), **a)).otherwise("")
    title = element("titleStmt", F.concat(element("title", escaped(F.coalesce("title", F.lit("")))), each(F.col("creators"), "author", lambda x: element("author", escaped(x))), each(F.col("contributors"), "respStmt", lambda x: F.concat(F.lit("<respStmt><resp>contributor</resp>"), element("name", escaped(x)), F.lit("</respStmt>")))))
    details = F.concat(maybe("licence", "availability"), F.when(~is_blank(F.col("created")), F.concat(F.lit('<date when="'), escaped(F.col("created")), F.lit('"/>'))).otherwise(""), maybe("identifier", "idno"))
    named = F.when(~is_blank(F.col("publisher")) | (details != ""), element("publisher", escaped(F.coalesce("publisher", F.lit("")))))
    publication = element("publicationStmt", F.when(named.isNull(), F.lit("<p/>")).otherwise(F.concat(named, details)))
    source = element("sourceDesc", element("p", escaped(F.coalesce("source", "title", F.lit("")))))
    return metadata.select("id", element("teiHeader", element("fileDesc", F.concat(title, maybe("extent", "extent"), publication, source))).alias("tei"))
