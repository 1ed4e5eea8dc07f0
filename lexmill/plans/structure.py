"""Queries of moves, namespaces, spans of text, content models and encodings over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import assemble, mapping, models, moves, prune, sequences
from lexmill.operators import select as S
from lexmill.plans import dictionary, refresh, remap
from lexmill.plans.queries import PARTS, _dealt, _table, _tag, event_labels, part_documents, part_nodes, query
from lexmill.sources.schema import compiled
from lexmill.sources.split import read_nodes
from lexmill.sources.store import shared_dir, stored
from lexmill.sources.xml import document_parts, shred


def supplier_nodes(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    """A document of each supplier."""
    return stored(shred(_dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), raw.alias("raw"))))


def _first_word(rest: str) -> str:
    return f"""WITH h AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS hw, trim(substr(p_name, length(string_split(p_name, ' ')[1]) + 1) || ' ' || p_brand) AS rest, replace(p_type, ' ', '.') AS pos, p_type FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY hw ORDER BY p_partkey) AS n FROM h) {rest}"""


@query(_first_word("""SELECT 'D_' || hw || '_' || n || '_' || pos AS xml_id, hw AS headword,
'<entry xml:id="D_' || hw || '_' || n || '_' || pos || '"><form type="lemma"><orth>' || hw || '</orth></form><gramGrp><gram type="pos" orig="' || p_type || '">' || p_type || '</gram></gramGrp><dictScrap>' || rest || '</dictScrap></entry>' AS tei FROM n"""))
def part_match_rest(spark, sf_dir):
    """A headword is the first word of its element: the other words and the label are leftover text."""
    spec = {**PARTS, "hw": {**PARTS["hw"], "rex": "^([^ ]+)", "rexGroup": 1}}
    return dictionary.dictionary_to_tei(part_nodes(spark, sf_dir), mapping.Mapping.of(spec), "dictionary", keep_scrap=True).select("xml_id", "headword", "tei")


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier)
SELECT s_suppkey AS doc_id, 1 AS k, 'before ' || s_name || ' mid' AS scrap FROM s UNION ALL SELECT s_suppkey, 2, 'end' FROM s""")
def outer_text(spark, sf_dir):
    """Text before, between and after entries goes to the entry on its left, or to the first."""
    entry = lambda n: T.element("entry", T.element("hw", F.lit(n)))
    nodes = supplier_nodes(spark, sf_dir, T.element("d", F.concat(F.lit("before "), T.element("i", F.col("s_name")), entry("a"), F.lit("mid"), entry("b"), F.lit("end"))))
    spec = mapping.Mapping.of({"entry": {"type": "xpath", "expr": ".//entry"}, "hw": PARTS["hw"]})
    out = dictionary.dictionary_to_tei(nodes, spec, keep_scrap=True)
    return out.select("doc_id", F.when(F.col("headword") == "a", 1).otherwise(2).alias("k"), F.regexp_extract("tei", "<dictScrap>(.*)</dictScrap>", 1).alias("scrap"))


def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three namespaces: d and n of the default one, t:b[@t:k], and u:b, whose prefix stands for one of two."""
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    inner = F.concat(F.lit('<n>x</n><t:b t:k="'), nation, F.lit('">'), name, F.lit('</t:b><b k="'), nation, F.lit('">plain</b><s xmlns="" xmlns:u="'), F.when(F.col("s_suppkey") % 2 == 0, "urn:t").otherwise("urn:other"), F.lit('"><u:b>u</u:b><n/></s>'))
    return supplier_nodes(spark, sf_dir, F.concat(F.lit('<d xmlns="urn:d" xmlns:t="urn:t">'), inner, F.lit("</d>")))


@query("""SELECT 'declared' AS path, s_suppkey AS doc_id, s_name AS value FROM supplier UNION ALL SELECT 'declared', s_suppkey, 'u' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'own scope', s_suppkey, s_name FROM supplier UNION ALL SELECT 'own scope', s_suppkey, 'u' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'attribute', s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'unprefixed', s_suppkey, 'plain' FROM supplier
UNION ALL SELECT 'any', s_suppkey, unnest([s_name, 'plain', 'u']) FROM supplier""")
def xpath_namespaces(spark, sf_dir):
    """Prefixes that a mapping declares, prefixes read in the elements' scope, prefixed attributes, and names without a prefix."""
    nodes = named_nodes(spark, sf_dir)
    paths = [("declared", ".//x:b", {"x": "urn:t"}), ("own scope", ".//t:b", None), ("attribute", ".//x:b[@x:k='3']", {"x": "urn:t"}), ("unprefixed", ".//b", None), ("any", ".//*:b", None)]
    out = None
    for label, path, names in paths:
        found = S.select(nodes, path, None, names).select(F.lit(label).alias("path"), "doc_id", F.col("text").alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT 'text' AS kind, p_partkey, p_name AS value FROM part UNION ALL SELECT 'attribute', p_partkey, p_size::VARCHAR FROM part
UNION ALL SELECT 'child', p_partkey, p_brand FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 'or', p_partkey, p_name FROM part WHERE p_size = 10 OR p_size = 20 AND starts_with(p_name, 'b')""")
def xpath_text(spark, sf_dir):
    """text() and attributes as rows, tests of a child's text, and 'and' with 'or'."""
    nodes = part_nodes(spark, sf_dir)
    own = S.select(nodes, ".//entry")
    ids = own.select("doc_id", F.col("pre").alias("ctx"), F.col("attrs")["id"].cast("long").alias("p_partkey"))
    rows = lambda kind, path: S.values(nodes, path, own).join(ids, ["doc_id", "ctx"]).select(F.lit(kind).alias("kind"), "p_partkey", "value")
    out = rows("text", "hw/text()").unionByName(rows("attribute", "@size"))
    out = out.unionByName(rows("child", "self::entry[pos='SMALL']/label/text()"))
    return out.unionByName(rows("or", "self::entry[@size='10' or @size='20' and starts-with(hw, 'b')]/hw/text()"))


@query("""SELECT 'following' AS axis, p_partkey, unnest([p_type, p_brand]) AS value FROM part UNION ALL SELECT 'preceding', p_partkey, unnest([p_name, p_type]) FROM part
UNION ALL SELECT 'next', p_partkey, p_type FROM part UNION ALL SELECT 'nearest', p_partkey, p_type FROM part""")
def xpath_siblings(spark, sf_dir):
    """Sibling axes within entries, with places counted from the element that they start at."""
    nodes = part_nodes(spark, sf_dir)
    ids = S.select(nodes, ".//entry").select("doc_id", F.col("pre").alias("parent"), F.col("attrs")["id"].cast("long").alias("p_partkey"))
    rows = lambda axis, path: S.select(nodes, path).join(ids, ["doc_id", "parent"]).select(F.lit(axis).alias("axis"), "p_partkey", F.col("text").alias("value"))
    paths = {"following": ".//hw/following-sibling::*", "preceding": ".//label/preceding-sibling::*", "next": ".//hw/following-sibling::*[1]", "nearest": ".//label/preceding-sibling::*[1]"}
    out = None
    for axis, path in paths.items():
        out = rows(axis, path) if out is None else out.unionByName(rows(axis, path))
    return out


@query("""SELECT s_suppkey AS doc_id, tag, path, CASE tag WHEN 'q' THEN s_name WHEN 'entry' THEN s_nationkey::VARCHAR ELSE '' END AS text, CASE tag WHEN 's' THEN '!?' ELSE '' END AS tail, place FROM supplier,
(VALUES ('d', 'd', 1), ('entry', 'd/entry', 2), ('s', 'd/entry/s', 3), ('p', 'd/entry/s/p', 4), ('q', 'd/entry/s/p/q', 5), ('r', 'd/entry/s/p/q/r', 6), ('z', 'd/entry/z', 7)) t(tag, path, place)""")
def adoption(spark, sf_dir):
    """q and all inside moves under p; what stood after it stays there."""
    inner = F.concat(F.col("s_nationkey").cast("string"), F.lit("<s><p/></s>!<q>"), F.col("s_name"), F.lit("<r/></q>?<z/>"))
    nodes = supplier_nodes(spark, sf_dir, T.element("d", T.element("entry", inner)))
    spec = mapping.Mapping.of({"entry": {"type": "xpath", "expr": ".//entry"}, "def": {"type": "simple", "selector": {"type": "xpath", "expr": ".//p"}, "attr": mapping.INNER_REC, "adoptSelector": {"type": "xpath", "expr": "../following-sibling::q"}}})
    now = moves.moved(nodes, moves.adoptions_of(nodes, spec, S.entries(nodes, spec.entry)))
    place = F.size(F.filter(F.array_sort(F.collect_list("pre").over(Window.partitionBy("doc_id"))), lambda x: x <= F.col("pre")))
    return now.select("doc_id", "tag", F.array_join("path", "/").alias("path"), "text", "tail", place.alias("place"))


@query("""SELECT s_suppkey AS doc_id, path, text FROM supplier, LATERAL (SELECT * FROM (VALUES ('entry', ''), ('entry/sense', ''), ('entry/sense/def', s_name || 'c'), ('entry/sense/sense', 'inner'),
('entry/dictScrap', ''), ('entry/dictScrap/def', 'loose'), ('entry/form', ''), ('entry/form/orth', s_name), ('entry/dictScrap', 'odd')) t(path, text))""")
def legal_parents(spark, sf_dir):
    """Elements climb to the nearest ancestor that may hold them; what an entry can't hold is wrapped there."""
    name = F.col("s_name")
    inner = F.concat(F.lit("<sense><def>"), name, F.lit("<sense>inner</sense>c</def></sense><def>loose</def><form><orth>"), name, F.lit("</orth><zzz>odd</zzz></form>"))
    return moves.legalised(supplier_nodes(spark, sf_dir, T.element("entry", inner))).select("doc_id", F.array_join("path", "/").alias("path"), "text")


def _scrap_document() -> Column:
    name = F.col("s_name")
    return T.element("entry", F.concat(F.lit("<sense><seg>"), name, F.lit("<def>d<seg>e<note>n</note>f</seg></def></seg><dictScrap><cit>q</cit></dictScrap></sense><xr><seg>"), name, F.lit("</seg></xr><seg> </seg>")))


@query("""SELECT 2 AS level, s_suppkey AS doc_id, path, text, tail FROM supplier, LATERAL (SELECT * FROM (VALUES ('entry', '', ''), ('entry/sense', '', ''), ('entry/sense/seg', s_name, ''), ('entry/sense/seg/def', 'd e', ''), ('entry/sense/seg/def/note', 'n', 'f'),
('entry/sense/cit', 'q', ''), ('entry/xr', '', ' '), ('entry/xr/seg', s_name, '')) t(path, text, tail))
UNION ALL SELECT 3, s_suppkey, path, text, tail FROM supplier, LATERAL (SELECT * FROM (VALUES ('entry', '', ''), ('entry/sense', '', ''), ('entry/sense/seg', s_name, ''), ('entry/sense/seg/def', 'd e', ''), ('entry/sense/seg/def/note', 'n', 'f'),
('entry/sense/cit', 'q', ''), ('entry/xr', '', ''), ('entry/xr/seg', s_name, '')) t(path, text, tail))""")
def thorough_scrap(spark, sf_dir):
    nodes = supplier_nodes(spark, sf_dir, _scrap_document())
    level = lambda n: prune.stripped(nodes, n).select(F.lit(n).alias("level"), "doc_id", F.array_join("path", "/").alias("path"), "text", "tail")
    return level(2).unionByName(level(3))


#: A small schema for the query, in the schema language's own form.
SCHEMA = """<grammar xmlns="http://relaxng.org/ns/structure/1.0"><start><ref name="entry"/></start>
<define name="entry"><element name="entry"><attribute name="id"/><ref name="hw"/><oneOrMore><choice><ref name="pos"/><ref name="label"/></choice></oneOrMore></element></define>
<define name="hw"><element name="hw"><text/></element></define><define name="pos"><element name="pos"><choice><value>SMALL</value><text/></choice></element></define><define name="label"><element name="label"><empty/></element></define>
<define name="dict"><element name="dict"><zeroOrMore><ref name="entry"/></zeroOrMore></element></define></grammar>"""


@query("SELECT 'label' AS tag, 'text' AS kind, 0 AS place, '' AS name, p_partkey FROM part UNION ALL SELECT 'entry', 'child', 1, 'label', p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'entry', 'end', 1, '', p_partkey FROM part WHERE p_size % 3 = 0 AND p_size % 2 = 1")
def content_models(spark, sf_dir):
    """Entries in three shapes: label before hw, hw alone, and the right order; labels hold text that the schema denies them."""
    parts = _dealt(spark, sf_dir, "part", "p_partkey")
    hw, label, pos = _tag("hw", F.col("p_name")), _tag("label", F.col("p_brand")), _tag("pos", F.col("p_type"))
    shape = F.when(F.col("p_size") % 2 == 0, F.concat(label, hw, pos)).when(F.col("p_size") % 3 == 0, hw).otherwise(F.concat(hw, pos, label))
    raw = T.element("dict", F.concat(T.element("entry", shape, id=F.col("p_partkey")), F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 1), T.element("entry", F.concat(hw, label), id=F.col("p_partkey"))).otherwise("")))
    nodes = stored(shred(parts.select(F.col("p_partkey").alias("doc_id"), raw.alias("raw"))))
    return models.validated(nodes, compiled(SCHEMA)).select("tag", "kind", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("name", F.lit("")).alias("name"), F.col("doc_id").alias("p_partkey"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)
SELECT l_orderkey, k, 'e' || l_orderkey || '_line_' || CASE WHEN l_orderkey % 2 = 0 THEN k + CASE WHEN k >= 2 THEN 1 ELSE 0 END ELSE k END AS xml_id FROM e""")
def other_ids(spark, sf_dir):
    """Numbers of an order's lines; every second order already uses the id with number 2."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", place.cast("long").alias("pre"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    used = orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string"), F.lit("_line_2")).alias("id"))
    nodes = lines.select(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("entry_id"), F.lit("line").alias("tag"), F.col("l_orderkey").alias("doc_id"), "pre", F.lit(None).cast("string").alias("own_id"))
    return assemble.other_identifiers(nodes, used).select(F.col("doc_id").alias("l_orderkey"), F.col("pre").alias("k"), "xml_id")


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(p_brand, '')) AS c FROM part WHERE p_size < 10), v AS (SELECT c, row_number() OVER (ORDER BY c) AS id FROM c),
e AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, length(p_name) AS n, p_name FROM part),
m AS (SELECT p_partkey, i, n, coalesce(id, 0) AS id FROM e LEFT JOIN v ON substr(p_name, i, 1) = c)
SELECT p_partkey, CASE WHEN any_value(n) < 12 THEN repeat('0 ', 12 - any_value(n)) ELSE '' END || string_agg(id::VARCHAR, ' ' ORDER BY i) FILTER (i > n - 12) AS codes FROM m GROUP BY 1""")
def char_codes(spark, sf_dir):
    """Codes of the last 12 characters of a name, by the alphabet of some brands."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    alphabet = sequences.vocabulary(parts.where("p_size < 10").select(F.explode(F.split("p_brand", "")).alias("c")), "c")
    return sequences.char_codes(parts, "p_name", alphabet, 12).select("p_partkey", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query("""WITH f AS (SELECT p_partkey, unnest(['T=' || p_type, 'B=' || p_brand, 'S=' || p_size]) AS f FROM part), v AS (SELECT f, row_number() OVER (ORDER BY f) AS id FROM (SELECT DISTINCT f FROM f JOIN part USING (p_partkey) WHERE p_size < 10))
SELECT p_partkey, (SELECT count(*) FROM v)::INTEGER AS size, coalesce(string_agg((id - 1)::VARCHAR, ',' ORDER BY id), '') AS places FROM f LEFT JOIN v USING (f) GROUP BY 1""")
def one_hot(spark, sf_dir):
    """Features of every part as sparse vectors over those of some."""
    parts = _table(spark, sf_dir, "part")
    rows = parts.select("p_partkey", "p_size", F.array(F.concat(F.lit("T="), "p_type"), F.concat(F.lit("B="), "p_brand"), F.concat(F.lit("S="), F.col("p_size").cast("string"))).alias("features"))
    known = sequences.vocabulary(rows.where("p_size < 10").select(F.explode("features").alias("f")), "f")
    return sequences.one_hot(rows, "features", known).select("p_partkey", "hot.size", F.array_join(F.transform("hot.indices", lambda i: i.cast("string")), ",").alias("places"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS \"right\", round(count(*) FILTER (quality = toxic) / count(*), 9) AS accuracy FROM labels")
def accuracy(spark, sf_dir):
    out = sequences.accuracy(sequences.confusion(_table(spark, sf_dir, "labels"), "quality", "toxic"))
    return out.select("n", "right", F.round("accuracy", 9).alias("accuracy"))


@query("""SELECT s_suppkey AS doc_id, path, id, orig_id, text FROM supplier, LATERAL (SELECT * FROM (VALUES ('d', NULL, NULL, NULL), ('d/entry', 'A_' || s_name || '_1_' || CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd ' || s_nationkey END, 'e1', NULL),
('d/entry/form', NULL, NULL, NULL), ('d/entry/form/orth', NULL, NULL, s_name), ('d/entry/gramGrp', NULL, NULL, NULL), ('d/entry/gramGrp/gram', NULL, CASE WHEN s_nationkey % 2 = 0 THEN 'n ' ELSE 'odd ' END || s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd ' || s_nationkey END),
('d/entry/sense', 'A_' || s_name || '_1_' || CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd ' || s_nationkey END || '_1', 's', 'x')) t(path, id, orig_id, text))""")
def remapped_tei(spark, sf_dir):
    """Parts of speech by a map made of the table itself, new identifiers, old ones kept."""
    n = F.col("s_nationkey").cast("string")
    pos = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit(" n "), n)).otherwise(F.concat(F.lit("odd "), n))
    raw = T.element("d", T.element("entry", F.concat(F.lit("<form>"), T.element("orth", F.col("s_name")), F.lit('</form><gramGrp><gram type="pos">'), pos, F.lit('</gram></gramGrp><sense xml:id="s">x</sense>')), xml__id=F.lit("e1")))
    table = _table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("n "), n).alias("original"), F.lit("even").alias("mapped"))
    nodes = remap.new_identifiers(stored(remap.remapped_pos(supplier_nodes(spark, sf_dir, raw), table)), "A")
    return nodes.select("doc_id", F.array_join("path", "/").alias("path"), F.col("attrs")["xml:id"].alias("id"), F.coalesce(F.col("attrs")[remap.OLD_ID], F.col("attrs")["orig"]).alias("orig_id"), F.when(F.col("text") != "", F.col("text")).alias("text"))


@query("""SELECT o_custkey AS doc_id, '<dict>' || string_agg('<entry id="' || o_orderkey || '">' || o_orderpriority || '</entry>', '' ORDER BY o_orderkey) || '</dict>' AS raw FROM orders GROUP BY 1""")
def written_documents(spark, sf_dir):
    """Documents shredded, written as markup again, and joined from their rows."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _tag("entry", F.col("o_orderpriority"), id=F.col("o_orderkey")).alias("xml"))
    docs = dictionary.batched(rows, F.col("o_custkey"), "o_orderkey", "dict").withColumn("raw", F.replace("raw", F.lit("\n"), F.lit("")))
    parts = document_parts(stored(shred(docs)))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tei"))), lambda s: s["tei"]), "").alias("raw"))


@query("""SELECT 'dict' AS tag, p_partkey // 500 AS doc, 1 AS n, (3 + 8 * count(*) - 2)::BIGINT AS last FROM part GROUP BY 2
UNION ALL SELECT t, p_partkey // 500, count(*), 0 FROM part, (VALUES ('entry'), ('hw'), ('pos'), ('label')) x(t) GROUP BY 1, 2""")
def split_files(spark, sf_dir):
    """Documents written as files, and read in splits that end with an entry."""
    path = shared_dir(spark)
    docs = part_documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.replace("raw", F.lit("\n"), F.lit("")).alias("value"))
    docs.write.partitionBy("doc").text(path)
    nodes = stored(read_nodes(spark, path, "entry"))
    doc = nodes.where("tag = 'entry'").groupBy("doc_id").agg(F.min(F.floor(F.col("attrs")["id"].cast("long") / 500)).alias("doc"))
    last = F.max(F.when(F.col("tag") == "dict", F.col("post")).otherwise(0))
    return nodes.join(doc, "doc_id").groupBy("tag", "doc").agg(F.count("*").alias("n"), last.alias("last"))


@query("""SELECT o_custkey % 5 AS dsid, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS numbered FROM orders GROUP BY 1""")
def refreshed_entries(spark, sf_dir):
    """Five datasets; a second mapping for two of them, and a refresh that leaves the others alone."""
    orders = _table(spark, sf_dir, "orders")
    entry = T.element("e", F.concat(F.when(F.col("o_orderstatus") != "F", _tag("hw", F.col("o_orderpriority"))).otherwise(""), _tag("w", F.col("o_orderstatus"))), id=F.col("o_orderkey"))
    docs = dictionary.batched(orders.select("o_custkey", "o_orderkey", entry.alias("xml")), F.col("o_custkey"), "o_orderkey", "dict")
    docs = stored(docs.withColumn("dsid", F.col("doc_id") % 5))
    spec = lambda hw: mapping.Mapping.of({"entry": {"type": "xpath", "expr": ".//e"}, "hw": {"type": "simple", "selector": {"type": "xpath", "expr": hw}, "attr": mapping.INNER}}).to_json()
    sets = docs.select("dsid").distinct()
    path = shared_dir(spark)
    refresh.refresh(docs, sets.withColumn("spec", F.when(F.col("dsid") < 2, spec("w")).otherwise(spec("hw"))), path)
    refresh.refresh(docs, sets.withColumn("spec", F.lit(spec("hw"))), path)
    rows = refresh.stored_entries(spark, path)
    return rows.groupBy(F.col("dsid").cast("long").alias("dsid")).agg(F.count("*").alias("entries"), F.count_if(F.col("entry_text").startswith("Entry ")).alias("numbered"))


@query("""SELECT s_suppkey AS doc_id, '<e xmlns:a="urn:lexmill:legacy" xmlns:m="urn:lexmill:meta" a:n="' || s_nationkey || '" m:id="i" xml:lang="en" m:e="e">' || s_name || '</e>' AS raw FROM supplier""")
def legacy_attributes(spark, sf_dir):
    raw = F.concat(F.lit('<e n="'), F.col("s_nationkey").cast("string"), F.lit('" xml:id="i" xml:lang="en">'), F.col("s_name"), F.lit("</e>"))
    parts = document_parts(mapping.legacy_attributes(supplier_nodes(spark, sf_dir, raw)))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tei"))), lambda s: s["tei"]), "").alias("raw"))


@query("""WITH e AS (SELECT user_id AS seq, ts, event_id, event_type AS base, event_id % 3 = 0 AS s FROM events),
c AS (SELECT *, CASE WHEN s OR lag(base) OVER w IS DISTINCT FROM base THEN 1 ELSE 0 END AS a, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY seq ORDER BY ts, event_id))
SELECT seq, k AS place, CASE WHEN a = 1 THEN '<container name="' || base || '">' ELSE '' END || '<TOKEN>' || event_id || '</TOKEN>' || CASE WHEN coalesce(lead(a) OVER (PARTITION BY seq ORDER BY k), 1) = 1 THEN '</container>' ELSE '' END AS tei FROM c""")
def container_markup(spark, sf_dir):
    labels = event_labels(spark, sf_dir)
    tokens = sequences.with_levels(labels.select("seq", "ord", "event_id"), [labels.select("seq", "ord", "label")])
    token = T.element("TOKEN", F.col("event_id").cast("string"))
    return sequences.container_markup(tokens, 1, token).where("place > 0 and place < 9223372036854775807")


@query("""SELECT row_number() OVER (ORDER BY p_brand, p_type) AS place, '<entry><form type="lemma"><orth>' || p_brand || '</orth></form><gramGrp><gram type="pos">' || p_type || '</gram></gramGrp>' || string_agg('<sense n="' || k || '"><def>' || p_name || '</def></sense>', '' ORDER BY k) || '</entry>' AS tei
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) AS k FROM part) GROUP BY p_brand, p_type""")
def table_document(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("pos"), F.col("p_name").alias("definition"))
    return dictionary.table_parts(rows).where("place > 0 and place < 9223372036854775807").select("place", "tei")
