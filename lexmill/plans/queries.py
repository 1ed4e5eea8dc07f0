"""The operators over the driver's tables, and SQL on the tables' own columns that gives the same rows.

XML is built from the columns, goes through the operators, and SQL never sees it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import assemble, catalog, discover, mapping, prune, sequences
from lexmill.operators import select as S
from lexmill.plans import dictionary
from lexmill.sources.store import dropped, stored
from lexmill.sources.xml import shred

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows become documents each: dealt by key, as a packed file of millions is read by one task, which would parse them all."""
    return _table(spark, sf_dir, name).repartition(key)


def _tag(tag: str, content: Column, **a: Column) -> Column:
    return T.element(tag, T.escaped(content.cast("string")), **a)


def part_documents(spark: SparkSession, sf_dir: str, per_document: int = 500) -> DataFrame:
    """Dictionary documents of `per_document` parts: entry[@id, @size](hw, pos, label)."""
    parts = _table(spark, sf_dir, "part")
    inner = F.concat(_tag("hw", F.col("p_name")), _tag("pos", F.col("p_type")), _tag("label", F.col("p_brand")))
    rows = parts.select("p_partkey", F.floor(F.col("p_partkey") / per_document).alias("d"), T.element("entry", inner, id=F.col("p_partkey"), size=F.col("p_size")).alias("xml"))
    return dictionary.batched(rows, F.col("d"), "p_partkey", "dict")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(shred(part_documents(spark, sf_dir)))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: order[@id](status, line[@n](def)) with the lines in the six-column order that is unique."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    line = lambda s: T.element("line", _tag("def", F.concat_ws(" ", s["l_returnflag"], s["l_partkey"])), n=s["l_linenumber"])
    each = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "l_returnflag"))), line), "").alias("lines"))
    joined = orders.join(each, orders["o_orderkey"] == each["l_orderkey"], "left")
    xml = T.element("order", F.concat(_tag("hw", F.col("o_orderpriority")), _tag("pos", F.col("o_orderstatus")), F.coalesce("lines", F.lit(""))), id=F.col("o_orderkey"))
    rows = stored(joined.select("o_orderkey", "o_custkey", xml.alias("xml")))  # so lines and documents aren't on disk at the same time
    nodes = stored(shred(dictionary.batched(rows, F.col("o_custkey"), "o_orderkey", "dict")))
    dropped(spark, [rows])
    return nodes


def geography_nodes(spark: SparkSession, sf_dir: str, batch: int = 1000) -> DataFrame:
    """region[@lang](nation[@id](name, customer(name))): a document for each nation and batch of customers, so documents don't grow with the tables."""
    region, nation, customer = (_table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    people = customer.select("c_nationkey", F.floor(F.col("c_custkey") / batch).alias("b"), "c_custkey", T.element("customer", _tag("name", F.col("c_name")), id=F.col("c_custkey")).alias("xml"))
    people = people.groupBy("c_nationkey", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "xml"))), lambda s: s["xml"]), "").alias("people"))
    places = nation.join(people, nation["n_nationkey"] == people["c_nationkey"], "left").join(region, nation["n_regionkey"] == region["r_regionkey"])
    inner = T.element("nation", F.concat(_tag("name", F.col("n_name")), F.coalesce("people", F.lit(""))), id=F.col("n_nationkey"))
    doc_id = (F.col("n_nationkey").cast("long") * 1_000_000_000 + F.coalesce("b", F.lit(0))).alias("doc_id")
    return stored(shred(places.select(doc_id, T.element("region", inner, lang=F.col("r_name")).alias("raw"))))


#: The documents of geography_nodes() in SQL.
_GEOGRAPHY = "WITH g AS (SELECT DISTINCT n_regionkey, n_nationkey, coalesce(c_custkey // 1000, 0) AS b FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey) "


PARTS = {"entry": {"type": "xpath", "expr": ".//entry"}, "hw": {"type": "simple", "selector": {"type": "xpath", "expr": "hw"}, "attr": mapping.INNER_REC}, "pos": {"type": "simple", "selector": {"type": "xpath", "expr": "pos"}, "attr": mapping.INNER_REC}}


@query("SELECT p_type AS pos, count(*) AS n, count(DISTINCT p_name) AS heads FROM part GROUP BY 1")
def pos_inventory(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    own = S.entries(nodes, PARTS["entry"])
    pos, hw = (mapping.found(nodes, PARTS[r], own) for r in ("pos", "hw"))
    return pos.select("doc_id", "ctx", F.col("final").alias("pos")).join(hw.select("doc_id", "ctx", "final"), ["doc_id", "ctx"]).groupBy("pos").agg(F.count("*").alias("n"), F.count_distinct("final").alias("heads"))


@query(_GEOGRAPHY + "SELECT 'customer' AS tag, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM g UNION ALL SELECT 'region', count(*) FROM g UNION ALL SELECT 'name', (SELECT count(*) FROM customer) + (SELECT count(*) FROM g)")
def tag_inventory(spark, sf_dir):
    return discover.tag_inventory(geography_nodes(spark, sf_dir))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def raw_tag_inventory(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw"))
    return discover.tag_inventory(shred(pages))


@query(_GEOGRAPHY + "SELECT 'region' AS parent_tag, 'nation' AS tag, count(*) AS n FROM g UNION ALL SELECT 'nation', 'name', count(*) FROM g UNION ALL SELECT 'nation', 'customer', count(*) FROM customer UNION ALL SELECT 'customer', 'name', count(*) FROM customer")
def tag_edges(spark, sf_dir):
    return discover.tag_edges(geography_nodes(spark, sf_dir))


@query("SELECT * FROM (VALUES ('region', '', 'nation'), ('nation', 'region', 'customer,name'), ('customer', 'nation', 'name'), ('name', 'customer,nation', '')) t(tag, parents, children)")
def tag_graph(spark, sf_dir):
    return discover.tag_graph(geography_nodes(spark, sf_dir)).select("tag", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query("SELECT unnest(['region', 'region/nation', 'nation', 'region/nation/name', 'nation/name', 'name', 'region/nation/customer', 'nation/customer', 'customer', 'region/nation/customer/name', 'nation/customer/name', 'customer/name']) AS path")
def path_suffixes(spark, sf_dir):
    return discover.path_suffixes(geography_nodes(spark, sf_dir))


@query("SELECT * FROM (VALUES (1, 'region/nation/name'), (3, 'customer'), (5, 'customer/name')) t(path_id, path)")
def valid_paths(spark, sf_dir):
    paths = spark.createDataFrame([(1, "region/nation/name"), (2, "region/customer"), (3, "customer"), (4, "name/nation"), (5, "customer/name")], "path_id int, path string")
    return discover.valid_paths(paths, geography_nodes(spark, sf_dir))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 100")
def value_inventory(spark, sf_dir):
    return discover.value_inventory(part_nodes(spark, sf_dir), ["label"])


@query("SELECT p_partkey FROM part WHERE (p_size = 10 OR p_size = 20) AND p_type <> 'SMALL' UNION SELECT p_partkey FROM part WHERE p_size = 30")
def select_union_exclude(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    x = lambda e: {"type": "xpath", "expr": e}
    own = S.entries(nodes, PARTS["entry"])
    small = mapping.found(nodes, {**PARTS["pos"], "rex": "^SMALL$"}, own)
    picked = S.selected(nodes, {"type": "union", "selectors": [x(".//entry[@size='10']"), x(".//entry[@size='20']")]}).join(small.select("doc_id", F.col("ctx").alias("pre")), ["doc_id", "pre"], "left_anti")
    rest = S.selected(nodes, {"type": "exclude", "left": x(".//entry[@size='30']"), "right": x(".//entry[@size='31']")})
    return picked.unionByName(rest).select(F.col("attrs")["id"].cast("long").alias("p_partkey")).distinct()


@query("SELECT p_partkey, p_brand AS value, regexp_extract(p_brand, 'Brand#(\\d+)', 1) AS matched, CASE regexp_extract(p_brand, 'Brand#(\\d+)', 1) WHEN '11' THEN 'eleven' WHEN '22' THEN 'twenty-two' ELSE regexp_extract(p_brand, 'Brand#(\\d+)', 1) END AS final FROM part WHERE regexp_matches(p_brand, 'Brand#(\\d+)')")
def attr_regex_xlat(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    own = S.entries(nodes, PARTS["entry"])
    label = {"type": "simple", "selector": {"type": "xpath", "expr": "label"}, "attr": mapping.INNER, "rex": r"Brand#(?P<number>\d+)", "rexGroup": "number", "xlat": {"11": "eleven", "22": "twenty-two"}}
    ids = own.select("doc_id", F.col("pre").alias("ctx"), F.col("attrs")["id"].cast("long").alias("p_partkey"))
    return mapping.found(nodes, label, own).join(ids, ["doc_id", "ctx"]).select("p_partkey", "value", "matched", "final")


@query("SELECT role, strategy, count(*) AS n FROM (SELECT 'hw' AS role, CASE WHEN strpos(p_name, ' ') > 0 THEN 'part' ELSE 'consume' END AS strategy FROM part UNION ALL SELECT 'pos', 'consume' FROM part UNION ALL SELECT 'note', 'part' FROM part UNION ALL SELECT 'usg', 'sibling' FROM part) GROUP BY 1, 2")
def order_strategy(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    spec = {**PARTS, "hw": {**PARTS["hw"], "rex": "^[^ ]+"}, "note": PARTS["pos"], "usg": {"type": "simple", "selector": {"type": "xpath", "expr": "."}, "attr": "size"}}
    own = S.entries(nodes, spec["entry"])
    return mapping.role_matches(nodes, mapping.Mapping.of(spec), own).groupBy("role", "strategy").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, r_name AS lang FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def nearest_language(spark, sf_dir):
    nodes = geography_nodes(spark, sf_dir)
    at = S.select(nodes, ".//customer").select("doc_id", "pre", F.col("attrs")["id"].cast("long").alias("c_custkey"))
    langs = mapping.found(nodes, {"type": "simple", "selector": {"type": "xpath", "expr": ".//region"}, "attr": "lang"})
    return mapping.nearest(nodes, at, langs, "lang").select("c_custkey", "lang")


@query("SELECT p_partkey, 'd_' || replace(trim(p_name), ' ', '.') || '_' || row_number() OVER (PARTITION BY replace(trim(p_name), ' ', '.') ORDER BY p_partkey) || '_' || replace(trim(p_type), ' ', '.') AS xml_id FROM part")
def entry_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", T.name_safe(F.col("p_name")).alias("hw"), F.col("p_name"), F.col("p_type"), F.col("p_partkey").alias("entry"))
    n = assemble.numbered(rows, ["p_partkey"])
    return n.select("p_partkey", assemble.entry_identifier(F.lit("d"), F.col("p_name"), F.col("n"), F.col("p_type")).alias("xml_id"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS n, o_orderpriority AS hw, o_orderstatus AS pos FROM orders)
SELECT o_orderkey, row_number() OVER w AS k, 'd_' || replace(hw, ' ', '.') || '_' || n || '_' || pos || '_' || row_number() OVER w AS xml_id, l_returnflag || ' ' || l_partkey AS def
FROM lineitem JOIN e ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""")
def sense_ids(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    own = S.entries(nodes, {"type": "xpath", "expr": ".//order"})
    value = lambda tag: mapping.found(nodes, {"type": "simple", "selector": {"type": "xpath", "expr": tag}, "attr": mapping.INNER}, own).select("doc_id", "ctx", F.col("final").alias(tag))
    heads = own.select("doc_id", F.col("pre").alias("ctx"), F.col("attrs")["id"].cast("long").alias("o_orderkey")).join(value("hw"), ["doc_id", "ctx"]).join(value("pos"), ["doc_id", "ctx"])
    n = assemble.numbered(heads.withColumn("raw_hw", F.col("hw")).withColumn("hw", T.name_safe(F.col("hw"))).withColumn("entry", F.col("o_orderkey")), ["doc_id", "ctx"])
    ids = n.select("doc_id", "ctx", "o_orderkey", assemble.entry_identifier(F.lit("d"), F.col("raw_hw"), F.col("n"), F.col("pos")).alias("entry_id"))
    senses = mapping.found(nodes, {"type": "simple", "selector": {"type": "xpath", "expr": "line"}, "attr": mapping.INNER_REC}, own)
    k = F.row_number().over(Window.partitionBy("doc_id", "ctx").orderBy("pre"))
    return senses.withColumn("k", k.cast("long")).join(ids, ["doc_id", "ctx"]).select("o_orderkey", "k", assemble.sense_identifier(F.col("entry_id"), F.col("k")).alias("xml_id"), F.col("final").alias("def"))


@query("""SELECT o_custkey AS doc_id, o_orderkey AS id, false AS is_top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS place FROM orders
UNION ALL SELECT DISTINCT o_custkey, o_custkey, true, 1 FROM orders""")
def nested_promote(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", T.element("entry", F.lit("x"), id=F.col("o_orderkey")).alias("xml"))
    each = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "xml"))), lambda s: s["xml"]), "").alias("inner"))
    nodes = stored(shred(each.select("doc_id", T.element("dict", T.element("entry", F.col("inner"), id=F.col("doc_id"))).alias("raw"))))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    return S.entries(nodes, {"type": "xpath", "expr": ".//entry"}).select("doc_id", F.col("attrs")["id"].cast("long").alias("id"), "is_top", place.cast("long").alias("place"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey AS doc_id, 'before ' || o_orderkey AS piece, CASE WHEN k = 1 THEN o_orderkey ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY k) END AS owner, CASE WHEN k = 1 THEN 'left' ELSE 'right' END AS side FROM o""")
def scrap_owners(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.concat(F.lit("<b>before "), F.col("o_orderkey").cast("string"), F.lit("</b>")), T.element("entry", F.lit("x"), id=F.col("o_orderkey"))).alias("xml"))
    nodes = stored(shred(dictionary.batched(orders, F.col("o_custkey"), "o_orderkey", "dict")))
    own = S.entries(nodes, {"type": "xpath", "expr": ".//entry"})
    pieces = nodes.where("tag = 'b'").select("doc_id", F.col("pre").alias("at"), F.col("text").alias("piece"))
    ids = own.select("doc_id", F.col("pre").alias("owner"), F.col("attrs")["id"].cast("long").alias("id"))
    return assemble.leftover_owners(pieces, own).join(ids, ["doc_id", "owner"]).select("doc_id", "piece", F.col("id").alias("owner"), "side")


@query("SELECT p_brand AS lemma, p_type AS pos, string_agg(p_name, '|' ORDER BY p_name) AS senses, count(*) AS n FROM part GROUP BY 1, 2")
def group_senses(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("pos"), F.col("p_name").alias("definition"))
    return dictionary.grouped_senses(rows).select("lemma", "pos", F.array_join("senses", "|").alias("senses"), F.size("senses").cast("long").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b') ORDER BY p_name, p_partkey LIMIT 100")
def search_prefix_top100(spark, sf_dir):
    return catalog.prefix_search(_table(spark, sf_dir, "part"), "p_name", "b", ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 100")
def page_of_entries(spark, sf_dir):
    return catalog.entry_page(_table(spark, sf_dir, "part"), 2, ["p_name", "p_partkey"]).select("p_partkey", "p_name")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words as PDF-like tokens: a line for each text line, a word place from 1 in each."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    words = lines.select("doc_id", (F.col("line") + 1).alias("line"), F.posexplode(F.split("body", " ")).alias("at", "text"))
    ord_ = (F.col("line").cast("long") * 1_000_000 + F.col("at")).alias("ord")
    return words.select("doc_id", ord_, "line", (F.col("at") + 1).cast("long").alias("word"), "text", (8 + F.length("text") % 3).alias("font_size"), F.lit("no").alias("bold"), F.lit("no").alias("italic"), F.lit("serif").alias("font_name"))


_TOKENS = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l2 AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM l),
w AS (SELECT doc_id, line, string_split(body, ' ') AS ws FROM l2),
t AS (SELECT doc_id, line, unnest(range(1, len(ws) + 1)) AS word, unnest(ws) AS text FROM w)
"""


@query(_TOKENS + "SELECT doc_id, line * 1000000 + word - 1 AS ord, text, CASE WHEN line <> coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line, word), 0) THEN 1 ELSE 0 END AS newline FROM t WHERE text <> ''")
def newline_flag(spark, sf_dir):
    return sequences.token_features(document_tokens(spark, sf_dir)).select("doc_id", "ord", "text", "newline")


@query(_TOKENS + "SELECT f AS feature, count(*) AS n FROM (SELECT unnest(['SIZE=' || (8 + length(text) % 3), 'BOLD=no', 'ITALIC=no', 'FONT=serif', 'TOKEN=' || text]) AS f FROM t WHERE text <> '') GROUP BY 1")
def token_features(spark, sf_dir):
    return sequences.token_features(document_tokens(spark, sf_dir)).select(F.explode(F.slice("features", 1, 5)).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@query(_TOKENS + """, p AS (SELECT *, regexp_extract(text, '^(.*?)[.,;:!?’]*$', 1) AS body, regexp_extract(text, '([.,;:!?’]*)$', 1) AS signs FROM t WHERE text <> ''),
q AS (SELECT *, list_filter(list_concat([body], CASE WHEN signs = '' THEN [] ELSE string_split(signs, '') END), lambda x: x <> '') AS parts FROM p),
s AS (SELECT *, coalesce(sum(len(parts) - 1) OVER (PARTITION BY doc_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM q)
SELECT doc_id, line, (word + shift + unnest(range(0, len(parts))))::BIGINT AS word, unnest(parts) AS text FROM s""")
def punct_split(spark, sf_dir):
    return sequences.split_punctuation(document_tokens(spark, sf_dir)).select("doc_id", F.col("line").cast("long").alias("line"), "word", "text")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a label stream: a user is a page, an event a token, its type the label's base; every third event starts a container."""
    start = F.when(F.col("event_id") % 3 == 0, "_start").otherwise("_inside")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.struct("ts", "event_id").alias("ord"), "event_id", F.concat("event_type", start).alias("label"))


_EVENTS = "WITH e AS (SELECT user_id AS seq, ts, event_id, event_type AS base, event_id % 3 = 0 AS s FROM events) "


@query(_EVENTS + "SELECT seq, event_id, base, (sum(CASE WHEN s OR p IS DISTINCT FROM base THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ts, event_id))::BIGINT AS container FROM (SELECT *, lag(base) OVER (PARTITION BY seq ORDER BY ts, event_id) AS p FROM e)")
def label_decode(spark, sf_dir):
    return sequences.decoded(event_labels(spark, sf_dir)).select("seq", "event_id", "base", "container")


@query(_EVENTS + "SELECT seq, event_id, segment FROM (SELECT seq, event_id, (sum(CASE WHEN base = 'click' AND s THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ts, event_id))::BIGINT AS segment FROM e) WHERE segment > 0")
def entry_segments(spark, sf_dir):
    return sequences.segments(event_labels(spark, sf_dir), "click_start").select("seq", "event_id", "segment")


@query(_EVENTS + "SELECT seq, string_agg(base || CASE WHEN s THEN '_start' ELSE '_inside' END, ' ' ORDER BY ts, event_id) AS labels, count(*) AS n FROM e GROUP BY 1")
def label_sequences(spark, sf_dir):
    rows = event_labels(spark, sf_dir).withColumn("features", F.array("label"))
    return sequences.sequences(rows, "seq").select("seq", F.array_join("labels", " ").alias("labels"), F.size("features").cast("long").alias("n"))


@query("SELECT user_id AS seq, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN event_type || '_start' ELSE event_type || '_inside' END AS label FROM events")
def start_inside_labels(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("seq"), "event_id", sequences.label_of_container(F.col("user_id"), F.col("event_type"), by).alias("label"))


@query("SELECT structure, count(*) AS n FROM (SELECT user_id, '1:' || string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS structure FROM events GROUP BY 1) GROUP BY 1")
def container_profile(spark, sf_dir):
    return discover.container_profile(_table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), F.lit(1).alias("level"), F.col("event_type").alias("name")))


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'ADJ' WHEN 'LARGE' THEN 'NOUN' ELSE p_type END AS p_type FROM part")
def pos_remap(spark, sf_dir):
    table = spark.createDataFrame([("SMALL", "ADJ"), ("LARGE", "NOUN")], "original string, mapped string")
    return catalog.remapped(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.broadcast(table), "p_type")


@query("SELECT quality::VARCHAR AS actual, toxic::VARCHAR AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return sequences.confusion(_table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH m AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT unnest(['0', '1']) AS label),
x AS (SELECT label, (SELECT count(*) FROM m WHERE a::VARCHAR = label) AS support, (SELECT count(*) FROM m WHERE b::VARCHAR = label) AS said, (SELECT count(*) FROM m WHERE a = b AND a::VARCHAR = label) AS hit FROM c),
y AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM x)
SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM y""")
def classification_report(spark, sf_dir):
    out = sequences.classification_report(confusion_matrix(spark, sf_dir))
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(regexp_extract(w, '[A-Za-z]'))), '') AS acronym FROM part")
def acronym(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.acronym(F.col("p_name")).alias("acronym"))


@query("SELECT p_partkey, replace(replace(p_brand, '#', '〇23〇'), ' ', '.') AS safe FROM part")
def id_fix(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.name_safe(F.col("p_brand")).alias("safe"))


@query("SELECT page_id, CASE WHEN strpos(url, 'example.') > 0 THEN substr(url, strpos(url, 'example.')) ELSE '' END AS tail FROM pages")
def url_tail(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "(example\\..*)$", 1).alias("tail"))


@query("SELECT o_custkey, body, count(*) AS n, min(o_orderkey) AS first, any_value(range_) AS range FROM (SELECT *, (k - 1) // 5 AS body, ((k - 1) // 5) * 5 + 1 || '-' || least(((k - 1) // 5) * 5 + 5, m) AS range_ FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)) GROUP BY 1, 2")
def preview_bodies(spark, sf_dir):
    rows = sequences.bodies(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 5, ["o_orderkey"], "o_custkey")
    return rows.groupBy("o_custkey", "body").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.first("range").alias("range"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) > round_even(0.75 * count(*) OVER (), 0) AS test FROM events")
def head_tail_split(spark, sf_dir):
    return sequences.head_tail_split(_table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "test")


@query("SELECT c_custkey, o_orderkey, c_name || '/' || o_orderkey AS display FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def datasets_with_mappings(spark, sf_dir):
    datasets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dsid"), F.col("c_name").alias("name"))
    maps = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dsid"), "o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    return catalog.datasets_with_mappings(datasets, maps).select(F.col("dsid").alias("c_custkey"), "o_orderkey", "display")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 0")
def delete_cascade(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("dsid"))
    return catalog.without_dataset(_table(spark, sf_dir, "orders").withColumn("dsid", F.col("o_custkey")), gone).select("o_orderkey")


@query("SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT event_type AS value FROM events)")
def label_vocabulary(spark, sf_dir):
    return sequences.vocabulary(_table(spark, sf_dir, "events"), "event_type")


@query("SELECT 'size' AS attribute, count(*) AS n FROM part")
def stripped_attributes(spark, sf_dir):
    return assemble.stripped_attributes(part_nodes(spark, sf_dir), ["id"])


@query("""WITH h AS (SELECT p_partkey, row_number() OVER (PARTITION BY replace(p_name, ' ', '.') ORDER BY p_partkey) AS n, replace(p_name, ' ', '.') AS hw, replace(p_type, ' ', '.') AS pos, p_name, p_type FROM part)
SELECT 'D_' || hw || '_' || n || '_' || pos AS xml_id, p_name AS headword, p_type AS pos, 0::BIGINT AS n_senses,
'<entry xml:id="D_' || hw || '_' || n || '_' || pos || '"><form type="lemma"><orth>' || p_name || '</orth></form><gramGrp><gram type="pos" orig="' || p_type || '">' || p_type || '</gram></gramGrp></entry>' AS tei FROM h""")
def tei_transform(spark, sf_dir):
    out = dictionary.dictionary_to_tei(part_nodes(spark, sf_dir), mapping.Mapping.of(PARTS), "dictionary")
    return out.select("xml_id", "headword", "pos", "n_senses", "tei")


@query("""WITH e AS (SELECT o_orderkey, 'D_' || replace(o_orderpriority, ' ', '.') || '_' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) || '_' || o_orderstatus AS xml_id, o_orderpriority AS headword FROM orders)
SELECT e.xml_id, headword, count(l_orderkey) AS n_senses FROM e LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def tei_senses(spark, sf_dir):
    x = lambda e: {"type": "simple", "selector": {"type": "xpath", "expr": e}, "attr": mapping.INNER_REC}
    spec = {"entry": {"type": "xpath", "expr": ".//order"}, "sense": {"type": "xpath", "expr": "line"}, "hw": x("hw"), "pos": x("pos"), "def": x(".//def")}
    nodes = order_nodes(spark, sf_dir)
    out = dictionary.dictionary_to_tei(nodes, mapping.Mapping.of(spec), "dictionary").select("xml_id", "headword", "n_senses")
    dropped(spark, [nodes], out)  # all that is needed of them is stored again
    return out


@query("""SELECT p_brand AS lemma, p_type AS pos, '<entry><form type="lemma"><orth>' || p_brand || '</orth></form><gramGrp><gram type="pos">' || p_type || '</gram></gramGrp>' || string_agg('<sense n="' || k || '"><def>' || p_name || '</def></sense>', '' ORDER BY k) || '</entry>' AS tei
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) AS k FROM part) GROUP BY p_brand, p_type""")
def csv_to_tei(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("pos"), F.col("p_name").alias("definition"))
    return dictionary.table_to_tei(rows)


@query("""SELECT r_regionkey AS id, '<teiHeader><fileDesc><titleStmt><title>' || r_name || '</title><author>A ' || r_name || '</author></titleStmt><publicationStmt><publisher></publisher><date when="2020"/></publicationStmt><sourceDesc><p>' || r_name || '</p></sourceDesc></fileDesc></teiHeader>' AS tei FROM region""")
def tei_header(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.array(F.concat(F.lit("A "), "r_name")).alias("creators"), F.array().cast("array<string>").alias("contributors"), none.alias("publisher"), none.alias("licence"), F.lit("2020").alias("created"), none.alias("identifier"), none.alias("extent"), none.alias("source"))
    return assemble.header(rows)


@query(_GEOGRAPHY + "SELECT 'customer' AS tag, 'nation' AS parent_tag, count(*) AS n FROM customer UNION ALL SELECT 'nation', 'region', count(*) FROM g UNION ALL SELECT 'region', NULL, count(*) FROM g UNION ALL SELECT 'name', 'nation', count(*) FROM g UNION ALL SELECT 'name', 'customer', count(*) FROM customer")
def content_model_errors(spark, sf_dir):
    return assemble.model_errors(geography_nodes(spark, sf_dir)).groupBy("tag", "parent_tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'hw,pos' AS roles FROM part")
def augmented_view(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    own = S.entries(nodes, PARTS["entry"])
    both = mapping.annotated(nodes, mapping.role_matches(nodes, mapping.Mapping.of(PARTS), own)).where("roles is not null")
    ids = own.select("doc_id", F.col("pre").alias("parent"), F.col("attrs")["id"].cast("long").alias("p_partkey"))
    each = both.select("doc_id", "parent", F.explode("roles").alias("r")).join(ids, ["doc_id", "parent"])
    return each.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("r.role")), ",").alias("roles"))


def entries_by_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a dictionary to TEI, entries and homonyms by part of speech."""
    return tei_transform(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("n"), F.count_distinct("headword").alias("heads"), F.max(F.length("tei")).alias("longest"))


QUERIES["entries_by_pos"] = entries_by_pos
ORACLE["entries_by_pos"] = f"SELECT pos, count(*) AS n, count(DISTINCT headword) AS heads, max(length(tei))::INTEGER AS longest FROM ({ORACLE['tei_transform']}) GROUP BY 1"


@query("SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_partkey // 500 UNION SELECT max(p_partkey) FROM part GROUP BY p_partkey // 500")
def xpath_position(spark, sf_dir):
    return S.select(part_nodes(spark, sf_dir), ".//entry[1] | .//entry[last()]").select(F.col("attrs")["id"].cast("long").alias("p_partkey"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_size::VARCHAR, '1') AND contains(p_partkey::VARCHAR, '7')")
def xpath_predicates(spark, sf_dir):
    return S.select(part_nodes(spark, sf_dir), ".//entry[starts-with(@size, '1')][contains(@id, '7')][not(@lang)]").select(F.col("attrs")["id"].cast("long").alias("p_partkey"))


@query("SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) <= 20")
def first_entries(spark, sf_dir):
    own = S.entries(part_nodes(spark, sf_dir), PARTS["entry"])
    return catalog.first_entries(own, 20, ["pre"]).select(F.col("attrs")["id"].cast("long").alias("p_partkey"))


_NUMBERED = ORACLE["tei_transform"].replace("SELECT 'D_'", "SELECT p_partkey // 500 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS k, 'D_'", 1)


@query(f"""SELECT doc_id, k, tei FROM ({_NUMBERED}) UNION ALL
SELECT DISTINCT p_partkey // 500, 0, '<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Part ' || p_partkey // 500 || '</title></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><p>Part ' || p_partkey // 500 || '</p></sourceDesc></fileDesc></teiHeader><text><body>' FROM part UNION ALL
SELECT p_partkey // 500, count(*) + 1, '</body></text></TEI>' FROM part GROUP BY 1""")
def tei_document(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    text, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    about = nodes.where("parent is null").select(F.col("doc_id").alias("id"), F.concat(F.lit("Part "), F.col("doc_id").cast("string")).alias("title"), texts.alias("creators"), texts.alias("contributors"), *[text.alias(c) for c in ("publisher", "licence", "created", "identifier", "extent", "source")])
    own = dictionary.dictionary_to_tei(nodes, mapping.Mapping.of(PARTS), "dictionary")
    parts = dictionary.tei_parts(nodes, own, assemble.header(about))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return parts.select("doc_id", k.cast("long").alias("k"), "tei")


@query("SELECT s_suppkey AS doc_id, '<seg>' || s_name || '!</seg>' AS tei FROM supplier")
def no_entry_fallback(spark, sf_dir):
    docs = _dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), T.element("d", F.concat(_tag("x", F.col("s_name")), F.lit("!"))).alias("raw"))
    nodes = stored(shred(docs))
    none = spark.createDataFrame([], "doc_id long, entry long, tei string")
    return dictionary.tei_parts(nodes, none, spark.createDataFrame([], "id long, tei string")).where("place = 0").select("doc_id", "tei")


@query("SELECT DISTINCT o_custkey::VARCHAR AS label FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def unseen_labels(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("label", F.col("o_custkey").cast("string"))
    return sequences.unseen_labels(rows.where("o_orderkey % 4 <> 0"), rows.where("o_orderkey % 4 = 0"))


@query("SELECT max(n) AS max_tokens, max(c) AS max_chars FROM (SELECT user_id, count(*) AS n, max(length(event_type)) AS c FROM events GROUP BY 1)")
def max_lengths(spark, sf_dir):
    return sequences.max_lengths(_table(spark, sf_dir, "events"), "user_id", "event_type")


@query("WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT p_brand AS value FROM part WHERE p_size < 10)) SELECT p_partkey, coalesce(id, 0) AS code FROM part LEFT JOIN v ON p_brand = value")
def token_codes(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    return sequences.coded(parts, "p_brand", sequences.vocabulary(parts.where("p_size < 10"), "p_brand")).select("p_partkey", "code")


@query("SELECT event_id AS orig_id, dense_rank() OVER (ORDER BY user_id) AS entry_n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sense_n FROM events")
def renumbered(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("old", F.col("event_id"))
    return sequences.renumbered(rows, "user_id", ["ts", "event_id"], "old").select("orig_id", "entry_n", "sense_n")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def dataset_errors(spark, sf_dir):
    datasets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dsid"), "c_name")
    return catalog.errors_with_datasets(_table(spark, sf_dir, "orders").withColumn("dsid", F.col("o_custkey")), datasets).select("o_orderkey", "c_name")


_CONTAINERS = _EVENTS + """, c AS (SELECT *, (sum(CASE WHEN s OR p IS DISTINCT FROM base THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ts, event_id))::BIGINT AS container
FROM (SELECT *, lag(base) OVER (PARTITION BY seq ORDER BY ts, event_id) AS p FROM e)) """


@query(_CONTAINERS + "SELECT DISTINCT t AS original, t AS mapped FROM (SELECT string_agg((event_id % 5)::VARCHAR, ' ' ORDER BY ts, event_id) AS t FROM c WHERE base = 'click' GROUP BY seq, container)")
def container_texts(spark, sf_dir):
    tokens = event_labels(spark, sf_dir).withColumn("text", (F.col("event_id") % 5).cast("string"))
    return sequences.container_texts(tokens, "click")


@query(_CONTAINERS + """SELECT seq, container, base, replace(rtrim(j, ','), '1', 'one') AS text, CASE WHEN ends_with(j, ',') THEN ',' ELSE '' END AS rest FROM
(SELECT seq, container, base, string_agg((event_id % 5)::VARCHAR || CASE WHEN event_id % 2 = 0 THEN ',' ELSE '' END, ' ' ORDER BY ts, event_id) AS j FROM c GROUP BY 1, 2, 3)""")
def clean_containers(spark, sf_dir):
    text = F.concat(F.lit(" "), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 2 == 0, ",").otherwise(""))
    return sequences.clean_containers(event_labels(spark, sf_dir).withColumn("text", text), {"1": "one"})


@query(_CONTAINERS + """, f AS (SELECT *, event_id % 2 AS b, lag(event_id % 2) OVER (PARTITION BY seq, container ORDER BY ts, event_id) AS q FROM c)
SELECT event_id, container AS level_1, (sum(CASE WHEN event_id % 5 = 0 OR q IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY seq, container ORDER BY ts, event_id))::BIGINT AS level_2, base AS base_1, 'x' || b AS base_2 FROM f""")
def nested_levels(spark, sf_dir):
    outer = event_labels(spark, sf_dir)
    inner = F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 5 == 0, "_start").otherwise("_inside"))
    levels = [outer.select("seq", "ord", "label"), outer.select("seq", "ord", inner.alias("label"))]
    return sequences.with_levels(outer.select("seq", "ord", "event_id"), levels).select("event_id", "level_1", "level_2", "base_1", "base_2")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def entries_of_file(spark, sf_dir):
    own = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("xfid"))
    return catalog.entries_of_file(own, _table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "xfid", "c_custkey").select("o_orderkey", "c_name")


@query(_GEOGRAPHY + """SELECT n_nationkey::BIGINT * 1000000000 + b AS doc_id, tag, id, row_number() OVER (PARTITION BY n_nationkey, b ORDER BY tag = 'nation', id) AS place FROM
(SELECT n_nationkey, b, 'nation' AS tag, n_nationkey AS id FROM g UNION ALL SELECT c_nationkey, c_custkey // 1000, 'customer', c_custkey FROM customer)""")
def exit_order(spark, sf_dir):
    own = S.in_exit_order(S.select(geography_nodes(spark, sf_dir), ".//nation | .//customer"))
    return own.select("doc_id", "tag", F.col("attrs")["id"].cast("long").alias("id"), "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_type, p_partkey) AS place FROM part")
def dictionary_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("lemma"), F.col("p_type").alias("pos"), F.col("p_partkey").alias("sense_id"))
    return sequences.in_dictionary_order(rows).select("p_partkey", "place")


@query("""SELECT 'hw' AS role, CASE WHEN regexp_extract(p_name, '^[a-z]+') <> p_name THEN 'part' ELSE 'consume' END AS strategy, count(*) AS n, count(*) AS entries FROM part WHERE regexp_matches(p_name, '^[a-z]+') GROUP BY 1, 2
UNION ALL SELECT 'pos', 'consume', count(*), count(*) FROM part""")
def match_statistics(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    spec = mapping.Mapping.of({**PARTS, "hw": {**PARTS["hw"], "rex": "^[a-z]+"}})
    return mapping.match_statistics(mapping.role_matches(nodes, spec, S.entries(nodes, spec.entry)))


@query("SELECT 'entry' AS element, 'size' AS attribute, p_size::VARCHAR AS value, count(*) AS n FROM part GROUP BY 3")
def stored_values(spark, sf_dir):
    known = spark.createDataFrame([("label", None, "old", 1)], "element string, attribute string, value string, n long")
    return catalog.stored_values(known, "entry", "size", discover.value_inventory(part_nodes(spark, sf_dir), ["entry"], "size", None))


@query(ORACLE["tag_graph"])
def graph_of_dataset(spark, sf_dir):
    graph = discover.tag_graph(geography_nodes(spark, sf_dir))
    own = catalog.graph_of(graph.withColumn("dsid", F.explode(F.array(F.lit(1), F.lit(2)))), 2)
    return own.select("tag", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query("""SELECT s_suppkey AS doc_id, 'entry' AS tag, 'entry' AS path, '' AS text, '' AS tail FROM supplier
UNION ALL SELECT s_suppkey, 'def', 'entry/def', 'p ' || s_name || ' (', '' FROM supplier
UNION ALL SELECT s_suppkey, 'gram', 'entry/def/gram', s_nationkey::VARCHAR, ' q' FROM supplier
UNION ALL SELECT s_suppkey, 'seg', 'entry/seg', s_name, ' ' FROM supplier
UNION ALL SELECT s_suppkey, 'dictScrap', 'entry/dictScrap', '', '' FROM supplier
UNION ALL SELECT s_suppkey, 'usg', 'entry/dictScrap/usg', 'u', '' FROM supplier""")
def stripped_scrap(spark, sf_dir):
    scrap = lambda *c: T.element("seg", F.concat(*c))
    name, lit = F.col("s_name"), F.lit
    note = T.element("def", F.concat(lit("p"), scrap(name, scrap(lit(" ("))), T.element("gram", F.col("s_nationkey").cast("string")), scrap(lit(" q"))))
    raw = T.element("entry", F.concat(note, scrap(name), scrap(lit(" ")), T.element("dictScrap", T.element("usg", lit("u")))))
    nodes = stored(shred(_dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), raw.alias("raw"))))
    return prune.unwrapped(nodes, prune.strippable(nodes)).select("doc_id", "tag", F.array_join("path", "/").alias("path"), "text", "tail")


from lexmill.plans import structure  # noqa: E402, F401  (registers its queries)
