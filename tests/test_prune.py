import re

from lexmill.operators import catalog, prune, sequences
from lexmill.operators import select as S
from lexmill.sources.tables import read_dictionary, write_dictionary, write_log
from lexmill.sources.xml import shred


def nodes_of(spark, *texts):
    return shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw string"))


def markup(rows):
    """The node table's rows of one document as markup."""
    inside = {}
    for r in sorted(rows, key=lambda r: r["pre"]):
        inside.setdefault(r["parent"], []).append(r)

    def written(r):
        return f"<{r['tag']}>{r['text']}{''.join(map(written, inside.get(r['pre'], [])))}</{r['tag']}>{r['tail']}"

    return "".join(map(written, inside.get(None, [])))


def stripped(spark, *texts):
    nodes = nodes_of(spark, *texts)
    rows = prune.unwrapped(nodes, prune.strippable(nodes)).collect()
    return [markup([r for r in rows if r["doc_id"] == i]) for i in range(len(texts))]


def test_scrap_goes_where_its_text_may_stay(spark):
    cases = {
        "<seg>a<seg>b</seg></seg>": "<seg>a b</seg>",  # the document element stays
        "<sense><seg>a</seg></sense>": "<sense><seg>a</seg></sense>",
        "<sense><seg> </seg>x</sense>": "<sense> x</sense>",
        "<def><seg><seg>a</seg>b</seg>c</def>": "<def>a b c</def>",
        "<def><seg>a<cit>q</cit></seg></def>": "<def><seg>a<cit>q</cit></seg></def>",
        "<def>x<gram>g</gram><seg>y</seg>z</def>": "<def>x<gram>g</gram>y z</def>",
        "<entry/>": "<entry></entry>",
    }
    assert stripped(spark, *cases) == list(cases.values())


def test_unwrapping_keeps_text_and_structure(spark):
    text = "<d><a>1<b>2<c>3</c>4</b>5</a>6<b><b>7</b></b><c>8</c></d>"
    nodes = nodes_of(spark, text)
    of = nodes.where("tag = 'b' or tag = 'd'")
    rows = prune.unwrapped(nodes, of.unionByName(of), spaced=False).collect()  # repeated rows are one
    assert markup(rows) == "<d><a>12<c>3</c>45</a>67<c>8</c></d>"
    assert {(r["tag"], r["depth"], r["sib"], tuple(r["path"]), len(r["ancestors"])) for r in rows} == {("d", 0, 0, ("d",), 0), ("a", 1, 0, ("d", "a"), 1), ("c", 2, 0, ("d", "a", "c"), 2), ("c", 1, 1, ("d", "c"), 1)}
    plain = lambda x: re.sub(r"<[^>]*>", "", x)
    assert plain(markup(rows)) == plain(text)
    assert markup(prune.unwrapped(nodes, nodes.where("false")).collect()) == text
    empty = nodes.where("false")
    assert prune.unwrapped(empty, empty).count() == 0 and prune.strippable(empty).count() == 0


def test_entries_of_files_with_other_types(spark):
    own = spark.createDataFrame([(1, "7"), (2, " 8 "), (3, "x"), (4, None)], "id int, xfid string")
    files = spark.createDataFrame([(7, "a"), (8, "b"), (None, "c")], "fid int, name string")
    assert [tuple(r) for r in catalog.entries_of_file(own, files, "xfid", "fid").select("id", "name").orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_stored_values_are_not_found_again(spark):
    known = spark.createDataFrame([("e", None, "v", 2)], "element string, attribute string, value string, n long")
    fails = spark.createDataFrame([("w", 1)], "value string, n long").selectExpr("value", "raise_error('computed') as n")
    assert [tuple(r) for r in catalog.stored_values(known, "e", None, fails).collect()] == [("e", None, "v", 2)]
    now = spark.createDataFrame([("w", 1)], "value string, n long")
    assert [tuple(r) for r in catalog.stored_values(known, "e", "a", now).collect()] == [("e", "a", "w", 1)]


def test_containers_as_texts(spark):
    rows = [(1, 1, "pos_start", "a"), (1, 2, "pos_inside", "b;"), (1, 3, "pos_start", None), (1, 4, "hw_start", "x"), (2, 1, "pos_inside", "a"), (2, 2, "pos_inside", "b;")]
    tokens = spark.createDataFrame(rows, "seq int, ord int, label string, text string")
    assert [tuple(r) for r in sequences.container_texts(tokens, "pos").collect()] == [("a b;", "a b;")]
    clean = sequences.clean_containers(tokens, {"a": "A"}).orderBy("seq", "container").collect()
    assert [(r["base"], r["text"], r["rest"]) for r in clean] == [("pos", "A b", ";"), ("pos", "", ""), ("hw", "x", ""), ("pos", "A b", ";")]
    levels = sequences.with_levels(tokens.select("seq", "ord"), [tokens.where("seq = 1").select("seq", "ord", "label")]).orderBy("seq", "ord").collect()
    assert [r["level_1"] for r in levels] == [1, 1, 2, 3, None, None]


def test_order_of_ends(spark):
    own = S.select(nodes_of(spark, "<d><e><e/></e><e/></d>"), ".//e")
    assert [r["place"] for r in S.in_exit_order(own).orderBy("pre").collect()] == [2, 1, 3]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb", 'say "hi", now', "x"), ("c", "n", " y ")], "lemma string, definition string, pos string")
    write_dictionary(rows, f"{tmp_path}/d.csv")
    assert sorted(map(tuple, read_dictionary(spark, f"{tmp_path}/d.csv").select("lemma", "definition", "pos").collect())) == sorted(map(tuple, rows.collect()))
    write_log(rows, f"{tmp_path}/log")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(lines) == 2 and all(x.startswith('{"definition":') for x in lines)
