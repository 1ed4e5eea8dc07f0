import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import assemble, mapping
from lexmill.operators import select as S
from lexmill.plans.dictionary import dictionary_to_tei
from lexmill.sources.xml import parse, shred

DOC = '<d><e l="hu"><hw>big <i>cat</i></hw>;<p v="n">noun</p><s><def>an animal</def><x>a big cat sat</x></s><def>loose</def><e><hw>big cat</hw><p>verb</p></e>rest</e></d>'


def x(expr):
    return {"type": "xpath", "expr": expr}


def simple(expr, attr=mapping.INNER_REC, **more):
    return {"type": "simple", "selector": x(expr), "attr": attr, **more}


SPEC = {"entry": x(".//e"), "sense": x("s"), "entry_lang": simple(".//e", "l"), "hw": simple("hw"), "pos": simple("p", xlat={"noun": "NOUN"}), "def": simple(".//def"), "ex": simple(".//x")}


@pytest.fixture(scope="module")
def nodes(spark):
    return shred(spark.createDataFrame([(1, DOC)], "doc_id long, raw string")).cache()


def test_values(spark, nodes):
    own = S.entries(nodes, SPEC["entry"])
    got = lambda t: sorted(tuple(r) for r in mapping.found(nodes, t, own).select("value", "matched", "final").collect())
    assert got(simple("hw", mapping.INNER)) == [("big ", "big ", "big "), ("big cat", "big cat", "big cat")]
    assert got(simple("hw")) == [("big cat", "big cat", "big cat")] * 2
    assert got(simple("p", "v", xlat={"n": "N"})) == [("n", "n", "N")]
    assert got(simple("hw", rex=r"(?P<first>\w+) (\w+)", rexGroup="first")) == [("big cat", "big", "big")] * 2
    assert got(simple("hw", rex="zzz")) == []
    assert got(simple("hw", rex="b", rexGroup=3)) == [("big cat", "", "")] * 2
    assert got({**simple("p"), "attr": mapping.CONSTANT, "const": "c"}) == [("c", "c", "c")] * 2
    assert got({"type": "union", "transformers": [simple("p", "v"), simple("p")]}) == [("n", "n", "n"), ("verb", "verb", "verb")]


def test_strategies_and_single_consumer(nodes):
    own = S.entries(nodes, SPEC["entry"])
    spec = mapping.Mapping.of({"entry": SPEC["entry"], "hw": simple("hw"), "def": simple("hw"), "note": simple("hw", rex="cat"), "usg": simple("p", "v")})
    found = {(r["role"], r["strategy"]) for r in mapping.role_matches(nodes, spec, own).collect()}
    assert found == {("def", "consume"), ("hw", "part"), ("note", "part"), ("usg", "sibling")}


def test_adoption_takes_each_element_once(nodes):
    adopters = S.select(nodes, ".//s").unionByName(S.select(nodes, ".//hw")).select("doc_id", "pre")
    rows = mapping.adopted(nodes, x("../def"), adopters).collect()
    assert len(rows) == 1


def test_json_round_trip_and_errors():
    assert json.loads(mapping.Mapping.of(json.dumps(SPEC)).to_json()) == SPEC
    exclude = {"type": "exclude", "left": x("a"), "right": x("b")}
    assert json.loads(mapping.Mapping.of({"entry": exclude, "hw": simple("hw")}).to_json())["entry"] == exclude
    for bad in ({"entry": {"type": "nope"}}, {"entry": x("a"), "zzz": simple("a")}):
        with pytest.raises(ValueError):
            mapping.Mapping.of(bad)


def test_tei(nodes):
    rows = dictionary_to_tei(nodes, mapping.Mapping.of(SPEC), "my dict", keep_scrap=True).orderBy("entry").collect()
    assert [(r["xml_id"], r["headword"], r["pos"], r["n_senses"]) for r in rows] == [("MD_big.cat_1_NOUN", "big cat", "NOUN", 2), ("MD_big.cat_2_verb", "big cat", "verb", 0)]
    tei = rows[0]["tei"]
    tags = [n["tag"] for n in parse(0, tei)]
    assert tags == ["entry", "form", "orth", "gramGrp", "gram", "sense", "def", "cit", "quote", "sense", "def", "dictScrap"]
    assert 'xml:lang="hu"' in tei and 'orig="noun"' in tei and "<sense xml:id=\"MD_big.cat_1_NOUN_1\">" in tei and "<dictScrap>; rest</dictScrap>" in tei


def test_numbers_count_senses_with_another_headword(spark):
    rows = spark.createDataFrame([("e1", "a", 1), ("e1", "b", 2), ("e1", "b", 3), ("e2", "b", 4), ("e2", "a", 5)], "entry string, hw string, pre int")
    got = sorted((r["entry"], r["hw"], r["pre"], r["n"]) for r in assemble.numbered(rows, ["pre"]).collect())
    assert got == [("e1", "a", 1, 1), ("e1", "b", 2, 1), ("e1", "b", 3, 1), ("e2", "a", 5, 2), ("e2", "b", 4, 2)]


def test_leftover_text_goes_left_but_for_the_first(spark):
    pieces = spark.createDataFrame([(1, 0, "a"), (1, 12, "b"), (1, 30, "c"), (2, 1, "d")], "doc_id int, at long, piece string")
    own = spark.createDataFrame([(1, 5, 10), (1, 15, 20)], "doc_id int, pre long, post long")
    assert sorted(tuple(r) for r in assemble.leftover_owners(pieces, own).select("piece", "owner", "side").collect()) == [("a", 5, "left"), ("b", 5, "right"), ("c", 15, "right"), ("d", None, "left")]


def test_header_of_every_subset_of_metadata(spark):
    names = ["title", "publisher", "licence", "created", "identifier", "extent", "source"]
    rows = [tuple([i] + [n if i >> k & 1 else None for k, n in enumerate(names)] + [["A <x>"] if i & 1 else [], None if i & 2 else ["B"]]) for i in range(1 << len(names))]
    frame = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} string" for n in names) + ", creators array<string>, contributors array<string>")
    import xml.etree.ElementTree as ET

    got = assemble.header(frame).collect()
    assert len(got) == 1 << len(names)
    for r in got:
        assert ET.fromstring(r["tei"]).find("fileDesc/sourceDesc/p") is not None


def test_content_model(spark):
    good = shred(spark.createDataFrame([(1, "<entry><form><orth/></form><sense><def/></sense></entry>"), (2, "<entry><def/><zzz/></entry>")], "doc_id long, raw string"))
    assert sorted((r["doc_id"], r["tag"], r["parent_tag"]) for r in assemble.model_errors(good).collect()) == [(2, "def", "entry"), (2, "zzz", "entry")]
    assert [tuple(r) for r in assemble.stripped_attributes(good.withColumn("attrs", F.create_map(F.lit("k"), F.lit("v"))), []).collect()] == [("k", 8)]


def test_named_groups_are_renamed_for_java():
    from lexmill.operators.mapping import java_pattern

    assert java_pattern(r"(?P<my_x>a+)-(?P=my_x)", "my_x") == (r"(?<g1>a+)-\k<g1>", 1)


def test_empty_attribute_values_are_told_apart(spark):
    from lexmill.operators.discover import value_inventory
    from lexmill.operators.select import steps_of

    assert steps_of(".//e[@a='']")[-1][2] == [("a", "")] and steps_of(".//e[@a]")[-1][2] == [("a", None)]
    rows = [("p", " noun ", {"k": " x"}), ("p", "noun", {"k": "x"}), ("p", " ", {"k": ""}), ("p", None, {})]
    nodes = spark.createDataFrame(rows, "tag string, text string, attrs map<string,string>")
    assert [tuple(r) for r in value_inventory(nodes, ["p"]).collect()] == [("noun", 2)]
    assert [tuple(r) for r in value_inventory(nodes, ["p"], "k").collect()] == [("x", 2)]


def test_quoted_line_breaks(spark, tmp_path):
    from lexmill.sources.tables import read_dictionary

    (tmp_path / "d.csv").write_text('lemma,pos,definition\na,NOUN,"two\nlines"\nb,VERB,"say ""hi"", now"\n')
    assert [tuple(r) for r in read_dictionary(spark, str(tmp_path / "d.csv")).orderBy("lemma").collect()] == [("a", "NOUN", "two\nlines"), ("b", "VERB", 'say "hi", now')]


def test_positions_unions_and_predicates(spark):
    nodes = shred(spark.createDataFrame([(1, '<d><e k="a/b"/><s><e/><e k="x|y"/><f k="ab"/></s><e/></d>')], "doc_id long, raw string"))
    got = lambda e: sorted(r["pre"] for r in S.select(nodes, e).collect())
    ids = {r["pre"]: r["tag"] for r in nodes.collect()}
    first, inner, second, f, last = sorted(p for p, tag in ids.items() if tag in "ef")
    assert got(".//e[1]") == [first, inner] and got(".//e[last()]") == [second, last] and got("./d/e[2]") == [last] and got(".//e[9]") == []
    assert got(".//e[@k][1]") == [first, second] and got(".//e[1][@k]") == [first]
    assert got(".//e[@k='a/b'] | .//e[@k='x|y'] | .//e[1]") == [first, inner, second]
    assert got(".//*[contains(@k, 'b')]") == [first, f] and got(".//*[starts-with(@k, 'x')]") == [second] and got(".//e[not(@k)]") == [inner, last]
    for bad in ("descendant::e[1]", ".//ancestor::e", "e[count(x)]", "e[1", "e[0]", "e[/x]", "text()/x", "e/@k[1]"):
        with pytest.raises(ValueError):
            S.steps_of(bad)


def test_whole_documents(spark, tmp_path):
    from xml.etree import ElementTree

    from lexmill.plans.dictionary import tei_parts, write_tei

    docs = spark.createDataFrame([(1, DOC), (2, "<d>no <b>entry</b> &amp; more</d>"), (3, None), (4, "<d/>")], "doc_id long, raw string")
    nodes = shred(docs).cache()
    own = dictionary_to_tei(nodes, mapping.Mapping.of(SPEC))
    parts = tei_parts(nodes, own, spark.createDataFrame([(1, "<teiHeader>h</teiHeader>")], "id long, tei string"))
    write_tei(parts, str(tmp_path / "tei"))
    whole = {d: "".join(p.read_text() for p in sorted((tmp_path / "tei" / f"doc_id={d}").glob("*.txt"))) for d in (1, 2, 4)}
    assert len(list((tmp_path / "tei").glob("doc_id=*"))) == 3  # a null document is none
    ns = "{http://www.tei-c.org/ns/1.0}"
    bodies = {d: ElementTree.fromstring(t.encode()).find(f"{ns}text/{ns}body") for d, t in whole.items()}
    assert [e.tag for e in bodies[1]] == [ns + "entry"] * 2 and "<teiHeader>h</teiHeader>" in whole[1]
    assert [(e.tag, e.text) for e in bodies[2]] == [(ns + "seg", "no entry & more")] and [e.text for e in bodies[4]] == [None]


def test_limits_and_errors(spark):
    from lexmill.operators import catalog

    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 7)], "doc_id long, pre long")
    assert sorted(map(tuple, catalog.first_entries(rows, 2, ["pre"]).collect())) == [(1, 0), (1, 1), (2, 7)] and catalog.first_entries(rows, 0, ["pre"]).count() == 0
    errors = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "dsid long, message string")
    assert [r["message"] for r in catalog.errors_with_datasets(errors, spark.createDataFrame([(1, "d")], "dsid long, name string")).collect()] == ["a"]


def test_pages(spark):
    from lexmill.operators import catalog

    rows = spark.createDataFrame([(f"n{i // 3}", i) for i in range(25)], "name string, id long").repartition(5)
    got = lambda page: [r["id"] for r in catalog.entry_page(rows, page, ["name", "id"], 10).collect()]
    want = [i for _, i in sorted((f"n{i // 3}", i) for i in range(25))]
    assert got(1) == want[:10] and got(2) == want[10:20] and got(3) == got(9) == got(0) == want[20:]
    first = catalog.page_after(rows, ["name", "id"], [], 10).collect()
    assert [r["id"] for r in first] == want[:10] and [r["id"] for r in catalog.page_after(rows, ["name", "id"], [first[-1]["name"], first[-1]["id"]], 10).collect()] == want[10:20]
    assert catalog.entry_page(rows.limit(0), 1, ["name", "id"]).count() == 0
