"""Paths with namespaces, text, attributes, siblings and tests, held against a walk over the parsed tree."""

import pytest

from lexmill.operators import mapping
from lexmill.operators import select as S
from lexmill.sources.xml import document_parts, parse
from tests.test_prune import nodes_of

DOC = '<d xmlns:t="urn:t"><t:b t:k="1" k="2">x</t:b><b k="1">y</b><s xmlns="urn:s"><b>z</b><t:b xmlns:t="urn:u">w</t:b><q:b>v</q:b></s></d>'


@pytest.fixture(scope="module")
def nodes(spark):
    return nodes_of(spark, DOC).cache()


def texts(rows):
    return sorted(r["text"] for r in rows.collect())


def test_names_and_scopes():
    rows = {r["text"]: r for r in parse(0, DOC) if r["text"]}
    assert [(rows[c]["tag"], rows[c]["prefix"], rows[c]["ns"]) for c in "xyzwv"] == [("b", "t", "urn:t"), ("b", "", ""), ("b", "", "urn:s"), ("b", "t", "urn:u"), ("q:b", "", "")]
    assert dict(rows["x"]["attrs"]) == {"{urn:t}k": "1", "k": "2"} and dict(rows["w"]["scope"]) == {"t": "urn:u", "": "urn:s"}


def test_prefixes(nodes):
    got = lambda path, names=None: texts(S.select(nodes, path, None, names))
    assert got(".//b") == ["y", "z"] and got(".//t:b") == ["w", "x"] and got(".//t:b", {"t": "urn:t"}) == ["x"] and got(".//o:b", {"o": "urn:u"}) == ["w"]
    assert got(".//o:b") == [] and got(".//*:b") == ["w", "x", "y", "z"] and got(".//t:*", {"t": "urn:s"}) == ["", "z"] and got(".//q:b") == ["v"]
    assert got(".//*[@t:k='1']") == ["x"] and got(".//*[@o:k]", {"o": "urn:t"}) == ["x"] and got(".//*[@k='1']") == ["y"] and got(".//t:b[not(@t:k)]") == ["w"]
    selector = {"type": "union", "selectors": [{"type": "xpath", "expr": ".//o:b", "namespaces": {"o": "urn:t"}}, {"type": "xpath", "expr": ".//b"}]}
    assert texts(S.selected(nodes, selector)) == ["x", "y", "z"] and S.namespaces_of(selector) == {"o": "urn:t"}
    part = {"type": "simple", "selector": selector["selectors"][0], "attr": "o:k"}
    assert [r["value"] for r in mapping.found(nodes, part).collect()] == ["1"]
    assert texts(S.preview_entries(nodes, "t:b", 1)) == ["x"] and texts(S.preview_entries(nodes, "b")) == ["y", "z"]


TREE = '<d><e i="1"><h>a b</h><p>n</p><s>1<x>2</x>3</s></e><e i="2"><p>v</p><h>c</h></e><e i="3">t<u/><h>a</h>r</e></d>'


def test_text_attributes_and_siblings(spark):
    nodes = nodes_of(spark, TREE).cache()
    value = lambda path: [r["value"] for r in S.values(nodes, path).orderBy("at", "value").collect()]
    assert value(".//h/text()") == ["a b", "c", "a"] and value("./d/e/@i") == ["1", "2", "3"] and value(".//@i | .//p/text()") == ["1", "n", "2", "v", "3"]
    assert value(".//s/text()") == ["1", "3"] and value(".//s//text()") == ["1", "2", "3"] and value(".//e/@*") == ["1", "2", "3"] and value(".//u/text()") == []
    names = lambda path: [r["tag"] + r["text"] for r in S.select(nodes, path).orderBy("pre").collect()]
    assert names(".//p/following-sibling::*") == ["s1", "hc"] and names(".//h/preceding-sibling::*") == ["pv", "u"]
    assert names(".//s/preceding-sibling::*[1]") == ["pn"] and names(".//s/preceding-sibling::*[last()]") == ["ha b"] and names(".//h/following-sibling::p") == ["pn"]
    assert names("./d/descendant-or-self::h") == ["ha b", "hc", "ha"]
    for bad in (".//h/text()", ".//e/@i"):
        with pytest.raises(ValueError):
            S.select(nodes, bad)
    with pytest.raises(ValueError):
        S.values(nodes, ".//h")
    for bad in ("e/text()/x", "@i/x", "following-sibling::e[1][@i]", "e[count(@i)]", "e[position()<2]", "text()[1]"):
        with pytest.raises(ValueError):
            S.steps_of(bad)


def test_tests_of_children_and_text(spark):
    nodes = nodes_of(spark, TREE).cache()
    ids = lambda test: [r["attrs"]["i"] for r in S.select(nodes, f".//e{test}").orderBy("pre").collect()]
    assert ids("[s]") == ["1"] and ids("[not(s)]") == ["2", "3"] and ids("[s/x]") == ["1"] and ids("[h='a']") == ["3"] and ids("[h!='a']") == ["1", "2"]
    assert ids("[contains(h, 'a')]") == ["1", "3"] and ids("[starts-with(s, '12')]") == ["1"] and ids("[text()='r']") == ["3"] and ids("[contains(text(), 'r')]") == []
    assert ids("[@i='1' or h='c']") == ["1", "2"] and ids("[p and not(s)]") == ["2"] and ids("[(@i='1' or @i='2') and p='v']") == ["2"] and ids("[@i='2' or @i='3' and p]") == ["2"]
    assert ids("[.='ta' or .='tar']") == ["3"] and ids("[h/text()='c']") == ["2"] and ids("[u/following-sibling::h]") == ["3"] and ids("[position()=2]") == ["2"] and ids("[p][last()]") == ["2"]
    assert ids("[@i!='1']") == ["2", "3"] and ids("[h='a or b']") == [] and ids("[../e]") == ["1", "2", "3"] and ids("[@*]") == ["1", "2", "3"]


def test_documents_are_written_as_they_were(spark):
    whole = ['<d xmlns="urn:d" xmlns:t="urn:t" a="&lt;1&gt;"><t:b t:k="1" xml:lang="en">x &amp; y</t:b>tail<s><u xmlns:v="urn:v" v:w="2"></u></s></d>', "<e>only</e>", "<e></e>"]
    rows = document_parts(nodes_of(spark, *whole)).collect()
    assert ["".join(r["tei"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["place"])) for i in range(3)] == whole
