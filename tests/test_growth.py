"""What texts and senses of matches cost, and that odd selectors are still followed."""

from pyspark.sql import functions as F

from lexmill.operators import mapping
from lexmill.operators import select as S
from lexmill.plans.dictionary import dictionary_to_tei
from lexmill.sources.store import stored
from lexmill.sources.xml import shred


def nodes_of(spark, raw):
    return stored(shred(spark.createDataFrame([(1, raw)], "doc_id long, raw string")))


def leaf(path):
    return {"type": "simple", "selector": {"type": "xpath", "expr": path}, "attr": mapping.INNER_REC}


def test_elements_without_children_need_no_join_with_pieces_of_text(spark):
    nodes = nodes_of(spark, "<d><e><hw>a</hw><hw/></e><e><hw>b</hw></e></d>")
    found = mapping.found(nodes, leaf("hw"), S.select(nodes, ".//e"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["final"] for r in found.collect()) == ["", "a", "b"]
    mixed = nodes_of(spark, "<d><e><hw>a<i>b</i>c</hw></e><e><hw>d</hw></e></d>")
    assert sorted(r["final"] for r in mapping.found(mixed, leaf("hw"), S.select(mixed, ".//e")).collect()) == ["abc", "d"]


def test_a_sense_around_its_entry_still_holds_the_matches(spark):
    nodes = nodes_of(spark, "<d><s><e><hw>a</hw><def>x</def></e></s></d>")
    spec = mapping.Mapping.of({"entry": {"type": "xpath", "expr": ".//e"}, "sense": {"type": "xpath", "expr": ".."}, "hw": leaf("hw"), "def": leaf("def")})
    row = dictionary_to_tei(nodes, spec).select("n_senses", F.col("tei").contains("<def>x</def></sense>").alias("held")).collect()
    assert [tuple(r) for r in row] == [(1, True)]


SPEC = {"entry": {"type": "xpath", "expr": ".//e"}, "sense": {"type": "xpath", "expr": ".//s"}, "hw": leaf("hw"), "def": leaf(".//def")}


def test_columns_that_are_not_asked_for_are_not_dealt_out(spark):
    nodes = nodes_of(spark, "<d><e><hw>a</hw><s><def>x</def></s></e></d>")
    out = dictionary_to_tei(nodes, mapping.Mapping.of(SPEC)).select("xml_id", "headword", "n_senses")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "senses#" not in plan.replace("n_senses#", "") and "<def>" not in plan
    assert [tuple(r) for r in out.collect()] == [("D_a_1_pos", "a", 1)]


def test_only_elements_with_an_entry_s_name_are_looked_up_around_others(spark):
    nodes = nodes_of(spark, "<d><x><e><y><hw>a</hw></y></e></x></d>")
    own = S.entries(nodes, SPEC["entry"])
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in own.select("outermost", "is_top").collect()] == [(2, True)]
    assert S.names_of({"type": "xpath", "expr": ".//e[@k]/p:f | g"}) == {"f", "p:f", "g"} and S.names_of({"type": "xpath", "expr": "e/.."}) is None
    inside = nodes_of(spark, '<d xmlns:p="u"><p:e><e><e><hw>a</hw></e></e></p:e></d>')
    assert sorted(tuple(r) for r in S.entries(inside, SPEC["entry"]).select("pre", "outermost", "is_top").collect()) == [(2, 2, True), (3, 2, False)]
    found = mapping.found_all(inside, [leaf(".//hw")], S.entries(inside, SPEC["entry"]), tags={"e"})
    assert sorted((r["ctx"], r["final"]) for r in found.collect()) == [(2, "a"), (3, "a")]


def test_roles_of_different_elements_do_not_meet():
    assert not mapping.may_meet([leaf("hw"), leaf(".//def | x"), leaf("p:y")])
    assert mapping.may_meet([leaf("hw"), leaf(".//hw")]) and mapping.may_meet([leaf("hw"), leaf("*")]) and mapping.may_meet([leaf("p:y"), leaf("y")])
    assert not mapping.may_meet([leaf("*")])


def test_matches_go_to_the_nearest_sense_that_is_open(spark):
    nodes = nodes_of(spark, "<d><e><hw>a</hw><s><def>1</def><s><s/><def>2</def></s><g><def>3</def></g></s><def>4</def><s><def>5</def></s><g><s><def>6</def></s><def>7</def></g></e><e><def>8</def></e></d>")
    rows = dictionary_to_tei(nodes, mapping.Mapping.of(SPEC)).orderBy("entry").collect()
    inside = [[part.partition("</sense>")[0].partition(">")[2] for part in r["tei"].split("<sense")[1:]] for r in rows]
    texts = [["".join(c for c in x if c.isdigit()) for x in own] for own in inside]
    assert texts == [["13", "2", "", "4", "5", "6", "7"], ["8"]] and [r["n_senses"] for r in rows] == [7, 1]
