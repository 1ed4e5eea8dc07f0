"""Content models: the schema compiler against a backtracking matcher, and errors with their places."""

import random

import pytest

from lexmill.operators import models
from lexmill.sources.schema import after, compiled, nullable
from lexmill.sources.xml import parse, shred
from tests.test_prune import nodes_of

NS = 'xmlns="http://relaxng.org/ns/structure/1.0"'


def grammar(body, *names):
    leaves = "".join(f'<define name="{n}"><element name="{n}"><empty/></element></define>' for n in names)
    return f'<grammar {NS}><define name="top"><element name="top">{body}</element></define>{leaves}</grammar>'


def ref(n):
    return f'<ref name="{n}"/>'


def matches(kind, names):
    """All ways in which a random pattern (nested tuples) can use up names."""
    if kind[0] == "ref":
        return {1} if names[:1] == [kind[1]] else set()
    if kind[0] == "empty":
        return {0}
    if kind[0] == "choice":
        return set().union(*(matches(k, names) for k in kind[1:]))
    if kind[0] == "optional":
        return {0} | matches(kind[1], names)
    if kind[0] in ("zeroOrMore", "oneOrMore"):
        done, new = set(), matches(kind[1], names)
        while new:
            done |= new
            new = {a + b for a in new for b in matches(kind[1], names[a:])} - done
        return done | ({0} if kind[0] == "zeroOrMore" else set())
    ends = {0}
    for k in kind[1:]:
        ends = {a + b for a in ends for b in matches(k, names[a:])}
    return ends


def random_pattern(r, depth=0):
    kind = r.choice(["ref", "ref", "choice", "optional", "zeroOrMore", "oneOrMore", "group"] if depth < 3 else ["ref"])
    if kind == "ref":
        return ("ref", r.choice("abc"))
    if kind in ("optional", "zeroOrMore", "oneOrMore"):
        return (kind, random_pattern(r, depth + 1))
    return (kind, *[random_pattern(r, depth + 1) for _ in range(r.randint(1, 3))])


def written(p):
    return ref(p[1]) if p[0] == "ref" else f"<{p[0]}>{''.join(map(written, p[1:]))}</{p[0]}>"


def test_automata_match_what_the_patterns_match():
    r = random.Random(1)
    for _ in range(150):
        p = random_pattern(r)
        model = compiled(grammar(written(p), "a", "b", "c"))["top"]
        for _ in range(20):
            names = [r.choice("abc") for _ in range(r.randint(0, 5))]
            state = 0
            for n in names:
                state = model.steps[state].get(n) if state is not None else None
            assert (state is not None and model.final[state]) == (len(names) in matches(p, names)), (p, names)


def test_interleaved_and_repeated_definitions():
    model = compiled(grammar(f"<interleave>{ref('a')}<zeroOrMore>{ref('b')}</zeroOrMore></interleave>", "a", "b"))["top"]
    run = lambda names: [s := 0, *[s := model.steps[s].get(n, -1) if s >= 0 else -1 for n in names]][-1]
    assert [model.final[run(x)] for x in ("a", "bab", "abb", "b", "")] == [True, True, True, False, False] and run("aa") == -1
    two = f'<grammar {NS}><define name="m" combine="choice">{ref("a")}</define><define name="m" combine="choice">{ref("b")}</define><define name="t"><element name="top"><oneOrMore>{ref("m")}</oneOrMore></element></define>'
    two += "".join(f'<define name="{n}"><element name="{n}"><mixed><empty/></mixed></element></define>' for n in "ab") + "</grammar>"
    made = compiled(two)
    assert made["top"].free and set(made["top"].steps[0]) == {"a", "b"} and made["a"].text and not made["top"].text
    with pytest.raises(ValueError):
        compiled(f'<grammar {NS}><define name="x">{ref("x")}</define><start><element name="e">{ref("x")}</element></start></grammar>')
    assert nullable(("empty",)) and after(("text",), "a") == ("never",)


SCHEMA = f"""<grammar {NS}><define name="e"><element name="e"><attribute name="xml:id"/><optional><attribute name="n"/></optional>{ref('h')}<zeroOrMore>{ref('s')}</zeroOrMore><optional>{ref('t')}</optional></element></define>
<define name="h"><element name="h"><text/></element></define><define name="s"><element name="s"><zeroOrMore><choice>{ref('s')}{ref('t')}</choice></zeroOrMore></element></define>
<define name="t"><element name="t"><oneOrMore><choice>{ref('t')}{ref('h')}</choice></oneOrMore></element></define></grammar>"""


def test_errors_and_their_places(spark):
    cases = {
        '<e xml:id="1"><h>x</h><s><s/></s><t><h/></t></e>': set(),
        "<e><h/></e>": {("e", "attribute", None, "xml:id")},
        '<e xml:id="1"><s/><h/></e>': {("e", "child", 1, "s")},
        '<e xml:id="1"><h/><t><h/></t><s/><h/></e>': {("e", "child", 3, "s")},
        '<e xml:id="1"/>': {("e", "end", 0, None)},
        '<e xml:id="1"><h/><s>text<h/> <h/></s></e>': {("s", "text", None, None), ("s", "child", 1, "h"), ("s", "child", 2, "h")},
        '<e xml:id="1"><h/><t/><zzz/></e>': {("e", "child", 3, "zzz"), ("t", "end", 0, None), ("zzz", "unknown", None, "zzz")},
    }
    nodes = nodes_of(spark, *cases)
    found = models.content_errors(nodes, compiled(SCHEMA)).collect()
    assert [{(r["tag"], r["kind"], r["place"], r["name"]) for r in found if r["doc_id"] == i} for i in range(len(cases))] == list(cases.values())
    assert next(r["message"] for r in found if r["kind"] == "unknown").endswith(":ERROR:unknown:no element zzz")
    assert models.content_errors(nodes.where("false"), compiled(SCHEMA)).count() == 0
    assert models.content_errors(nodes, {}).where("kind <> 'unknown'").count() == 0


def test_foreign_attributes_go(spark):
    nodes = shred(spark.createDataFrame([(1, '<e xmlns:m="urn:m" xmlns:t="http://www.tei-c.org/ns/1.0" xml:id="i" n="1" m:k="2" t:q="3"/>')], "doc_id long, raw string"))
    attrs = models.without_foreign_attributes(nodes).collect()[0]["attrs"]
    assert attrs == {"xml:id": "i", "n": "1", "{http://www.tei-c.org/ns/1.0}q": "3"}
    assert parse(1, "<e a:b='1'/>")[0]["attrs"] == [("a:b", "1")]  # an undeclared prefix is part of the name


def test_a_file_of_many_small_documents_is_parsed_by_many_tasks(spark, tmp_path):
    from lexmill.plans.queries import _dealt

    spark.range(400_000).selectExpr("id AS p_partkey", "repeat('x', 40) || id AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() == 1
    assert _dealt(spark, str(tmp_path), "part", "p_partkey").rdd.getNumPartitions() > 1
