"""Moves of subtrees, legal parents, thorough stripping and text conservation, on small and on random trees."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import assemble, mapping, moves, pieces, prune
from lexmill.operators import select as S
from lexmill.plans.dictionary import dictionary_to_tei, leftover
from lexmill.sources.xml import parse
from tests.test_prune import markup, nodes_of

ENTRY = {"type": "xpath", "expr": ".//entry"}


def x(expr):
    return {"type": "xpath", "expr": expr}


def simple(expr, attr=mapping.INNER_REC, **more):
    return {"type": "simple", "selector": x(expr), "attr": attr, **more}


def random_tree(r, tags, depth=0, root="entry"):
    text = lambda: "".join(r.choice("abc 12") for _ in range(r.randint(0, 4)))
    kids = "".join(random_tree(r, tags, depth + 1, None) + text() for _ in range(r.randint(0, 3 if depth < 4 else 0)))
    tag = root or r.choice(tags)
    return f"<{tag}>{text()}{kids}</{tag}>"


def consistent(rows, text_too=None):
    """The rows are a node table: ticks, chains, places and paths agree."""
    by = {r["pre"]: r for r in rows}
    assert len(by) == len(rows)
    places = {}
    for r in sorted(rows, key=lambda r: r["pre"]):
        assert r["pre"] < r["post"] and r["depth"] == len(r["ancestors"]) and len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["tag"]
        assert r["parent"] == (r["ancestors"][-1] if r["ancestors"] else None)
        if r["parent"] is not None:
            up = by[r["parent"]]
            assert up["pre"] < r["pre"] and r["post"] < up["post"] and up["ancestors"] + [up["pre"]] == r["ancestors"] and up["path"] == r["path"][:-1]
        assert r["sib"] == places.get(r["parent"], 0)
        places[r["parent"]] = r["sib"] + 1


def of_document(rows, i):
    return [r for r in rows if r["doc_id"] == i]


def plain(text):
    return re.sub(r"<[^>]*>", "", text)


def test_adoption_moves_subtrees(spark):
    cases = [
        ("<d><entry>0<s>a<p/>b</s>1<q>c<r>d</r></q>2</entry>t</d>", [("p", "q")], "<d><entry>0<s>a<p><q>c<r>d</r></q></p>b</s>12</entry>t</d>"),
        ("<d><entry><q>c</q>1<s><p/></s>2</entry></d>", [("p", "q")], "<d><entry>1<s><p><q>c</q></p></s>2</entry></d>"),
        ("<d><entry><q/>1<r/>2<s/>3</entry></d>", [("s", "q"), ("s", "r")], "<d><entry>12<s><q></q><r></r></s>3</entry></d>"),
        ("<d><entry><a><b/></a><c/></entry></d>", [("b", "a"), ("c", "a")], "<d><entry><c><a><b></b></a></c></entry></d>"),  # b inside a can't adopt it
        ("<d><entry><a/><b/></entry></d>", [("a", "b"), ("b", "a")], "<d><entry><a><b></b></a></entry></d>"),  # no cycle
        ("<d><entry><a/></entry><entry><b/></entry></d>", [("a", "b")], "<d><entry><a></a></entry><entry><b></b></entry></d>"),  # not from another entry
    ]
    nodes = nodes_of(spark, *[c[0] for c in cases]).cache()
    pre = {(r["doc_id"], r["tag"]): r["pre"] for r in nodes.collect()}
    pairs = spark.createDataFrame([(i, pre[i, a], pre[i, b]) for i, (_, own, _) in enumerate(cases) for a, b in own], "doc_id long, adopter long, adoptee long")
    found = moves.adoptions(nodes, pairs, S.entries(nodes, ENTRY).where("is_top"))
    rows = moves.moved(nodes, found).collect()
    for i, (_, _, want) in enumerate(cases):
        consistent(of_document(rows, i))
        assert markup(of_document(rows, i)) == want
    none = moves.moved(nodes, found.where("false"))
    assert [markup(of_document(none.collect(), i)) for i in range(len(cases))] == [markup(of_document(nodes.collect(), i)) for i in range(len(cases))]


def test_random_adoptions_keep_text_and_elements(spark):
    r = random.Random(5)
    texts = ["<d>" + random_tree(r, "abcdef") + "x" + random_tree(r, "abcdef") + "</d>" for _ in range(25)]
    nodes = nodes_of(spark, *texts).cache()
    rows = nodes.collect()
    pairs = []
    for i in range(len(texts)):
        own = [n["pre"] for n in of_document(rows, i)]
        pairs += [(i, a, r.choice(own)) for a in r.sample(own, min(len(own), 6))]
    first = {}
    for i, a, b in sorted(pairs):
        first.setdefault((i, b), a)
    frame = spark.createDataFrame([(i, a, b) for (i, b), a in first.items()], "doc_id long, adopter long, adoptee long")
    after = moves.moved(nodes, moves.adoptions(nodes, frame, S.entries(nodes, ENTRY).where("is_top"))).collect()
    changed = 0
    for i, text in enumerate(texts):
        own = of_document(after, i)
        consistent(own)
        assert sorted(n["tag"] for n in own) == sorted(n["tag"] for n in of_document(rows, i))
        assert sorted(plain(markup(own))) == sorted(plain(text))
        changed += markup(own) != markup(of_document(rows, i))
    assert changed > 10


def test_a_mapping_with_adoption_runs(spark):
    spec = {"entry": ENTRY, "sense": x("sense"), "hw": simple("hw"), "def": simple(".//def", adoptSelector=x("../following-sibling::ex")), "ex": simple("ex | sense/ex")}
    doc = "<d><entry><hw>h</hw><sense><def>one</def></sense><sense><def>two</def></sense><ex>e</ex></entry></d>"
    tei = dictionary_to_tei(nodes_of(spark, doc), mapping.Mapping.of(spec), keep_scrap=True).collect()[0]["tei"]
    first, second = re.findall(r"<sense.*?</sense>", tei)
    assert "<def>one</def><cit" in first and "<quote>e</quote>" in first and "quote" not in second and "dictScrap" not in tei
    without = {**spec, "def": simple(".//def")}
    tei = dictionary_to_tei(nodes_of(spark, doc), mapping.Mapping.of(without)).collect()[0]["tei"]
    assert tei.index("<cit") < tei.index("<sense")


def test_climbing_leaves_no_errors(spark):
    r = random.Random(7)
    tags = ["seg", "ref", "def", "orth", "gram", "cit", "sense", "dictScrap", "note", "gloss", "usg", "xr", "form", "gramGrp", "quote", "zzz", "body"]
    texts = [random_tree(r, tags) for _ in range(30)]
    nodes = nodes_of(spark, *texts).cache()
    assert assemble.model_errors(nodes).count() > 50
    after = moves.legalised(nodes).cache()
    assert assemble.model_errors(after).collect() == []
    rows = after.collect()
    for i, text in enumerate(texts):
        consistent(of_document(rows, i))
        assert sorted(plain(markup(of_document(rows, i)))) == sorted(plain(text))


def test_nearest_legal_parent(spark):
    cases = {
        "<entry><sense><def>a<sense>b</sense>c</def>d</sense></entry>": "<entry><sense><def>ac</def><sense>b</sense>d</sense></entry>",
        "<entry><def>a</def></entry>": "<entry><dictScrap><def>a</def></dictScrap></entry>",
        "<entry><seg>a<note>n</note></seg>t</entry>": "<entry><dictScrap>a<note>n</note></dictScrap>t</entry>",
        "<entry><form><zzz>q</zzz>r</form></entry>": "<entry><form>r</form><dictScrap>q</dictScrap></entry>",
        "<entry/>": "<entry></entry>",
    }
    rows = moves.legalised(nodes_of(spark, *cases)).collect()
    assert [markup(of_document(rows, i)) for i in range(len(cases))] == list(cases.values())


# ------------------------------------------------------------------ thorough stripping


def thorough_by_force(text, level):
    """Recursion on a tree of lists: [tag, text, children, tail]."""
    rows = parse(0, text)
    made = {r["pre"]: [r["tag"], r["text"], [], r["tail"]] for r in rows}
    for r in rows:
        if r["parent"] is not None:
            made[r["parent"]][2].append(made[r["pre"]])
    root = made[0]
    seam = lambda a, b: a + (" " if a and b and not a[-1].isspace() and not b[0].isspace() else "") + b

    def clean(node):
        for kid in node[2]:
            clean(kid)
        kept = []
        put = lambda t: kept[-1].__setitem__(3, seam(kept[-1][3], t)) if kept else node.__setitem__(1, seam(node[1], t))
        for kid in node[2]:
            says = bool(kid[1].strip()) or any(g[3].strip() for g in kid[2])
            legal = all(g[0] in assemble.PARENTS and node[0] in assemble.PARENTS[g[0]] for g in kid[2])
            scrap = kid[0] in prune.SCRAP
            if scrap and level == 3 and not kid[2] and node[0] != "xr":
                put(kid[3])
            elif scrap and legal and not (says and node[0] not in prune.TEXTUAL):
                put(kid[1])
                kept += kid[2]
                put(kid[3])
            else:
                kept.append(kid)
        node[2] = kept

    clean(root)
    written = lambda n: f"<{n[0]}>{n[1]}{''.join(map(written, n[2]))}</{n[0]}>{n[3]}"
    return written(root)


@pytest.mark.parametrize("level", [2, 3])
def test_thorough_stripping(spark, level):
    r = random.Random(level)
    tags = ["seg", "seg", "dictScrap", "def", "sense", "note", "xr", "cit", "quote"]
    texts = ["<xr><seg>a</seg>b</xr>", "<entry><seg> <seg> </seg></seg></entry>", "<def>x<seg>y<note>z</note>w</seg>v</def>", "<entry/>"] + [random_tree(r, tags, root=r.choice(tags)) for _ in range(40)]
    nodes = nodes_of(spark, *texts).cache()
    rows = prune.stripped(nodes, level).collect()
    squeezed = lambda t: re.sub(r"\s+", " ", t)
    for i, text in enumerate(texts):
        consistent(of_document(rows, i))
        assert squeezed(markup(of_document(rows, i))) == squeezed(thorough_by_force(text, level)), text
    assert prune.stripped(nodes.where("false"), level).count() == 0
    with pytest.raises(ValueError):
        prune.thorough(nodes, 4)


# ------------------------------------------------------------------ spans of text


def test_a_match_takes_its_characters_alone(spark):
    doc = '<d>out<entry k="v"><hw>big <i>do</i>g</hw>, <p>n.</p></entry>mid<entry><hw>cat</hw></entry>end</d>'
    spec = mapping.Mapping.of({"entry": ENTRY, "hw": simple("hw", rex="^[^ ]+ (d)", rexGroup=1), "pos": simple("p", rex="[a-z]+"), "usg": simple(".", "k")})
    nodes = nodes_of(spark, doc).cache()
    own = S.entries(nodes, ENTRY)
    matches = mapping.role_matches(nodes, spec, own)
    assert {(r["role"], r["matched"], r["start"]) for r in matches.collect()} == {("hw", "d", 4), ("pos", "n", 0), ("usg", "v", 0)}
    tei = [r["tei"] for r in dictionary_to_tei(nodes, spec, keep_scrap=True).orderBy("entry").collect()]
    assert "<orth>d</orth>" in tei[0] and '<usg type="hint">v</usg>' in tei[0] and "<dictScrap>out big o g , . mid</dictScrap>" in tei[0]
    assert "<dictScrap>cat end</dictScrap>" in tei[1]


def test_text_in_is_text_out(spark):
    r = random.Random(11)
    texts = ["<d>o" + random_tree(r, "abcde") + "x" + random_tree(r, "abcde") + "y</d>" for _ in range(40)]
    nodes = nodes_of(spark, *texts).cache()
    own = S.entries(nodes, ENTRY)
    spec = mapping.Mapping.of({"entry": ENTRY, "hw": simple(".//a", rex="[a-c]+"), "pos": simple(".//b", mapping.INNER), "def": simple(".//c", rex="1( ?)2", rexGroup=1), "ex": simple(".//d"), "note": simple(".//e", rex="zzz")})
    matches = mapping.role_matches(nodes, spec, own).cache()
    spans = pieces.spans_in_pieces(nodes, mapping.taken_spans(matches))
    cut = pieces.segments(nodes, spans).collect()
    rest = {(s["doc_id"], s["at"], s["off"]) for s in leftover(nodes, matches, own).collect()}
    assert rest == {(s["doc_id"], s["at"], s["off"]) for s in cut if not s["taken"]}
    for i, text in enumerate(texts):
        mine = sorted((s["at"], s["off"], s["piece"]) for s in cut if s["doc_id"] == i)
        assert "".join(p for *_, p in mine) == plain(text)
    taken = {}
    for s in sorted(cut, key=lambda s: (s["doc_id"], s["at"], s["off"])):
        if s["taken"]:
            for up in s["around"]:
                taken[s["doc_id"], up] = taken.get((s["doc_id"], up), "") + s["piece"]
    seen = 0
    for m in matches.where("attr like '%innerTextRec' and role in ('hw', 'ex')").collect():
        assert m["matched"] in taken.get((m["doc_id"], m["pre"]), "") or m["matched"] == ""
        seen += 1
    assert seen > 20 and any(not s["taken"] for s in cut)


def test_offsets_count_characters(spark):
    nodes = nodes_of(spark, "<d>😀a<b>é</b>c</d>")
    of = nodes.where("tag = 'd'")
    assert [(r["lo"], r["hi"]) for r in pieces.offsets(nodes, of).orderBy("at").collect()] == [(0, 2), (2, 3), (3, 4)]
    assert [(r["lo"], r["hi"]) for r in pieces.offsets(nodes, of, False).orderBy("at").collect()] == [(0, 2), (2, 3)]


def test_running_values_over_ranges(spark):
    from lexmill.operators.runs import in_runs

    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, i]), i % 5) for i in r.sample(range(3000), 3000)]
    frame = spark.createDataFrame(rows, "k string, at int, mark int, v int").repartition(7)
    got = in_runs(frame, ["k"], ["at"], count="n", sums={"before": F.col("v")}, last={"seen": F.col("mark")}).collect()
    state, want = {}, {}
    for k, at, mark, v in sorted(rows, key=lambda x: x[1]):
        n, total, seen = state.get(k, (0, 0, None))
        seen = mark if mark is not None else seen
        want[at] = (n + 1, total, seen)
        state[k] = (n + 1, total + v, seen)
    assert {x["at"]: (x["n"], x["before"], x["seen"]) for x in got} == want
    assert in_runs(frame.limit(0), ["k"], ["at"], count="n").count() == 0
