import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import discover
from lexmill.operators import select as S
from lexmill.sources.xml import node_batches, parse, read_documents, shred

DOC = '<d lang="x">a<e id="1">b<hw>c</hw>d<e id="2"><hw>i</hw></e>e</e>f<e id="3"><hw>k</hw></e></d>'


def nodes_of(spark, *raws, **options):
    return shred(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "doc_id long, raw string"), **options).cache()


def test_intervals_and_text():
    rows = parse(1, DOC)
    assert [r["tag"] for r in rows] == ["d", "e", "hw", "e", "hw", "e", "hw"]
    assert all(r["pre"] < r["post"] for r in rows)
    by_pre = {r["pre"]: r for r in rows}
    for r in rows:
        assert all(by_pre[a]["pre"] < r["pre"] and r["post"] < by_pre[a]["post"] for a in r["ancestors"])
        assert (r["parent"] is None) == (not r["ancestors"])
    assert [(r["text"], r["tail"]) for r in rows[:3]] == [("a", ""), ("b", "f"), ("c", "d")]


@pytest.mark.parametrize(
    ("raw", "tags"),
    [
        ("", []),
        (None, []),
        ("   ", []),
        ("<a><b></a>", ["a", "b"]),
        ("<a></x><B>t</B></a>", ["a", "B"]),
        ('<!DOCTYPE a SYSTEM "missing.dtd"><a>&unknown;<b/></a>', ["a", "b"]),
        ("<A><script>x<i>y</i></script></A", ["A", "script", "i"]),
        ("no markup at all", []),
    ],
)
def test_malformed_documents_are_repaired(raw, tags):
    assert [r["tag"] for r in parse(1, raw)] == tags


TEXT = st.text(alphabet="ab \n&<é", max_size=5)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.builds(lambda t: ("x", t, []), TEXT), lambda inner: st.builds(lambda t, c: ("y", t, c), TEXT, st.lists(inner, max_size=3)), max_leaves=8))
def test_text_is_conserved(tree):
    from xml.sax.saxutils import escape

    def write(node):
        return f"<{node[0]}>{escape(node[1])}{''.join(write(c) for c in node[2])}</{node[0]}>"

    def text(node):
        return node[1] + "".join(text(c) for c in node[2])

    rows = parse(0, write(tree))
    pieces = sorted([(r["pre"], r["text"]) for r in rows] + [(r["post"], r["tail"]) for r in rows])
    assert "".join(p for _, p in pieces) == text(tree)


def test_selectors(spark):
    nodes = nodes_of(spark, DOC)
    ids = lambda df: sorted(r[0] for r in df.select(F.col("attrs")["id"]).collect())
    assert ids(S.select(nodes, ".//e")) == ["1", "2", "3"]
    assert ids(S.select(nodes, "d/e")) == ["1", "3"]
    assert ids(S.select(nodes, ".//e//e")) == ["2"]
    assert ids(S.select(nodes, ".//e[@id='3']")) == ["3"]
    own = S.select(nodes, ".//e").drop("ctx")
    assert sorted(r["text"] for r in S.select(nodes, "hw", own).collect()) == ["c", "i", "k"]
    assert sorted(r["tag"] for r in S.select(nodes, "..", own).collect()) == ["d", "d", "e"]
    assert ids(S.select(nodes, "ancestor::e", S.select(nodes, ".//hw").drop("ctx"))) == ["1", "1", "2", "3"]
    assert S.select(nodes, "..").count() == 0
    x = lambda e: {"type": "xpath", "expr": e}
    assert ids(S.selected(nodes, {"type": "union", "selectors": [x(".//e"), x("d/e")]})) == ["1", "2", "3"]
    assert ids(S.selected(nodes, {"type": "exclude", "left": x(".//e"), "right": x("d/e")})) == ["2"]
    assert S.selected(nodes, None).count() == 0
    assert ids(S.select(nodes, ".//e[2]")) == ["3"] and ids(S.select(nodes, "d/e|d/e/e")) == ["1", "2", "3"]
    for bad in ("ancestor::e[2]", "count(e)", "e|count(f)"):
        with pytest.raises(ValueError):
            S.select(nodes, bad)
    assert S.parent_normalised({"type": "union", "selectors": [x("a/.."), x("a")]})["selectors"][0]["expr"] == ".."


def test_entries_and_promotion(spark):
    rows = S.entries(nodes_of(spark, DOC, "<d/>"), {"type": "xpath", "expr": ".//e"}).orderBy("doc_id", "pre").collect()
    assert [(r["attrs"]["id"], r["is_top"], r["outermost"] == rows[0]["pre"]) for r in rows] == [("1", True, True), ("2", False, True), ("3", True, False)]


def test_discovery(spark):
    nodes = nodes_of(spark, DOC)
    assert {(r["parent_tag"], r["tag"], r["n"]) for r in discover.tag_edges(nodes).collect()} == {("d", "e", 2), ("e", "hw", 3), ("e", "e", 1)}
    assert {r["path"] for r in discover.path_suffixes(nodes).collect()} == {"d", "d/e", "e", "d/e/hw", "e/hw", "hw", "d/e/e", "e/e", "d/e/e/hw", "e/e/hw"}
    assert [r["value"] for r in discover.value_inventory(nodes, ["e"], "id", 2).collect()] == ["1", "2"]
    tokens = '<BODY><container name="entry"><TOKEN>a</TOKEN><container name="sense"><container name="pos"><TOKEN>b</TOKEN></container></container></container></BODY>'
    names = discover.container_ancestry(nodes_of(spark, tokens)).orderBy("pre").collect()
    assert [r["names"] for r in names] == [[], ["entry"], ["entry"]]


def test_files_globs_and_zips(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<a/>")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.xml", "<x/>")
        z.writestr("y.xml", "<y><z/></y>")
    docs = read_documents(spark, f"{tmp_path}/*")
    assert sorted(r["raw"] for r in docs.collect()) == ["<a/>", "<x/>", "<y><z/></y>"]
    assert sorted(r["tag"] for r in shred(docs).collect()) == ["a", "x", "y", "z"]
    assert sorted(r["text"] for r in nodes_of(spark, "<a> <b> x </b>\n</a>", drop_blank_text=True).collect()) == ["", " x "]


def test_small_documents_share_a_batch_and_large_ones_are_cut():
    raws = ["<d><e/></d>"] * 3000 + ["<d>" + "<e/>" * 7000 + "</d>", None, "<d/>"]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(raws))), pa.array(raws)], names=["doc_id", "raw"])
    out = list(node_batches(iter([docs.slice(0, 2000), docs.slice(2000)])))
    assert [b.num_rows for b in out] == [5000, 5000, 3002]
    assert [(i, p) for b in out for i, p in zip(b.column("doc_id").to_pylist(), b.column("pre").to_pylist())] == [(i, r["pre"]) for i, raw in enumerate(raws) for r in parse(i, raw)]
