"""A refresh rewrites the datasets that changed and leaves the others' files alone."""

import json
from pathlib import Path

from lexmill.operators import mapping
from lexmill.plans.refresh import refresh, stored_entries


def spec(hw):
    return json.dumps({"entry": {"type": "xpath", "expr": ".//e"}, "hw": {"type": "simple", "selector": {"type": "xpath", "expr": hw}, "attr": mapping.INNER}})


def test_only_changed_datasets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(d, 10 * d + k, f"<d><e><hw>a</hw><w>b{k}</w></e><e><w>c</w></e></d>") for d in (1, 2, 3) for k in (0, 1)]
    docs = lambda rows: spark.createDataFrame(rows, "dsid long, doc_id long, raw string")
    maps = lambda **hw: spark.createDataFrame([(int(k[1:]), spec(v)) for k, v in hw.items()], "dsid long, spec string")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(path, "entries").rglob("*.parquet")}
    of = lambda found, d: {k: v for k, v in found.items() if f"dsid={d}/" in k}
    texts = lambda d: sorted(r["entry_text"] for r in stored_entries(spark, path).where(f"dsid = {d}").collect())

    assert refresh(docs(rows), maps(d1="hw", d2="hw", d3="hw"), path) == [1, 2, 3]
    first = files()
    assert texts(1) == ["Entry 1", "Entry 3", "a", "a"] and {r["xml_id"] for r in stored_entries(spark, path).where("dsid = 2").collect()} == {"D_a_1_pos", "D_a_2_pos", "D_headword_1_pos", "D_headword_2_pos"}
    assert refresh(docs(rows[::-1]), maps(d3="hw", d2="hw", d1="hw"), path) == [] and files() == first
    assert refresh(docs(rows), maps(d1="hw", d2="w", d3="hw"), path) == [2]
    second = files()
    assert texts(2) == ["b0", "b1", "c", "c"] and of(second, 1) == of(first, 1) and of(second, 3) == of(first, 3) and not set(of(second, 2)) & set(of(first, 2))
    edited = rows[:-1] + [(3, 31, "<d><e><hw>new</hw></e></d>")]
    assert refresh(docs(edited), maps(d1="hw", d2="w", d3="hw"), path) == [3] and texts(3) == ["Entry 1", "a", "new"] and of(files(), 2) == of(second, 2)
    empty = [r for r in edited if r[0] != 2] + [(2, 20, "<d/>")]
    assert refresh(docs(empty), maps(d2="w", d3="hw"), path) == [1, 2]  # one is gone, one has no entries any more
    assert {r["dsid"] for r in stored_entries(spark, path).select("dsid").distinct().collect()} == {3}
