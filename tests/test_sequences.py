import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import catalog, sequences
from lexmill.plans.dictionary import table_to_tei
from lexmill.sources.tables import dictionary_errors, read_dictionary, read_pos_map, repository_record


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column).collect()]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, T.name_safe(v), " a b ", "x:y", "a#", "\U0001d4b3", "〇", "é-1", "") == ["a.b", "x〇3a〇y", "a〇23〇", "〇1d4b3〇", "〇3007〇", "é-1", ""]
    assert one(spark, T.acronym(v), "my big dict", "1 2", None, "éa 9b") == ["MBD", "dict", "dict", "ÉB"]
    assert one(spark, T.peeled(v), "a.,", "?!", "a.b", "") == [["a", ".", ","], ["?", "!"], ["a.b"], []]
    assert one(spark, T.without_namespace(v), "{http://x}a", "a") == ["a", "a"]
    assert one(spark, T.handle_suffix(v), " http://hdl.handle.net/1/2 ", "1/2") == ["1/2", "1/2"]
    assert one(spark, T.is_blank(v), "  ", "x", None) == [True, False, True]
    assert one(spark, T.translated(v, {"a": "b"}), "a", "c", None) == ["b", "c", None]
    assert one(spark, T.replaced(v, {"a+": "b", "b": "c"}), " aa ") == ["c"]
    assert one(spark, T.entry_head(v), '<entry xmlns="u">\nx', "ab") == ["<entry>", "ab"]


def test_features_and_punctuation(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1, "a,."), (1, 2, 0, 2, "b"), (1, 3, 5, 1, ""), (1, 4, 5, 1, "!"), (1, 5, 5, 2, "c")], "doc_id int, ord int, line int, word int, text string")
    got = sequences.split_punctuation(rows).orderBy("ord", "nth").collect()
    assert [(r["text"], r["word"]) for r in got] == [("a", 1), (",", 2), (".", 3), ("b", 4), ("!", 1), ("c", 2)]
    full = rows.withColumns({n: F.lit("x") for n in ("font_size", "bold", "italic", "font_name")})
    assert [r["newline"] for r in sequences.token_features(full).orderBy("ord").collect()] == [0, 0, 1, 0]


def test_labels_decode(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a_inside", "a_inside", "a_start", "b_inside", "noise", "noise", "b_start"])], "seq int, ord int, label string")
    assert [r["container"] for r in sequences.decoded(rows).orderBy("ord").collect()] == [1, 1, 2, 3, 4, 4, 5]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["x", "entry_start", "scrap", "y", "entry_start"])], "seq int, ord int, label string")
    assert [(r["label"], r["segment"]) for r in sequences.segments(rows).orderBy("ord").collect()] == [("entry_start", 1), ("y", 1), ("entry_start", 2)]


def test_alignment_windows_and_splits(spark):
    raw = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "doc_id int, ord int, text string")
    other = spark.createDataFrame([(1, i, t, "l") for i, t in enumerate("abxd")], "doc_id int, ord int, text string, label string")
    assert sorted(r["text"] for r in sequences.aligned(raw, other).collect()) == ["a", "b"]
    assert [r["test"] for r in sequences.head_tail_split(raw, ["ord"]).orderBy("ord").collect()] == [False, False, False, True]
    pages = spark.createDataFrame([(p,) for p in range(1, 8)], "page int")
    assert [r[0] for r in sequences.next_pages(pages, 1, 3).collect()] == [4, 5, 6]
    assert [(r["body"], r["range"]) for r in sequences.bodies(raw, 3, ["ord"], "doc_id").orderBy("ord").collect()] == [(0, "1-3")] * 3 + [(1, "4-4")]
    assert [tuple(r) for r in sequences.vocabulary(raw, "text").orderBy("id").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in sequences.classification_report(sequences.confusion(rows, "y", "p")).collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, pytest.approx(1 / 3), 1.0), "c": (1, 0.0, 0.0)}


def test_catalog(spark):
    rows = spark.createDataFrame([(i, f"w{i:03d}") for i in range(250)], "id int, entry string")
    page = lambda n: [r["id"] for r in catalog.entry_page(rows, n, ["entry"]).collect()]
    assert page(1) == list(range(100)) and page(3) == list(range(200, 250)) and page(99) == page(3) == page(0)
    assert catalog.prefix_search(rows, "entry", "w_", ["entry"]).count() == 0
    assert catalog.prefix_search(rows, "entry", "w1", ["entry"]).count() == 100
    table = spark.createDataFrame([("w000", "x"), ("w000", "y")], "original string, mapped string")
    assert [r["entry"] for r in catalog.remapped(rows.where("id < 2"), table, "entry").orderBy("id").collect()] == ["x", "w001"]
    assert sorted(tuple(r) for r in catalog.refreshed_map(spark.createDataFrame([("w000",), ("q",)], "value string"), table.limit(1)).collect()) == [("q", "q"), ("w000", "x")]
    named = catalog.headword_or_number(spark.createDataFrame([(1, 1, None), (1, 2, "h")], "k int, o int, headword string"), ["o"], "k")
    assert [r["entry_text"] for r in named.orderBy("o").collect()] == ["Entry 0", "h"]


def test_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text("lemma,pos,definition,sense_id,entry_id\na,NOUN,x <y>,1,e\na,NOUN,b,1,e\nb,foo,c,2,e\n")
    rows = read_dictionary(spark, f"{tmp_path}/d.csv")
    assert sorted((r["error"], r["value"]) for r in dictionary_errors(rows).collect()) == [("entry_id", "e"), ("pos", "foo"), ("sense_id", "1")]
    tei = {r["lemma"]: r["tei"] for r in table_to_tei(rows).collect()}
    assert '<sense n="1"><def>b</def></sense><sense n="2"><def>x &lt;y&gt;</def></sense>' in tei["a"]
    (tmp_path / "bad.csv").write_text("lemma,pos\na,b\n")
    with pytest.raises(ValueError):
        read_dictionary(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "map.csv").write_text("original_pos,tei_pos\na,b,NOUN\nx,VERB\n")
    assert sorted(tuple(r) for r in read_pos_map(spark, f"{tmp_path}/map.csv").collect()) == [("a,b", "NOUN"), ("x", "VERB")]
    record = spark.createDataFrame([(1, "<r><title>T</title><creator><p><firstName>A</firstName><lastName>B</lastName></p></creator></r>")], "id int, raw string")
    assert [tuple(r) for r in repository_record(record).collect()] == [(1, "T", ["A B"], "", "")]


def test_codes_lengths_and_unseen(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "value string, id long")
    rows = spark.createDataFrame([(1, "a"), (1, "zzz"), (2, None)], "seq long, label string")
    assert sorted((r["seq"], r["code"]) for r in sequences.coded(rows, "label", known).collect()) == [(1, 0), (1, 1), (2, 0)]
    assert tuple(sequences.max_lengths(rows, "seq", "label").first()) == (2, 3) and tuple(sequences.max_lengths(rows.where("false"), "seq", "label").first()) == (0, 0)
    assert [r["label"] for r in sequences.unseen_labels(rows, rows.where("label = 'a'")).collect()] == ["zzz"]


def test_codes_and_vectors(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("é", 3)], "value string, id long")
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "xaébba")], "k int, t string")
    want = {1: [0, 0, 1, 2], 2: [0] * 4, 3: [0] * 4, 4: [3, 2, 2, 1]}
    for limit in (10_000, 2):  # as a map, and by a join
        sequences.MAP_VALUES, old = limit, sequences.MAP_VALUES
        assert {r["k"]: r["codes"] for r in sequences.char_codes(rows, "t", known, 4).collect()} == want
        sequences.MAP_VALUES = old
    features = spark.createDataFrame([(1, ["b", "a", "b", "z"]), (2, []), (3, None), (1, ["é"])], "k int, f array<string>")
    got = sorted((r["k"], r["hot"]["size"], r["hot"]["indices"], r["hot"]["values"]) for r in sequences.one_hot(features, "f", known).collect())
    assert got == [(1, 3, [0, 1], [1.0, 1.0]), (1, 3, [2], [1.0]), (2, 3, [], []), (3, 3, [], [])]


def test_accuracy(spark):
    rows = spark.createDataFrame([("a", "a", 3), ("a", "b", 1)], "actual string, predicted string, n long")
    assert [tuple(r) for r in sequences.accuracy(rows).collect()] == [(4, 3, 0.75)] and [tuple(r) for r in sequences.accuracy(rows.limit(0)).collect()] == [(0, 0, 0.0)]


def test_numbers_skip_used_ones(spark):
    from lexmill.operators.assemble import first_of_senses, other_identifiers

    rows = [("e1", "cit", 1, i, None) for i in range(5)] + [("e1", "usg", 1, 9, "own"), ("e1", "usg", 1, 10, "own"), ("e2", "cit", 1, 11, "e1_cit_4"), ("e2", "cit", 1, 12, "e2"), ("e2", "note", 2, 1, None)]
    used = spark.createDataFrame([("e1",), ("e2",), ("e1_cit_1",), ("e1_cit_3",), ("e1_cit_03",), ("e1_cit_x",), (None,)], "id string")
    got = other_identifiers(spark.createDataFrame(rows, "entry_id string, tag string, doc_id long, pre long, own_id string"), used).orderBy("doc_id", "pre")
    assert [r["xml_id"] for r in got.collect()] == ["e1_cit_2", "e1_cit_5", "e1_cit_6", "e1_cit_7", "e1_cit_8", "own", "e1_usg_1", "e1_cit_4", "e2_cit_1", "e2_note_1"]
    matches = spark.createDataFrame([(1, 0, 5, "hw", "a", [0, 2]), (1, 0, 4, "hw", "b", [0]), (1, 0, 6, "pos", "n", [0, 2, 3])], "doc_id long, entry long, pre long, role string, final string, above array<long>")
    senses = spark.createDataFrame([(1, 0, 2), (1, 0, 3), (1, 0, 9)], "doc_id long, entry long, pre long")
    assert sorted((str(r["sense"]), r["headword"], r["pos"]) for r in first_of_senses(matches, senses).collect()) == [("2", "a", "n"), ("3", None, "n"), ("9", None, None), ("None", "b", "n")]


def test_one_lemma_with_two_entry_ids_is_an_error(spark):
    from lexmill.sources.tables import dictionary_errors

    rows = spark.createDataFrame([("a", "NOUN", "x", "1"), ("a", "NOUN", "y", "2"), ("b", "NOUN", "z", "3")], "lemma string, pos string, definition string, entry_id string")
    assert [tuple(r) for r in dictionary_errors(rows).collect()] == [("lemma", "a", 2)]


def test_containers_as_markup(spark):
    rows = [(1, i, t, l1, b1, l2, b2) for i, (t, l1, b1, l2, b2) in enumerate([("a", 1, "entry", 1, "form"), ("b", 1, "entry", 2, "scrap"), ("c", 1, "entry", 3, "pos"), ("d", 2, "entry", 1, "pos"), ("e", 3, "noise", None, None), ("<f", None, None, 1, "pos")])]
    frame = spark.createDataFrame(rows, "seq int, ord int, text string, level_1 long, base_1 string, level_2 long, base_2 string")
    parts = sequences.container_markup(frame, 2, T.element("T", T.escaped(F.col("text")))).orderBy("place").collect()
    box = lambda name, x: f'<container name="{name}">{x}</container>'
    t = lambda x: f"<T>{x}</T>"
    assert "".join(p["tei"] for p in parts) == "<body>" + box("entry", box("form", t("a")) + t("b") + box("pos", t("c"))) + box("entry", box("pos", t("d"))) + box("noise", t("e")) + t("&lt;f") + "</body>"


def test_levels_are_written_and_read(spark, tmp_path):
    from lexmill.plans.dictionary import table_parts, write_tei
    from lexmill.sources.tables import read_levels, write_levels

    rows = spark.createDataFrame([([["SIZE=1", "TOKEN=a"], ["TOKEN=é"]], ["x_start", "x_inside"])], "features array<array<string>>, labels array<string>")
    write_levels({"level_1": rows, "unlabelled": rows.drop("labels")}, f"{tmp_path}/j")
    back = read_levels(spark, f"{tmp_path}/j", ["level_1", "unlabelled"])
    assert back["level_1"].collect() == rows.collect() and back["unlabelled"].collect()[0]["labels"] is None
    table = spark.createDataFrame([("b", "NOUN", "x"), ("a", "VERB", "<y>"), ("a", "NOUN", "z")], "lemma string, pos string, definition string")
    write_tei(table_parts(table), f"{tmp_path}/t")
    from xml.etree import ElementTree

    whole = ElementTree.fromstring("".join(p.read_text() for p in sorted((tmp_path / "t" / "doc_id=0").glob("*.txt"))).encode())
    assert [x.text for x in whole.iter("{http://www.tei-c.org/ns/1.0}orth")] == ["a", "a", "b"] and [x.text for x in whole.iter("{http://www.tei-c.org/ns/1.0}def")] == ["z", "<y>", "x"]


def test_elements_without_ids_are_not_stored_and_large_groups_are_numbered_alike(spark, tmp_path, monkeypatch):
    import uuid

    from lexmill.operators import assemble

    nodes = spark.range(3000).selectExpr("concat('e', id % 3 * id % 7) AS entry_id", "'s' AS tag", "id % 5 AS doc_id", "id AS pre", "CASE WHEN id % 100 = 0 THEN concat('e0_s_', id) END AS own_id")
    used = spark.createDataFrame([("e0_s_2",), ("e0_s_3",), ("e3_s_1",)], "id string")
    monkeypatch.setattr("lexmill.sources.store.shared_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    plain = {tuple(r) for r in assemble.other_identifiers(nodes, used).collect()}
    written = sum(spark.read.parquet(f"file://{p}").count() for p in tmp_path.iterdir())
    assert len(plain) == 3000 == len({r[5] for r in plain}) and not {r[5] for r in plain} & {"e0_s_2", "e0_s_3", "e3_s_1"}
    assert written < 300  # ids that are there or in use
    monkeypatch.setattr(assemble, "LARGE", 300)
    assert {tuple(r) for r in assemble.other_identifiers(nodes, used).collect()} == plain
