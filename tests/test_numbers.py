"""How entries without a headword get their numbers."""

from lexmill.operators import catalog


def test_entries_of_one_dataset_are_dealt_by_ranges(spark):
    rows = spark.createDataFrame([(1, i, None if i % 2 else "h") for i in range(40)], "dsid int, o int, headword string")
    out = catalog.headword_or_number(rows, ["o"], "dsid")
    assert "hashpartitioning(dsid" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["o"]: r["entry_text"] for r in out.collect()} == {i: f"Entry {i}" if i % 2 else "h" for i in range(40)}
