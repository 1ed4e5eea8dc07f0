"""Every query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

from lexmill.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    return sorted(repr([value(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLE[name]).df())


def test_stream_of_documents(spark, tmp_path):
    from lexmill.operators.mapping import INNER, Mapping
    from lexmill.streaming.feed import entries_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.xml").write_text("<d><e><hw>a</hw></e><e><hw>b</hw></e></d>")
    spec = Mapping.of({"entry": {"type": "xpath", "expr": ".//e"}, "hw": {"type": "simple", "selector": {"type": "xpath", "expr": "hw"}, "attr": INNER}})
    for _ in range(2):  # a second run finds nothing new
        stream = entries_stream(spark, str(source), spec, f"{tmp_path}/out", f"{tmp_path}/state")
        stream.awaitTermination(120)
    assert sorted(r["headword"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
