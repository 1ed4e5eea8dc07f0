"""Large files read in splits give the same node table as whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources import split
from lexmill.sources.xml import read_documents, shred


def rows_of(nodes):
    return sorted((r["pre"], r["post"], r["parent"], r["depth"], r["sib"], r["tag"], r["text"], r["tail"], tuple(r["path"]), tuple(r["ancestors"]), r["prefix"], r["ns"], tuple(sorted(r["attrs"].items())), tuple(sorted(r["scope"].items()))) for r in nodes.collect())


def dictionary(r, n):
    entry = lambda i: f'<t:e n="{i}" k="a&gt;\'b">w{i}<h>{"x" * r.randint(0, 9)}<!-- < </h> --></h>{r.choice(["", "é", "<t:e>in<br/>ner</t:e>z", "<![CDATA[<q>]]>"])}</t:e>{r.choice(["", chr(10), " tail "])}'
    letters = "".join(f'<letter v="{k}">l{k}' + "".join(entry(i) for i in range(n)) + f"</letter>after{k}" for k in range(5))
    return f'<?xml version="1.0"?>\n<!DOCTYPE d>\n<d xmlns="urn:d" xmlns:t="urn:t">start{letters}<end/>\n</d>\n'


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_splits_give_the_whole_node_table(spark, tmp_path, small_splits):
    r = random.Random(4)
    (tmp_path / "a.xml").write_text(dictionary(r, 60))
    want = rows_of(shred(read_documents(spark, f"{tmp_path}/a.xml")))
    lines = split._lines(spark, f"{tmp_path}/a.xml", "t:e")
    assert lines.select("start").distinct().count() > 10 and lines.rdd.getNumPartitions() > 10
    nodes = split.read_nodes(spark, f"{tmp_path}/a.xml", "t:e")
    assert rows_of(nodes) == want
    assert rows_of(split.read_nodes(spark, f"{tmp_path}/a.xml", "letter")) == want and rows_of(split.read_nodes(spark, f"{tmp_path}/a.xml", "none")) == want


def test_many_files_and_edges(spark, tmp_path, small_splits):
    r = random.Random(6)
    texts = [dictionary(r, 15), "<e>one</e>", "<e><e>a</e>b<e/></e>", "<d/>", dictionary(r, 3)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.xml").write_text(text)
    got = split.read_nodes(spark, str(tmp_path), "e").cache()
    assert got.select("doc_id").distinct().count() == len(texts)
    docs = sorted([tuple(x) for x in rows_of(shred(spark.createDataFrame([(0, t)], "doc_id long, raw string")))] for t in texts)
    by = {}
    for row in got.collect():
        by.setdefault(row["doc_id"], []).append(row)
    frames = sorted(rows_of(got.where(F.col("doc_id") == d)) for d in by)
    assert frames == docs


def test_malformed_files_are_refused(spark, tmp_path, small_splits):
    for i, text in enumerate(("<d><e>a</e></f></d>", "<d><e>a</e></d></d>")):
        (tmp_path / f"{i}.xml").write_text(text)
        with pytest.raises(Exception, match="read it whole"):
            split.read_nodes(spark, f"{tmp_path}/{i}.xml", "e").count()
