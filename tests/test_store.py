"""What Spark takes a stored table's size for."""

import time

from pyspark.sql import functions as F

from lexmill.sources import store
from lexmill.sources.store import stored
from lexmill.sources.xml import document_parts, shred


def test_packed_keys_count_as_large_as_they_are_in_memory(spark):
    wide = [F.lit(None).cast("map<string,string>").alias(f"m{i}") for i in range(6)]
    nodes = stored(spark.range(400_000).select(F.expr("id div 11").alias("doc_id"), F.expr("id % 11").alias("pre"), *wide))
    keys = nodes.select("doc_id", "pre")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")  # the keys are 6.4 MB
    try:
        plan = nodes.join(keys.withColumnRenamed("pre", "up"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" not in plan


def test_documents_as_markup_send_no_scopes_to_the_driver(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("<d><e>x</e><e>x</e></d>").alias("raw"))
    nodes = stored(shred(docs))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")  # 60,000 scopes are more
    try:
        plan = document_parts(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" not in plan


def test_shuffled_keys_are_not_sent_to_the_driver_while_a_query_runs(spark):
    nodes = stored(spark.range(300_000).select(F.expr("id div 11").alias("doc_id"), F.expr("id % 11").alias("pre")))
    few = nodes.groupBy("doc_id", "pre").agg(F.count("*").alias("n"))
    joined = nodes.join(few, ["doc_id", "pre"])  # the keys are 7 MB once they are shuffled
    assert joined.count() == 300_000
    counted = joined.groupBy().count()
    counted.collect()
    assert "BroadcastHashJoin" not in counted._jdf.queryExecution().executedPlan().toString()


def test_nothing_that_was_shuffled_for_a_table_stays_on_disk(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before = shuffled()
    few = stored(spark.range(100_000).groupBy(F.expr("id % 1000").alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and few.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"  # the caller's own queries keep theirs


def test_tables_that_are_still_read_are_not_dropped(spark):
    one, two = stored(spark.range(3)), stored(spark.range(5))
    folders = [df.inputFiles()[0].rpartition("/")[0] for df in (one, two)]
    kept = one.where("id > 0")
    store.dropped(spark, [one, two], kept)
    assert kept.count() == 2
    assert [store.exists(spark, f) for f in folders] == [True, False]
