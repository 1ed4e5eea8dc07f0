"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in that folder: spark.checkpoint.dir, or where it is unset and the session is local, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


#: Spark takes a file's bytes as its rows' bytes, though two columns of keys need a hundred times their share of the file in memory.
UNPACKED, PLAIN = ("spark.sql.sources.fileCompressionFactor", "100.0"), "1.0"
#: Up to so many bytes of shuffled rows Spark may send to the driver in a running query; a table of keys takes five times as many there, and a job has many joins.
SENT = ("spark.sql.adaptive.autoBroadcastJoinThreshold", "1m")
#: While a table is written: what has been shuffled for it is deleted as soon as it is there, not when the driver next collects garbage.
CLEANED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame) -> DataFrame:
    """A table written there and read back: computed once, and what follows survives lost executors.

    From then on the session takes files as much larger in memory than on disk, and of what a query has shuffled only little for small (unless
    it has settings of its own), so that the driver isn't sent tables of a million keys, one for each join. Of what was shuffled for the table
    nothing stays on disk.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    if spark.conf.get(UNPACKED[0], PLAIN) == PLAIN:
        spark.conf.set(*UNPACKED)
    if spark.conf.get(SENT[0], None) is None:
        spark.conf.set(*SENT)
    before = spark.conf.get(CLEANED[0], None)
    spark.conf.set(*CLEANED)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED[0]) if before is None else spark.conf.set(CLEANED[0], before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, tables: list[DataFrame], kept: DataFrame | None = None) -> None:
    """Deletes tables that stored() gave, but for those that `kept` still reads."""
    folders = lambda df: {f.rpartition("/")[0] for f in df.inputFiles()}
    read = set() if kept is None else folders(kept)
    for path in {p for table in tables for p in folders(table)} - read:
        deleted(spark, path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    files, where = _file_system(spark, path)
    return files.exists(where)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a path and all below; one that isn't there stays so."""
    files, where = _file_system(spark, path)
    files.delete(where, True)
