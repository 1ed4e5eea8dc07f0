"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; whatever lies between is a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it back: what follows survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions_of(df: DataFrame) -> int:
    """How many partitions a table of df's size should be dealt to: as many as df is read in, or as the session asks for if that is more."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Lists of up to so many ids (8 bytes each) are sent to every executor; documents are shuffled to longer ones.
BROADCAST_IDS = 1_000_000


def small(rows: DataFrame) -> DataFrame:
    """A stored table, marked for sending to every executor if it has few rows of fixed width."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined ('left_semi' or 'left_anti') with distinct doc_ids; the documents aren't shuffled if there are few."""
    return docs.join(small(stored(ids)), "doc_id", how).select(docs.columns)


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty; bytes.lower() and bytes.split() then treat ASCII alone."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, with the end."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_[edges[0] : edges[-1]], edges - edges[0]


@dataclass
class Words:
    """The words of many texts: the distinct ones, the number of each word in order, and how many each text has."""

    distinct: pa.Array
    at: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def words_in(texts: pa.Array, lower: bool = True) -> Words:
    """Words between ASCII white space, with A-Z lower-cased or not; null has none."""
    data, edges = flat(texts)
    if lower:
        data = LOWER_BYTE[data]
    inside = ~SPACE_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    begins[first] = inside[first]
    count = np.concatenate([[0], np.cumsum(begins)])
    starts = np.flatnonzero(begins[inside])
    offsets = np.append(starts, int(inside.sum())).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return Words(own.dictionary, own.indices.to_numpy(), np.diff(count[edges]))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of a doc_id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string")).cast("long") % n


class WordCodes(dict):
    """64-bit codes of words, computed once for each word in a batch of tasks; emptied when full."""

    LIMIT = 600_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


CODES = WordCodes()


#: Text goes to Python about so many bytes at a time: a task has a batch several times over, in the JVM's own memory, on the way, and in the worker.
SENT = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def in_small_batches(rows: DataFrame) -> DataFrame:
    """The rows; from then on the session sends Python batches of SENT bytes, unless it has a limit of its own."""
    if rows.sparkSession.conf.get(SENT[0], None) is None:
        rows.sparkSession.conf.set(*SENT)
    return rows


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the system: a job's stages share their workers, and freed memory stays theirs."""
    CODES.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(CODES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
