"""Token ids in word-aligned binary blocks (Simple-8b), in ascending order of doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import partitions_of, record_batch, shared_dir
from lexmill.llm.encoding import encoder, text_slices

#: A word's upper 4 bits select how many ids its lower 60 bits hold and how wide they are.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Each window's maximum from two shorter windows: (its size, one that starts it, one that ends it).
WINDOWS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 4), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 8), (20, 12, 8), (30, 15, 15), (60, 30, 30), (120, 60, 60)]
LIMITS = np.array([1 << int(w) for w in WIDTHS], dtype=np.uint64)
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
STRIDE = 128

BLOCKS = "shard int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, words binary, offsets binary, escapes binary"
BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOC_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Words, the id offset of every 128th word, and escapes (position and value of ids over 60 bits, which the words hold as 0)."""
    n = len(ids)
    values = np.zeros(n + 120, dtype=np.uint64)
    values[:n] = ids
    escapes = b""
    if n and (top := int(values.max())) >= 1 << 60:
        at = np.flatnonzero(values >> np.uint64(60))
        escapes = np.stack([at.astype("<u8"), values[at].astype("<u8")], axis=1).tobytes()
        values[at] = 0
        top = int(values.max())
    need = SMALL[values] if n and top < 1 << 16 else np.searchsorted(LIMITS, values, side="right").astype(np.uint8)
    largest = {1: need}
    for size, a, b in WINDOWS:
        largest[size] = np.maximum(largest[a][: len(need) - size + 1], largest[b][size - b : size - b + len(need) - size + 1])
    best = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    for c in range(len(COUNTS) - 2, -1, -1):
        best[largest[int(COUNTS[c])][:n] <= c] = c
    steps, starts, i = COUNTS[best].astype(np.uint8).tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, dtype=np.int64)
    chosen = best[at] if n else best
    words = chosen.astype(np.uint64) << np.uint64(60)
    for c in np.unique(chosen):
        rows = np.flatnonzero(chosen == c)
        first = at[rows]
        held = words[rows]
        for k in range(int(COUNTS[c])):
            held |= values[first + k] << np.uint64(k * int(WIDTHS[c]))
        words[rows] = held
    return words.astype("<u8").tobytes(), at[::STRIDE].astype("<u4").tobytes(), escapes


def unpack(words: bytes, offsets: bytes, n: int, escapes: bytes = b"") -> np.ndarray:
    """The n ids of a block: runs of 128 words are decoded side by side, each from its stored offset."""
    w = np.frombuffer(words, dtype="<u8")
    kind = (w >> np.uint64(60)).astype(np.int64)
    runs = np.frombuffer(offsets, dtype="<u4").astype(np.int64)
    counts = np.zeros(len(runs) * STRIDE, dtype=np.int64)
    counts[: len(w)] = COUNTS[kind]
    begins = (np.cumsum(counts.reshape(-1, STRIDE), axis=1) - counts.reshape(-1, STRIDE) + runs[:, None]).ravel()[: len(w)]
    out = np.zeros(n + int(COUNTS[0]), dtype=np.uint64)  # the last word may have room for more
    for c in np.unique(kind):
        rows = np.flatnonzero(kind == c)
        first, held, mask = begins[rows], w[rows], np.uint64((1 << int(WIDTHS[c])) - 1)
        for k in range(int(COUNTS[c])):
            out[first + k] = (held >> np.uint64(k * int(WIDTHS[c]))) & mask
    out = out[:n]
    if escapes:
        e = np.frombuffer(escapes, dtype="<u8").reshape(-1, 2)
        out[e[:, 0].astype(np.int64)] = e[:, 1]
    return out


def unpack_from(words: bytes, offsets: bytes, n: int, first: int, count: int, escapes: bytes = b"") -> np.ndarray:
    """Ids first to first+count of a block of n, decoding only the words around them."""
    at = np.frombuffer(offsets, dtype="<u4").astype(np.int64)
    if not len(at) or count <= 0:
        return np.zeros(0, dtype=np.uint64)
    a, b = int(np.searchsorted(at, first, side="right")) - 1, int(np.searchsorted(at, first + count, side="left"))
    base = int(at[a])
    some = (at[a:b] - base).astype("<u4").tobytes()
    out = unpack(words[a * STRIDE * 8 : b * STRIDE * 8], some, (int(at[b]) if b < len(at) else n) - base)
    if escapes:
        e = np.frombuffer(escapes, dtype="<u8").reshape(-1, 2)
        e = e[(e[:, 0] >= base) & (e[:, 0] < base + len(out))]
        out[(e[:, 0] - np.uint64(base)).astype(np.int64)] = e[:, 1]
    return out[first - base : first - base + count]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, block_tokens: int = 65_536) -> None:
    """Encodes every text and writes blocks to `path`, shards and blocks in ascending doc_id order.

    docs: doc_id, text; other columns are ignored. A null or empty text has the end id alone. Null doc_ids come first; rows that
    repeat a doc_id are all kept, next to each other, by text. A block holds whole documents, about `block_tokens` ids, so
    a longer document has a block of its own. Rows are spread by sampled ranges of doc_id, so no source or group of copies is hot.
    """
    end = np.zeros(0, dtype=np.uint32) if end_id is None else np.array([end_id], dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, enc = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        own, ids, lengths, held = [], [], [], 0  # of the block that is being filled

        def block_of() -> pa.RecordBatch:
            return record_batch(BLOCK_SCHEMA, [[shard], [block], [start], [held], [pa.concat_arrays(own)], [np.concatenate(lengths)], *([x] for x in pack(np.concatenate(ids)))])

        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                doc_ids = batch.column(0).slice(a, b - a)
                got, n = enc.batch(batch.column(1).slice(a, b - a))
                got, n = np.insert(got, np.repeat(np.cumsum(n), len(end)), np.tile(end, len(n))), n + len(end)
                ends = np.cumsum(n)
                i = 0
                while i < len(n):
                    before = int(ends[i] - n[i])
                    j = int(np.searchsorted(ends, before + block_tokens - held, side="right"))
                    if j <= i and held:  # the document begins a new block
                        yield block_of()
                        block, start, own, ids, lengths, held = block + 1, start + held, [], [], [], 0
                        continue
                    j = max(j, i + 1)
                    own.append(doc_ids.slice(i, j - i))
                    ids.append(got[before : int(ends[j - 1])])
                    lengths.append(n[i:j])
                    held += int(ends[j - 1]) - before
                    i = j
        if own:
            yield block_of()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs.repartitionByRange(partitions_of(docs), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file, with the number of ids in all shards before each block's shard."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote, 12 bytes each
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(before), "shard")


def token_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of each document's ids, decoded from the blocks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, start, n, own, lengths, words, offsets, escapes in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(words, offsets, n, escapes).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield record_batch(DOC_SCHEMA, [own, begins + (before + start), lengths, crcs])

    return blocks.select("before", "start", "n_tokens", "doc_ids", "doc_tokens", "words", "offsets", "escapes").mapInArrow(decode, DOCS)


def tokens_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in `wanted`, decoding of each block only the words around them.

    blocks: read_tokens(); wanted: doc_id. Rows that repeat a doc_id in the file are all given; a null doc_id finds nothing.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, first, count, n, words, offsets, escapes in zip(*(c.to_pylist() for c in batch.columns)):
                yield record_batch(IDS_SCHEMA, [[doc_id], [unpack_from(words, offsets, n, first, count, escapes).astype(np.int64)]])

    place = F.expr("transform(sequence(1, size(doc_ids)), i -> struct(doc_ids[i - 1] as doc_id, aggregate(slice(doc_tokens, 1, i - 1), 0L, (x, y) -> x + y) as first, doc_tokens[i - 1] as count))")
    where = blocks.select("shard", "block", F.explode(place).alias("d")).select("shard", "block", "d.*").join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id")
    return where.join(blocks, ["shard", "block"]).select("doc_id", "first", "count", "n_tokens", "words", "offsets", "escapes").mapInArrow(decode, "doc_id long, ids array<long>")


def token_file_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Writes the token file into the shared folder and reads it back."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(read_tokens(spark, path))
