"""Best-fit packing of documents into sequences, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import give_back, in_small_batches, record_batch, stored
from lexmill.llm.encoding import encoder, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = "item long, length long, part long, bin long, offset long, gap long"
PLACED_SCHEMA = pa.schema([("item", pa.int64()), ("length", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("gap", pa.int64())])
#: Rounds without a gain after which the exchange ends: by size of gap and by chance in turn.
FRUITLESS = 3
#: Chunks that a worker's encoder remembers, and bytes of text that it encodes at a time: an executor's workers share what its heap leaves.
CHUNKS, SLICE = 600_000, 2_000_000


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """The least number of bins that any packing needs; histogram[x] items have length x.

    The largest bound of two families of dual feasible functions: those that round x up past a threshold and drop small items
    (with them large and middle items are counted, the rest fills what these leave), and the stepwise u(k), k to 20.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    h = histogram.astype(np.int64)
    bound = -(-int((h * x).sum()) // capacity)
    count, total = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * x)])
    k = np.arange(0, capacity // 2 + 1)
    half = capacity // 2
    large = count[capacity + 1] - count[capacity - k + 1]
    middle, middle_sum = count[capacity - k + 1] - count[half + 1], total[capacity - k + 1] - total[half + 1]
    small_sum = total[half + 1] - total[k]
    spill = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    bound = max(bound, int((large + middle + spill).max()))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        bound = max(bound, -(-int((h * u).sum()) // (k * capacity)))
    return bound


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, taken in this order, and the number of bins; zero-length items aren't expected."""
    bins, offsets, n = [], [], 0
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r left
    for size in lengths.tolist():
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, n
            n += 1
        bins.append(b)
        offsets.append(capacity - left)
        if left > size:
            room[left - size].append(b)
            open_ |= 1 << (left - size)
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64), n


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """best_fit() of the longest items first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bins[order], offsets[order], n = best_fit(lengths[order], capacity)
    return bins, offsets, n


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids and end id, cut from the back into pieces of `capacity` where it is longer: the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc = encoder(tokenizer, CHUNKS)
        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE):
                ids, n = enc.batch(batch.column(1).slice(a, b - a))
                ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                ends = n[of] - (pieces[of] - 1 - nth) * capacity  # in the document
                starts = np.maximum(0, ends - capacity)
                first, held = (np.cumsum(n) - n)[of], ids.tobytes()
                crcs = [zlib.crc32(held[x:y]) for x, y in zip((4 * (first + starts)).tolist(), (4 * (first + ends)).tolist())]
                yield record_batch(PIECE_SCHEMA, [batch.column(0).slice(a, b - a).take(pa.array(of)), nth.astype(np.int32), starts, ends - starts, crcs])

        give_back()

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, PIECES)


def closer(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, n: int, bound: int, capacity: int, tries: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """A packing of `bound` bins or more, but no more than n: the bins with room and half of the full ones are packed anew, in an order that is a little disturbed."""
    random = np.random.default_rng(len(lengths))
    for _ in range(tries):
        if n <= bound:
            break
        fill = np.bincount(bins, weights=lengths, minlength=n)
        chosen = np.flatnonzero((fill < capacity) | (random.random(n) < 0.5))
        mine = np.flatnonzero(np.isin(bins, chosen))
        order = np.argsort(-lengths[mine] * (1 + 0.1 * random.random(len(mine))), kind="stable")
        new, places, k = best_fit(lengths[mine][order], capacity)
        if k < len(chosen):
            bins, offsets = bins.copy(), offsets.copy()
            bins[mine[order]], offsets[mine[order]] = chosen[new], places
            _, bins = np.unique(bins, return_inverse=True)
            bins = bins.reshape(-1)
            n -= len(chosen) - k
    return bins, offsets, n


def placed(table: pa.Table, group: str, capacity: int, old: int | None = None) -> pa.Table:
    """The items of one group by best-fit decreasing, and by a search for what a gap leaves where that needs more bins than the bound.

    old: the bins that the items came in; where no fewer are needed, they stay as they were.
    """
    lengths = table.column("length").to_numpy()
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins, offsets, n = closer(lengths, *best_fit_decreasing(lengths, capacity), bound, capacity)
    part = table.column(group).to_numpy()
    if old is not None:
        own = np.stack([table.column("part").to_numpy(), table.column("bin").to_numpy()], axis=1)
        if len(np.unique(own, axis=0)) <= n:
            return table.select(PLACED_SCHEMA.names).cast(PLACED_SCHEMA)
    gap = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)[bins]
    return pa.table([table.column("item"), table.column("length"), pa.array(part), pa.array(bins), pa.array(offsets), pa.array(gap)], schema=PLACED_SCHEMA)


def pack_sequences(pieces: DataFrame, capacity: int = 1024, part_items: int = 20_000) -> DataFrame:
    """Places pieces of at most `capacity` in as few sequences as it can.

    pieces: the columns of PIECES, one row for each piece. Their rows are dealt by number, so equal rows too, into parts of about
    `part_items`; each part packs by best-fit decreasing and compares its bin count with its lower bound. Then, as long as all parts
    together need more sequences than the bound of the whole, sequences exchange their pieces: one whose gap is smaller than the smallest
    piece in any sequence with a gap is closed, the others are dealt anew, those of like gaps together and by chance in turn, and
    packed again; a part keeps what it had if that needs no more sequences. The exchange ends when the open sequences' own bound is their
    number, when all of them met in one part in vain, or after FRUITLESS rounds without a gain. A task holds about `part_items` small rows.
    Pieces with a null doc_id and repeated rows are packed like others.

    Returns the columns of PIECES with sequence_id, offset, and of the whole packing n_sequences, its lower_bound, and certified: whether
    they are equal, so that no packing needs fewer.
    """
    spark, pieces = pieces.sparkSession, stored(pieces.withColumn("item", F.monotonically_increasing_id()))

    def histogram(rows: DataFrame) -> np.ndarray:
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # `capacity` rows at most
            counts[r["length"]] = r["n"]
        return counts

    def packed(items: DataFrame, old: int | None = None) -> DataFrame:
        return stored(items.groupBy("next").applyInArrow(lambda t: placed(t, "next", capacity, old), PLACED))

    def by_chance(items: DataFrame, number: int, key: Column, first: int) -> DataFrame:
        return items.withColumn("next", F.lit(first) + F.pmod(F.xxhash64(F.lit(first), key), F.lit(max(1, -(-number // part_items)))))

    def by_gap(items: DataFrame, first: int) -> DataFrame:
        """Sequences in the order of their gaps, largest first, in parts of `part_items` pieces; equal gaps by chance."""
        edges, start = [], 0
        for r in sorted(items.groupBy("gap").agg(F.count("*").alias("n")).collect(), reverse=True):  # `capacity` rows at most
            edges.append((r["gap"], start, r["n"]))
            start += r["n"]
        chance = F.pmod(F.xxhash64(F.lit(first), "part", "bin"), F.lit(1 << 20)) / (1 << 20)
        at = F.floor((F.col("start_") + chance * F.col("n_")) / part_items)
        return items.join(F.broadcast(spark.createDataFrame(edges, "gap long, start_ long, n_ long")), "gap").withColumn("next", F.lit(first) + at)

    def sequences(rows: DataFrame) -> int:
        return rows.where("offset = 0").count()

    counts = histogram(pieces)
    bound, n = lower_bound(counts, capacity), int(counts.sum())
    now = packed(by_chance(pieces.select("item", "length"), n, F.col("item"), 0))
    total, fruitless, turn, whole = sequences(now), 0, 1, []
    while bound < total and fruitless < FRUITLESS:
        least = now.where("gap > 0").agg(F.min("length")).first()[0]
        loose = now.where(F.col("gap") >= least)
        counts = histogram(loose)
        number, had = int(counts.sum()), sequences(loose)
        if had <= lower_bound(counts, capacity):
            break
        whole.append(now.where(F.col("gap") < least))
        first = turn << 24
        now = packed(by_gap(loose, first) if turn % 2 else by_chance(loose, number, F.struct("part", "bin"), first), 0)
        gained = had - sequences(now)
        total -= gained
        fruitless, turn = 0 if gained else fruitless + 1, turn + 1
        if not gained and number <= part_items:
            break
    places = now
    for more in whole:
        places = places.unionByName(more)
    places = places.select("item", (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    facts = [F.lit(total).cast("long").alias("n_sequences"), F.lit(bound).cast("long").alias("lower_bound"), F.lit(total == bound).alias("certified")]
    return pieces.join(places, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *facts)


def packed_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenizes and packs whole documents (doc_id, text; other columns are ignored; a null text is empty, so its end id alone)."""
    return pack_sequences(pieces_of(docs, tokenizer, end_id, capacity), capacity)
