"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import flat, record_batch, remainder, stored, words_in
from lexmill.llm.encoding import text_slices

#: Counts of words with a share of the training tokens of 1/HOT or more are sent to every task: by that, HOT words at most.
HOT = 1 << 18
#: The most frequent words are symbols of their own.
OWN = 1 << 15
#: Other words are symbols by class, their last three bytes' hash.
CLASSES = 2048
STATES = 12
ALPHA = 0.1
END = b""
BATCH_TOKENS = 500_000
#: Tokens whose posteriors are worked out at a time.
BLOCK = 1 << 14
#: Tokens whose posteriors are summed by symbol at a time, a multiple of BLOCK.
SUMMED = 8 * BLOCK
#: Tokens that one task of a round reads, where there are that many; each task sends its counts of all symbols.
TASK_TOKENS = 1 << 25


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


#: crc32 of single bytes, from which that of a few bytes follows.
CRC_BYTE = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ zlib.crc32(b"\xff") for b in range(256)], dtype=np.uint32)


def word_classes(words: pa.Array) -> np.ndarray:
    """word_class() of each of many words (binary, no null): the last bytes of all words are folded at once."""
    data, edges = flat(words)
    class_ = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for back in (3, 2, 1):
        at = np.flatnonzero(np.diff(edges) >= back)
        own = class_[at]
        class_[at] = CRC_BYTE[(own ^ data[edges[1:][at] - back]) & 0xFF] ^ (own >> np.uint32(8))
    return (~class_ % CLASSES).astype(np.int64)


@dataclass
class Vocabulary:
    """Hot words (the end first, then by count), their counts, each class's tokens and distinct words, and the totals N and V.

    Words of number `own` and more, and all that aren't hot, belong to their class.
    """

    hot: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    own: int

    @property
    def size(self) -> int:
        return self.own + CLASSES

    def unigram(self) -> np.ndarray:
        seen = np.concatenate([self.counts[: self.own], self.class_tokens]) + ALPHA
        return seen / seen.sum()


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state: the symbol's probability in the state


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary; empty: the end), n over all training tokens; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(texts)], pa.int64())], names=["word", "n"])
            for a, b in text_slices(texts):
                words = words_in(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([words.distinct, pa.array(np.bincount(words.at, minlength=len(words.distinct)))], names=["word", "n"])

    return stored(train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary's bounded part, and the counts of all words that aren't hot."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = (F.col("n") * HOT >= total["n"]) | (F.length("word") == 0)
    rows = counts.where(hot).toArrow().to_pydict()  # HOT + 1 rows at most
    known = sorted(zip(rows["word"], rows["n"]), key=lambda x: (x[0] != END, -x[1], x[0]))
    if not known or known[0][0] != END:
        known.insert(0, (END, 0))
    others = counts.where(~hot)
    tail = F.crc32(F.expr("substring(word, -3, 3)")) % CLASSES
    classes = others.groupBy(tail.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows at most
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        tokens[r["c"]], words[r["c"]] = r["n"], r["v"]
    for word, n in known[OWN:]:
        tokens[word_class(word)] += n
        words[word_class(word)] += 1
    return Vocabulary([w for w, _ in known], np.array([n for _, n in known], dtype=np.float64), tokens, words, total["n"], total["v"], min(OWN, len(known))), others


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"
RARE = pa.struct([("word", pa.binary()), ("n", pa.int64())])
CODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("symbols", pa.binary()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(RARE))])


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """The symbols of each text and its end, stored, short texts first in each file.

    base, score: the base score, and the model's score given the symbols, without the logarithms of the counts of words that aren't
    hot; rare: these words and how often the text has them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        hot, own, n_hot = pa.array(vocab.hot, pa.binary()), vocab.own, len(vocab.hot)
        classes = -np.log10(vocab.class_tokens + ALPHA * (vocab.class_words + 1))
        logs, total = np.log10(vocab.counts + ALPHA), math.log10(vocab.tokens + ALPHA * (vocab.distinct + 1))
        for batch in batches:
            for a, b in text_slices(batch.column(2), 3_000_000):
                words = words_in(batch.column(2).slice(a, b - a))
                n, k = b - a, len(words.distinct)
                number = pc.fill_null(pc.index_in(words.distinct, value_set=hot), n_hot).to_numpy()
                class_ = np.zeros(k, dtype=np.int64)
                far = np.flatnonzero(number >= own)
                class_[far] = word_classes(words.distinct.take(pa.array(far)))
                symbol = np.where(number < own, number, own + class_).astype("<i4")
                log = np.append(logs, 0.0)[number]
                score = np.where(number < own, 0.0, classes[class_] + log)
                ends = np.cumsum(words.sizes)
                doc = np.repeat(np.arange(n), words.sizes)
                sums = lambda x: np.bincount(doc, weights=x[words.at], minlength=n)
                seen = (np.append(vocab.counts > 0, False)[number]).astype(np.int64)
                symbols = np.insert(symbol[words.at], ends, np.int32(0))
                edges = np.append(0, 4 * (ends + np.arange(1, n + 1))).astype(np.int32)
                rare = np.flatnonzero(number[words.at] >= n_hot)
                pairs, times = np.unique(doc[rare] * max(1, k) + words.at[rare], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(n + 1) * max(1, k)).astype(np.int32)
                values = pa.StructArray.from_arrays([words.distinct.take(pa.array(pairs % max(1, k))), pa.array(times)], fields=list(RARE))
                yield record_batch(CODED_SCHEMA, [
                    batch.column(0).slice(a, n), batch.column(1).slice(a, n), words.sizes + 1,
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(symbols)]),
                    sums(seen).astype(np.int64) + int(vocab.counts[0] > 0), sums(log - total) + logs[0] - total, sums(score), pa.ListArray.from_arrays(pa.array(offsets), values),
                ])

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(encode, ENCODED.partition(", ")[2])
    return stored(rows.sortWithinPartitions("n_tokens").select(F.monotonically_increasing_id().alias("row"), "*"), compression="zstd")


def by_time(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first; how many are active at each step; all symbols, step by step."""
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    begin = np.cumsum(active) - active
    at = s[np.arange(int(active.sum())) - np.repeat(begin, active)] + np.repeat(np.arange(len(active)), active)
    return order, active, symbols[at]


def forward(model: Model, emit: np.ndarray, active: np.ndarray, every: int) -> np.ndarray:
    """Overwrites emit with the forward probabilities, scaled to sum to 1 at every `every`-th step; returns each row's scale."""
    scale, a, last = np.ones(len(emit), dtype=emit.dtype), 0, None
    move, ones = model.move.astype(emit.dtype), np.ones(len(model.start), dtype=emit.dtype)
    for t, m in enumerate(active.tolist()):
        own = emit[a : a + m]
        own *= model.start if last is None else last[:m] @ move
        if t % every == 0:
            s = own @ ones
            own /= s[:, None]
            scale[a : a + m] = s
        last = own
        a += m
    return scale


def likelihoods(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sequence's natural log probability; the forward probabilities are scaled to sum to 1 at every step."""
    order, active, seen = by_time(symbols, starts, sizes)
    scale = forward(model, model.emit[seen], active, 1)
    of = np.arange(len(seen)) - np.repeat(np.cumsum(active) - active, active)
    out = np.empty(len(sizes))
    out[order] = np.bincount(of, weights=np.log(scale), minlength=len(sizes))
    return out


def relative_emissions(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's emissions divided by their largest, in single precision, and the largest's logarithms."""
    largest = model.emit.max(axis=1)
    return (model.emit / largest[:, None]).astype(np.float32), np.log(largest)


class Room:
    """Arrays that a task uses again for each batch: memory that is new costs more time than what is done in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def array(self, name: str, rows: int, columns: int, dtype: type) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows:
            self.held[name] = np.empty((rows, columns), dtype=dtype)
        return self.held[name][:rows]


def expected_counts(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, relative: tuple[np.ndarray, np.ndarray] | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (symbol x state) by scaled forward-backward over whole sequences, and their log likelihood.

    Emissions are relative to their largest state's, so scaling at every second step keeps single precision in range.
    """
    order, active, seen = by_time(symbols, starts, sizes)
    table, largest = relative or relative_emissions(model)
    room, states, seen = room or Room(), len(model.start), seen.astype(np.intp)
    emit, alpha, beta = (room.array(name, len(seen), states, np.float32) for name in ("emit", "alpha", "beta"))
    table.take(seen, axis=0, out=emit, mode="clip")
    alpha[:] = emit
    scale = forward(model, alpha, active, 2)
    back, ones = np.ascontiguousarray(model.move.T.astype(np.float32)), np.ones(len(model.start), dtype=np.float32)
    a, ahead = len(seen), emit[:0]
    for t in range(len(active) - 1, -1, -1):
        m, k = int(active[t]), len(ahead)
        a -= m
        own = beta[a : a + m]
        own[k:] = 1
        if k:
            np.matmul(ahead, back, out=own[:k])
            if t % 2:
                own[:k] /= (own[:k] @ ones)[:, None]
        ahead = emit[a : a + m]
        ahead *= own  # from here on, emit holds the products with beta
    first = int(active[0]) if len(active) else 0
    ends = (np.cumsum(active) - active)[sizes[order] - 1] + np.arange(len(sizes))
    logs = np.log(scale, dtype=np.float64).sum() + np.log(alpha[ends].sum(axis=1), dtype=np.float64).sum() + largest[seen].sum()
    before, moves = np.arange(first, len(seen)) - np.repeat(active[:-1], active[1:]), np.zeros((states, states))
    by_state, out = room.array("by_state", states, SUMMED, np.float64), np.zeros((states, len(model.emit)))
    for i in range(0, len(seen), BLOCK):  # beta becomes the posteriors; blocks stay in a core's cache
        own = beta[i : i + BLOCK]
        own *= alpha[i : i + BLOCK]
        share = 1 / (own @ ones)
        own *= share[:, None]
        j, k = max(i, first), i + len(own)
        if j < k:
            ahead = emit[j:k]
            ahead *= (share[j - i :] / scale[j:k])[:, None]
            moves += alpha.take(before[j - first : k - first], axis=0).T @ ahead
        begun = i // SUMMED * SUMMED
        by_state[:, i - begun : k - begun] = own.T
        if k == begun + SUMMED or k == len(seen):
            for s in range(states):
                out[s] += np.bincount(seen[begun:k], weights=by_state[s, : k - begun], minlength=len(model.emit))
    return beta[:first].sum(axis=0, dtype=np.float64), moves * model.move, out.T, float(logs)


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, starts and sizes of about BATCH_TOKENS at a time, one text at least."""
    if not len(column):
        return
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
    symbols, a = np.frombuffer(data, dtype="<i4"), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BATCH_TOKENS, side="right")) - 1)
        own = edges[a : b + 1].astype(np.int64)
        yield symbols[own[0] : own[-1]], own[:-1] - own[0], np.diff(own)
        a = b


def baum_welch(train: DataFrame, known: Vocabulary, model: Model) -> tuple[Model, float]:
    """One round over all rows of train (symbols): each task's expected counts are summed by symbol, OWN + CLASSES rows at most.

    Returns the improved model, and the log likelihood of a token under the old one.
    """
    states, spark = len(model.start), train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        relative = relative_emissions(now)
        begun, moves, emitted, logs, room = np.zeros(states), np.zeros((states, states)), np.zeros(now.emit.shape), 0.0, Room()
        for batch in batches:
            for own in _batches(batch.column(0)):
                x, y, z, log = expected_counts(now, *own, relative, room)
                begun, moves, logs = begun + x, moves + y, logs + log
                emitted += z
        at = np.flatnonzero(emitted.any(axis=1))
        if not len(at):
            return
        rows = np.concatenate([emitted[at], moves, begun[None], np.full((1, states), logs)])
        ids = np.concatenate([at, -1 - np.arange(states + 2)]).astype(np.int32)
        for i in range(0, len(ids), 1 << 14):
            j = slice(i, i + (1 << 14))
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), *(pa.array(rows[j, s]) for s in range(states))], names=["symbol", *names])

    tasks = max(spark.sparkContext.defaultParallelism, -(-known.tokens // TASK_TOKENS))
    sums = train.select("symbols").coalesce(tasks).mapInArrow(expect, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    ids, values = sums.column("symbol").to_numpy(), np.stack([sums.column(n).to_numpy() for n in names], axis=1) if len(sums) else np.zeros((0, states))
    rest, emitted = np.zeros((states + 2, states)), np.zeros(model.emit.shape)
    emitted[ids[ids >= 0]] = values[ids >= 0]
    rest[-1 - ids[ids < 0]] = values[ids < 0]
    shared.unpersist()
    return improved(rest[states], rest[:states], emitted, known), float(rest[states + 1, 0]) / max(1, known.tokens)


def improved(begun: np.ndarray, moves: np.ndarray, emitted: np.ndarray, known: Vocabulary) -> Model:
    """The model of these counts, each state's emissions smoothed with some of the unigram distribution."""
    begun = begun + 0.5
    moves = moves + 0.5
    emitted = emitted + 50 * known.unigram()[:, None]
    return Model(begun / begun.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


def first_model(known: Vocabulary, states: int, seed: int = 7) -> Model:
    """Nearly the unigram distribution in each state; the states tend to stay."""
    random = np.random.default_rng(seed)
    emit = known.unigram()[:, None] * random.gamma(2.0, 0.5, (known.size, states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def train_model(train: DataFrame, known: Vocabulary, states: int = STATES, rounds: int = 12, gain: float = 0.005) -> Model:
    """Baum-Welch rounds, each over all training rows, until a round has gained less than `gain` natural log units a token, but `rounds` at most."""
    model, before = first_model(known, states), -math.inf
    for _ in range(rounds):
        model, now = baum_welch(train, known, model)
        if now - before < gain:
            break
        before = now
    return model


SCORED_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = 12, gain: float = 0.005) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    docs: doc_id, text; other columns are ignored. Null and empty texts are the end token alone. Rows are scored one by one; those
    with a null doc_id or crc32(doc_id) mod 10 = 0 aren't learned from; all others are in each round of train_model(). The model:
    states move and emit symbols; a symbol is the end or one of the most frequent words, or a class, and then the word has its smoothed
    share of the class's training tokens. Texts become symbols once; rounds and the forward recursion read these. Counts of words that
    aren't hot come by a join on the word, so no task holds the whole vocabulary, which grows with the corpus.
    """
    spark = docs.sparkSession
    held = F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    counts = word_counts(docs.where("not held_out"))
    known, others = vocabulary(counts)
    rows = encoded(docs, known)
    model = train_model(rows.where("not held_out"), known, states, rounds, gain)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            logs = [likelihoods(own, *x) for x in _batches(batch.column(4))]
            scores = np.concatenate([np.zeros(0), *logs]) / math.log(10) + batch.column(7).to_numpy()
            yield record_batch(SCORED_SCHEMA, [*(batch.column(i) for i in (0, 1, 2, 3, 5, 6)), scores])

    fixed = rows.drop("rare").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(others.withColumnRenamed("n", "c").hint("shuffle_hash"), "word", "left")
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"), F.sum(log).alias("rare_log"))
    out = fixed.join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "rare_known").cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), plus("base", "rare_log").alias("base_score"), plus("score", "rare_log").alias("score"))
