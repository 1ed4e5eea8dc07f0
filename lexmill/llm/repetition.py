"""Quality rules on repetition inside a document, from suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import give_back, in_small_batches, record_batch, text_bytes, word_codes
from lexmill.llm.encoding import slices

SYMBOLS = "#*$%&|<>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, spans array<array<long>>"


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words from there that its document has elsewhere too.

    Suffix array of all documents' words by prefix doubling (ranks over 1, 2, 4, ... words, documents apart), then the longest
    common prefix of neighbouring suffixes from the same ranks. The deepest common-prefix interval around a suffix, so its longest
    repeat, is the larger of those to its two neighbours.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    _, ids = np.unique(words, return_inverse=True)
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids.reshape(-1)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = head + 1  # rank 0: beyond the document's end
    ranks, step = [rank], 1
    end = np.append(np.flatnonzero(np.diff(doc)) + 1, n)[np.unique(doc, return_inverse=True)[1].reshape(-1)]
    while True:
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        open_ = np.flatnonzero(~single)  # places in the order where suffixes are still equal
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + step < end[at], rank[np.minimum(at + step, n - 1)], 0)
        again = np.lexsort((after, rank[at]))
        at, after = at[again], after[again]
        order[open_] = at
        own = rank[at]
        changed = np.ones(len(at), dtype=bool)
        changed[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        fresh = fresh.copy()
        fresh[open_] = changed
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(changed, open_, 0)) + 1
        ranks.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(ranks[0][a] == ranks[0][b])
    common = np.zeros(n + 1, dtype=np.int64)
    i, j, got = a[near], b[near], np.zeros(len(near), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = i + got, j + got
        inside = (x < end[i]) & (y < end[j])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        got += np.where(inside & (ranks[k][x] == ranks[k][y]) & (x + (1 << k) <= end[i]) & (y + (1 << k) <= end[j]), 1 << k, 0)
    common[near + 1] = got
    out = np.empty(n, dtype=np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def repetition(docs: DataFrame, min_repeat: int = 8) -> DataFrame:
    """Counts of every whole text, and the spans [first word, end) that the union of its repeats of `min_repeat` words or more covers.

    docs: doc_id, text; other columns are ignored. Null, empty and blank texts have no words. Rows are scored one by one, so repeated
    rows and ids give a row each. Texts are taken about a million characters at a time, a longer one by itself.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in slices(texts):
                yield record_batch(SCHEMA, _scored(doc_ids[a:b], texts[a:b], min_repeat))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, COLUMNS)


def _scored(doc_ids: list, texts: list[bytes], min_repeat: int) -> list:
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    codes = word_codes([w for words in split for w in words])
    doc = np.repeat(np.arange(len(texts)), sizes)
    longest = longest_repeats(codes, doc)
    n = len(codes)
    own = lambda at: np.bincount(doc[at], minlength=len(texts)).astype(np.int64)
    three = np.flatnonzero(longest >= 3)
    words3 = own(covered(three, np.full(len(three), 3), n)) if n else sizes
    long_ = np.flatnonzero(longest >= min_repeat)
    inside = covered(long_, longest[long_], n)
    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, doc, longest)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & (doc[1:] == doc[:-1])])) if n else np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & (doc[1:] == doc[:-1]), [False]])) + 1 if n else starts
    base = np.cumsum(sizes) - sizes
    spans: list[list] = [[] for _ in texts]
    for s, e, d in zip(starts.tolist(), ends.tolist(), doc[starts].tolist()):
        spans[d].append([s - int(base[d]), e - int(base[d])])
    chars, symbols, dups = [], [], []
    for t, words in zip(texts, split):
        joined = b"".join(words)
        chars.append(len(joined.decode()))
        symbols.append(sum(map(joined.count, (c.encode() for c in SYMBOLS))))
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dups.append(len(lines) - len(set(lines)))
        else:
            dups.append(0)
    return [doc_ids, sizes, chars, symbols, dups, words3, own(np.flatnonzero(inside)) if n else sizes, top, spans]


def _passes(n, repeat, inside, longest, max_covered: float, max_repeat: int, min_words: int):
    """(base_failed, kept) from counts; for columns and arrays alike."""
    failed = (n < min_words) | (100 * repeat > 50 * n)
    return failed, ~failed & (inside <= max_covered * n) & (longest <= max_repeat)


def repetition_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.4, max_repeat: int = 200, min_words: int = 50) -> DataFrame:
    """repetition() with base_failed (fewer than `min_words` words, or over half of them in repeated 3-word windows) and kept.

    Kept: the base hasn't failed, repeats of `min_repeat` words or more cover at most `max_covered` of the words, and the longest repeat has
    at most `max_repeat` words. The limits are in words, whatever the corpus.
    """
    failed, kept = _passes(F.col("n_words"), F.col("n_repeat_words"), F.col("covered_words"), F.col("longest_repeat"), max_covered, max_repeat, min_words)
    return repetition(docs, min_repeat).withColumn("base_failed", failed).withColumn("kept", kept)


def without_repetitive(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.4, max_repeat: int = 200, min_words: int = 50) -> DataFrame:
    """The documents that repetition_rules() keeps, with all their columns; nothing is shuffled."""
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(place))
            for a, b in slices(texts):
                _, n, _, _, _, repeat, inside, longest, _ = _scored([None] * (b - a), texts[a:b], min_repeat)
                _, kept = _passes(n, repeat, inside, longest, max_covered, max_repeat, min_words)
                yield batch.slice(a, b - a).filter(pa.array(kept))
        give_back()

    return in_small_batches(docs).mapInArrow(keep, docs.schema)
