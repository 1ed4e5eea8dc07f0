"""Exact passages that several documents share, whatever the lines they lie in: found by winnowing, checked by their words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, dropped, give_back, in_small_batches, join_ids, mixed, record_batch, small, stored, text_bytes, word_codes
from lexmill.llm.encoding import slices

WORDS = 50
BATCH_CHARS = 2_000_000
BASE = 0x9E3779B97F4A7C15
WORD_BYTES = re.compile(WORD.encode())
KEY_SCHEMA = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])
TEXT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_code", pa.int64()), ("text", pa.string())])


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """A code of each run of n words; equal runs have equal codes wherever they begin."""
    powers, back = (np.full(len(codes) + 1, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * back[:-1], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * powers[: len(codes) - n + 1])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    have, out = 1, x
    while 2 * have <= n:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (n - have)], out[n - have :])


def windows(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `words` words within a text: the text's number, the first word's place in it, the run's code, and its key.

    The key is the least code of the runs of half as many words in it, so it depends on the run's words alone, and neighbouring runs
    mostly share it.
    """
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    codes = word_codes([w for own in split for w in own])
    if len(codes) < words:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    half = words // 2 + 1
    keys = _least(_runs(codes, half), words - half + 1)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(of[: len(codes) - words + 1] == of[words - 1 :])
    return of[at], at - (np.cumsum(sizes) - sizes)[of[at]], _runs(codes, words)[at], keys[at]


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """key, doc_id of all runs, neighbours with one key once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), text_bytes(batch.column(1))
            for a, b in slices(texts, BATCH_CHARS):
                of, _, _, keys = windows(texts[a:b], words)
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
                yield record_batch(KEY_SCHEMA, [keys[new].view(np.int64), ids[a:b][of[new]]])
        give_back()

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(emit, "key long, doc_id long")


def _codes(docs: DataFrame, words: int) -> DataFrame:
    """key (a run's code), doc_id of the runs whose key is in the document's `keys`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)
            for i, text in enumerate(texts):
                _, _, codes, keys = windows([text], words)
                own = np.unique(codes[np.isin(keys.view(np.int64), lists[i].values.to_numpy())])
                yield record_batch(KEY_SCHEMA, [own.view(np.int64), np.full(len(own), ids[i])])
        give_back()

    return in_small_batches(docs.select("doc_id", "text", "keys")).mapInArrow(emit, "key long, doc_id long")


def without_runs(text: bytes, codes: np.ndarray, words: int = WORDS) -> bytes:
    """The text without the runs that have one of these codes; a line end after a cut stays unless the cut began the line."""
    _, at, own, _ = windows([text], words)
    hit = at[np.isin(own.view(np.int64), codes)]
    spans = [m.span() for m in WORD_BYTES.finditer(text)]
    edges = np.zeros(len(spans) + 2, dtype=np.int64)
    np.add.at(edges, hit + 1, 1)
    np.add.at(edges, hit + words + 1, -1)
    change = np.flatnonzero(np.diff((np.cumsum(edges) > 0).astype(np.int64))).tolist()
    out, done = [], 0
    for i, j in zip(change[::2], change[1::2]):
        begin, end = spans[i][0], spans[j - 1][1]
        after = spans[j][0] if j < len(spans) else len(text)
        first = not text[:begin].rpartition(b"\n")[2].strip()
        out.append(text[done:begin])
        done = after if b"\n" not in text[end:after] else end + (text[end:after].index(b"\n") + 1 if first else 0)
    return b"".join([*out, text[done:]])


def _rewritten(docs: DataFrame, words: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists, codes = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2), batch.column(3).to_pylist()
            new = [without_runs(t, lists[i].values.to_numpy(), words).decode() for i, t in enumerate(texts)]
            yield record_batch(TEXT_SCHEMA, [ids, codes, new])
        give_back()

    return in_small_batches(docs.select("doc_id", "text", "keys", "text_code")).mapInArrow(emit, "doc_id long, text_code long, text string")


def _shared(rows: DataFrame) -> DataFrame:
    """key, first_doc of what two documents or more have."""
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return stored(ends.where("first_doc < last_doc").select("key", "first_doc"))


def _cuts(docs: DataFrame, keys: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows of documents that share a run, and for each doc_id that loses one the codes of what it loses."""
    met = stored(keys.join(_shared(keys), "key").select("doc_id", "key").distinct())
    some = stored(join_ids(docs, met.select("doc_id").distinct(), "left_semi").withColumn("text_code", F.xxhash64("text")))
    codes = stored(_codes(some.join(met.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "doc_id"), words))
    cut = stored(codes.join(_shared(codes), "key").where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys")))
    for done in (met, codes):
        dropped(done)
    return some, cut


def without_shared_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with each run of `words` words or more that two documents share cut from all but the one with the least doc_id.

    docs: doc_id (long), text and any other columns, whatever their names, which stay; n_chars, if there, is that of the new text. Documents of
    which no word is left go. Words are compared in ASCII lower case; lines play no part. Rows with a null doc_id or text stay as they
    are; rows that repeat a doc_id are one document. Any shared run has a key that both documents have (the least code of a half as long
    run in each `words` words), so only runs with such a key are compared in full. What is cut is in a document with a lesser doc_id: if
    it is cut there too, an even lesser one has it. A cut joins what stood around it, which may be a run that another document has too:
    documents that were cut are compared again, among themselves and with all others, until nothing is cut.
    """
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row"))
    keys = fresh = stored(_keys(own, words))
    edited, now = None, own
    while True:
        some, cut = _cuts(now, fresh, words)
        ids = stored(cut.select("doc_id"))
        if ids.isEmpty():
            break
        texts = stored(_rewritten(some.join(cut, "doc_id"), words).dropDuplicates(["doc_id", "text_code"]))
        changed = stored(some.drop("text").join(texts, ["doc_id", "text_code"]).select("doc_id", "text", "row"))
        for done in (some, cut, texts):
            dropped(done)
        before, edited = edited, changed if edited is None else stored(join_ids(edited, ids, "left_anti").unionByName(changed))
        if before is not None:
            dropped(before)
        now = join_ids(own, edited.select("doc_id").distinct(), "left_anti").unionByName(edited)
        new = stored(_keys(changed, words))
        old, keys = keys, stored(join_ids(keys, ids, "left_anti").unionByName(new))
        for done in (old,) if fresh is old else (old, fresh):
            dropped(done)
        fresh = stored(keys.join(small(stored(new.select("key").distinct())), "key", "left_semi"))
    if edited is None:
        return docs
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    changed = edited.where(F.col("text").rlike(WORD)).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    rest = docs.where("text is null").unionByName(join_ids(docs.where("text is not null"), edited.select("doc_id").distinct(), "left_anti"))
    return rest.unionByName(changed)
