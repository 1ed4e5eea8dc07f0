"""Size-aware heavy-light join: documents whose word-shingle sets have a Jaccard similarity of 3/4 or more, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import give_back, in_small_batches, join_ids, record_batch, stored, text_bytes
from lexmill.llm.components import components
from lexmill.llm.encoding import slices
from lexmill.llm.shingles import shingle_sets

BUCKET_BITS = 18
#: The boundary between small and large sets is sought up to this size, beyond which subsets are always dearer than lists.
MOST_SMALL = 64
SIGNED = "doc_id long, n long, f1 long, f2 long, prefix array<long>, scan long"
SIGNED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("scan", pa.int64())])
SET_SCHEMA = pa.schema([("id", pa.int64()), ("codes", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
    for a, b in slices(texts):
        yield doc_ids[a:b], shingle_sets(texts[a:b])


def shingle_frequencies(docs: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall into each of 2^18 buckets: a table of fixed size, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for _, sets in _sets(batch):
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 15):
            part = at[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])
        give_back()

    found = in_small_batches(docs).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def signed_sets(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """Size, fingerprint and prefix of each document's set.

    Shingles are ordered by their bucket's frequency, rare first, then by code: an order that all sets share. Sets that link
    have at least c = ceil(3n/4) shingles of either in common, so their least common shingle is among the first n-c+1 of each,
    and their two least are among the first n-c+2, the prefix. scan: what reading the lists of the first n-c+1 is
    estimated to cost.
    """
    rank = docs.sparkSession.sparkContext.broadcast(frequencies.astype(np.uint32))  # 1 MB, whatever the input

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = rank.value
        mean = max(1.0, float(weight.mean()))
        for batch in batches:
            for doc_ids, sets in _sets(batch):
                rows = []
                for s in sets:
                    n = len(s)
                    if not n:
                        rows.append((0, None, None, None, 0))
                        continue
                    w = weight[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    first = n + (-3 * n // 4) + 1
                    kept = min(n, first + 1)
                    order = np.argsort(w, kind="stable") if kept == n else np.lexsort((s, w))
                    prefix, w = s[order[:kept]].view(np.int64), w[order[:first]]
                    f1 = int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                    f2 = int((s ^ (s >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64))
                    rows.append((n, f1, f2, prefix, int(first + np.maximum(0, w - mean).sum())))
                n, f1, f2, prefix, scan = zip(*rows)
                yield record_batch(SIGNED_SCHEMA, [doc_ids, n, f1, f2, prefix, scan])
        give_back()

    return in_small_batches(docs).mapInArrow(sign, SIGNED)


def boundary(reps: DataFrame) -> int:
    """The size x up to which sets enumerate pairs of their prefix, by cost; larger than 3x/4 are read by inverted lists.

    A pair of sets up to x meets in a subset; otherwise one is larger than x and the other, as it may link, than 3x/4.
    """
    p = F.size("prefix").cast("long")
    rows = reps.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.sum(p * (p - 1) / 2).alias("subsets"), F.sum("scan").alias("lists")).collect()  # 64 rows at most
    subsets, lists = ({r["n"]: float(r[c]) for r in rows} for c in ("subsets", "lists"))

    def cost(x: int) -> float:
        return sum(v for n, v in subsets.items() if n <= x) + sum(v for n, v in lists.items() if 4 * n > 3 * x)

    return min(range(MOST_SMALL + 1), key=cost)


def _keys(small: int) -> Column:
    """key, reach of a set's prefix: reach is the most that a set can share with another if this key is the first they share."""
    pairs = F.flatten(F.transform("prefix", lambda a, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda b, k: F.struct(F.xxhash64(F.lit(2), a, b).alias("key"), (F.col("n") - i - k).alias("reach")))))
    single = F.transform(F.slice("prefix", 1, (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1).cast("int")), lambda a, i: F.struct(a.alias("key"), (F.col("n") - i).alias("reach")))
    nothing = F.array().cast("array<struct<key:long,reach:long>>")
    return F.concat(F.when(F.col("n") <= small, pairs).otherwise(nothing), F.when(F.col("n") * 4 > 3 * small, single).otherwise(nothing))


def _enough(n: Column, m: Column, reach: Column) -> Column:
    """Whether sets of n and m shingles that share at most `reach` can link."""
    return 7 * reach >= 3 * (n + m)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs whose prefixes leave room for a link.

    What two sets have in common, up to where the shorter-reaching prefix ends, lies in both prefixes; beyond, no more than that set's
    other shingles can follow. The larger of both remainders bounds it.
    """
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return both.where(175 * most >= 75 * (F.col("na") + F.col("nb"))).select("a", "b")


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a > b) whose sets link, by comparing the sets of the documents that pairs name."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, found in _sets(batch):
                yield record_batch(SET_SCHEMA, [doc_ids, [s.view(np.int64) for s in found]])
        give_back()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = stored(in_small_batches(join_ids(docs, ids, "left_semi")).mapInArrow(sets, "id long, codes array<long>"))
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("codes").alias("ca")), "a").join(own.select(F.col("id").alias("b"), F.col("codes").alias("cb")), "b")
    same = F.size(F.array_intersect("ca", "cb")).cast("long")
    return both.where(100 * same >= 75 * (F.size("ca") + F.size("cb") - same)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach.

    docs: doc_id, text; other columns are ignored. Null, empty and blank texts have no shingles and link with nothing. A null doc_id
    names no document: such rows come back with a null component_id. Repeated rows are one document. Documents
    with equal sets are one representative. Each key (a shingle or pair of shingles of a prefix) pairs each of its sets with the one before
    it and with the first, so a group of m copies yields 2m candidates, not m^2. The first is the set whose prefix is the most
    frequent: of a text and its edited copies, the text itself, which all of them resemble. Candidates are verified and joined
    into components. Only where a key still holds more than one component, among the sets it can be the first shared key of, sets of
    different components are compared with each other, which makes the result exact. Codes are 64-bit hashes of shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(signed_sets(docs, shingle_frequencies(docs)))
    classes = stored(signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("scan").alias("scan")))
    small = boundary(classes)
    entries = classes.where("n > 1").select("rep", "n", (F.col("scan") / F.col("n")).alias("central"), F.explode(_keys(small)).alias("k")).select("rep", "n", "central", "k.key", "k.reach")
    by_key = Window.partitionBy("key").orderBy(F.desc("central"), "rep")
    me = F.struct("rep", "n", "reach")
    near = entries.select("key", "rep", "n", "reach", F.lag(me).over(by_key).alias("before"), F.lead("rep").over(by_key).alias("after"), F.first(me).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("hub"))
    near = stored(near.where("before is not null or after is not null"))
    likely = lambda other: (F.col(f"{other}.rep") != F.col("rep")) & _enough(F.col("n"), F.col(f"{other}.n"), F.least("reach", f"{other}.reach"))
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    first = near.where(likely("before")).select(*ordered("rep", "before.rep")).unionByName(near.where(likely("hub")).select(*ordered("rep", "hub.rep"))).distinct()
    first = stored(first)
    links = stored(_links(stored(_possible(first, classes)), docs))
    found = components(links)

    labelled = near.select("key", "rep", "n", "reach").join(found.select(F.col("a").alias("rep"), F.col("b").alias("of")), "rep", "left").select("key", "rep", "n", "reach", F.coalesce("of", "rep").alias("of"))

    def several(rows: DataFrame, sets: int) -> DataFrame:
        return rows.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count("*").alias("m"), F.min("n").alias("least")).where((F.col("x") < F.col("y")) & (F.col("m") >= sets)).select("key", "least")

    left = stored(labelled.join(several(labelled, 3), "key").where(_enough(F.col("n"), F.greatest("least", F.ceil(F.col("n") * 3 / 4)), F.col("reach"))).drop("least"))
    left = stored(left.join(several(left, 2).select("key"), "key", "left_semi"))
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.of") != F.col("y.of")) & (F.col("x.rep") > F.col("y.rep")) & _enough(F.col("x.n"), F.col("y.n"), F.least("x.reach", "y.reach")))
    rest = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    rest = stored(rest.join(first, ["a", "b"], "left_anti"))
    more = stored(_links(stored(_possible(rest, classes)), docs))
    if more.limit(1).count():
        found = components(links.unionByName(more))

    of = classes.select("f1", "f2", "n", "rep").join(found.select(F.col("a").alias("rep"), "b"), "rep", "left").select("f1", "f2", "n", F.coalesce("b", "rep").alias("of"))
    out = signed.select("doc_id", "n", "f1", "f2").join(of, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those whose component has a lesser doc_id; all columns stay, and so do rows with a null doc_id."""
    found = jaccard_components(docs)
    return join_ids(docs, found.where("doc_id <> component_id").select("doc_id").distinct(), "left_anti")
