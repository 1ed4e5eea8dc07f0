"""Hard negatives by a dual-tree search: anchors in blocks against all rows, node pairs pruned by intervals of their inner products."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, record_batch, shared_dir, stored
from lexmill.llm.vectors import integer_vectors, matrix

HIT_SCHEMA = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
HITS = "anchor int, slot int, score long, vec_id long"
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Tree:
    """Vectors sorted so that every node is a range; a node has a ball around its vectors and the range of their labels.

    Labels are split first, then the widest component at its median, so nodes of one label are the rule.
    """

    order: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(x: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        order = np.argsort(labels, kind="stable")
        x, labels = x[order], labels[order]
        ranges, links, todo = [(0, len(x))], [(-1, -1)], [0]
        while todo:
            node = todo.pop()
            a, b = ranges[node]
            if b - a <= leaf:
                continue
            if labels[a] != labels[b - 1]:
                cut = a + int(np.searchsorted(labels[a:b], max(labels[(a + b) // 2], labels[a] + 1)))
            else:
                part = x[a:b]
                spread = part.max(axis=0) - part.min(axis=0)
                cut = (a + b) // 2
                if spread.any():  # else equal vectors, which any cut parts
                    own = np.argpartition(part[:, int(spread.argmax())], cut - a)
                    x[a:b], order[a:b] = part[own], order[a:b][own]
            links[node] = (len(ranges), len(ranges) + 1)
            todo += links[node]
            ranges += [(a, cut), (cut, b)]
            links += [(-1, -1), (-1, -1)]
        start, end = np.array(ranges, dtype=np.int64).T
        left, right = np.array(links, dtype=np.int64).T
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        centre = np.round((sums[end] - sums[start]) / np.maximum(end - start, 1)[:, None])  # any point is a centre; whole numbers keep the arithmetic near exact
        radius = np.array([math.sqrt(((x[a:b] - c) ** 2).sum(axis=1).max()) if b > a else 0.0 for a, b, c in zip(start.tolist(), end.tolist(), centre)])
        norm = np.sqrt((centre**2).sum(axis=1))
        return Tree(order, x, labels, start, end, left, right, centre, norm, radius, labels[start] if len(x) else start, labels[end - 1] if len(x) else start)


def interval(q: Tree, c: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between nodes i of q and j of c, widened by more than rounding can take away."""
    middle = np.einsum("ij,ij->i", q.centre[i], c.centre[j])
    reach = q.norm[i] * c.radius[j] + c.norm[j] * q.radius[i] + q.radius[i] * c.radius[j]
    reach = reach * (1 + 1e-9) + q.norm[i] * c.norm[j] * 1e-9 + 1
    return middle - reach, middle + reach


class Search:
    """The best `top` rows of each anchor and slot whose score lies within the slot's limits, over any number of batches of candidates.

    same: candidates have the anchor's label and another vec_id; else they have another label. low, high: (anchors, slots), inclusive.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int, leaf: int = 32):
        self.tree = Tree.of(x.copy(), labels, leaf)
        self.ids, self.low, self.high = ids[self.tree.order], low[self.tree.order], high[self.tree.order]
        self.same, self.top = same, top
        self.scores = np.full((*low.shape, top), LEAST, dtype=np.int64)
        self.found = np.full((*low.shape, top), MOST, dtype=np.int64)
        self.peak = int(np.abs(x).max()) if x.size else 0

    def limits(self) -> np.ndarray:
        """A score below this can't be among the best of an anchor's slot; of slots that want nothing, MOST."""
        return np.maximum(self.low, self.scores[:, :, -1])

    def pairs(self, c: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaf pairs that may hold a hit, with their intervals, the most promising first."""
        q, limit = self.tree, self.limits()
        wants = limit <= self.high
        least = np.where(wants, limit, MOST).min(axis=1)
        most = np.where(wants, self.high, LEAST).max(axis=1)
        edges = lambda f, values, empty: np.array([f(values[a:b]) if b > a else empty for a, b in zip(q.start.tolist(), q.end.tolist())])
        node_least, node_most = edges(np.min, least, MOST), edges(np.max, most, LEAST)
        i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        while len(i):
            low, high = interval(q, c, i, j)
            keep = (high >= node_least[i]) & (low <= node_most[i])
            if self.same:
                keep &= (q.low[i] <= c.high[j]) & (c.low[j] <= q.high[i])
            else:
                keep &= (q.low[i] != q.high[i]) | (c.low[j] != c.high[j]) | (q.low[i] != c.low[j])
            i, j, low, high = i[keep], j[keep], low[keep], high[keep]
            ends_q, ends_c = q.left[i] < 0, c.left[j] < 0
            leaves = ends_q & ends_c
            done.append((i[leaves], j[leaves], low[leaves], high[leaves]))
            by_c = ~leaves & ~ends_c & (ends_q | (c.radius[j] >= q.radius[i]))
            by_q = ~leaves & ~by_c
            i, j = np.concatenate([i[by_c], i[by_c], q.left[i[by_q]], q.right[i[by_q]]]), np.concatenate([c.left[j[by_c]], c.right[j[by_c]], j[by_q], j[by_q]])
        i, j, low, high = (np.concatenate(x) for x in zip(*done))
        best = np.argsort(-high, kind="stable")
        return i[best], j[best], low[best], high[best]

    def add(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = 128) -> None:
        """A batch of candidates; equal scores are ranked by the smaller id."""
        if not len(x) or not len(self.ids):
            return
        c = Tree.of(x.copy(), labels, leaf)
        ids, q = ids[c.order], self.tree
        peak = int(np.abs(x).max()) if x.size else 0
        exact = np.float64 if peak * self.peak * x.shape[1] < 1 << 53 else np.int64
        mine, theirs = q.x.astype(exact), c.x.astype(exact)
        for i, j, low, high in zip(*(v.tolist() for v in self.pairs(c))):
            a, b, s, e = q.start[i], q.end[i], c.start[j], c.end[j]
            limit = np.maximum(self.low[a:b], self.scores[a:b, :, -1])
            if not ((limit <= high) & (limit <= self.high[a:b]) & (self.high[a:b] >= low)).any():
                continue
            scores = (mine[a:b] @ theirs[s:e].T).astype(np.int64)
            fits = q.labels[a:b, None] == c.labels[None, s:e]
            fits = fits & (self.ids[a:b, None] != ids[None, s:e]) if self.same else ~fits
            for slot in range(limit.shape[1]):
                hit = fits & (scores >= limit[:, slot, None]) & (scores <= self.high[a:b, slot, None])
                rows = np.flatnonzero(hit.any(axis=1))
                if not len(rows):
                    continue
                cols = np.flatnonzero(hit[rows].any(axis=0))
                at = np.ix_(rows, cols)
                own = np.where(hit[at], scores[at], LEAST)
                own_ids = np.where(hit[at], ids[s:e][cols][None, :], MOST)
                own = np.concatenate([self.scores[a + rows, slot], own], axis=1)
                own_ids = np.concatenate([self.found[a + rows, slot], own_ids], axis=1)
                first = np.lexsort((own_ids, -own), axis=1)[:, : self.top]
                self.scores[a + rows, slot] = np.take_along_axis(own, first, axis=1)
                self.found[a + rows, slot] = np.take_along_axis(own_ids, first, axis=1)

    def hits(self) -> list[np.ndarray]:
        """anchor (its number as given), slot, score, id."""
        row, slot, nth = np.nonzero(self.scores > LEAST)
        return [self.tree.order[row].astype(np.int32), slot.astype(np.int32), self.scores[row, slot, nth], self.found[row, slot, nth]]


def best_rows(candidates: DataFrame, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, top: int) -> DataFrame:
    """anchor, slot, rank, score, vec_id of the best candidates; each task keeps its own best and Spark ranks the tasks'."""
    width = anchors["x"].shape[1]
    sent = candidates.sparkSession.sparkContext.broadcast((anchors, low, high))  # a block of anchors, so bounded

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = sent.value
        found = Search(block["x"], block["label"], block["vec_id"], low, high, same, top)
        for batch in batches:
            found.add(matrix(batch.column(2), width), batch.column(1).to_numpy(), batch.column(0).to_numpy())
        yield record_batch(HIT_SCHEMA, found.hits())

    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    hits = candidates.select("vec_id", "label", "v").mapInArrow(search, HITS)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def seeded(candidates: DataFrame, sample: DataFrame, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, top: int) -> DataFrame:
    """best_rows() over all candidates, whose limits start at what a sample of them already gives."""
    raised = low.copy()
    for r in best_rows(sample, anchors, low, high, same, top).where(F.col("rank") == top).collect():  # one row a slot
        raised[r["anchor"], r["slot"]] = r["score"]
    return best_rows(candidates, anchors, raised, high, same, top)


def _blocks(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The anchors with the number of their block, none of which has more than `size`."""
    n = max(1, -(-anchors.count() // size))
    while True:
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        if dealt.groupBy("block").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= size:
            return dealt, n
        n *= 2


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, block: int = 20_000, sample: int = 16_384) -> DataFrame:
    """For each anchor and each of its positives, the rows of other labels that score nearest below the positive.

    vectors: vec_id (long), embedding (array of floats), label (int); other columns, whatever their names, are left out. Rows with a null
    vec_id or label, a null vector, or a null or non-finite component take no part; components become floor(256 * x) (beyond 2**24 raises
    OverflowError), and shorter vectors count as filled up with zeros. Anchors are the rows whose vec_id is divisible by `every`; of those
    that repeat a vec_id, the one with the least label and bytes. An anchor's positives are the first `positives` rows of its label with
    another vec_id, by score, then by vec_id; a positive's negatives are the first `negatives` rows of other labels whose score is between
    `least_percent` of the positive's and the positive's. Other rows that repeat a vec_id each count. An empty table gives no rows.

    Anchors are sent in blocks of at most `block` rows; every task holds one tree over a block and one over its batch of candidates. About
    `sample` rows, whatever the input's size, only give limits to start from. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding").where("vec_id is not null and label is not null")
    own = stored(integer_vectors(given, ["vec_id", "label"]))
    facts = own.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("width")).first()
    width = max(1, (facts["width"] or 0) // 4)
    some = stored(own.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, facts["n"] // sample))) == 0).select("vec_id", "label", "v"))
    heads = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    heads = stored(heads)
    dealt, n_blocks = _blocks(heads, block)
    path = shared_dir(spark)
    for b in range(n_blocks):
        rows = dealt.where(F.col("block") == b).orderBy("vec_id").collect()  # at most `block`
        anchors = {"vec_id": np.array([r["vec_id"] for r in rows], dtype=np.int64), "label": np.array([r["label"] for r in rows], dtype=np.int32), "x": matrix(pa.array([r["v"] for r in rows], pa.binary()), width)}
        shape = (len(rows), 1)
        near = seeded(own, some, anchors, np.full(shape, LEAST + 1), np.full(shape, MOST - 1), True, positives).collect()  # `positives` rows an anchor
        low, high = np.full((len(rows), positives), MOST, dtype=np.int64), np.full((len(rows), positives), LEAST, dtype=np.int64)
        for r in near:
            low[r["anchor"], r["rank"] - 1], high[r["anchor"], r["rank"] - 1] = -(-least_percent * r["score"] // 100), r["score"]
        far = seeded(own, some, anchors, low, high, False, negatives)
        pairs = spark.createDataFrame([(r["anchor"], r["rank"] - 1, int(anchors["vec_id"][r["anchor"]]), r["vec_id"], r["score"]) for r in near], "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        out = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), ["anchor", "slot"])
        out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    for done in (own, some, heads):
        dropped(done)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def relabelled(vectors: DataFrame, every: int = 7, kinds: int = 10) -> DataFrame:
    """vec_id, embedding, label, with the label of every so many vec_ids moved to the next: labels that aren't all right."""
    label = F.col("label").cast("int")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (label + 1) % kinds).otherwise(label).alias("label"))
