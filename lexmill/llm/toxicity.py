"""A linear-chain conditional random field that tags toxic spans; its marginals give document scores and offending offsets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import record_batch, remainder, text_bytes
from lexmill.llm.encoding import slices
from lexmill.llm.labelled import labelled_sample

DIMENSIONS = 1 << 18
#: Documents of a class that the field is fitted to.
BOUND = 3000
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: A feature belongs to toxic documents where its log-likelihood ratio exceeds the logarithm of the number of features looked at by so much.
SURE = 2.0


def features(word: bytes) -> list[int]:
    """Hashed features of one token: the stripped lower-case word, its first three to six bytes and its last four."""
    w = word.lower().strip(EDGES)
    return [zlib.crc32(x) % DIMENSIONS for x in (b"w" + w, b"3" + w[:3], b"4" + w[:4], b"5" + w[:5], b"6" + w[:6], b"s" + w[-4:])]


@dataclass
class Field:
    """weights: of toxic against clean by feature; move: log potentials (from, to); document: intercept and weights of a document's two figures."""

    weights: np.ndarray
    move: np.ndarray
    document: np.ndarray


def marginals(node: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of the toxic tag, and the expected counts of tag pairs, by scaled forward-backward.

    node: log potential of toxic against clean; sequences lie one after the other.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left").tolist()
    at = np.concatenate([s[:m] + t for t, m in enumerate(active)]) if longest else np.zeros(0, dtype=np.int64)
    x = np.clip(node[at], -30, 30)
    heat = np.stack([1 / (1 + np.exp(x)), 1 / (1 + np.exp(-x))], axis=1)
    step = np.exp(move)
    alpha, scale, last, a = np.empty_like(heat), np.empty(len(heat)), None, 0
    for m in active:
        own = heat[a : a + m] * 0.5 if last is None else (last[:m] @ step) * heat[a : a + m]
        c = own.sum(axis=1)
        last = alpha[a : a + m] = own / c[:, None]
        scale[a : a + m] = c
        a += m
    toxic, pairs, beta = np.empty(len(heat)), np.zeros((2, 2)), np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        a -= m
        if len(beta) < m:
            beta = np.concatenate([beta, np.ones((m - len(beta), 2))])
        toxic[a : a + m] = alpha[a : a + m, 1] * beta[:, 1]
        if t:
            ahead = heat[a : a + m] * beta / scale[a : a + m, None]
            b = a - active[t - 1]
            pairs += alpha[b : b + m].T @ ahead
            beta = ahead @ step.T
    out = np.empty(len(node))
    out[at] = toxic
    return out, pairs * step


def figures(toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A document's largest marginal, and the logarithm of one plus the sum of those over 0.2."""
    starts, some = np.cumsum(sizes) - sizes, sizes > 0
    out = np.zeros((len(sizes), 2))
    if some.any():
        out[some, 0] = np.maximum.reduceat(toxic, starts[some])
        out[some, 1] = np.log1p(np.add.reduceat(np.where(toxic > 0.2, toxic, 0), starts[some]))
    return out


def near_copies(docs: list[list[bytes]], seeds: int = 6) -> np.ndarray:
    """The number of each document's group of near copies: those whose word pairs have a similarity of 0.75 or more with the group's first.

    Documents that share a least hash of their word pairs are compared, each with the first of the groups that have it.
    """
    firsts: dict[tuple[int, int], list[int]] = {}
    pairs: list[set] = []
    of = np.arange(len(docs))
    for i, words in enumerate(docs):
        own = {a + b" " + b for a, b in zip(words, words[1:])} or {b" ".join(words)}
        pairs.append(own)
        marks = [(seed, min(zlib.crc32(p, seed) for p in own)) for seed in range(1, seeds + 1)]
        for j in dict.fromkeys(j for m in marks for j in firsts.get(m, [])):
            same = len(own & pairs[j])
            if 100 * same >= 75 * (len(own) + len(pairs[j]) - same):
                of[i] = j
                break
        else:
            for m in marks:
                firsts.setdefault(m, []).append(i)
            continue
        pairs[i] = set()  # only firsts are compared again
    return of


def token_labels(docs: list[list[bytes]], y: np.ndarray) -> list[np.ndarray]:
    """Labelled tokens from labelled documents: in toxic ones, those with a feature that surely belongs to toxic documents.

    A group of near copies weighs as much as one document, or all that copies have in common would seem to belong to their label.
    """
    seen: tuple[Counter, Counter] = Counter(), Counter()
    known: dict[bytes, list[int]] = {}
    of = near_copies(docs)
    members = Counter(zip(of.tolist(), y.tolist()))  # copies with either label are a group for each
    n = np.ones(2)
    for words, label, group in zip(docs, y.tolist(), of.tolist()):
        for w in set(words):
            if w not in known:
                known[w] = features(w)[:5]
        share = 1 / members[group, label]
        for f in {f for w in set(words) for f in known[w]}:
            seen[label][f] += share
        n[label] += share
    sure = set()
    for f, k in seen[1].items():
        a, b = k / n[1], seen[0].get(f, 0) / n[0]
        if a > 8 * b:
            c = seen[0].get(f, 0)
            m = (k + c) / n.sum()
            ratio = k * np.log(a / m) + (c * np.log(b / m) if c else 0)
            if ratio > SURE + np.log(len(seen[1])):
                sure.add(f)
    return [np.array([label == 1 and not sure.isdisjoint(known[w]) for w in words], dtype=bool) for words, label in zip(docs, y.tolist())]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Intercept and weights, by Newton's method with a little shrinkage, classes weighing as in the data."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return w


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 30) -> Field:
    """Fits the field to labelled tokens by AdaGrad on the exact gradient, then a document's score to its label.

    Every fourth document is kept from the field, and the score is fitted to these alone.
    """
    own: dict[bytes, bytes] = {}
    docs = [[own.setdefault(w, w) for w in t.split()] for t in texts]
    later = np.arange(len(docs)) % 4 == 3
    after, docs = [d for d, z in zip(docs, later) if z], [d for d, z in zip(docs, later) if not z]
    y_after, y = y[later], y[~later]
    tags = token_labels(docs, y)
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for d in docs for w in d), dtype=np.int64, count=int(sizes.sum()))
    table = np.array([features(w) for w in numbers], dtype=np.int64).reshape(-1, 6)
    tag = np.concatenate([*tags, np.zeros(0, dtype=bool)])
    inner = np.ones(len(tag), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    pairs = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(pairs, (tag[at - 1].astype(int), tag[at].astype(int)), 1)
    weights, move, bias = np.zeros(DIMENSIONS), np.zeros((2, 2)), np.full(1, -4.0)
    g_w, g_m = np.full(DIMENSIONS, 1e-3), np.full((2, 2), 1e-3)
    total = max(1, len(tag))
    for _ in range(rounds if len(tag) else 0):
        node = (weights[table].sum(axis=1) + bias[0])[ids]
        p, expected = marginals(node, move, sizes)
        error = np.bincount(ids, weights=p - tag, minlength=len(table))
        g = np.bincount(table.ravel(), weights=np.repeat(error, table.shape[1]), minlength=DIMENSIONS) + 0.01 * weights
        m = (expected - pairs) / total * 100
        g_w += g * g
        g_m += m * m
        weights -= 0.7 * g / np.sqrt(g_w)
        move -= 0.3 * m / np.sqrt(g_m)
        move -= move[0, 0]
    weights = np.append(weights, bias)
    nodes, sizes = Nodes(weights), np.array([len(d) for d in after], dtype=np.int64)
    node = np.array([nodes[w] for d in after for w in d])
    return Field(weights, move, logistic(figures(marginals(node, move, sizes)[0], sizes), y_after))


class Nodes(dict):
    """A word's log potential, computed once; emptied when full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 700_000:
            self.clear()
        out = self[word] = float(self.weights[features(word)].sum() + self.weights[-1])
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int64())))])


def toxic_spans(docs: DataFrame, model: Field, limit: float = 0.5) -> DataFrame:
    """doc_id, score, spans: [start, end) in characters of each run of tokens whose marginal is over `limit`.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no span and the score of no evidence. Rows are scored
    one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        nodes = Nodes(field.weights)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in slices(texts, 5_000_000):
                split = [t.split() for t in texts[a:b]]
                sizes = np.array([len(d) for d in split], dtype=np.int64)
                node = np.fromiter((x for d in split for x in map(nodes.__getitem__, d)), dtype=np.float64, count=int(sizes.sum()))
                p, _ = marginals(node, field.move, sizes)
                z = figures(p, sizes) @ field.document[1:] + field.document[0]
                hot, starts = np.flatnonzero(p > limit), np.cumsum(sizes) - sizes
                of = np.searchsorted(starts, hot, side="right") - 1
                spans: list[list] = [[] for _ in split]
                for d in np.unique(of).tolist():
                    text, words = texts[a + d], [m.span() for m in WORDS.finditer(texts[a + d])]
                    mine, last = (hot[of == d] - starts[d]).tolist(), None
                    for k in mine:
                        s, e = words[k]
                        if last == k - 1:
                            spans[d][-1][1] = e
                        else:
                            spans[d].append([s, e])
                        last = k
                    if not text.isascii():
                        spans[d] = [[len(text[:s].decode()), len(text[:e].decode())] for s, e in spans[d]]
                yield record_batch(SCHEMA, [doc_ids[a:b], 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, spans array<array<long>>")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document.

    labels: doc_id, toxic. The field is fitted on the driver to at most about `bound` documents of each class whose
    crc32(doc_id) mod 3 isn't 1; every document is scored. Without labels all scores are 0.5.
    """
    out = remainder(F.col("doc_id"), 3) == 1
    rows = labelled_sample(docs, labels, "toxic", ~out, bound).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts, y = text_bytes(rows.column("text").combine_chunks()), rows.column("y").to_numpy()[order]
    model = fit([texts[i] for i in order], y)
    scored = toxic_spans(docs, model)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
