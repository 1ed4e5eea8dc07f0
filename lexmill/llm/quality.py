"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import record_batch, remainder, stored, text_bytes
from lexmill.llm.labelled import labelled_sample

BOUND = 4000
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
MARKS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b"!", b"?", b"{", b"_")


def figures(text: bytes) -> list[float]:
    """Shares and logarithms that describe a whole text's form; no word, language or source is looked at."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * (15 + len(MARKS)) + [1.0]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    same = sum(map(operator.eq, words, words[1:]))
    letters = max(1, size - text.count(b" "))
    distinct = len(set(words))
    marks = [min(1.0, 4 * text.count(m) / n) for m in MARKS]
    capital = (size - len(text.translate(None, CAPITALS))) / letters
    return [
        np.log1p(n) / 10, min(1.0, 20 / n), min(1.0, 3 * capital), float(capital > 0.4), (size - len(text.translate(None, DIGITS))) / letters,
        min(1.0, 2 * same / n), distinct / n, np.log1p(n / distinct) / 3, min(1.0, len(b"".join(words)) / n / 20), 1 - len(set(lines)) / len(lines), min(1.0, len(lines) / n * 5),
        min(1.0, 5 * text.count(b".") / n), min(1.0, 5 * text.count(b",") / n), min(1.0, 2 * text.count(b"!!") / n), min(1.0, sum(map(text.count, MARKS[:7])) / n), *marks, 0.0,
    ]


@dataclass
class Scorer:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


WIDTH = len(figures(b""))
FIGURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def figured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the figures of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(FIGURE_SCHEMA, [batch.column(0), [figures(t) for t in text_bytes(batch.column(1))]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def totals(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The sum of of(x), n numbers, over all rows of x."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out, sums = np.zeros(n), rows.select("x").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    return out


def fit(positive: np.ndarray, unlabelled: DataFrame, prior: float | None, rounds: int = 30, shrink: float = 1e-4) -> Scorer:
    """Minimises prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)]) with the logistic loss l, by Newton steps over all rows of `unlabelled`.

    As l(+) - l(-) is linear, the sum is convex while its second part, the estimated risk on negatives, is above 0. The maximum with 0
    is kept as a border: a step that would take that part below 0 is shortened, and where no step is left the fit ends. prior None:
    minimises E+[l(+)] + Eu[l(-)], so unlabelled texts count as negatives.
    """
    moments = totals(unlabelled, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 2 * WIDTH + 1)
    n, k = moments[0], len(positive)
    if not n or not k:
        return Scorer(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    mean = (moments[1 : WIDTH + 1] + positive.sum(axis=0)) / (n + k)
    spread = np.sqrt(np.maximum(0, (moments[WIDTH + 1 :] + (positive * positive).sum(axis=0)) / (n + k) - mean * mean)) + 0.05
    p = np.column_stack([(positive - mean) / spread, np.ones(k)])
    ridge = np.append(np.full(WIDTH, shrink), 0.0)
    size = (WIDTH + 1) * (WIDTH + 2) + 1

    def at(tries: list[np.ndarray]) -> np.ndarray:
        """Mean l(-), its gradient and second derivatives over the unlabelled rows, for each try."""

        def of(x: np.ndarray) -> np.ndarray:
            u, out = np.column_stack([(x - mean) / spread, np.ones(len(x))]), []
            for w in tries:
                z = np.clip(u @ w, -30, 30)
                s = 1 / (1 + np.exp(-z))
                out += [[np.log1p(np.exp(z)).sum()], s @ u, ((u * (s * (1 - s))[:, None]).T @ u).ravel()]
            return np.concatenate(out)

        return totals(unlabelled, of, size * len(tries)).reshape(len(tries), size) / n

    def risks(w: np.ndarray, row: np.ndarray) -> tuple[float, float]:
        z = np.clip(p @ w, -30, 30)
        negative = row[0] - (prior * np.log1p(np.exp(z)).mean() if prior is not None else 0)
        return negative, (1 if prior is None else prior) * np.log1p(np.exp(-z)).mean() + negative + (ridge * w * w).sum() / 2

    w = np.zeros(WIDTH + 1)
    now = at([w])[0]
    for _ in range(rounds):
        gradient, bend = now[1 : WIDTH + 2] + ridge * w, now[WIDTH + 2 :].reshape(WIDTH + 1, -1) + np.diag(ridge + 1e-9)
        if prior is None:
            s = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30)))
            gradient, bend = gradient - ((1 - s) @ p) / k, bend + (p * (s * (1 - s))[:, None]).T @ p / k
        else:
            gradient = gradient - prior * p.mean(axis=0)
        step = np.linalg.solve(bend, gradient)
        tries = [w - share * step for share in (1.0, 0.5, 0.2, 0.04)]
        rows = at(tries)
        good = [(r, i) for i, (v, row) in enumerate(zip(tries, rows)) for negative, r in [risks(v, row)] if negative >= 0]
        if not good or min(good)[0] >= risks(w, now)[1] - 1e-9:
            break
        w, now = tries[min(good)[1]], rows[min(good)[1]]
    return Scorer(mean, spread, w[:-1], float(w[-1]))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(rows: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, score of every row of figures."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                yield record_batch(SCHEMA, [batch.column(0), own.score(_matrix(batch.column(1)))])

    return rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")


def class_prior(positive: np.ndarray, unlabelled: DataFrame) -> float:
    """The estimated share of positives in web text, from positives and unlabelled texts alone; 0.5 without either.

    A classifier that tells positives from unlabelled texts, both sides weighing the same, gives the ratio r of their densities as its odds.
    Where surely all texts are positive, r is one over the share, so r / (1 + r) is 1 / (1 + share); its mean over the positives is
    that or less, so the estimate errs upwards if at all.
    """
    model = fit(positive, unlabelled, None)
    mean = float(model.score(positive).mean()) if len(positive) else 0.5
    return min(0.99, max(0.01, 1 / mean - 1)) if model.weights.any() else 0.5


def quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Trusted positives are labelled rows with quality 1, about
    `bound` of them; the unlabelled set is all web text whatever its label; both come from rows whose crc32(doc_id) mod 4 isn't 2.
    The positives are on the driver, the unlabelled rows' share of the risk is summed where their figures are stored. Labels 0 are
    never looked at. Null and empty texts score as texts without words; without positives all scores are 0.5.
    """
    out = remainder(F.col("doc_id"), 4) == 2
    known = labelled_sample(docs, labels.where("quality = 1"), "quality", ~out, bound).select("text").toArrow()
    p = np.array([figures(x) for x in text_bytes(known.column("text").combine_chunks())]).reshape(-1, WIDTH)
    p = p[np.lexsort(p.T)]  # the same model however the rows arrive
    rows = stored(figured(docs))
    web = rows.where(~out)
    model = fit(p, web, class_prior(p, web))
    return scored(rows, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
