"""Exact Lloyd rounds over integer vectors, with Elkan's bounds kept between the rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, record_batch, stored
from lexmill.llm.vectors import integer_vectors, matrix

STATE = "vec_id long, v binary, cluster int, was int, upper double, lower binary"
STATE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary())])
SUMS_SCHEMA = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
FINAL_SCHEMA = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row; either side may be a single row."""
    apart = vectors - centroids
    return np.einsum("ij,ij->i", apart, apart)


def above(squares: np.ndarray) -> np.ndarray:
    """Roots of exact integers, none too small."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf)


def below(squares: np.ndarray) -> np.ndarray:
    """Roots of exact integers, none too large."""
    return np.maximum(0.0, np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf))


@dataclass
class Move:
    """The centroids of a round, how far each has come since the last (rounded up), and half the distances between them (rounded down)."""

    centroids: np.ndarray
    drift: np.ndarray
    half: np.ndarray
    nearest: np.ndarray

    @staticmethod
    def to(centroids: np.ndarray, before: np.ndarray) -> Move:
        k = len(centroids)
        half = np.stack([below(squared(centroids, c[None, :])) for c in centroids]) / 2 if k else np.zeros((0, 0))
        others = np.where(np.eye(k, dtype=bool), np.inf, half)
        drift = np.where((centroids == before).all(axis=1), 0.0, above(squared(centroids, before)))
        return Move(centroids, drift, half, others.min(axis=1) if k > 1 else np.full(k, np.inf))


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, of equally near ones the smallest number, with the bounds that hold now.

    upper[i] is no less than the distance to the vector's own centroid, lower[i, j] no more than that to centroid j, both before the
    centroids moved. A distance is skipped only where a bound says that it is strictly larger, so ties are always computed.
    """
    cluster, lower = cluster.copy(), np.maximum(0.0, np.where(move.drift > 0, np.nextafter(lower - move.drift, -np.inf), lower))
    drift = move.drift[cluster]
    upper = np.where(drift > 0, np.nextafter(upper + drift, np.inf), upper)
    rows = np.flatnonzero(upper >= move.nearest[cluster])
    if len(rows):
        own, mine, bounds = x[rows], cluster[rows], lower[rows]
        best = squared(own, move.centroids[mine])
        near = above(best)
        bounds[np.arange(len(rows)), mine] = below(best)
        for j in range(len(move.centroids)):
            at = np.flatnonzero((mine != j) & (bounds[:, j] <= near) & (move.half[mine, j] <= near))
            if not len(at):
                continue
            d = squared(own[at], move.centroids[j][None, :])
            bounds[at, j] = below(d)
            closer = (d < best[at]) | ((d == best[at]) & (j < mine[at]))
            at, d = at[closer], d[closer]
            mine[at], best[at], near[at] = j, d, above(d)
        cluster[rows], lower[rows], upper[rows] = mine, bounds, near
    return cluster, upper, lower


def _round(state: DataFrame, move: Move, width: int) -> DataFrame:
    k = len(move.centroids)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            was = batch.column(2).to_numpy()
            lower = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f4").reshape(n, k).astype(np.float64)
            cluster, upper, lower = assigned(matrix(batch.column(1), width), was, batch.column(4).to_numpy(), lower, move)
            kept = np.maximum(np.float32(0), np.nextafter(lower.astype("<f4"), np.float32(-np.inf)))
            yield record_batch(STATE_SCHEMA, [batch.column(0), batch.column(1), cluster, was, upper, [r.tobytes() for r in kept.astype("<f4")]])

    return state.select("vec_id", "v", "cluster", "was", "upper", "lower").mapInArrow(step, STATE)


def _first(vectors: DataFrame, move: Move, width: int) -> DataFrame:
    """All vectors with their first centroid, all marked as new in it."""
    k = len(move.centroids)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cluster, upper, lower = assigned(matrix(batch.column(1), width), np.zeros(n, dtype=np.int32), np.full(n, np.inf), np.zeros((n, k)), move)
            kept = np.maximum(np.float32(0), np.nextafter(lower.astype("<f4"), np.float32(-np.inf)))
            yield record_batch(STATE_SCHEMA, [batch.column(0), batch.column(1), cluster, np.full(n, -1, dtype=np.int32), upper, [r.tobytes() for r in kept.astype("<f4")]])

    return vectors.select("vec_id", "v").mapInArrow(start, STATE)


def _changes(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to the centroids' sums and counts: each task sums its own, Spark sums the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, now, was = matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(total, now, x)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
            n += np.bincount(now, minlength=k) - np.bincount(was[was >= 0], minlength=k)
        some = np.flatnonzero((total != 0).any(axis=1) | (n != 0))
        yield record_batch(SUMS_SCHEMA, [np.repeat(some, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(some)), total[some].reshape(-1), np.repeat(n[some], width)])

    rows = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(add, "cluster int, place int, total long, n long")
    total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for r in rows.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * width rows at most
        total[r["cluster"], r["place"]], n[r["cluster"]] = r["total"], r["n"]
    return total, n


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: str = "2") -> DataFrame:
    """Centroid clustering of `width`-component vectors by Elkan's bounds; all arithmetic that decides is on integers.

    vectors: vec_id (long), embedding (array of floats); other columns, whatever their names, are left out. Rows whose vector is null, of
    another size, or has a null or non-finite component take no part; components become floor(256 * x), and one beyond 2**24 raises
    OverflowError. Centroids start as the k rows with the least sha256 of "seed:vec_id" (all rows, if fewer; null ids last; rows that
    repeat an id in the order of their bytes). Rows with a null or repeated vec_id are clustered like others. In each round, a vector goes to
    the nearest centroid, of equally near ones to the smallest number, and a centroid that has vectors becomes their exact floored mean.

    The bounds of each vector (one upper, k lower) are stored with it after each round, so a lost executor's work is redone from there, and
    the state before it is deleted. The driver holds k * width sums. Returns vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256; empty for no vectors.
    """
    spark = vectors.sparkSession
    own = stored(integer_vectors(vectors.select(F.col("vec_id").cast("long"), "embedding"), ["vec_id"], size=width))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = own.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in first], dtype=np.int64).reshape(len(first), width)
    n_centroids = len(centroids)
    if not n_centroids:
        dropped(own)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = stored(_first(own, Move.to(centroids, centroids), width))
    dropped(own)
    total, n = np.zeros((n_centroids, width), dtype=np.int64), np.zeros(n_centroids, dtype=np.int64)
    for _ in range(rounds):
        more, change = _changes(state, n_centroids, width)
        total, n = total + more, n + change
        new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
        last, state = state, stored(_round(state, Move.to(new, centroids), width))
        centroids = new
        dropped(last)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(2)
            yield record_batch(FINAL_SCHEMA, [batch.column(0), cluster, squared(matrix(batch.column(1), width), centroids[cluster.to_numpy()])])

    rows = stored(state.select("vec_id", "v", "cluster").mapInArrow(finished, "vec_id long, cluster int, distance long"))
    dropped(state)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows at most
    whole = sum(r["s"] for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r["cluster"], r["s"], whole, digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
