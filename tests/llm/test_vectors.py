"""Clustering and hard negatives against brute force on integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster int, score long, extra string"


def integers(e):
    return None if e is None or any(x is None or not math.isfinite(x) for x in e) else [math.floor(256 * float(np.float32(x))) for x in e]


def lloyd(rows, k, rounds, width):
    own = [(i, x) for i, e, *_ in rows if (x := integers(e)) is not None and len(x) == width]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))[:k]
    centroids = [list(x) for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in own]
        for j in range(len(centroids)):
            mine = [x for (_, x), a in zip(own, at) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(x)[::-1]) for i, x in own]
    whole = sum(d for _, _, d in found)
    inertia = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    return [(i, c, d, inertia[c], whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def some_vectors(n, width, seed, spread=4):
    r = np.random.default_rng(seed)
    middles = r.integers(-3, 4, (spread, width)) / 4
    rows = []
    for i in range(n):
        e = (middles[r.integers(spread)] + r.integers(-2, 3, width) / 256).tolist()
        rows.append((i, e, int(r.integers(0, 4)), "a", 1, 2, None))
    return rows


ODD = [(None, [0.5, 0.25, 0.0], 1, None, None, None, None), (900, None, 1, "", 0, 0, "x"), (901, [0.5, None, 0.0], 1, "", 0, 0, "x"), (902, [0.5, float("nan"), 0.0], 2, "", 0, 0, "x"), (903, [float("inf"), 0.0, 0.0], 2, "", 0, 0, "x"), (904, [0.1, 0.2], None, "", 0, 0, "x"), (905, [], 2, "", 0, 0, "x"), (906, [0.1, 0.2], 1, "", 0, 0, "x")]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_clustering_is_lloyds(spark, k):
    from lexmill.llm.centroids import clustered

    same = [(700 + i, [0.125, 0.125, 0.125], 1, "a", 1, 2, None) for i in range(40)]  # one vector many times, and repeated rows
    rows = some_vectors(150, 3, 1) + ODD + same + [same[0]] * 3
    got = clustered(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, rounds=3, width=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows, k, 3, 3), key=key)


def test_clustering_of_nothing(spark):
    from lexmill.llm.centroids import clustered

    assert clustered(spark.createDataFrame([], VECTORS)).count() == 0
    assert clustered(spark.createDataFrame(ODD[1:], VECTORS), width=3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 8), st.integers(1, 30), st.integers(0, 10**6))
def test_bounds_never_lose_the_nearest(n, width, k, reach, seed):
    """Whatever way the centroids move, the bounds give the nearest centroid with the smallest number."""
    from lexmill.llm.centroids import Move, assigned

    r = np.random.default_rng(seed)
    x = r.integers(-reach, reach + 1, (n, width)).astype(np.int64)
    before = centroids = r.integers(-reach, reach + 1, (k, width)).astype(np.int64)
    cluster, upper, lower = np.zeros(n, dtype=np.int32), np.full(n, np.inf), np.zeros((n, k))
    for _ in range(5):
        cluster, upper, lower = assigned(x, cluster, upper, lower, Move.to(centroids, before))
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert cluster.tolist() == d.argmin(axis=1).tolist()
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(d)).all()
        lower = np.maximum(np.float32(0), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))).astype(np.float64)
        before, centroids = centroids, centroids + r.integers(-2, 3, (k, width)) * r.integers(0, 2, (k, 1))


def test_a_component_out_of_range_is_refused(spark):
    from lexmill.llm.centroids import clustered

    with pytest.raises(Exception, match="beyond"):
        clustered(spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id long, embedding array<float>, label int"), width=2).count()


def brute_negatives(rows, every, top, percent=80):
    own = [(i, x, lab) for i, e, lab, *_ in rows if i is not None and lab is not None and (x := integers(e)) is not None]
    heads = {}
    for i, x, lab in own:
        if i % every == 0:
            heads.setdefault(i, []).append((lab, np.array(x, "<i4").tobytes(), x))
    out = []
    for a, copies in heads.items():
        label, _, x = min(copies)
        score = lambda y: sum(p * q for p, q in zip(x, y))
        near = sorted((-score(y), i) for i, y, lab in own if lab == label and i != a)[:top]
        far = sorted((-score(y), i) for i, y, lab in own if lab != label)
        for s, p in near:
            fits = [(t, i) for t, i in far if percent * -s <= 100 * -t <= 100 * -s][:top]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits)]
    return out


@pytest.mark.parametrize(("every", "block", "sample"), [(10, 20_000, 16_384), (3, 20, 8)])
def test_hard_negatives(spark, every, block, sample):
    from lexmill.llm.hard_negatives import hard_negatives

    same = [(5000 + i, [0.5, 0.5, 0.25], i % 3, "a", 1, 2, None) for i in range(60)]
    rows = some_vectors(160, 3, 2) + ODD + same + [(1000, [0.25, 0.5, 0.5], 1, "a", 1, 2, None), (1000, [0.25, 0.5, 0.5], 0, "a", 1, 2, None), (-30, [0.25, 0.25, 0.5], 1, "a", 1, 2, None)] + [(7, [0.5, 0.5, 0.5], 2, "a", 1, 2, None)] * 3
    got = hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=every, block=block, sample=sample)
    want = brute_negatives(rows, every, 5)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    from lexmill.llm.hard_negatives import hard_negatives, relabelled

    assert hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [0.5], 1)], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(7, [0.5], 9, "k"), (None, [0.5], 3, "k"), (14, None, None, "k"), (8, [0.5], 9, "k")]
    got = relabelled(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, k string"))
    assert [r["label"] for r in got.collect()] == [0, 3, None, 9]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 90), st.integers(1, 5), st.integers(1, 40), st.booleans(), st.integers(0, 10**6))
def test_dual_tree_is_brute_force(n, m, width, reach, same, seed):
    from lexmill.llm.hard_negatives import LEAST, MOST, Search

    r = np.random.default_rng(seed)
    x, y = r.integers(-reach, reach + 1, (n, width)), r.integers(-reach, reach + 1, (m, width))
    labels, theirs, ids = r.integers(0, 3, n), r.integers(0, 3, m), r.integers(0, m, m)
    top = np.sort(r.integers(-reach * reach, reach * reach * width + 1, (n, 2)), axis=1)
    low, high = (np.full((n, 1), LEAST + 1), np.full((n, 1), MOST - 1)) if same else (top[:, :1], top[:, 1:])
    own_ids = r.integers(0, m, n)
    search = Search(x, labels, own_ids, low, high, same, 3, leaf=4)
    for part in np.array_split(np.arange(m), 3):
        search.add(y[part], theirs[part], ids[part], leaf=4)
    got = sorted(zip(*(c.tolist() for c in search.hits())))
    want = []
    for i in range(n):
        fits = [(-int(x[i] @ y[j]), int(ids[j])) for j in range(m) if ((labels[i] == theirs[j] and own_ids[i] != ids[j]) if same else labels[i] != theirs[j]) and low[i, 0] <= x[i] @ y[j] <= high[i, 0]]
        want += [(i, 0, -s, d) for s, d in sorted(fits)[:3]]
    assert got == sorted(want)
