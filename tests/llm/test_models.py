"""The trained models against brute force: the risk of the quality classifier, its prior, and groups of near copies."""

import numpy as np
import pytest


def figures_frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, x array<double>").repartition(3)


def mixed(seed, n, share, k, apart=2.0):
    """Texts' figures of two kinds that overlap a little: positives alone, and a mixture."""
    from lexmill.llm.quality import WIDTH

    r = np.random.default_rng(seed)
    draw = lambda n, shift: r.normal(0, 1, (n, WIDTH)) * (np.arange(WIDTH) < 4) + shift * (np.arange(WIDTH) < 2)
    return draw(k, apart), np.concatenate([draw(int(n * share), apart), draw(n - int(n * share), -apart)])


def loss(z):
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(0, -z)


def risk(w, model, positive, unlabelled, prior, shrink=1e-4):
    """The estimator as published, term by term: the positives' risk, and the unlabelled less the positives' as negatives."""
    z = lambda x: np.column_stack([(x - model.mean) / model.spread, np.ones(len(x))]) @ w
    ridge = shrink * (w[:-1] ** 2).sum() / 2
    if prior is None:
        return loss(z(positive)).mean() + loss(-z(unlabelled)).mean() + ridge, 1.0
    negative = loss(-z(unlabelled)).mean() - prior * loss(-z(positive)).mean()
    return prior * loss(z(positive)).mean() + max(0.0, negative) + ridge, negative


@pytest.mark.parametrize("prior", [0.5, None])
def test_fit_finds_the_least_risk(spark, prior):
    from lexmill.llm.quality import fit

    positive, unlabelled = mixed(1, 3000, 0.5, 1500, 0.6)
    model = fit(positive, figures_frame(spark, unlabelled), prior)
    w = np.append(model.weights, model.bias)
    least, negative = risk(w, model, positive, unlabelled, prior)
    assert negative > 0.01  # inside the border
    r, beaten = np.random.default_rng(2), 0
    for scale in (1e-3, 1e-2, 0.1, 0.5):
        for _ in range(60):
            other, part = risk(w + r.normal(0, scale, len(w)), model, positive, unlabelled, prior)
            beaten += part >= 0 and other < least - 1e-5
    assert not beaten  # the sum is convex while its second part is over 0, so no place near is lower
    step = np.eye(len(w)) * 1e-5
    slope = np.array([(risk(w + s, model, positive, unlabelled, prior)[0] - risk(w - s, model, positive, unlabelled, prior)[0]) / 2e-5 for s in step])
    assert np.abs(slope).max() < 1e-3


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_the_prior_is_found_without_negatives(spark, share):
    from lexmill.llm.quality import class_prior

    positive, unlabelled = mixed(3, 3000, share, 1500)
    assert abs(class_prior(positive, figures_frame(spark, unlabelled)) - share) < 0.07


def test_no_positives_or_no_texts(spark):
    from lexmill.llm.quality import WIDTH, class_prior, fit

    none = spark.createDataFrame([], "doc_id long, x array<double>")
    assert class_prior(np.zeros((0, WIDTH)), none) == 0.5 and class_prior(np.zeros((3, WIDTH)), none) == 0.5
    assert not fit(np.zeros((3, WIDTH)), none, 0.5).weights.any()


def test_groups_of_near_copies():
    from lexmill.llm.toxicity import near_copies, token_labels

    r = np.random.default_rng(5)
    text = lambda: [f"w{i}".encode() for i in r.integers(0, 5000, 80)]
    a, b = text(), text()
    edited = [*a[:40], b"new", *a[41:]]
    docs = [a, b, edited, a, text(), [], [], [b"one"], list(reversed(a))]
    of = near_copies(docs).tolist()
    assert of[2] == of[3] == 0 and of[1] == 1 and of[4] == 4 and of[5] == of[6] and of[7] == 7 and of[8] == 8
    clean = [text() for _ in range(60)]
    bad = [[*text()[:20], b"vile"] for _ in range(12)]
    copies = [clean[0] + [b"harmless"]] * 30  # thirty copies marked toxic are one document's evidence
    tags = token_labels(clean + bad + copies, np.array([0] * 60 + [1] * 42))
    told = {w for d, t in zip(clean + bad + copies, tags) for w, x in zip(d, t) if x}
    assert b"vile" in told and b"harmless" not in told


def test_long_lists_are_not_sent(spark, monkeypatch):
    from lexmill.llm import url_lists

    captures = spark.createDataFrame([(1, "http://a.b.org/x/y?q", 100), (2, "http://c.org/", 100), (3, None, 100), (None, "http://a.b.org", 5_000_000)], "page_id long, url string, fetched long")
    entries = spark.createDataFrame([("b.org", 50, "add"), ("a.b.org/x", 90, "add"), ("a.b.org/x", 95, "remove"), ("c.org", 101, "add")], "pattern string, dated long, action string")
    rows = lambda: sorted(map(tuple, url_lists.temporal_list_join(captures, entries).collect()), key=str)
    sent = rows()
    monkeypatch.setattr(url_lists, "LIST_BYTES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = url_lists.temporal_list_join(captures, entries)._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and rows() == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (1, True, 1, "b.org") in sent and (2, False, 0, None) in sent and (3, False, 0, None) in sent and (None, True, 1, "b.org") in sent


def test_the_negative_risk_never_falls_below_zero(spark):
    from lexmill.llm.quality import fit

    positive, unlabelled = mixed(4, 200, 0.6, 60)  # far apart and few, so that the border is met
    for prior in (0.3, 0.6, 0.9):
        model = fit(positive, figures_frame(spark, unlabelled), prior)
        assert risk(np.append(model.weights, model.bias), model, positive, unlabelled, prior)[1] >= 0
