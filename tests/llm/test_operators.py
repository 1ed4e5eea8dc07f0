import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, k=5):
    w = WORDS.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def encoded(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# ------------------------------------------------------------------ 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700), st.data())
def test_simple8b_round_trip(ids, data):
    from lexmill.llm.token_store import pack, unpack, unpack_from

    words, offsets, escapes = pack(np.array(ids, dtype=np.uint64))
    assert unpack(words, offsets, len(ids), escapes).tolist() == ids
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert unpack_from(words, offsets, len(ids), first, count, escapes).tolist() == ids[first : first + count]


def test_long_runs_have_offsets():
    from lexmill.llm.token_store import pack, unpack_from

    ids = np.arange(20_000, dtype=np.uint64) % 50_000
    words, offsets, escapes = pack(ids)
    assert len(offsets) // 4 > 10
    for first in (0, 1, 511, 512, 9_999, 19_990):
        assert unpack_from(words, offsets, len(ids), first, 10, escapes).tolist() == ids[first : first + 10].tolist()


def test_token_file(spark, docs, corpus, none, odd):
    from lexmill.llm.common import shared_dir
    from lexmill.llm.token_store import read_tokens, token_file_digests, tokens_of, write_tokens

    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file_digests(docs).collect()}
    ids, start, want = encoded("word_bpe_49k.json"), 0, {}
    for i, text, *_ in corpus:
        own = [*ids(text), 1]
        want[i] = (start, len(own), crc(own))
        start += len(own)
    assert got == want
    path = shared_dir(spark)
    write_tokens(docs, path, "word_bpe_49k.json", block_tokens=300)
    some = tokens_of(read_tokens(spark, path), spark.createDataFrame([(0,), (3,), (3,), (44,), (999,), (None,)], "doc_id long"))
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {d: [*ids(corpus[d][1]), 1] for d in (0, 3, 44)}
    assert token_file_digests(none).count() == 0
    rows = token_file_digests(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 5, 5, 5, 6] and rows[-1]["n_tokens"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB's éßΣİ1\n\t ,.! ́<|end日", max_size=40), max_size=4))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_tokenizers(name, texts):
    from lexmill.llm.encoding import encoder

    ids = encoded(name)
    for column in (pa.array(texts, pa.string()), pa.array(["x", None, *texts], pa.string()).slice(1)):
        got, sizes = encoder(name).batch(column)
        want = [ids(t) for t in column.to_pylist()]
        assert sizes.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]


def test_other_tokenizers_are_not_cut(tmp_path):
    import json

    from lexmill.llm.encoding import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        steps = json.load(f)
    steps["pre_tokenizer"]["add_prefix_space"] = True  # under the known file's name
    path = tmp_path / "byte_bpe_50k.json"
    path.write_text(json.dumps(steps))
    from tokenizers import Tokenizer

    texts = ["one two", None, "", "two  one\n"]
    own = Tokenizer.from_file(str(path))
    got, sizes = Encoder(str(path)).batch(pa.array(texts))
    assert got.tolist() == [i for t in texts for i in own.encode(t or "", add_special_tokens=False).ids]


# ------------------------------------------------------------------ 2


def test_decontamination(spark, docs, corpus, none, odd):
    from lexmill.llm.decontamination import contaminated, decontaminated

    items = [(0, " ".join(corpus[3][1].split()[10:40])), (1, "One TWO"), (2, None), (3, " "), (4, "no such words in any text at all"), (5, " ".join(corpus[4][1].split()[5:25]) + " aa bb cc dd"), (None, "one two"), (6, "w w w w w w"), (6, "w w w w w w")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text, *_ in corpus:
        w = WORDS.findall(lower(text or ""))
        for i, item in items:
            k = min(5, len(WORDS.findall(lower(item or ""))))
            own = shingles(item)
            held = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if i is not None and own and 4 * len(own & held) >= 3 * len(own):
                want.add((d, i, len(own), len(own & held)))
    got = contaminated(docs, frame)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 4
    clean = decontaminated(docs, frame)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {c[0] for c in corpus} - {w[0] for w in want}
    twice = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e x y"), (2, "a b c d e f g z")], "item_id long, text string")
    texts = spark.createDataFrame([(7, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "A B C D e x y"), (8, "a b c d e x y")], "doc_id long, text string")
    assert sorted(map(tuple, contaminated(texts, twice).collect())) == [(7, 1, 4, 4), (7, 2, 4, 3), (8, 1, 3, 3)]  # no mixture of two rows
    assert contaminated(none, frame).count() == 0 and contaminated(docs, frame.limit(0)).count() == 0
    assert {r["doc_id"] for r in contaminated(odd, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect()} == {5}


# ------------------------------------------------------------------ 3


def repeats_by_force(words):
    n, longest = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        longest.append(best)
    return longest


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=4))
def test_longest_repeats(texts):
    from lexmill.llm.repetition import longest_repeats

    words = np.array([w for t in texts for w in t], dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.int64)
    assert longest_repeats(words, doc).tolist() == [x for t in texts for x in repeats_by_force(t)]


def test_repetition_rules(spark, docs, corpus, none, odd):
    from lexmill.llm.repetition import repetition_rules, without_repetitive

    got = {r["doc_id"]: r for r in repetition_rules(docs).collect()}
    for d, text, *_ in corpus:
        w, r = WORDS.findall(text or ""), got[d]
        if len(w) > 400:
            continue
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        longest = repeats_by_force(w)
        cover = {i + k for i, n in enumerate(longest) if n >= 8 for k in range(n)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        kept = not failed and len(cover) <= 0.4 * len(w) and max(longest, default=0) <= 200
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed, kept)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == want
        assert r["covered_words"] == len(cover) == sum(e - s for s, e in r["spans"]) and r["longest_repeat"] == max(longest, default=0)
    kept = without_repetitive(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
    assert repetition_rules(none).count() == 0 and repetition_rules(odd).count() == 6 and without_repetitive(odd).columns == odd.columns


# ------------------------------------------------------------------ 4


def test_hmm_by_enumeration():
    from itertools import product

    from lexmill.llm.hmm import Model, expected_counts, likelihoods

    r = np.random.default_rng(0)
    m = Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    sizes = np.array([4, 1, 6, 2])
    starts, symbols = np.cumsum(sizes) - sizes, r.integers(0, 5, sizes.sum())
    logs, begun, moves, emitted = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for a, n in zip(starts, sizes):
        seq, paths = symbols[a : a + n], []
        for p in product(range(3), repeat=int(n)):
            w = m.start[p[0]] * m.emit[seq[0], p[0]]
            for i in range(1, n):
                w *= m.move[p[i - 1], p[i]] * m.emit[seq[i], p[i]]
            paths.append((p, w))
        total = sum(w for _, w in paths)
        logs.append(np.log(total))
        for p, w in paths:
            begun[p[0]] += w / total
            for i in range(n):
                emitted[seq[i], p[i]] += w / total
                if i:
                    moves[p[i - 1], p[i]] += w / total
    assert np.allclose(likelihoods(m, symbols, starts, sizes), logs)
    x, y, z, log = expected_counts(m, symbols, starts, sizes)
    assert log == pytest.approx(sum(logs), rel=1e-5)
    assert np.allclose(x, begun, atol=1e-5) and np.allclose(y, moves, atol=1e-5) and np.allclose(z, emitted, atol=1e-5)


def test_hmm_scores(spark, docs, corpus, none, odd, monkeypatch):
    from lexmill.llm import hmm

    monkeypatch.setattr(hmm, "OWN", 20)  # so that words of all three kinds occur
    monkeypatch.setattr(hmm, "HOT", 3000)
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, states=3, rounds=3, gain=-1.0).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in corpus}
    tokens = {d: [*WORDS.findall(lower(t or "")), ""] for d, t, *_ in corpus}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    hot = [""] + [w for w, k in sorted(((w, k) for w, k in c.items() if w and k * 3000 >= n), key=lambda x: (-x[1], x[0].encode()))]
    own = {w: i for i, w in enumerate(hot[:20])}
    kind = lambda w: own.get(w, len(own) + zlib.crc32(w.encode()[-3:]) % hmm.CLASSES)
    in_class, of_class = Counter(), Counter()
    for w, k in c.items():
        if w not in own:
            in_class[kind(w)] += k
            of_class[kind(w)] += 1
    known = hmm.Vocabulary([w.encode() for w in hot], np.array([c[w] for w in hot], dtype=float), *(np.array([x[len(own) + i] for i in range(hmm.CLASSES)], dtype=float) for x in (in_class, of_class)), n, v, 20)
    assert len(own) == 20 < len(hot) < v
    m = hmm.first_model(known, 3)

    def pass_(seq):
        alpha, beta, total = [m.start * m.emit[seq[0]]], [np.ones(3)], 0.0
        for s in seq[1:]:
            alpha[-1], total = alpha[-1] / alpha[-1].sum(), total + np.log(alpha[-1].sum())
            alpha.append(alpha[-1] @ m.move * m.emit[s])
        total += np.log(alpha[-1].sum())
        for s in seq[:0:-1]:
            b = m.move @ (m.emit[s] * beta[0])
            beta.insert(0, b / b.sum())
        return alpha, beta, total

    for _ in range(3):
        begun, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros(m.emit.shape)
        for d in tokens:
            if not held[d]:
                seq = [kind(w) for w in tokens[d]]
                alpha, beta, _ = pass_(seq)
                for t, s in enumerate(seq):
                    g = alpha[t] * beta[t] / (alpha[t] @ beta[t])
                    emitted[s] += g
                    begun += g if not t else 0
                    if t:
                        x = np.outer(alpha[t - 1], m.emit[s] * beta[t]) * m.move
                        moves += x / x.sum()
        m = hmm.improved(begun, moves, emitted, known)
    for d in tokens:
        r = got[d]
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(tokens[d]), sum(w in c for w in tokens[d]), n)
        share = sum(np.log10((c[w] + 0.1) / (in_class[kind(w)] + 0.1 * (of_class[kind(w)] + 1))) for w in tokens[d] if w not in own)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(pass_([kind(w) for w in tokens[d]])[2] / np.log(10) + share, rel=1e-4)
    assert hmm.score_documents(none, states=2, rounds=2).count() == 0
    assert hmm.score_documents(odd, states=2, rounds=2).count() == 6


def test_hmm_batches_share_their_memory():
    """Counts of batches that lie in the memory of others before them, over several sums by symbol, are the counts of each text alone."""
    from lexmill.llm import hmm

    r = np.random.default_rng(4)
    emit = r.gamma(2.0, 0.5, (50, 3))
    model, room, held = hmm.Model(np.full(3, 1 / 3), np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.3, 0.3, 0.4]]), emit / emit.sum(axis=0)), hmm.Room(), None
    for total in (300, hmm.SUMMED + hmm.BLOCK + 7, 1, hmm.SUMMED):
        sizes = np.minimum(np.full(-(-total // 900), 900), total - 900 * np.arange(-(-total // 900)))
        starts, symbols = np.cumsum(sizes) - sizes, r.integers(0, 50, total).astype("<i4")
        begun, moves, emitted, log = hmm.expected_counts(model, symbols, starts, sizes, None, room)
        alone = [hmm.expected_counts(model, symbols[a : a + n], np.array([0]), np.array([n])) for a, n in zip(starts, sizes)]
        for got, parts in ((begun, [x[0] for x in alone]), (moves, [x[1] for x in alone]), (emitted, [x[2] for x in alone]), (log, [x[3] for x in alone])):
            assert np.allclose(got, sum(parts), rtol=1e-4, atol=1e-3)
        assert np.allclose(emitted.sum(axis=1), np.bincount(symbols, minlength=50), rtol=1e-5)
        assert held is None or total > len(held) or room.held["beta"] is held
        held = room.held["beta"]


def test_hmm_classes_of_many_words_are_those_of_each():
    from lexmill.llm import hmm

    words = [b"", b"a", b"ab", b"abc", b"xabc", "日本".encode(), b"\xff\xfe\x00", *(bytes([b, 255 - b]) for b in range(256))]
    assert hmm.word_classes(pa.array(words, pa.binary()).slice(2)).tolist() == [hmm.word_class(w) for w in words[2:]]
    assert hmm.word_classes(pa.array(words, pa.binary())).tolist() == [hmm.word_class(w) for w in words]
    assert len(hmm.word_classes(pa.array([], pa.binary()))) == 0


def test_hmm_rare_words_are_joined_without_a_sort(spark, docs, monkeypatch):
    from lexmill.llm import hmm

    monkeypatch.setattr(hmm, "HOT", 3000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hmm.score_documents(docs, states=2, rounds=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin [word" in plan


def test_hmm_rounds_see_all_rows(spark, monkeypatch):
    from lexmill.llm import hmm

    seen, one = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda train, *a: (seen.append(train.count()), one(train, *a))[1])
    docs = spark.range(9000).selectExpr("id AS doc_id", "'a b' AS text")
    hmm.score_documents(docs, states=2, rounds=8)
    assert 2 <= len(seen) < 8 and set(seen) == {sum(zlib.crc32(b"%d" % i) % 10 != 0 for i in range(9000))}


# ------------------------------------------------------------------ 5, 9


def test_crf_marginals_by_enumeration():
    from itertools import product

    from lexmill.llm.toxicity import marginals

    r = np.random.default_rng(1)
    sizes, move = np.array([3, 5, 1, 0]), r.normal(size=(2, 2))
    node = r.normal(size=9)
    p, pairs = marginals(node, move, sizes)
    want, both, at = [], np.zeros((2, 2)), 0
    for n in sizes.tolist():
        total, own, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=n):
            w = np.exp(sum(node[at + i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            own += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                two[a, b] += w
        want += (own / total).tolist()
        both += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, both)


def labelled(spark, n=300):
    import random

    r = random.Random(5)
    good = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(good) for _ in range(r.randint(30, 60))]
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["Zounds!", "blasted", "zounds"])
        if junk:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, none, odd):
    from lexmill.llm.toxicity import toxicity

    docs, labels = labelled(spark)
    rows = toxicity(docs, labels).join(labels, "doc_id").join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    for r in rows:
        if r["toxic"] and r["predicted"]:
            assert any(r["text"][s:e].lower().strip("!") in ("zounds", "blasted") for s, e in r["spans"])
    assert toxicity(none, labels).count() == 0
    scores = toxicity(odd, labels.limit(0)).collect()
    assert len(scores) == 6 and all(r["score"] == 0.5 for r in scores)


def test_quality(spark, none, odd):
    from lexmill.llm.quality import quality

    docs, labels = labelled(spark)
    rows = quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert quality(none, labels).count() == 0
    assert [r["score"] for r in quality(odd, labels.limit(0)).collect()] == [0.5] * 6


def test_quality_counts_all_web_text(spark, monkeypatch):
    from lexmill.llm import quality

    seen, one = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, *a: (seen.append(u.count()), one(p, u, *a))[1])
    docs, labels = labelled(spark)
    quality.quality(docs, labels, bound=20)
    assert len(seen) == 2 and set(seen) == {sum(zlib.crc32(b"%d" % i) % 4 != 2 for i in range(300))}  # for the prior, and for the score


# ------------------------------------------------------------------ 6


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_and_bins(lengths):
    from lexmill.llm.packing import best_fit_decreasing, lower_bound

    bins, offsets, n = best_fit_decreasing(np.array(lengths), 20)
    least = lower_bound(np.bincount(lengths, minlength=21), 20)

    def fits(k, items, room):
        return not items or any(room[i] >= items[0] and fits(k, items[1:], [*room[:i], room[i] - items[0], *room[i + 1 :]]) for i in range(k) if room[i] not in room[:i])

    best = next(k for k in range(1, len(lengths) + 1) if fits(k, sorted(lengths, reverse=True), [20] * k))
    assert least <= best <= n
    for b in range(n):
        own = sorted((o, x) for o, x, c in zip(offsets.tolist(), lengths, bins.tolist()) if c == b)
        assert own and all(o == sum(x for _, x in own[:i]) for i, (o, _) in enumerate(own)) and sum(x for _, x in own) <= 20


def check_packing(pieces, rows, capacity):
    assert Counter(tuple(r[:5]) for r in rows) == Counter(pieces)
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for own in by.values():
        own.sort()
        assert all(o == sum(x for _, x in own[:i]) for i, (o, _) in enumerate(own)) and sum(x for _, x in own) <= capacity
    return len(by)


def test_packing(spark, docs, corpus, none, odd):
    from lexmill.llm.packing import PIECES, best_fit_decreasing, lower_bound, pack_sequences, packed_documents

    ids, pieces = encoded("byte_bpe_50k.json"), []
    for d, text, *_ in corpus:
        own = [*ids(text), 2]
        first = len(own) % 64 or 64
        edges = [0, *range(first, len(own) + 1, 64)]
        pieces += [(d, k, a, b - a, crc(own[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check_packing(pieces, [tuple(r) for r in packed_documents(docs, capacity=64).select(names).collect()], 64)
    assert n <= 1.05 * sum(p[3] for p in pieces) / 64 + 1
    import random

    r = random.Random(1)
    many = [(i, 0, 0, r.randint(1, 1024), i) for i in range(3000)]
    frame = spark.createDataFrame(many, PIECES)
    least, apart = lower_bound(np.bincount([m[3] for m in many], minlength=1025), 1024), sum(best_fit_decreasing(np.array([m[3] for m in many[i::15]]), 1024)[2] for i in range(15))
    for size in (200, 5000):
        rows = pack_sequences(frame, part_items=size).collect()
        n = check_packing(many, [tuple(r[c] for c in names) for r in rows], 1024)
        assert least <= n <= min(apart, 1.02 * least + 1)
        assert {(r["n_sequences"], r["lower_bound"], r["certified"]) for r in rows} == {(n, least, n == least)}
    same = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "300L AS length", "7L AS ids_crc32")
    rows = pack_sequences(same, part_items=200).collect()  # equal rows are dealt apart
    assert check_packing([(None, 0, 0, 300, 7)] * 3000, [tuple(r[c] for c in names) for r in rows], 1024) == 1000
    assert packed_documents(none).count() == 0 and packed_documents(odd).count() == 6


# ------------------------------------------------------------------ 7


def test_temporal_lists(spark):
    from lexmill.llm.url_lists import temporal_list_join

    day = 86_400
    entries = spark.createDataFrame([("bad.com", day, "add"), ("bad.com", 40 * day, "remove"), ("BAD.com", 90 * day, "add"), ("x.org/p", 5 * day, "add"), ("x.org/p", 5 * day, "remove"), (None, 1, "add"), ("w.net", None, "add"), ("y.org/p", 0, "add"), ("N.org/News/Big", 0, "add")], "pattern string, dated long, action string")
    captures = [(1, "http://a.bad.com/x", 0), (2, "http://bad.com", day), (3, "https://u@A.b.bad.com:80/", 40 * day - 1), (4, "http://bad.com/", 40 * day), (5, "http://bad.com/", 91 * day), (6, "http://x.org/p/q", 6 * day), (7, "http://y.org/p?z", 3), (8, "http://y.org/q", 3), (9, None, 3), (10, "junk", 3), (11, "http://bad.com/", None), (5, "http://bad.com/", 91 * day), (12, "http://notbad.com/", 2 * day), (13, "http://n.ORG/News/Big/a?b", 1), (14, "http://n.org/news/big", 1), (15, "http://n.org/News", 1), (None, "http://y.org/p", 3), (None, None, 3)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched long").withColumn("pattern", F.lit("clash"))
    got = {r["page_id"]: r["blocked"] for r in temporal_list_join(frame, entries).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False, 9: False, 10: False, 11: False, 12: False, 13: True, 14: False, 15: False, None: True}
    assert temporal_list_join(frame.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in temporal_list_join(frame, entries.limit(0)).collect())


# ------------------------------------------------------------------ 8


def test_line_templates(spark, docs, corpus, none, odd):
    from lexmill.llm.line_templates import deduplicated, without_recurring_lines

    rows = [(1, "alpha beta gamma delta 17\nown words of the first one\nshort"), (2, "alpha beta gamma delta 9\nsomething else that is different\nshort"), (3, "alpha beta gamma delta x\nshort\nalpha beta gamma delta 400"), (4, "the report of Smith was filed on Monday"), (5, "the report of Jones was filed on Monday"), (6, "the report of Brown was filed on Monday\n\nkept"), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in without_recurring_lines(frame).collect()}
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("something else that is different\nshort", 3, 1)
    assert got[3] == ("short", 3, 2)
    assert (got[4][2], got[5], got[6]) == (0, ("", 1, 1), ("\nkept", 3, 1))
    assert got[7] == (None, 0, 0) and got[8] == ("", 1, 0)
    clash = ["id__", "dropped__", "codes", "row", "normal", "leaf", "n_dropped"]
    wide = without_recurring_lines(frame.select("*", *[F.lit(1).alias(c) for c in clash]))
    assert wide.columns == ["doc_id", "text", *clash[:-1], "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in wide.collect()} == got
    own = deduplicated(frame.withColumn("n_chars", F.lit(5)), nearest=False)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_chars"]) for r in own.collect()} == {d: (t, "clash", len(t) if k else 5) for d, (t, _, k) in got.items() if d != 5}
    spaced = spark.createDataFrame([(1, "a\t b  c d"), (2, " a b c d\r"), (3, "a b\x0bc\x0c d "), (4, "a bc d e"), (5, "   ")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in without_recurring_lines(spaced).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert without_recurring_lines(none).count() == 0 and deduplicated(none).count() == 0
    assert sorted(r["n_dropped"] for r in without_recurring_lines(odd).collect()) == [0] * 6
    by_id = {r["doc_id"]: r for r in without_recurring_lines(docs).collect()}
    assert sum(r["n_dropped"] for r in by_id.values()) >= 29 and by_id[0]["text"] == corpus[0][1]


def test_changed_copy_of_a_recurring_line(spark):
    from lexmill.llm.line_templates import without_recurring_lines

    line = "this page was made for the readers of the evening paper"
    rows = [(1, line), (2, line), (3, line), (4, line.replace("evening", "morning") + "\nown words here and more"), (5, "this page was never of any use to them all so"), (6, "this page was " + "x y z a b c d e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in without_recurring_lines(frame, nearest=True).collect()}
    assert got == {1: line, 2: "", 3: "", 4: "own words here and more", 5: rows[4][1], 6: rows[5][1]}
    rows = [(i, "see also the list") for i in (7, 8, 9)] + [(i, "see also the pages below") for i in (11, 12, 13)] + [(14, "see also the other ones")]
    got = {r["doc_id"]: r["n_dropped"] for r in without_recurring_lines(spark.createDataFrame(rows, frame.schema), nearest=True).collect()}
    assert got == {7: 0, 8: 1, 9: 1, 11: 0, 12: 1, 13: 1, 14: 1}


@pytest.mark.parametrize("partitions", [2, 4, 8])
def test_packing_exchanges_until_the_bound(spark, partitions):
    from lexmill.llm.packing import pack_sequences

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    same = spark.range(3000).repartition(partitions).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "300L AS length", "7L AS ids_crc32")
    rows = pack_sequences(same, part_items=200).collect()
    assert check_packing([(i, 0, 0, 300, 7) for i in range(3000)], [tuple(r[c] for c in names) for r in rows], 1024) == 1000
    assert {(r["n_sequences"], r["lower_bound"], r["certified"]) for r in rows} == {(1000, 1000, True)}


def test_shared_passages(spark, docs, corpus, none, odd):
    from lexmill.llm.passages import without_shared_passages

    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    passage = words(0, 60)
    rows = [(1, f"{words(1, 9)} {passage} {words(2, 9)}\nend"), (2, f"{words(3, 5)}\n{words(4, 5)} {passage.upper()}\n\n{words(5, 5)}"), (3, f"{passage}\n{words(6, 4)}"), (4, f"{words(0, 49)} other {words(7, 9)}"), (5, passage), (6, None), (None, passage), (7, " \n")]
    got = {r["doc_id"]: r["text"] for r in without_shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{words(3, 5)}\n{words(4, 5)} \n\n{words(5, 5)}", 3: words(6, 4), 4: rows[3][1], 6: None, None: passage, 7: " \n"}
    assert without_shared_passages(none).count() == 0 and without_shared_passages(odd).count() == 6
    before = {d: lower(t or "").split() for d, t, *_ in corpus}
    left = {r["doc_id"]: lower(r["text"] or "").split() for r in without_shared_passages(docs).collect()}
    runs = lambda of: {d: {tuple(w[i : i + 50]) for i in range(len(w) - 49)} for d, w in of.items()}
    had, has = runs(before), runs(left)
    assert Counter(r for x in had.values() for r in x).most_common(1)[0][1] > 1
    assert max(Counter(r for x in has.values() for r in x).values()) == 1
    assert set().union(*(set(w) for w in left.values())) == set().union(*(set(w) for w in before.values()))


def test_a_cut_that_joins_a_shared_run_is_followed_by_another(spark):
    from lexmill.llm.passages import without_shared_passages

    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    a, b, passage = words(1, 30), words(2, 30), words(0, 60)
    rows = [(0, f"{words(5, 5)} {passage}"), (1, f"{a} {b} {words(3, 9)}"), (2, f"{a} {passage} {b}"), (3, f"{words(4, 9)} {a} {passage} {b} {words(6, 9)}")]
    frame = spark.createDataFrame([(d, t, 0, "k", 7, "r", "c", 1) for d, t in rows], "doc_id long, text string, n_chars long, keys string, text_code long, row string, key string, first_doc long")
    got = without_shared_passages(frame)
    assert got.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: rows[0][1], 1: rows[1][1], 3: f"{words(4, 9)} {words(6, 9)}"}
    assert {tuple(r)[3:] for r in got.collect()} == {("k", 7, "r", "c", 1)}
    assert {r["doc_id"]: r["n_chars"] for r in got.collect()}[3] == len(f"{words(4, 9)} {words(6, 9)}")


# ------------------------------------------------------------------ 10


def components_by_force(rows):
    sets = {d: shingles(t) for d, t in rows}
    of = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b]:
                    m = len(sets[a] & sets[b])
                    if 100 * m >= 75 * len(sets[a] | sets[b]) and of[a] > of[b]:
                        of[a], changed = of[b], True
    return {d: (len(sets[d]), of[d]) for d in sets}


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join(spark, corpus, seed):
    from lexmill.llm.jaccard_join import jaccard_components, one_of_each

    import random

    r = random.Random(seed)
    rows = [(d, t) for d, t, *_ in corpus]
    for size in (1, 3, 5, 6, 7, 9, 13, 20, 40):  # chains and stars of edited texts around every boundary
        base = [f"{seed}w{r.randrange(9)}" if size < 6 else f"{size}w{i}" for i in range(size)]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(size)] = f"e{r.randrange(3)}"
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(frame).collect()}
    want = components_by_force(rows)
    assert got == want
    if not seed:
        assert {x["doc_id"] for x in one_of_each(frame).collect()} == {d for d, (_, c) in want.items() if d == c}


def test_jaccard_edges(spark, none, odd):
    from lexmill.llm.jaccard_join import jaccard_components, one_of_each

    assert jaccard_components(none).count() == 0
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_components(odd).collect())
    assert got == [("5", 1, 5), ("5", 2, 5), ("5", 2, 5), ("6", 0, 6), ("None", 0, None), ("None", 2, None)]
    assert one_of_each(odd).count() == 6


def test_components(spark):
    from lexmill.llm.components import components

    chain = [(i + 1, i) for i in range(40)] + [(100, 99), (102, 100), (103, 99)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99, 102: 99, 103: 99}


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, docs, corpus, none, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(corpus[3][1].split()[10:40])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path))
        assert sorted(now.columns) == sorted(docs.columns), name
        now = spark.createDataFrame(now.collect(), docs.schema)
        gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in now.collect()}
        clean = {i for i in range(30) if i != 3}
        assert not gone & clean, name
    left = {r["doc_id"] for r in now.collect()}
    assert 3 not in left and not left & {38, 39, 40, 41, 42, 43, 44, 45, 47, 48}
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_long_line_in_two_documents_is_packed_once(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    line = " ".join(f"both{i}" for i in range(60))
    rows = [(d, line + "\n" + " ".join(f"own{d}x{i}" for i in range(60)), "en", "s", 0) for d in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = {r["doc_id"]: r["n"] for r in corpus_pipeline.packing(spark, frame, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    alone = {r["doc_id"]: r["n"] for r in corpus_pipeline.packing(spark, frame.withColumn("text", F.split("text", "\n")[1]), str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes[1] > alone[1] and sizes[2] == alone[2]


def test_shared_passages_leave_one_copy_of_the_changed_texts(spark, tmp_path, monkeypatch):
    import uuid

    from lexmill.llm.passages import without_shared_passages

    run = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, f"{run(i)} {run(100 + i % 3)} {run(200 + i)}", "en", 5) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    monkeypatch.setattr("lexmill.llm.common.shared_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    got = {r["doc_id"]: r for r in without_shared_passages(docs).collect()}
    kept = [t for t in (spark.read.parquet(f"file://{p}") for p in tmp_path.iterdir() if any(p.glob("*.parquet"))) if "text" in t.columns and t.count()]
    assert all(len(got[i]["text"].split()) == (180 if i < 3 else 120) and got[i]["lang"] == "en" for i in range(9))
    assert all(got[i]["n_chars"] == len(got[i]["text"]) for i in range(3, 9))
    assert len(kept) == 1 and "text" not in kept[0].schema["row"].dataType.names


def test_text_goes_to_python_in_small_batches(spark):
    """A task's whole text was one batch before, tens of MB that the executor's JVM, the way and the worker held at once."""
    from lexmill.llm.common import SENT, in_small_batches
    from lexmill.llm.packing import pieces_of

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 300).alias("text"))
    before = spark.conf.get(SENT[0], None)
    try:
        spark.conf.unset(SENT[0])
        pieces_of(docs, "byte_bpe_50k.json", 2, 1024)
        sizes = [r["n"] for r in docs.mapInArrow(size, "n long").collect()]
        assert len(sizes) > 2 and max(sizes) < 5_000_000
        spark.conf.set(SENT[0], "8m")  # a limit of the session's own stays
        assert in_small_batches(docs) is docs and spark.conf.get(SENT[0]) == "8m"
    finally:
        spark.conf.unset(SENT[0]) if before is None else spark.conf.set(SENT[0], before)
