"""Models and indexes hold all of what they are given, beyond any list of frequent or small values."""

import math
import random

import numpy as np
import pytest

from corpusgraph.llm import lm, topk, toxicity


def test_bigrams_behind_rare_words_are_kept(spark):
    train = [(i, " ".join(f"common{(i * k) % 7}" for k in range(20)) + f" rare{i % 40} follows{i % 40}") for i in range(120)]
    docs = spark.createDataFrame([(1000, "rare3 follows3"), (1001, "rare3 follows4"), (1002, "never follows3"), (1003, None), *train], "doc_id long, text string")
    texts = spark.createDataFrame(train, "doc_id long, text string").select("text")
    scores = []
    for contexts in (3, 131_000):  # by the shuffled table, and by the broadcast list
        model = lm.fit_language_model(texts, contexts=contexts, bits_per_entry=60)
        scores.append({r.doc_id: r.score for r in lm.score_texts(docs, model).collect()})
    few, all_words = scores
    assert len(model.frequent.words) > 40
    assert few.keys() == all_words.keys() and all(abs(few[k] - all_words[k]) < 1e-9 for k in few)
    assert few[1000] > few[1001] + 1
    assert few[1000] > few[1002] + 1


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 4)).round(2) * 10.0 ** rng.integers(0, 7, (200, 1))
    points[150:] = np.round(points[150:] * 2e5 / np.abs(points[150:]).max(), 2)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(1000, [float("inf")] * 4), (1050, [float("nan")] * 4)]
    vectors = topk.quantised_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    q = [[math.floor(256 * x) for x in p] for p in points.tolist()]
    want = []
    for i in range(0, 200, 10):
        order = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(200) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    got = topk.top_k(vectors, vectors.where("id % 10 = 0"), k=5, shard_rows=50, block=7)
    assert sorted(map(tuple, got.collect())) == want


def test_tree_sums_beyond_64_bits():
    rng = np.random.default_rng(5)
    points = rng.integers(-(2**62), 2**62, (300, 3))
    tree = topk.KdTree(points, [[i] for i in range(300)])
    for i in range(0, 300, 30):
        scores = sorted(((sum(a * b for a, b in zip(points[i].tolist(), p, strict=True)), -j) for j, p in enumerate(points.tolist()) if j != i), reverse=True)
        assert tree.search(points[i], i, 5, -math.inf) == [(s, -j) for s, j in scores[:5]]


def test_top_k_refuses_what_64_bits_cannot_hold(spark):
    rows = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.quantised_vectors(rows, "vec_id", "embedding").collect()


def test_toxicity_without_telling_words(spark):
    """Two toxic texts are too few for the word list; the model must still tell them."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(40)), 0) for i in range(60)]
    bad = [word("qrstuvwx") for _ in range(6)]
    rows += [(60 + i, " ".join(rng.choice(bad) for _ in range(40)), 1) for i in range(2)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert min(scores[60], scores[61]) > max(scores[i] for i in range(60))
