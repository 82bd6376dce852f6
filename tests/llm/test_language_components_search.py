"""Language, whitening and lexical search against brute force and held-out labels, with nulls, empty, long and repeated rows and clashing names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import base, language, lexical, whitening

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(doc_id, Counter(t)) for doc_id, text in docs if (t := terms_of(text))]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in {(i, t): 0 for i, t in items}:
        query, found = Counter(terms_of(text)), []
        for doc_id, c in counted:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in query if t in c}
            score = sum(n * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in query.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ODD_DOCS = [
    (1, "Alpha beta gamma, beta"), (2, "alpha BETA"), (2, "alpha BETA"), (3, None), (4, ""), (5, "..."), (None, "alpha beta"), (6, "É été alpha é"),
    (7, "gamma " * 3000 + "delta"), *((100 + i, "common words in many copies") for i in range(60)), (8, "alpha-delta_9"), (9, "zeta"),
]
ODD_ITEMS = [(1, "alpha beta beta"), (1, "alpha beta beta"), (1, "delta"), (2, None), (3, ""), (4, "words common"), (None, "gamma zeta"), (5, "unknown"), (6, "été É")]


def test_lexical_search_equals_scoring_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in ODD_DOCS], "doc_id long, text string, score int, rank string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ODD_ITEMS], "item_id long, text string, doc_id int")
    want = plain_ranking(ODD_DOCS, ODD_ITEMS, 4)
    for kind in ({}, {"group_bytes": 12, "head": 1}):
        found = [tuple(r) for r in lexical.rank_documents(docs, items, k=4, **kind).collect()]
        assert sorted(found, key=str) == want


def test_lexical_search_prunes_and_loses_nothing(spark):
    docs, items = base.table(spark, SMALL, "documents"), base.table(spark, SMALL, "benchmark")
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(map(tuple, lexical.op13_lexical_search(spark, SMALL).collect()), key=str) == want
    # buckets of a few rows: most fall to the product of lengths or to the bound inside
    raw, at = lexical.text_bytes(pa.array([r.text for r in items.collect()]))
    hashes, begin = lexical.word_hashes(raw, at, lexical.LOOSE)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    postings = lexical.term_counts(docs, vocabulary)
    weights = np.full(len(vocabulary), 1000)
    buckets = lexical.length_buckets(lexical.impacts(postings, 200, 80_000, weights), bucket_rows=16).toPandas().sort_values("longest", ascending=False)
    query = lexical.query_vector(*lexical._counted(place[begin[0] : begin[1]]), weights)
    made = [lexical.Bucket(pa.array(b.ids), *(np.array(x) for x in (b.lengths, b.counts, b.terms, b.impacts)), weights) for b in buckets.itertuples()]
    scores = np.concatenate([b.scores(query, np.arange(len(b.ids))) for b in made])
    kth = int(np.sort(scores)[-3])
    left = [b.survivors(query, kth) for b in made]
    assert sum(map(len, left)) < len(scores) / 2
    assert sum(int((b.scores(query, rows) >= kth).sum()) for b, rows in zip(made, left, strict=True) if len(rows)) == (scores >= kth).sum()


def test_lexical_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.rank_documents(none, items).collect() == []
    assert lexical.rank_documents(some, items.where("false")).collect() == []


@pytest.mark.parametrize("name", ["random", "decay", "equal", "ties", "rank 1", "one", "close", "wide"])
def test_components_equal_a_full_decomposition(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 40))
    a = {
        "random": x.T @ x / 400, "decay": (x * 0.5 ** np.arange(40)).T @ (x * 0.5 ** np.arange(40)) / 400, "equal": np.eye(20), "one": np.array([[2.0]]),
        "ties": np.diag([5.0] * 9 + [4, 4, 3] + [1.0] * 8), "rank 1": np.outer(np.arange(1, 6.0), np.arange(1, 6.0)), "close": np.diag([1 + 1e-9, 1, 1 - 1e-9, 0.3, 0.2]),
        "wide": (w := rng.normal(size=(600, 200))).T @ w / 600,
    }[name]
    values, vectors = whitening.leading_components(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    want = want[want > 1e-12 * want[0]]
    assert len(values) == len(want) and np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    x = np.random.default_rng(5).normal(size=(50, 30))
    a = x.T @ x
    shifts = np.linspace(-1, 150, 97)
    assert (whitening.counts_above(whitening.tridiagonal(a), shifts) == [(np.linalg.eigvalsh(a) > s).sum() for s in shifts]).all()


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    d = (fit - s / n).astype(float)
    values, v = np.linalg.eigh(d.T @ d / n)
    values, v = values[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x * n - s) / n @ v / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitened_equals_a_plain_decomposition(spark):
    rows = base.table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    n, deviation, whitened, explained = plain_whitening([r.embedding for r in rows])
    found = {}
    for r in whitening.op12_whitened(spark, SMALL).collect():
        assert r.n == n and r.identity_error <= 1e-10
        found[r.vec_id, r.component] = r
    assert len(found) == 16 * len(rows)
    sign = np.sign([found[rows[0].vec_id, c].whitened * whitened[0, c - 1] for c in range(1, 17)])
    for i, r in enumerate(rows):
        own = [found[r.vec_id, c] for c in range(1, 17)]
        assert {x.deviation for x in own} == {int(deviation[i])}
        assert np.allclose([x.whitened for x in own] * sign, whitened[i, :16], atol=1e-9) and np.allclose([x.explained for x in own], explained[:16], rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, 5.0]), (2, [0.5, -0.9, 5.0]), (2, [0.5, -0.9, 5.0]), (3, [-2.0, 0.3, 5.0]), (4, [1.0, 1.5, 5.0])]
    bad = [(5, None), (6, []), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 1.0, 1.0]), (None, [0.0, 0.0, 0.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3, "s") for i, v in good + bad], "vec_id long, embedding array<double>, point int, dim string")
    found = whitening.whiten(df, "vec_id", "embedding").collect()
    n, deviation, whitened, explained = plain_whitening([v for _, v in good])
    assert sorted((r.id, r.component) for r in found) == sorted((i, c) for i, _ in good for c in (1, 2))  # the third dimension doesn't vary, (10) varies alone
    by = {(r.id, r.component): r for r in found}
    for i, (vec_id, _) in enumerate(good):
        for c in (1, 2):
            r = by[vec_id, c]
            assert (r.n, r.deviation) == (n, deviation[i]) and abs(abs(r.whitened) - abs(whitened[i, c - 1])) < 1e-9 and abs(r.explained - explained[c - 1]) < 1e-9
    assert whitening.whiten(df.where("false"), "vec_id", "embedding").collect() == []


def test_deviations_beyond_int64_are_exact_or_an_error():
    centred = whitening.Centred(10**6, [0, 0])
    small = centred(np.array([[1000, -2000]]))
    assert whitening.Centred.squares(small).tolist() == [10**18 + 4 * 10**18]
    with pytest.raises(OverflowError):
        whitening.Centred.squares(whitening.Centred(10**9, [0])(np.array([[10**6]])))


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = language.op11_languages(spark, folder).collect()
    lang = {r.doc_id: r.lang for r in base.table(spark, folder, "documents").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(lang.keys())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(i, f"the thing and other words {i}", "en") for i in range(40)] + [(100 + i, f"les choses et quelques mots {i}", "fr") for i in range(80)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 ... 34", None), (1003, "the other thing", None), (None, "quelques choses", "fr"), (1004, "the and thing " * 20_000, None)]
    df = spark.createDataFrame([(i, t, g, 1.0, "b") for i, t, g in rows + odd], "doc_id long, text string, lang string, score double, bucket string")
    model = language.fit_languages(df, sample_rows=50)
    assert model.languages == ["en", "fr"] and np.count_nonzero(model.weights) < model.weights.size / 10
    found = {r.doc_id: r for r in language.predict_languages(df, model).collect()}
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1000].score == 0
    assert [found[i].lang_pred for i in (1003, 1004, None, 5, 105)] == ["en", "en", "fr", "en", "fr"]
    alone = language.predict_languages(df, language.fit_languages(df.where("lang = 'fr'"))).collect()
    assert {r.lang_pred for r in alone} == {"und", "fr"} and {r.score for r in alone if r.lang_pred == "fr"} == {1.0}
    none = language.predict_languages(df, language.fit_languages(df.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.predict_languages(df.where("false"), model).collect() == []


def test_grams_equal_a_plain_cut():
    texts = ["Ab c", "", "éé--A", "x y", "ab"]
    row, bucket, count, letters = language.gram_counts(pa.array(texts), 20, 3)
    assert letters.tolist() == [True, False, True, True, True]
    want = []
    for t in texts:
        words = ["".join(x) for x in re.findall(r"[^\W\d_]+", t.lower())]
        starts_blank = [i > 0 or not t[0].isalpha() for i in range(len(words))]
        grams = Counter()
        for i, w in enumerate(words):
            ends_blank = i + 1 < len(words) or not t[-1].isalpha()
            s = " " * starts_blank[i] + w + " " * ends_blank
            for size in (1, 2, 3):
                for a in range(len(s) - size + 1):
                    g = s[a : a + size]
                    if g != " " and " " not in g[1:-1]:
                        grams[g] += 1
        want.append(grams)
    # a blank between two words closes one and opens the next: bigrams with it are counted once each, as here
    for i, grams in enumerate(want):
        assert sorted(count[row == i].tolist()) == sorted(grams.values())
