"""Lexical search in web syntax, trigram search and the inverted file against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import inverted, lexical, retrieval

SF01 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\W]+")


def plain_items(text):
    """[(clause, negative, words)] of a search in web syntax."""
    items, clause, joined = [], 0, False
    for token in re.findall(r'-?"[^"]*"|\S+', text):
        words = WORD.findall(token.lower())
        if token == "OR":
            joined = True
            continue
        if not words:
            continue
        clause += 0 if joined and items else 1
        joined = False
        items.append((clause, token.startswith("-"), words))
    return items


def plain_search(queries, chunks, k):
    terms = {c: WORD.findall(t.lower()) for c, t in chunks}
    df = Counter(t for ts in terms.values() for t in set(ts))
    mean = sum(map(len, terms.values())) / len(terms)

    def part(t, ts):
        tf = ts.count(t)
        return math.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))

    out = []
    for q, text in queries:
        items, found = plain_items(text), []
        for c, ts in terms.items():
            has = [any(ts[i : i + len(w)] == w for i in range(len(ts))) for _, _, w in items]
            want = {cl for cl, neg, _ in items if not neg}
            met = {cl for (cl, neg, _), h in zip(items, has, strict=True) if h and not neg}
            if want and met == want and not any(h and neg for (_, neg, _), h in zip(items, has, strict=True)):
                words = {w for (_, neg, ws), h in zip(items, has, strict=True) if h and not neg for w in ws}
                found.append((-round(sum(part(w, ts) for w in words), 6), c))
        out += [(q, c, n + 1) for n, (_, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 9, "head": 1}, {"block_rows": 4, "head": 2}])
def test_web_syntax_in_the_ranking_equals_a_plain_search(spark, blocks):
    rng = random.Random(4)
    words = ["red", "fox", "blue", "ran", "over", "tree", "the", "a_b"]
    chunks = [(f"c{i:03}", " ".join(rng.choices(words, weights=[2, 2, 1, 1, 1, 1, 9, 1], k=rng.randint(1, 30)))) for i in range(150)]
    queries = [
        (1, "red fox"), (2, '"red fox"'), (3, '"red fox" OR blue'), (4, 'the -"fox red"'), (5, '"the the the"'), (6, "red OR blue OR tree ran"), (7, "-red"), (8, ""),
        (9, "unknown OR fox"), (10, "unknown fox"), (11, "red-fox -blue"), (12, "OR red OR"), (13, '"a_b"'), (14, 'fox "red fox red" OR "fox ran"'), (15, "the"), (16, '"fox fox" -tree'),
    ]
    found = lexical.lexical_topk(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(chunks, "chunk_id string, content string"), k=5, **blocks)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == plain_search(queries, chunks, 5)


def plain_grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize("block", [500, 3])
def test_trigram_search_equals_all_pairs(spark, block):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12)))
    chunks = [(f"c{i:03}", text(), f"r{i % 2}") for i in range(120)] + [(f"d{i:03}", "abc dea éß", "r0") for i in range(40)] + [("e", None, "r0"), ("f", "", "r1")]
    queries = [(i, text(), f"r{i % 2}") for i in range(8)] + [(20, "abc dea éß", "r0"), (21, "", "r0"), (22, None, "r1")]
    want = []
    for q, t, repo in queries:
        a = plain_grams(t or "")
        found = [(-len(a & b) / len(a | b), c) for c, s, r in chunks if r == repo and a | (b := plain_grams(s or "")) and len(a & b) / len(a | b) > 0.1]
        want += [(q, c, round(-s, 9)) for s, c in sorted(found)[:7]]
    rows = lexical.trigram_topk(
        spark.createDataFrame(queries, "query_id int, text string, repo_id string"), spark.createDataFrame(chunks, "chunk_id string, content string, repo_id string"), k=7, block=block
    )
    assert sorted((r.query_id, r.chunk_id, round(r.similarity, 9)) for r in rows.collect()) == sorted(want)


def test_fallback_has_no_cross_join(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id int, text string")
    c = spark.createDataFrame([("a", "alpha beta"), ("b", "alpah betta"), ("c", "gamma gamma")], "chunk_id string, content string")
    found = lexical.lexical_with_fallback(q, c)
    assert not re.search("Cartesian|NestedLoop", found._jdf.queryExecution().toString())
    assert [(r.query_id, r.chunk_id) for r in found.orderBy("query_id", "rank").collect()] == [(1, "a"), (1, "b"), (2, "c")]


def test_inverted_file_finds_most_and_scores_few(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    exact = {(r.query_id, r.chunk_id): r.similarity for r in retrieval.semantic_topk(queries, rows).collect()}
    found = {(r.query_id, r.chunk_id): r.similarity for r in inverted.semantic_topk_approx(queries, rows).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(s - exact[key]) < 2e-6 for key, s in found.items() if key in exact)
    # 5 * 20 of 2000 vectors are scored for a query
    assert 5 * 20 <= 0.1 * e.count()


def test_inverted_file_needs_few_lists_where_there_are_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(4000)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [float("nan")] * 16), *((6000 + i, rows[7][1]) for i in range(300))]
    v = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(r[0], r[1]) for r in rows[::100]] + [(9000, None)], "query_id long, vector array<double>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.semantic_topk(q, v.where("chunk_id < 5000"), k=10).collect()}
    found = {(r.query_id, r.chunk_id) for r in inverted.semantic_topk_approx(q, v.where("chunk_id < 5000"), k=10, probe=0.08).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {r.chunk_id for r in inverted.semantic_topk_approx(q, v, k=10, probe=0.08).collect()}.isdisjoint({5000, 5001, 5002, 5003})
    assert inverted.semantic_topk_approx(q, v.where("false")).collect() == []
