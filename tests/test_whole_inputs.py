"""Registered queries work on all rows of their tables: no row is left out before an operator sees it."""

import pandas as pd
import pytest

from corpusgraph.operators import health, lexical, retrieval
from corpusgraph.plans import registry, reports  # noqa: F401
from corpusgraph.plans.fixtures import frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def links():
    """(src, dst) of lines next to each other in an order and a repository, from all of lineitem."""
    rows = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    rows["repo"] = rows["l_partkey"] % 4
    rows = rows.sort_values(["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    rows["dst"] = rows.groupby(["l_orderkey", "repo"])["l_partkey"].shift(-1)
    rows = rows[rows["dst"].notna() & (rows["dst"] != rows["l_partkey"])]
    return set(zip(rows["l_partkey"].astype(str), rows["dst"].astype(int).astype(str), strict=True))


@pytest.fixture(scope="module")
def calls(spark):
    """(src, dst) of the relations between source files."""
    return {(r.src, r.dst) for r in frame(spark, FOLDER, "fx_src_relations").collect()}


def test_relations_hold_every_link(spark, links):
    got = {(r.src, r.dst) for r in frame(spark, FOLDER, "fx_relations").select("src", "dst").distinct().collect()}
    assert got == links


def test_call_chains_hold_every_link_on_the_way(spark, calls):
    to = {}
    for a, b in calls:
        to.setdefault(a, set()).add(b)
    want = set()
    for source in {x for link in calls for x in link}:
        seen, front = {source}, {source}
        for depth in range(1, 4):
            want |= {(source, x, y, depth) for x in front for y in to.get(x, ())}
            front = {y for x in front for y in to.get(x, ())} - seen
            seen |= front
    got = {(r.source, r.src, r.dst, r.depth) for r in registry.QUERIES["g22_call_chains"](spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("name, steps, depth", [("g12_impact", "in", 4), ("r8_k_hop", "both", 2)])
def test_every_node_is_a_source(spark, calls, name, steps, depth):
    to = {}
    for a, b in calls:
        if steps != "in":
            to.setdefault(a, set()).add(b)
        if steps != "out":
            to.setdefault(b, set()).add(a)
    want = set()
    for source in {x for link in calls for x in link}:
        seen, front = {source}, {source}
        for d in range(1, depth + 1):
            front = {y for x in front for y in to.get(x, ())} - seen
            seen |= front
            want |= {(source, y, d) for y in front}
    got = [(r.source, r.node, r.depth) for r in registry.QUERIES[name](spark, FOLDER).collect()]
    assert len(got) == len(want) and set(got) == want


def test_semantic_queries_are_all_that_the_rule_names(spark):
    wanted = {r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 50 == 0}
    got = registry.QUERIES["r1_semantic_topk"](spark, FOLDER)
    assert {r.query_id for r in got.collect()} == wanted


def test_semantic_blocks_give_the_same(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    queries, vectors = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector"), e.selectExpr("vec_id AS chunk_id", "embedding")
    one, many = (retrieval.semantic_topk(queries, vectors, block=n).collect() for n in (10_000, 3))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one


def test_lexical_queries_are_whole_texts(spark):
    chunks = spark.createDataFrame([("a", "one two three four"), ("b", "one two three five"), ("c", "five four three two one")], "chunk_id string, content string")
    got = lexical.lexical_topk(spark.createDataFrame([(1, "one two three four"), (2, "one two three six")], "query_id long, text string"), chunks)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(1, "a"), (1, "c")}
    texts = {r.item_id: set(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    content = {str(r.doc_id): r.text.lower() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in registry.QUERIES["r3_lexical_topk"](spark, FOLDER).collect():
        assert all(word.strip(".,!?;:") in content[r.chunk_id] for word in texts[r.query_id])


def test_health_counts_chunks(spark):
    views = [frame(spark, FOLDER, f"fx_{v}") for v in ("symbol_files", "symbols", "relations", "symbol_chunks")]
    rows = health.file_health(*views).collect()
    assert all(r.chunk_count == r.symbol_count > 0 and r.avg_tokens > 0 and r.chunk_density > 0 for r in rows)
    documented = {(r.repo_id, r.file_id) for r in rows if r.doc_ratio >= 0.05}
    assert 0 < len(documented) < len(rows)
    assert all(("Low documentation coverage (<5%)" in r.issues) != ((r.repo_id, r.file_id) in documented) for r in rows)
    assert max(r.score for r in registry.QUERIES["h4_file_health"](spark, FOLDER).collect()) > 90
