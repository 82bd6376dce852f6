"""Cases of the fourth review: what was cut, and joins that grew with the square of a name's holders."""

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.llm import topk
from corpusgraph.operators import changes, graph, inverted, retrieval, search, traverse


def shuffled_rows(spark, make, what="shuffleWriteRecords"):
    """The rows of what make() returns, and how many rows (or bytes) its stages shuffled."""
    context = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        context.listenerBus().waitUntilEmpty(60_000)
        found = context.statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): getattr(x, what)() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    rows = make().collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def _ring(spark, n):
    """n functions, each in its own file; all call the last one, whose relations come last by every order of names."""
    symbols = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.format_string("s%05d", "id").alias("symbol_id"), F.format_string("f%05d", "id").alias("file_id"), F.format_string("src/f%05d.ts", "id").alias("path"),
        F.format_string("n%d", "id").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
    )
    pair = lambda d, t: spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("s%05d", "id").alias("src"), F.format_string("s%05d", d).alias("dst"), F.lit(t).alias("relation_type"))
    relations = pair((F.col("id") + 1) % n, "calls").unionByName(pair(F.lit(n - 1), "uses")).where("src <> dst")
    files = symbols.select("repo_id", "file_id", "path", F.lit(3).alias("line_count"))
    return symbols, relations, files


def test_graph_of_files_counts_every_edge(spark):
    n = 2500
    nodes, edges = graph.build_graph(*_ring(spark, n), level="file")
    first = nodes.orderBy(F.desc("in_degree"), "node").first()
    assert (first.node, first.in_degree, first.out_degree) == (f"src/f{n - 1:05d}.ts", n, 1)
    assert edges.where(F.col("target") == first.node).count() == 149


def test_graph_of_symbols_counts_every_relation(spark):
    n = 1500
    nodes, _ = graph.build_graph(*_ring(spark, n), level="symbol")
    first = nodes.orderBy(F.desc("in_degree"), "node").first()
    assert (first.node, first.in_degree, first.out_degree) == (f"s{n - 1:05d}", n, 1)


def _same_names(spark, n):
    """n functions of one name, and n queries for it in capitals, n for a part of it."""
    symbols = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.format_string("s%05d", "id").alias("symbol_id"), F.lit("build").alias("name"), F.format_string("src/f%05d.ts", "id").alias("path"), F.lit(1).alias("start_line")
    )
    names = spark.range(2 * n).select(F.format_string("q%05d", "id").alias("query_id"), F.lit("r").alias("repo_id"), F.when(F.col("id") < n, "BUILD").otherwise("uil").alias("name"))
    return names, symbols


def test_seeds_of_a_name_are_cut_before_they_meet_its_queries(spark):
    n = 600
    rows, moved = shuffled_rows(spark, lambda: search.seed_symbols(*_same_names(spark, n)))
    of = {}
    for r in rows:
        of.setdefault(r.query_id, []).append(r.symbol_id)
    assert {q: sorted(x) for q, x in of.items()} == {f"q{i:05d}": [f"s{j:05d}" for j in range(50 if i < n else 30)] for i in range(2 * n)}
    assert moved < n * n / 2


def test_queries_for_the_same_names_are_searched_once(spark):
    n = 600
    names, symbols = _same_names(spark, n)
    ids = symbols.select("repo_id", F.col("symbol_id").alias("src"))
    edges = ids.withColumns({"dst": F.format_string("s%05d", (F.substring("src", 2, 5).cast("int") * 7 + 1) % n), "relation_type": F.lit("calls")})
    chunks = symbols.select("repo_id", "symbol_id", F.col("symbol_id").alias("chunk_id"))
    rows, moved = shuffled_rows(spark, lambda: search.structural_topk(names, symbols, edges, chunks))
    assert {(r.query_id, r.chunk_id, r.score, r.rank) for r in rows} == {(f"q{i:05d}", f"s{j:05d}", 1.0, j + 1) for i in range(2 * n) for j in range(20)} and len(rows) == 40 * n
    assert moved < 40 * n + 20_000


def test_nearest_is_the_first_part_of_reach(spark):
    edges = spark.range(400).select(F.lit("r").alias("repo_id"), F.format_string("n%03d", F.col("id") * 31 % 67).alias("src"), F.format_string("n%03d", F.col("id") * F.col("id") % 53).alias("dst"), F.lit("t").alias("relation_type"))
    starts = spark.range(20).select(F.lit("r").alias("repo_id"), F.format_string("q%d", F.col("id") % 7).alias("source"), F.format_string("n%03d", F.col("id") * 3).alias("node"))
    for direction in ("in", "out", "both"):
        whole = {}
        for r in traverse.reach(starts, edges, max_depth=3, direction=direction, with_starts=True).collect():
            whole.setdefault(r.source, []).append((r.depth, r.node))
        for most in (2, 9, 30, 100):
            near = {}
            for r in traverse.nearest(starts, edges, most=most, max_depth=3, direction=direction).collect():
                near.setdefault(r.source, []).append((r.depth, r.node))
            assert {q: sorted(x) for q, x in near.items()} == {q: sorted(x)[:most] for q, x in whole.items()}


def test_changes_of_the_same_symbols_are_followed_once(spark):
    n = 500
    _, symbols = _same_names(spark, n)
    none = F.array().cast("array<string>")
    said = spark.range(n).select(F.format_string("c%05d", "id").alias("change_id"), F.lit("r").alias("repo_id"), F.lit("remove").alias("change_type"), none.alias("files"), none.alias("modules"), F.array(F.lit("Build")).alias("names"))
    users = spark.range(60).select(F.lit("r").alias("repo_id"), F.format_string("s%05d", F.col("id") + 100).alias("src"), F.format_string("s%05d", F.col("id") % 20).alias("dst"), F.lit("calls").alias("relation_type"))
    files = symbols.select("repo_id", "path")
    rows, moved = shuffled_rows(spark, lambda: changes.affected_items(said, files, symbols, users))
    assert len(rows) == len(set(rows)) == n * 80  # three dependents of each of the first twenty symbols, and the twenty files, which none of these is in
    assert {(r.change_id, r.symbol_id, r.scope, r.severity, r.breaks) for r in rows if r.symbol_id} == {(f"c{c:05d}", f"s{100 + i:05d}", "direct", "break", True) for c in range(n) for i in range(60)}
    assert moved < 150 * n


def test_approximate_search_leaves_lists_and_queries_where_they_are(spark):
    part = lambda i: F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000.0 - 1
    vectors = spark.range(3000).select(F.col("id").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), part).alias("embedding"))
    queries = vectors.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    find = lambda: inverted.semantic_topk_approx(queries, vectors, k=3, probe=1.0, min_similarity=0.2)
    rows, _ = shuffled_rows(spark, find)
    exact = retrieval.semantic_topk(queries, vectors, k=3, min_similarity=0.2).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in exact} and len(rows) == len(exact)
    plan = find()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "asked" not in plan  # the lists are scanned without a join with the queries


def test_suggestions_of_names_that_many_symbols_share(spark):
    symbols = spark.range(900).select(F.lit("r").alias("repo_id"), F.format_string("s%05d", "id").alias("symbol_id"), F.when(F.col("id") % 30 == 7, "Alpha").otherwise("beta_al").alias("name"))
    prefixes = spark.createDataFrame([("al",), ("BETA",), ("none",)], "prefix string")
    rows, moved = shuffled_rows(spark, lambda: retrieval.suggest_symbols(prefixes, symbols))
    ids = {"Alpha": [f"s{i:05d}" for i in range(900) if i % 30 == 7], "beta_al": [f"s{i:05d}" for i in range(900) if i % 30 != 7]}
    first = [("Alpha", i) for i in ids["Alpha"]] + [("beta_al", i) for i in ids["beta_al"][:20]]
    want = {("r", "al", i, name, n + 1) for n, (name, i) in enumerate(first)} | {("r", "BETA", i, "beta_al", n + 1) for n, i in enumerate(ids["beta_al"][:50])}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert moved < 3000


def test_exact_top_k_has_no_task_for_each_pair_of_block_and_shard(spark):
    points = np.random.default_rng(4).integers(-9, 10, (160, 4))
    rows = [(i, 4, bytearray(p.astype("<i8").tobytes())) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "id long, dim int, point binary")
    context = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    last = max((x.stageId() for x in (lambda f: (f.apply(i) for i in range(f.size())))(context.statusStore().stageList(None, False, False, none, None))), default=-1)
    got = {(r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(vectors, vectors.where("id < 80"), k=2, shard_rows=20, block=1).collect()}
    want = set()
    for q in range(80):
        best = sorted((-int(points[i] @ points[q]), i) for i in range(160) if i != q)[:2]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    context.listenerBus().waitUntilEmpty(60_000)
    found = context.statusStore().stageList(None, False, False, none, None)
    assert max(x.numTasks() for x in (found.apply(i) for i in range(found.size())) if x.stageId() > last) < 600  # 8 shards and 80 blocks: 1280 before
