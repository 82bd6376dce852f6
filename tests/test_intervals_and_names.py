"""Range joins, timelines of forks, search by name, API consumers and merged results against plain versions."""

import random

import pytest

from corpusgraph.operators import crossrepo, intervals, relations, search, workspace


def ranges(rng, n, files):
    return [(f"r{rng.randint(0, 1)}", rng.choice(files), i, (a := rng.randint(1, 60)), a + rng.choice([-1, 0, 0, 1, 5, 40])) for i in range(n)]


@pytest.mark.parametrize("cut_rows", [200_000, 30])
@pytest.mark.parametrize("kind", ["pairs", "tightest", "within"])
def test_overlaps_equal_all_pairs(spark, kind, cut_rows):
    rng = random.Random(8)
    a, b = ranges(rng, 200, ["hot", "hot", "x", None]), ranges(rng, 150, ["hot", "hot", "x", "y", None])
    schema = "repo string, path string, {0} long, start int, end int"
    left, right = spark.createDataFrame(a, schema.format("left_id")), spark.createDataFrame(b, schema.format("right_id"))
    found = intervals.overlaps(left, right, ["repo", "path"], tightest=kind != "pairs", within=kind == "within", cut_rows=cut_rows)
    pairs = [
        (r, p, i, j, d - c) for r, p, i, s, e in a for q, o, j, c, d in b
        if (r, p) == (q, o) and s <= e and c <= d and s <= d and c <= e and (kind != "within" or (c <= s and d >= e and (c, d) != (s, e)))
    ]
    if kind != "pairs":
        pairs = [min((x for x in pairs if x[2] == i), key=lambda x: (x[4], x[3])) for i in {x[2] for x in pairs}]
    got = [(x.repo, x.path, x.left_id, x.right_id) for x in found.collect()]
    assert len(got) == len(set(got))
    assert sorted(got, key=str) == sorted((x[:4] for x in pairs), key=str)


def test_rows_of_the_join_are_ranges_and_hits(spark):
    n = 3000
    left = spark.createDataFrame([("f", i, 3 * i, 3 * i + 1) for i in range(n)], "path string, left_id long, start int, end int")
    right = spark.createDataFrame([("f", i, 3 * i + 1, 3 * i + 2) for i in range(n)], "path string, right_id long, start int, end int")
    found = intervals.overlaps(left, right, ["path"], cut_rows=500)
    rows = found.collect()
    assert sorted((r.left_id, r.right_id) for r in rows) == [(i, i) for i in range(n)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_forks_keep_their_own_commits(spark):
    files = spark.createDataFrame([("a", "s", "x", 1, 2, 3, 1), ("b", "s", "x", 1, 2, 5, 1)], "repo_id string, sha string, path string, change_start int, change_end int, additions int, deletions int")
    symbols = spark.createDataFrame([("a", "x", "one", 1, 1), ("b", "x", "two", 2, 2)], "repo_id string, path string, name string, start_line int, end_line int")
    assert sorted((r.repo_id, r.sha, r.names) for r in workspace.touched_symbols(files, symbols).collect()) == [("a", "s", ["one"]), ("b", "s", ["two"])]
    assert sorted((r.repo_id, r.additions) for r in workspace.commit_stats(files).collect()) == [("a", 3), ("b", 5)]


def test_names_are_found_case_aside_with_their_chunks(spark):
    symbols = spark.createDataFrame(
        [("r", "1", "m.ts", "foo", "method", 1), ("r", "2", "b.ts", "Foo", "function", 4), ("r", "3", "a.ts", "foo", "class", 2), ("r", "4", "c.ts", "foo", "variable", 1), ("r", "5", "d.ts", "use", "function", 1),
         ("r", "6", "e.ts", "fo", "function", 1), ("r", "7", "f.ts", "FOO", "enum", 1)], "repo_id string, symbol_id string, path string, name string, kind string, start_line int")
    chunks = spark.createDataFrame([("r", s, f"c{s}", 1, 9) for s in "123456"], "repo_id string, symbol_id string, chunk_id string, start_line int, end_line int")
    wanted = spark.createDataFrame([("q", "FOO")], "query_id string, name string")
    found = relations.find_definitions(wanted, symbols, chunks).orderBy("rank").collect()
    assert [(r.symbol_id, r.chunk_id, r["rank"]) for r in found] == [("2", "c2", 2), ("3", "c3", 3), ("1", "c1", 4)]  # 7, without a chunk, is the first
    edges = spark.createDataFrame([("r", "5", "2", "calls"), ("r", "6", "2", "mentions"), ("r", "1", "3", "extends"), ("r", "7", "3", "uses")], "repo_id string, src string, dst string, relation_type string")
    used = relations.find_usages(wanted, symbols, edges, chunks).orderBy("rank").collect()
    assert [r.symbol_id for r in used] == ["5", "1"]


def test_routes_are_found_anywhere_in_a_text(spark):
    deep = "/".join(f"p{i}" for i in range(13))
    files = spark.createDataFrame(
        [("b", "src/app/api/users/route.ts", ""), ("b", f"app/api/{deep}/route.ts", ""), ("b", "src/routes/Users.ts", ""), ("c", "x.ts", f"fetch('/api/users/{deep}')"), ("c", "y.ts", f"fetch(`x/API/{deep}/z`)"),
         ("c", "z.ts", "fetch('/apiusers')"), ("c", "w.ts", "'/api/users'"), ("b", "own.ts", "fetch('/api/users')"), ("c", "n.ts", None)], "repo_id string, path string, content string")
    found = {(r.from_path, r.name) for r in crossrepo.api_consumers(files).collect()}
    assert found == {("x.ts", "/api/users"), ("x.ts", "/users"), ("y.ts", f"/api/{deep}")}


def test_many_words_equal_contains(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab/", k=rng.randint(1, 5))) for _ in range(60)})
    texts = [(i, "".join(rng.choices("ab/c", k=rng.randint(0, 40)))) for i in range(60)] + [(99, None)]
    w, t = spark.createDataFrame([(x,) for x in [*words, ""]], "word string"), spark.createDataFrame(texts, "id int, text string")
    want = sorted((i, x) for i, text in texts for x in words if text and x in text)
    for block in (20_000, 7):
        assert sorted((r.id, r.word) for r in crossrepo.texts_holding(t, w, block=block).collect()) == want


def test_a_place_comes_once(spark):
    rows = [(1, 0, 1, "a.ts", 10, "c1"), (1, 0, 2, "a.ts", 10, "c2"), (1, 1, 1, "a.ts", 10, "c3"), (1, 1, 2, "b.ts", 10, "c4"), (2, 1, 1, "a.ts", 10, "c5")]
    merged = search.multi_query_merge(spark.createDataFrame(rows, "question_id int, ordinal int, rank int, file_path string, start_line int, chunk_id string"))
    assert sorted((r.question_id, r.place, r.chunk_id) for r in merged.collect()) == [(1, 1, "c1"), (1, 2, "c4"), (2, 1, "c5")]
