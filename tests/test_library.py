"""Small hand-made cases for parts that the star-schema tables don't reach."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusgraph.functions import paths, text
from corpusgraph.operators import chunks, relations, reports, retrieval, traverse
from corpusgraph.sources import files


def test_intents(spark):
    asked = {
        "where is the definition of foo": "find_definition",
        "who calls parseConfig": "find_usage",
        "handlers without validation": "find_missing",
        "code similar to this": "find_similar",
        "show me the singleton": "find_pattern",
        "list all endpoints": "find_code",
        "explain UserService": "find_code",
        "how does it work": "general",
    }
    rows = spark.createDataFrame([Row(q=q, want=w) for q, w in asked.items()])
    assert rows.where(text.intent_of(F.col("q")) != F.col("want")).count() == 0


def test_identifiers(spark):
    found = spark.range(1).select(text.symbol_candidates(F.lit("use `x.y` and \"Foo\" in getUser2, snake_case of MyClass")).alias("c")).first().c
    assert found == ["x.y", "Foo", "MyClass", "snake_case", "getUser2"]


def test_routes(spark):
    given = {
        "src/app/api/a/[id]/route.ts": "/api/a/:id", "x/pages/api/u/[...all].ts": "/api/u/:all*", "x/pages/api/index.js": "/api", "src/app/route.tsx": "/",
    }
    rows = spark.createDataFrame([Row(p=p, want=w) for p, w in given.items()])
    assert rows.where(paths.route_path(F.col("p")) != F.col("want")).count() == 0


def test_git_lines(spark):
    lines = lambda *x: spark.createDataFrame([Row(value=v) for v in x])
    assert files.parse_commits(lines("a|2020|me|fix | this", "broken")).collect() == [Row(sha="a", date="2020", author="me", subject="fix | this")]
    assert [tuple(r) for r in files.parse_numstat(lines("1\t2\ta\tb", "-\t-\tc")).collect()] == [("a\tb", 1, 2), ("c", 0, 0)]
    assert [r.line for r in files.parse_hunks(lines("@@ -1,2 +5,3 @@ x", "@@ -1 +9 @@", "@@ -1 +4,0 @@", "+ y")).collect()] == [5, 6, 7, 9, 4]


def test_scan_and_filters(spark, tmp_path):
    for name, data in {"a.ts": b"x\ny", "node_modules/b.ts": b"x", "c.png": b"x", "d.py": b"\0x", "src/e.py": b"z", "empty.py": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.drop_binary(files.skip_filter(files.scan_files(spark, str(tmp_path), "r")))
    facts = files.file_facts(found.withColumn("content", F.decode("bytes", "UTF-8")))
    assert sorted((r.path, r.line_count, r.size_bytes) for r in facts.collect()) == [("a.ts", 2, 3), ("src/e.py", 1, 1)]


def test_incremental_equals_full(spark):
    make = lambda d: spark.createDataFrame([Row(repo_id="r", path=p, content_hash=h) for p, h in d.items()])
    old, new = make({"a": "1", "b": "2", "c": "3"}), make({"a": "1", "b": "9", "d": "4"})
    diff = files.diff_snapshot(old, new)
    assert {r.path: r.status for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    fresh = new.join(diff.where("status IN ('new', 'changed')").select("path"), "path", "left_semi").select(*old.columns)
    after = files.apply_snapshot({"files": old}, {"files": fresh}, diff)["files"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, new.collect()))


def test_fusion_bonus_and_scope(spark):
    rows = [("q", "A", "f", 10, "semantic", 0.9), ("q", "B", "g", 10, "semantic", 0.7), ("q", "A", "f", 10, "lexical", 0.8), ("q", "C", "h", 10, "lexical", 0.1)]
    scored = spark.createDataFrame(rows, "query_id string, chunk_id string, file_path string, token_count int, strategy string, score double")
    plain = {r.chunk_id: r.final for r in retrieval.fuse_rankings(scored).collect()}
    assert plain == {"A": 0.9, "B": 0.0, "C": 0.0}
    scope = spark.createDataFrame([("q", "g")], "query_id string, scope_path string")
    assert {r.chunk_id: r.final for r in retrieval.fuse_rankings(scored, scope).collect()}["B"] == 0.3


def test_overlaps_keep_the_better_chunk(spark):
    rows = [("q", "x.ts", "a", 1, 20, 0.9), ("q", "x.ts", "b", 5, 15, 0.7), ("q", "x.ts", "c", 18, 40, 0.6), ("q", "y.ts", "d", 5, 15, 0.5)]
    ranked = spark.createDataFrame(rows, "query_id string, file_path string, chunk_id string, start_line int, end_line int, score double")
    kept = reports.drop_overlaps(ranked).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in kept] == [("a", 1), ("c", 2), ("d", 3)]


def test_progress_and_bookmarks(spark):
    rows = spark.createDataFrame([(1, "r", "dev", [1], 1), (1, "r", "dev", [1, 2, 2], 2)], "user_id int, repo_id string, role string, completed_steps array<int>, updated_at int")
    assert reports.progress(rows, 4).first().percent == 50
    marks = spark.createDataFrame([("f", "Old one", 1), ("f", "New one", 2), ("g", "x", 3)], "file_path string, title string, created_at int")
    found = reports.bookmarks_by_file(marks, "ONE").collect()
    assert [(r.file_path, r.n, [t.title for t in r.titles]) for r in found] == [("f", 2, ["New one", "Old one"])]


def test_cycles_are_found_once(spark):
    edges = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "b", "a"), ("s", "a", "b")]
    rows = spark.createDataFrame([(*e, "imports") for e in edges], "repo_id string, src string, dst string, relation_type string")
    assert sorted(r.nodes for r in traverse.find_cycles(rows).collect()) == [["a", "b"], ["a", "b", "c"]]


def chunks_by_hand(text):
    rows, size = text.split("\n"), lambda t: -(-len(t) // 4)
    if size(text) <= 800:
        return [(1, len(rows))]
    out, first, tokens = [], 0, 0
    for i, line in enumerate(rows):
        tokens += size(line)
        if tokens >= 500:
            cut = next((j + 1 for j in range(i, max(first + 5, i - 10) - 1, -1) if not rows[j].strip()), i + 1)
            out.append((first + 1, cut))
            first, tokens = cut, 0
    if first < len(rows) and "\n".join(rows[first:]):
        out.append((first + 1, len(rows)))
    return out


def test_chunks_by_lines(spark):
    import random

    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", "x" * rng.randint(1, 200), "word " * 9]) for _ in range(rng.choice([1, 3, 80, 300]))) for _ in range(40)] + ["", "y" * 9000]
    files_table = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, file_id string, content string")
    got = {}
    for r in chunks.chunk_by_lines(files_table).orderBy("seq").collect():
        got.setdefault(int(r.file_id), []).append((r.start_line, r.end_line))
        assert r.content == "\n".join(texts[int(r.file_id)].split("\n")[r.start_line - 1 : r.end_line])
    assert got == {i: chunks_by_hand(t) for i, t in enumerate(texts)}


def test_imports_become_relations(spark):
    paths_of = ["src/auth/middleware.ts", "src/auth/index.ts", "src/app.ts", "lib/util.py"]
    files_table = spark.createDataFrame([("r", p) for p in paths_of], "repo_id string, path string")
    keys = {(r.key, r.target) for r in relations.path_index(files_table).collect()}
    assert {("auth/middleware", paths_of[0]), ("src/auth", paths_of[1]), ("auth", paths_of[1]), ("util", paths_of[3])} <= keys
    imports = [("r", "src/app.ts", "./auth", ["login"]), ("r", "src/app.ts", "../lib/util", ["helper", "hidden"]), ("r", "src/app.ts", "react", ["x"]), ("r", "src/auth/index.ts", "@/none/middleware", ["check"])]
    symbols = [
        ("r", "src/auth/index.ts", "s1", "login", "function", 1), ("r", "src/app.ts", "s2", "main", "function", 5), ("r", "src/app.ts", "s3", "login", "variable", 9),
        ("r", "lib/util.py", "s4", "helper", "function", 1), ("r", "lib/util.py", "s5", "hidden", "function", 4), ("r", "src/auth/middleware.ts", "s6", "check", "function", 1),
    ]
    found = relations.build_relations(
        spark.createDataFrame(symbols, "repo_id string, path string, symbol_id string, name string, kind string, start_line int"),
        spark.createDataFrame(imports, "repo_id string, path string, source string, names array<string>"),
        spark.createDataFrame([("r", "lib/util.py", "helper")], "repo_id string, path string, name string"),
        files_table,
    )
    assert sorted((r.src, r.dst) for r in found.collect()) == [("s1", "s6"), ("s2", "s4"), ("s3", "s1")]
