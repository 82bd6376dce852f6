"""What reviewers and the search for design decisions are shown."""

import re

from corpusgraph.operators import reports, search
from corpusgraph.plans import registry, searching  # noqa: F401
from corpusgraph.plans.fixtures import frame

FOLDER = "/root/testdata/sf0.001"


def test_each_role_is_shown_its_own_repository(spark):
    assert len(search.ROLES) == 8
    rows = registry.QUERIES["r37_role_context"](spark, FOLDER).collect()
    chunks = {(r.repo_id, r.file_path): r.content for r in frame(spark, FOLDER, "fx_src_chunks").collect()}
    repos = {repo for repo, _ in chunks}
    assert {(r.repo_id, r.role) for r in rows} == {(repo, role) for repo in repos for role in search.ROLES} and len(rows) == 8 * len(repos)
    shown = 0
    for r in rows:
        heads = re.findall(r"### File: (\S+) \(L(\d+)-L(\d+)\)\n", r.context)
        assert len(heads) <= 12 and len(r.context) <= 32_000 and len({h[0] for h in heads}) == len(heads)
        for path, first, _ in heads:
            assert first == "1" and chunks[r.repo_id, path][:40].split("\n")[0] in r.context
        shown += len(heads)
    assert shown > 20


def test_discovery_shows_one_chunk_of_each_file(spark):
    rows = registry.QUERIES["r38_discovery_context"](spark, FOLDER).collect()
    chunks = {(r.repo_id, r.file_path): r.content for r in frame(spark, FOLDER, "fx_src_chunks").collect()}
    assert rows and len({(r.repo_id, r.file_path) for r in rows}) == len(rows)
    for repo in {r.repo_id for r in rows}:
        assert sorted(r.place for r in rows if r.repo_id == repo) == list(range(1, sum(r.repo_id == repo for r in rows) + 1)) and sum(r.repo_id == repo for r in rows) <= 25
    assert all(r.text == chunks[r.repo_id, r.file_path][:1_500] for r in rows)


def test_bookmarks_are_those_of_a_user_and_found_in_notes(spark):
    rows = [("u", "a.ts", "Login", "see the guard", 1), ("u", "a.ts", "Other", None, 2), ("v", "a.ts", "Guard", None, 3), ("u", "guard.ts", "x", None, 4), ("u", "a.ts", "Newest guard", None, 5)]
    marks = spark.createDataFrame(rows, "user_id string, file_path string, title string, note string, created_at int")
    found = {(r.user_id, r.file_path): (r.n, r.titles) for r in reports.bookmarks_by_file(marks, "GUARD").collect()}
    assert found == {("u", "a.ts"): (2, ["Newest guard", "Login"]), ("v", "a.ts"): (1, ["Guard"]), ("u", "guard.ts"): (1, ["x"])}
