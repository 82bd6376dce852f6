"""Traversal from every node at once, on graphs with hubs, against a plain search."""

import random

import pytest

from corpusgraph.operators import traverse


@pytest.mark.parametrize("direction", ["in", "out"])
def test_every_node_reaches_what_a_plain_search_reaches(spark, direction):
    rng = random.Random(12)
    edges = {("r", f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}", "calls") for _ in range(120)} | {("r", "hub", f"n{i}", "uses") for i in range(40)} | {("q", "n1", "n2", "calls"), ("q", "n2", "n1", "calls")}
    edges |= {("r", f"n{i}", "hub", "calls") for i in range(20, 40)} | {("r", "x", "x", "calls")}
    relations = spark.createDataFrame(sorted(edges), "repo_id string, src string, dst string, relation_type string")
    for depth in (1, 2, 3):
        want = set()
        for repo in ("r", "q"):
            next_of = {}
            for e in edges:
                if e[0] == repo:
                    a, b = (e[2], e[1]) if direction == "in" else (e[1], e[2])
                    next_of.setdefault(a, set()).add(b)
                    next_of.setdefault(b, set())
            for source in next_of:
                seen, front = {source}, {source}
                for d in range(1, depth + 1):
                    front = {b for a in front for b in next_of[a]} - seen
                    seen |= front
                    want |= {(repo, source, b, d) for b in front}
        got = [tuple(r) for r in traverse.reach_all(relations, max_depth=depth, direction=direction).collect()]
        assert len(got) == len(want) and set(got) == want
    assert traverse.reach_all(relations.where("false")).collect() == []
