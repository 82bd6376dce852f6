"""Near duplicates, top-k, line dedup, repeated passages, against brute force; edge rows of all of them."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import lines, neardup, suffixes, topk

DOCS = "doc_id long, text string, lang string, score double"


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_by_force(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(rows), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(s), low[find(k)], low[find(k)] == i) for k, (i, s) in enumerate(rows)}


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "x " * 30_000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_components(docs).collect()}
    assert got == near_by_force(rows)


def test_near_duplicates_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", None, None), (4, "a b c d e f", None, None), (4, "a b c d e f", None, None), (2, "z", None, None)], DOCS)
    got = sorted(map(tuple, neardup.near_components(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, None, False), (4, 4, True), (4, 4, True), (2, 2, True)], key=str)
    assert neardup.near_components(docs.where("false")).count() == 0


def test_signature_pigeonhole():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**16, (1, neardup.HASHES)).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(neardup.HASHES, 17, replace=False)
        b[0, wrong] ^= np.uint16(1)
        assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 8)).round(2)
    points[40:80] = points[40]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, []), (1200, [1.0, 2.0]), (None, [1.0] * 8), (50, rows[50][1])]
    vectors = topk.quantised_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5, shard_rows=60, block=3)
    q = np.floor(256 * points).astype(int)
    want = []
    for i in range(0, 300, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def line_rows():
    shared, short = "This line is shared widely", "short"
    return [
        (3, f"{shared}\nown three\n  {shared.upper()} \n{short}"), (1, f"{short}\n{shared}\nalpha line one"), (2, None), (5, ""), (7, f"alpha LINE one\t\n{shared}"),
        (8, "é" * 9 + "\n" + "é" * 10), (9, "é" * 9 + "\n" + "é" * 10), (10, "only once here\nonly once here"),
    ]


def clean(rows):
    docs = {i: (t or "").split("\n") for i, t in rows}
    holders = {}
    for i, own in docs.items():
        for x in own:
            k = lines.key_of(x)
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, own in docs.items():
        kept = [x for x in own if not (len(holders.get(lines.key_of(x), ())) > 1 and min(holders[lines.key_of(x)]) != i)]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_and_its_undoing(spark):
    rows = line_rows()
    make = lambda some: spark.createDataFrame([(i, t, "en", 1.0) for i, t in some], DOCS)
    read = lambda df: {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in df.collect()}
    assert read(lines.dedup_lines(make(rows))) == clean(rows)
    index = lines.line_index(make(rows), batches=3)
    gone = [1, 9]
    left = [r for r in rows if r[0] not in gone]
    after = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert read(lines.drop_lines(make(left), after.drops())) == clean(left)
    again = after.insert(lines.line_references(make([r for r in rows if r[0] in gone])))
    assert read(lines.drop_lines(make(rows), again.drops())) == clean(rows)
    keys = lines.line_references(make(left)).select("key").distinct()
    assert after.known(keys).count() == keys.count()
    assert lines.dedup_lines(make([])).count() == 0


def test_line_counts_come_through_the_filters(spark, monkeypatch):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in rows], DOCS)
    references = lines.line_references(docs).distinct().collect()
    holders = {}
    for r in references:
        holders.setdefault(bytes(r.key), set()).add(r.doc_id)
    want = {(k, len(own), min(own)) for k, own in holders.items()}
    read = lambda index: {(bytes(r.key), r.n_docs, r.owner) for r in index.counts.collect()}
    assert read(lines.line_index(docs, batches=3)) == want
    # filters that know nothing let known keys in as new ones
    monkeypatch.setattr(lines.LineIndex, "maybe_known", lambda self, keys: keys.where("false"))
    assert read(lines.line_index(docs, batches=3)) != want


def test_line_dedup_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(connection.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.OP6_SQL})").fetchall())
    assert sorted(map(tuple, lines.op6_line_dedup(spark, "/root/testdata/sf0.001").collect())) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    cuckoo = lines.CuckooFilter.sized_for(len(keys))
    assert cuckoo.insert(keys)
    assert cuckoo.contains(keys).all()
    cuckoo.delete(keys[:2500])
    assert cuckoo.contains(keys[2500:]).all()
    assert cuckoo.contains(keys[:2500]).mean() < 0.02


def passages_by_force(rows, length):
    count = {}
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_passages_equal_brute_force(spark, hot):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, rows = [text(150), text(260)], []
    for i in range(30):
        a, b = rng.choice(shared), rng.choice(shared)
        cut = rng.randrange(80)
        rows.append((i, text(rng.randrange(60)) + a[cut:] + text(rng.randrange(90)) + b[: len(b) - cut]))
    rows += [(40, None), (41, ""), (42, "xy" * 300), (43, "short"), (44, rows[3][1]), (44, rows[4][1]), (None, rows[5][1]), (45, text(3000)), (46, "a" * 99)]
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in rows], DOCS)
    out = suffixes.cut_spans(docs, suffixes.repeated_spans(docs, length=100, batches=3, hot=hot))
    got = [tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=str) == passages_by_force(rows, 100)
    none = docs.where("false")
    assert suffixes.cut_spans(none, suffixes.repeated_spans(none)).count() == 0
