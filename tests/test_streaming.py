"""Streams give the rows of the same job over a table."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusgraph.sources import index
from corpusgraph.streaming import jobs


def test_quota_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("key_prefix"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    limits = rows.select("key_prefix", F.lit(3).alias("most")).distinct()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    writer = jobs.quota_windows(stream, limits).writeStream.outputMode("append").format("memory").queryName("quota")
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = rows.agg(F.max("ts")).first()[0]
    closed = jobs.quota_windows(rows, limits).where(F.col("window_start") < F.lit(newest) - F.expr("INTERVAL 11 MINUTES"))
    got = spark.table("quota")
    assert closed.count() > 0
    assert closed.exceptAll(got).count() == 0
    assert got.exceptAll(jobs.quota_windows(rows, limits)).count() == 0


def source(rng, names, own):
    lines = []
    for other in rng.sample(names, 3):
        lines.append(f"import {{ f{other}, C{other} }} from '{rng.choice(['./', '../src/', '@/src/'])}{other}'")
    base = rng.choice(names)
    lines += [f"export function f{own}(x) {{", "  return x", "}", f"export class C{own} extends C{base} {{", f"  m{rng.randint(0, 9)}() {{ }}", "}"]
    return "\n".join(lines + [f"// {rng.random()}"] * rng.randint(0, 40))


def snapshots():
    """Three states of two repositories: edits, new and deleted files, and renames."""
    rng, names = random.Random(3), [f"n{i}" for i in range(8)]
    state = {(r, f"src/{n}.ts"): source(rng, names, n) for r in "ab" for n in names[:6]}
    yield dict(state)
    for step in range(2):
        for key in rng.sample(sorted(state), 3):
            state[key] = source(rng, names, rng.choice(names))
        old = rng.choice(sorted(state))
        state[old[0], f"src/{names[6 + step]}.ts"] = state.pop(old)
        state[rng.choice("ab"), f"lib/{names[step]}.ts"] = source(rng, names, names[step])
        del state[rng.choice(sorted(state))]
        yield dict(state)


def rows_of(tables):
    some = ("files", "symbols", "chunks", "relations")
    return {name: sorted(map(str, tables[name].select(*sorted(tables[name].columns)).collect())) for name in some}


SOURCE = "repo_id string, path string, content string"


def whole(spark, state):
    files = spark.createDataFrame([(*k, v) for k, v in state.items()], SOURCE)
    tables = index.derived(files)
    return rows_of(tables | {"relations": index.related(tables)})


def test_incremental_index_equals_a_full_rebuild(spark, tmp_path, monkeypatch):
    states = list(snapshots())
    for i, state in enumerate(states):  # batches by the order of their files
        folder = tmp_path / "in" / str(i)
        spark.createDataFrame([(*k, v) for k, v in state.items()], SOURCE).coalesce(1).write.parquet(str(folder))
    store = index.IndexStore(spark, str(tmp_path / "index"))
    kept = []
    for i, state in enumerate(states):
        batch = spark.read.schema(SOURCE).parquet(str(tmp_path / "in" / str(i)))
        if i == 1:  # one that fails between two tables leaves the index as it was
            monkeypatch.setattr(store, "_publish", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.apply(batch, i)
            monkeypatch.undo()
            assert rows_of(store.tables()) == kept[-1]
        assert store.apply(batch, i) and not store.apply(batch, i)
        kept.append(rows_of(store.tables()))
        assert kept[-1] == whole(spark, state)
    assert len(kept[-1]["relations"]) > 10 and len({str(k["relations"]) for k in kept}) == 3
    assert len(store.runs()) == 3
    store.compact()
    assert len(store.runs()) == 1 and rows_of(store.tables()) == kept[-1]


def test_only_what_a_change_reaches_is_made_again(spark):
    files = [("r", "src/a.ts", "export function fa() {\n}"), ("r", "src/b.ts", "import { fa } from './a'\nexport function fb() {\n}"), ("r", "src/c.ts", "import { fb } from './b'\nexport class C extends D {\n}"),
             ("r", "src/d.ts", "export class D {\n}"), ("q", "x.ts", "import { fa } from './a'\nexport function g() {\n}")]
    tables = index.derived(spark.createDataFrame(files, SOURCE))
    tables["relations"] = index.related(tables)
    now = [("r", "src/a.ts", "export function fz() {\n}\nexport function fa() {\n}"), *files[1:4]]
    fresh, gone = index.advance(tables, spark.createDataFrame(now, SOURCE))
    assert [tuple(r) for r in gone["files"].collect()] == [("r", "src/a.ts")]
    assert sorted(r.path for r in gone["relations"].collect()) == ["src/a.ts", "src/b.ts"]
    assert {r.path for r in fresh["symbols"].collect()} == {"src/a.ts"}
    assert [(r.path, r.dst) for r in fresh["relations"].collect()] == [("src/b.ts", "src/a.ts:3:fa")]


def test_index_follows_a_stream(spark, tmp_path):
    first, last = [list(snapshots())[i] for i in (0, 2)]
    store = index.IndexStore(spark, str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SOURCE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, state in (("0", first), ("1", last)):
        spark.createDataFrame([(*k, v) for k, v in state.items()], SOURCE).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        jobs.incremental_index(stream, store, str(tmp_path / "state")).awaitTermination()
        assert rows_of(store.tables()) == whole(spark, state)


def test_quota_decisions_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(6)
    base = datetime(2024, 5, 1, 12)
    events = [(i, base + timedelta(seconds=i // 2 + rng.random() / 4), rng.choice("uv"), rng.choice(["chat", "scan"])) for i in range(400)]
    schema = "event_id long, ts timestamp, user_id string, key_prefix string"
    for i in range(0, 400, 57):
        spark.createDataFrame(events[i : i + 57], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    limits, most = spark.createDataFrame([("chat", 5), ("scan", 12)], "key_prefix string, most int"), {"chat": 5, "scan": 12}
    counts, want = Counter(), []
    for event_id, ts, user, prefix in sorted(events, key=lambda e: (e[1], e[0])):
        at = int(ts.timestamp() * 1_000_000)
        window = at // 60_000_000
        counts[user, prefix, window] += 1
        n = counts[user, prefix, window]
        want.append((event_id, n <= most[prefix], max(0, most[prefix] - n), ((window + 1) * 60_000_000 - at) // 1000))
    plain = lambda df: sorted((r.event_id, r.allowed, r.remaining, r.reset_ms) for r in df.collect())
    table = spark.createDataFrame(events, schema)
    assert plain(jobs.quota_decisions(table, limits)) == sorted(want)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decided = jobs.quota_decisions(stream, limits, late="5 seconds").writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "state"))
    query = decided.trigger(availableNow=True).start()
    query.awaitTermination()
    assert plain(spark.table("decided")) == sorted(want)
    assert len(query.recentProgress) > 3
    # of 4 windows of 4 keys at most the open ones are kept
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 8


def test_progress_counts_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("j", "scan"), ("j", "scan"), ("j", "chunk"), ("k", "scan")], "job_id string, phase string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = jobs.progress_counts(stream).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == [("j", "chunk", 1), ("j", "scan", 2), ("k", "scan", 1)]
