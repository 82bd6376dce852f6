"""Classifiers, language model, BPE, decontamination, sharding and the pipeline: brute force, round trips, accuracy, edge rows."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import base, bpe, decontam, lm, quality, sharding, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double"
EDGES = [(9001, None, None, None), (9002, "", None, None), (9003, "  \n\n", None, None), (9004, "a " * 60_000, None, None), (None, "x y z", None, None), (9005, "x y z", None, None)]


def heldout(i):
    return zlib.crc32(str(i).encode()) % 5


def accuracy(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return sum(a == b for a, b in held) / len(held)


def test_quality_on_held_out_rows(spark):
    rows = quality.op3_quality_scores(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "quality") > 0.97


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame(EDGES, DOCS)
    stats = quality.with_statistics(docs)
    labels = spark.createDataFrame([(9001, 0), (9004, 1), (9004, None), (9005, 7)], "doc_id long, label int")
    model = quality.fit_quality(stats, labels)
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(stats, model).collect())
    none = quality.fit_quality(stats, labels.where("false"))
    assert {round(r.score, 3) for r in quality.quality_scores(stats, none).collect()} == {0.5}
    assert quality.with_statistics(docs.where("false")).count() == 0


def test_toxicity_learns_marked_words(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zzwretch", "qqvermin", "xxrotter"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows] + EDGES, DOCS)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if heldout(i)], "doc_id long, label int")
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(scores[i] >= 0.5) == bool(x) for i, _, x in rows if not heldout(i)]
    assert sum(held) / len(held) > 0.95
    assert toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels.where("false"))).where("score <> 0").count() == 0


def test_language_model_base_is_exact_and_parts_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, DOCS).select("doc_id", "text"))
    train = docs.where(~base.held_out(F.col("doc_id"), 1)).select("text")
    model = lm.fit_language_model(train, contexts=50, bits_per_entry=60)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    counts = Counter(w for i, own in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in own)
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.distinct) == (n, v)
    want = sorted((str(i), len(own), sum(w in counts for w in own), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 4)) for i, own in rows)
    scored = lm.score_texts(docs, model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in scored) == want
    assert all(r.score < 0 for r in scored)
    parts = lm.score_texts(docs, model, broadcast_bytes=1 << 16).collect()  # one segment a pass
    assert model.segments > 1
    assert sorted(round(r.score, 6) for r in parts) == sorted(round(r.score, 6) for r in scored)


def test_filter_holds_all_levels():
    keys = np.arange(1, 2000, dtype=np.uint64)
    levels = 1 + (np.arange(len(keys)) % 5)
    bits = np.zeros(lm._SEGMENT_BITS, bool)
    for level in range(1, 6):
        bits[lm._bits(keys[levels >= level], level).ravel()] = True
    part = lm.FilterPart(1, 0, np.packbits(bits, bitorder="little")[None, :])
    assert (part.read(keys, 1) >= levels).all()
    assert (part.read(keys + np.uint64(10**6), 1) > 0).mean() < 0.01


def test_filter_makes_only_the_places_it_looks_at():
    keys = np.random.default_rng(5).integers(0, 2**63, 60_000).astype(np.uint64)
    bits = np.zeros((3, lm._SEGMENT_BITS), bool)
    segment, levels = lm.segment_of(keys, 3), 1 + np.arange(len(keys)) % 4
    for level in range(1, 5):
        own = levels >= level
        bits[segment[own, None], lm._bits(keys[own], level)] = True
    part = lm.FilterPart(3, 0, np.packbits(bits, axis=1, bitorder="little"))
    asked = np.concatenate([keys, keys + np.uint64(1)])
    want, here = np.zeros(len(asked), np.int64), lm.segment_of(asked, 3)[:, None]
    for level in range(1, 30):
        want[(want == level - 1) & bits[here, lm._bits(asked, level)].all(1)] = level
    assert (want[: len(keys)] >= levels).all()
    tracemalloc.start()
    found = part.read(asked, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == want).all()
    assert peak < 100 * len(asked)  # all places of all keys take 96 bytes a key more


def test_frequent_words_are_not_read_again_for_each_text():
    words = np.arange(1, 400, dtype=np.uint64)
    frequent = lm.Frequent(words[:300], np.ones(300, np.int64), np.zeros(300))
    asked = []

    class Part(lm.FilterPart):
        def read(self, keys, lowest):
            asked.append((lowest, set(keys.tolist())))
            return (keys % np.uint64(7)).astype(np.int64)

    part = Part(1, 0, np.zeros((1, lm._SEGMENT_BITS // 8), np.uint8))
    stored = frequent.levels(part)
    asked.clear()
    tokens = np.concatenate([words, words[::-1]])
    first = np.arange(len(tokens)) % 50 == 0
    one, two = lm.read_tokens(part, 2, tokens, first, frequent.find(tokens), stored)
    assert (one == lm.unigram_keys(tokens) % np.uint64(7)).all() and (two == lm.bigram_keys(lm.before(tokens, first), tokens) % np.uint64(7)).all()
    assert [keys for lowest, keys in asked if lowest == 1] == [set(lm.unigram_keys(words[300:]).tolist())]


def test_parts_of_the_filter_read_only_their_own_keys():
    rng = np.random.default_rng(6)
    words, segments = rng.integers(0, 2**63, 3000).astype(np.uint64), 8
    tokens = words[(rng.random(20_000) ** 3 * len(words)).astype(int)]
    first = np.arange(len(tokens)) % 40 == 0
    keys = np.concatenate([lm.unigram_keys(words), lm.bigram_keys(lm.before(tokens, first), tokens)[::2]])
    bits = np.zeros((segments, lm._SEGMENT_BITS), bool)
    for level in (1, 2, 3):
        bits[lm.segment_of(keys, segments)[:, None], lm._bits(keys, level)] = True
    packed = np.packbits(bits, axis=1, bitorder="little")
    frequent = lm.Frequent(np.sort(words[:200]), np.ones(200, np.int64), np.zeros(200))
    asked = []

    class Part(lm.FilterPart):
        def read(self, keys, lowest):
            asked.append(len(keys))
            return super().read(keys, lowest)

    whole, total = Part(segments, 0, packed), np.zeros((len(tokens), 2), np.uint8)
    want = np.stack(lm.read_tokens(whole, 2, tokens, first, frequent.find(tokens), frequent.levels(whole)), 1)
    assert (want[:, 0] == 3).all() and 0.5 <= (want[:, 1] == 3).mean() < 1
    for k in range(segments):
        part = Part(segments, k, packed[k : k + 1])
        stored = frequent.levels(part)
        asked.clear()
        total = np.maximum(total, lm.read_own_tokens(part, 2, tokens, first, frequent, stored))
        assert sum(asked) < len(tokens) / 4
    assert (total == want).all()


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit_language_model(none.select("text"))
    scored = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (scored.n_tokens, scored.n_known) == (3, 0)
    assert lm.score_texts(none, model).count() == 0


def odd_texts():
    rng = random.Random(1)
    fixed = ["", "aaaaaaa" * 30, "  \n\n  x\t\ty  ", "<|endoftext|> hi<|endoftext|>", "don't we'll I'M 12345 ½ 日本語 🎉🎉 \x1c \x85 \xa0  x", "x" * 3000, "ab" * 700, " " * 500]
    return fixed + ["".join(rng.choice("ab c\n'sé1!日 ") for _ in range(rng.randint(0, 80))) for _ in range(1500)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    with open(path, encoding="utf-8") as file:
        own = bpe.SpeculativeBpe(file.read())
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:80]
        assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False) == text


def test_bpe_documents(spark):
    docs = spark.createDataFrame(EDGES, DOCS)
    both = bpe.decode_documents(bpe.encode_documents(docs, bpe.tokenizer_path()), bpe.tokenizer_path())
    assert both.columns == ["doc_id", "text", "lang", "score", "ids", "decoded"]
    assert both.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs, bpe.tokenizer_path()).collect()}
    assert (rows[9001].n_tokens, rows[9001].ids_sha256, rows[9001].decoded_sha256) == (0, empty, empty)


def align_by_force(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.integers(2, 6, (80, 12)).astype(np.uint64), rng.integers(2, 6, (80, 30)).astype(np.uint64)
    assert decontam.align(a, b)[0].tolist() == [align_by_force(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_contamination_finds_copies_and_edits(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrs") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(20, None), (21, ""), (22, "tiny")]
    rows, want = [], set()
    for i in range(200):
        own = [word() for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            k = rng.randrange(20)
            passage = items[k][1].split()
            for _ in range(rng.choice([0, 3, 6])):
                passage[rng.randrange(30)] = word()
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + "," for w in passage]
            want.add((i, k))
        rows.append((i, " ".join(own), "en", 0.5))
    docs = spark.createDataFrame(rows + EDGES, DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    in_blocks = decontam.contaminated(docs, benchmark, block_words=100)
    assert {(r.doc_id, r.item_id) for r in in_blocks.collect()} == want
    clean = decontam.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows + EDGES if (r[0], 0) not in {(i, 0) for i, _ in want})
    assert decontam.contaminated(docs, benchmark.where("false")).count() == 0


def hilbert_by_force(x, bits):
    """Place of a point by walking down the levels of the plane curve (two dimensions)."""
    a, b, place = x[0], x[1], 0
    for k in range(bits - 1, -1, -1):
        p, q = (a >> k) & 1, (b >> k) & 1
        place = place * 4 + ((3 * p) ^ q)
        if not q:
            if p:
                a, b = (1 << bits) - 1 - a, (1 << bits) - 1 - b
            a, b = b, a
    return place


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours(spark, dimensions, bits):
    code = F.array(*(F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int") for i in range(dimensions)))
    rows = spark.range(1 << (dimensions * bits)).select(code.alias("c"), sharding.hilbert_index(code, dimensions, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(p - q) for p, q in zip(a.c, b.c, strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_edge_rows(spark):
    rows = [(i % 37, "s" if i % 3 else None, float(i), "x") for i in range(500)] + [(None, None, None, None), (1, "s", float("nan"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size double, cell string")
    out = sharding.hilbert_shards(df, ["source", "size"], ["doc_id"], shards=7).collect()
    sizes = Counter(r.shard for r in out)
    assert sum(sizes.values()) == 502 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.hilbert_shards(df.where("false"), ["source", "size"], ["doc_id"]).count() == 0
    few = sharding.hilbert_shards(df.limit(3), ["source", "size"], ["doc_id"]).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_pipeline_stages_take_effect(spark):
    docs = base.table(spark, SMALL, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = base.kept_table(stage(spark, docs, SMALL))
        assert after.columns == docs.columns
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs, counts = after, [*counts, after.count()]
    assert counts[1] < counts[0] and sorted(counts, reverse=True) == counts
    out = corpus_pipeline.run(spark, SMALL)
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out.select("doc_id", "decoded_sha256").collect()} == want
