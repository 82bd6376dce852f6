"""Registered queries against brute force on the smallest tables; clashing names, nulls and empty tables through all of them."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import base, bpe, decontam, lines, lm, quality, queries, sharding, suffixes, words

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2_kd_top_k": ["query_id", "rank", "vec_id", "score"],
    "op3_quality_scores": ["doc_id", "held_out", "score", "predicted"],
    "op4_toxicity_scores": ["doc_id", "held_out", "score", "predicted"],
    "op5_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op7_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_repeated_passages": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_hilbert_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_contaminated": ["doc_id", "item_id"],
    "op11_languages": ["doc_id", "held_out", "lang_pred", "score"],
    "op12_whitened": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_lexical_search": ["item_id", "rank", "doc_id", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries_return_their_columns(spark, name):
    out = queries.queries()[name](spark, SMALL)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = out.collect()
    assert rows
    if name not in ("op2_kd_top_k", "op10_contaminated", "op12_whitened", "op13_lexical_search"):
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in base.table(spark, SMALL, "documents").collect())
    if "held_out" in out.columns and name != "op11_languages":
        rest = 1 if name.startswith("op5") else 0
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == rest) for r in rows)
    if "predicted" in out.columns:
        least = 0.3 if name.startswith("op3") else 0.5
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)


def curve_place(x, bits):
    """Place on the Hilbert curve of a cell in any number of dimensions, by undoing the turns of each level."""
    x, n = list(x), len(x)
    for k in range(bits - 1, 0, -1):
        q = 1 << k
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for k in range(bits - 1, 0, -1):
        if x[n - 1] & (1 << k):
            t ^= (1 << k) - 1
    out = 0
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + (((x[i] ^ t) >> k) & 1)
    return out


def test_shards_equal_a_sort_of_all_rows(spark):
    docs = base.table(spark, SMALL, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), F.pmod(F.xxhash64("doc_id", F.crc32(text.cast("binary"))), F.lit(1 << 20)).alias("part")).collect()
    rank = {c: {v: i + 1 for i, v in enumerate(sorted({r[c] for r in rows}))} for c in ("lang", "source")}
    size = {r.doc_id: len(r.text.encode()) + 16 for r in rows}
    code = lambda n: min(int(np.floor(np.log2(n + 1) * 2)) + 1, 31)
    order = sorted(rows, key=lambda r: (curve_place([rank["lang"][r.lang], rank["source"][r.source], code(size[r.doc_id])], 5), r.part, r.doc_id))
    low, more = divmod(len(rows), 40)
    want, at = {}, 0
    for s in range(40):
        for slot in range(low + (s < more)):
            want[order[at].doc_id] = (s, slot)
            at += 1
    got = {r.doc_id: r for r in queries.queries()["op9_hilbert_shards"](spark, SMALL).collect()}
    assert {i: (r.shard, r.slot) for i, r in got.items()} == want
    assert all((r.size, r.law, r.grown_shard) == (size[i], "rows", None) for i, r in got.items())
    assert all(got[r.doc_id].text_crc32 == zlib.crc32(r.text.encode()) for r in rows)


def test_many_texts_are_coded_by_ranges_of_their_order(spark):
    df = spark.range(2000).select(F.format_string("v%05d", (F.col("id") * 7919) % 2000).alias("v"))
    rows = df.select("v", sharding.quantised(df, "v", 5).alias("c")).orderBy("v").collect()
    codes = [r.c for r in rows]
    assert codes == sorted(codes) and set(codes) == set(range(1, 32)) and max(Counter(codes).values()) < 4 * 2000 / 31


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = base.table(spark, SMALL, "documents").limit(60)
    model = lm.fit_language_model(docs.select("text"), bits_per_entry=80)
    (part,) = model.parts(1 << 30)
    counts = model.counts.toPandas()
    keys = counts["key"].to_numpy().view(np.uint64)
    share = (lm.value_of(part.read(lm.unigram_keys(keys), 1)) + 0.5) / (model.filter_tokens + 0.5 * (model.distinct + 1))
    for i in np.argsort(-counts["n"].to_numpy())[:40]:
        two = part.read(lm.bigram_keys(np.full(len(keys), keys[i]), keys), model.lowest_pair)
        value = np.where(two > 0, lm.value_of(two) - model.discount, 0.0)
        kept, times = np.full(len(keys), counts["t"][i]), np.full(len(keys), float(counts["n"][i]))
        known = lm.pair_probability(value, share, kept, times).sum()
        unknown = lm.pair_probability(np.zeros(1), np.array([0.5 / (model.filter_tokens + 0.5 * (model.distinct + 1))]), kept[:1], times[:1])[0]
        assert abs(known + unknown - 1) < 1e-6


def test_pair_counts_are_exact(spark):
    docs = base.table(spark, SMALL, "documents").select("text")
    want = Counter()
    for r in docs.collect():
        own = [b"\n", *(r.text or "").encode().lower().split(), b"\n"]
        want.update(zip(own, own[1:], strict=False))
    for least in (1, 2):
        got = lm.count_pairs(docs, min_count=least, segment_keys=5000).toPandas()
        assert sorted(got["n"]) == sorted(n for n in want.values() if n >= least)


def passages_by_force(rows, n=51):
    holders = defaultdict(set)
    own = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        own[i] = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        for x in own[i]:
            holders[x].add(i)
    return {i: sum(len(holders[x]) > 1 for x in xs) for i, xs in own.items()}


def removed_by_force(rows, n=400):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = {}
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in base.table(spark, SMALL, "documents").collect()]
    got = queries.queries()["op8_repeated_passages"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_by_force(rows)
    assert {r.doc_id: r.n_passages for r in got} == passages_by_force(rows)


def test_passages_of_equal_rows_and_edges(spark):
    own = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(own)), (1, " ".join(own)), (2, "x " + " ".join(own[10:75]) + " y"), (3, None), (4, ""), (5, " ".join(own[:50])),
            (6, " ".join(["again"] * 60)), (None, "z " + " ".join(own[20:80]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = {x.r: x.n for x in suffixes.shared_passages(docs).collect()}
    keys = {x.doc_id: x.r for x in docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("r")).collect()}
    assert {i: r.get(k, 0) for i, k in keys.items()} == {1: 20, 2: 15, 3: 0, 4: 0, 5: 0, 6: 0, None: 10}
    assert suffixes.shared_passages(docs.where("false")).count() == 0


def best_alignments(docs, items):
    """Every pair of a document and an item with at least half of the highest score, by aligning each item with each whole text."""
    found = set()
    tokens = lambda t: words.word_hashes(*words.text_bytes(pa.array([t])), words.LOOSE)[0]
    for item_id, item in items:
        own = tokens(item or "")
        if not len(own):
            continue
        for doc_id, text in docs:
            whole = tokens(text or "")
            if len(whole) and decontam.align(own[None], whole[None])[0][0] >= 0.5 * decontam.MATCH * len(own):
                found.add((doc_id, item_id))
    return found


def test_contaminated_query_equals_all_alignments(spark):
    docs = [(r.doc_id, r.text) for r in base.table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in base.table(spark, SMALL, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op10_contaminated"](spark, SMALL).collect()}
    assert got and got == best_alignments(docs, items)


def test_quality_weights_equal_one_plain_system(spark):
    docs = base.table(spark, SMALL, "documents")
    labels = quality.training_labels(base.table(spark, SMALL, "labels"), "quality")
    stats = base.kept_table(quality.with_statistics(docs)).repartition(7)
    model = quality.fit_quality(stats, labels)
    rows = stats.join(labels.groupBy("doc_id").agg(F.avg("label").alias("label")), "doc_id").toPandas()
    x, y = np.stack(rows["stats"].to_numpy()), rows["label"].to_numpy()
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = model.features(x)
    plain = np.linalg.solve(z.T @ z + 1e-4 * len(x) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ plain, z @ model.weights, atol=1e-6)


ODD = "doc_id long, text string, lang string, `a.b` string, n_lines int, n_dropped int, __doc string, score double, ids int, decoded string, shard int, slot int, cell long, row string, n int"


def odd_docs(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, "en", f"x{i}", 7, 8, "KEEP", 0.25, 9, "d", 5, 6, 77, "R", 3) for i, t in enumerate(
        [long, long, "one repeated line here\nsecond", "one repeated line here\nthird", None, "", "a", "y" * 20_000 + " " + long])]
    return spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)] * 2, ODD)


def test_columns_of_any_name_are_kept(spark):
    docs = odd_docs(spark)
    plain = [base.quoted(c) for c in docs.columns if c != "text"]
    want = sorted(map(str, docs.select(*plain).collect()))

    def same(out, new):
        assert out.columns == [*docs.columns, *new]
        assert sorted(map(str, out.select(*plain).collect())) == want

    same(lines.dedup_lines(docs), ["n_lines_1", "n_dropped_1"])
    same(sharding.hilbert_shards(docs, ["a.b", "lang", "score"], ["doc_id", "a.b"], shards=3), ["shard_1", "slot_1"])
    model = quality.fit_quality(quality.with_statistics(docs), spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, label int"))
    same(quality.score_documents(docs, model), ["score_1"])
    same(bpe.encode_documents(docs, bpe.tokenizer_path()), ["ids_1"])
    same(decontam.clean_documents(docs, spark.createDataFrame([(1, "not here at all")], "item_id long, text string")), [])


def test_pipeline_with_odd_columns_and_nothing(spark):
    for docs in (odd_docs(spark), odd_docs(spark).where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = base.kept_table(stage(spark, docs, SMALL))
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    from test_pairs_and_passages import near_by_force

    docs = base.table(spark, SMALL, "documents")
    good = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, SMALL).orderBy("doc_id").collect()]
    scores = {r.doc_id: r.predicted for r in queries.queries()["op3_quality_scores"](spark, SMALL).collect()}
    assert [i for i, _ in good] == sorted(i for i, p in scores.items() if p == 1)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for i, text in good:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    lost = lambda i, k: len(holders.get(k, ())) > 1 and min(holders[k]) != i
    clean = [(i, "\n".join(x for x in text.split("\n") if not lost(i, key(x)))) for i, text in good]
    near = near_by_force(clean)
    kept = [(i, t) for i, t in clean if near[i][2]]
    items = [(r.item_id, r.text) for r in base.table(spark, SMALL, "benchmark").collect()]
    leaked = {i for i, _ in best_alignments(kept, items)}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = {}
    for i, t in kept:
        if i not in leaked:
            ids = library.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
