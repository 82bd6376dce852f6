"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, failures are merged exactly.

A token sequence is the BPE result of its bytes if every token is the BPE result of its own bytes and no
two neighbours would have merged across their border while they were being built. The second is
a property of pairs: for a piece x on the right edge of the left token and a piece y on the left edge of
the right one, the merge (x, y) must not come before both pieces have been merged on. So words are cut by
longest match first; all distinct neighbouring pairs of a batch are checked at once, against a table that
is kept; only the words with a failing pair are merged step by step, many words at a time.

The tokenizer file is a parameter (a `tokenizers` JSON of a byte-level BPE without normalizer whose ids
are 256 + rank of the merge). Its text goes to the workers as a broadcast: a fixed few MB.

Defined results: a null text is the empty text, with no tokens; special tokens in a text are one id each, as
the library does by default; texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free_name, map_rows, table, tidied, with_field

_NEVER = np.int64(1 << 40)
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: bytes without a glyph follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SpeculativeBpe:
    #: Words whose encoding is kept; beyond it the store starts anew.
    KEEP_WORDS = 400_000
    #: Longer words are merged with a heap instead of in arrays.
    LONG_WORD = 256

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer is needed")
        chars = _byte_of_char()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *self.specials.values())
        self.bytes = [b""] * self.size
        for text, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in text)
        for text, i in self.specials.items():
            self.bytes[i] = text.encode()
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        keys = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab[(pair.replace(" ", "", 1) if isinstance(pair, str) else "".join(pair))]
            if made != 256 + rank:
                raise ValueError("ids must be 256 + rank of the merge")
            self.left[made], self.right[made] = a, b
            keys.append(a * self.size + b)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys, range(len(keys)), strict=True))
        self.byte_id = np.zeros(256, np.int64)
        for i in range(256):
            self.byte_id[self.bytes[i][0]] = i
        self._edges()
        own = (self.left >= 0).nonzero()[0]
        ok = self._fits(self.left[own], self.right[own], own - 256)
        self.sound = np.ones(self.size, bool)
        self.sound[own] = ok
        for i in own:  # by id: parts come before what they make
            self.sound[i] = self.sound[i] and self.sound[self.left[i]] and self.sound[self.right[i]]
        self.matcher = ahocorasick.Automaton()
        for i in range(len(vocab)):
            self.matcher.add_word(self.bytes[i].decode("latin-1"), i)
        self.matcher.make_automaton()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.words: dict[str, bytes] = {}
        self.good_pairs = self.bad_pairs = np.zeros(0, np.int64)
        self.find = regex.compile(_PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else None

    def _edges(self) -> None:
        """Each token's pieces along its left and its right edge, and the rank at which each is merged on."""
        pieces: dict[str, list] = {}
        for side, part in (("left", self.left), ("right", self.right)):
            now, until, found = np.arange(self.size), np.full(self.size, _NEVER), []
            while (now >= 0).any():
                found.append((now.copy(), until.copy()))
                until = np.where(now >= 256, now - 256, _NEVER)
                now = np.where(now >= 0, part[now], -1)
            pieces[side] = found
        self.left_edge, self.right_edge = pieces["left"], pieces["right"]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def _fits(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of a and b (until: before the rank at which they are merged themselves)."""
        ok = np.ones(len(a), bool)
        for i, (x, x_end) in enumerate(self.right_edge):
            xs = x[a]
            if not (xs >= 0).any():
                break
            x_until = x_end[a] if i or until is None else until
            for j, (y, y_end) in enumerate(self.left_edge):
                ys = y[b]
                both = (xs >= 0) & (ys >= 0) & ok
                if not both.any():
                    break
                y_until = y_end[b] if j or until is None else until
                at = np.flatnonzero(both)
                r = self._ranks(xs[at], ys[at])
                crossing = (r < x_until[at]) & ((r < y_until[at]) | ((r == y_until[at]) & (j > 0)))
                ok[at[crossing & (r < _NEVER)]] = False
        return ok

    def _checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each neighbouring pair fits; verdicts on distinct pairs are kept."""
        keys = a * self.size + b
        new = np.setdiff1d(keys, np.concatenate([self.good_pairs, self.bad_pairs]))
        if len(new):
            fits = self._fits(new // self.size, new % self.size)
            if len(self.good_pairs) + len(self.bad_pairs) > 4_000_000:
                self.good_pairs = self.bad_pairs = np.zeros(0, np.int64)
                return self._checked(a, b)
            self.good_pairs = np.union1d(self.good_pairs, new[fits])
            self.bad_pairs = np.union1d(self.bad_pairs, new[~fits])
        if not len(self.bad_pairs):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.bad_pairs, keys), len(self.bad_pairs) - 1)
        return self.bad_pairs[at] != keys

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian uint32, of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        longest = self.matcher.iter_long
        proposed = [[i for _, i in longest(b.decode("latin-1"))] for b in raw]
        counts = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        word = np.repeat(np.arange(len(words)), counts)
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.sound[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            wrong[word[inner[~self._checked(flat[inner], flat[inner + 1])]]] = True
        covered = np.bincount(word, self.lengths[flat], len(words)).astype(np.int64)
        wrong |= covered != np.array([len(b) for b in raw], np.int64)
        small = flat.astype("<u4").tobytes()
        out = [small[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        for i, ids in self._merge_exactly([(i, raw[i]) for i in np.flatnonzero(wrong).tolist()]):
            out[i] = ids
        return out

    def _merge_exactly(self, words: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i, b in words:
            if len(b) > self.LONG_WORD:
                yield i, self._merge_long(b)
            else:
                by_length.setdefault(len(b), []).append((i, b))
        for n, some in by_length.items():
            at = np.array([i for i, _ in some])
            ids = self.byte_id[np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(len(some), n)]
            while len(at):
                ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(at), 1), _NEVER)
                where = ranks.argmin(axis=1)
                best = ranks[np.arange(len(at)), where]
                done = best == _NEVER
                for i, row in zip(at[done].tolist(), ids[done].astype("<u4"), strict=True):
                    yield i, row.tobytes()
                at, ids, where, best = at[~done], ids[~done], where[~done], best[~done]
                ids[np.arange(len(at)), where] = best + 256
                keep = np.ones(ids.shape, bool)
                keep[np.arange(len(at)), where + 1] = False
                ids = ids[keep].reshape(len(at), ids.shape[1] - 1)

    def _merge_long(self, raw: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n, rank_of, size = len(ids), self.rank_of, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank_of.get(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = 256 + r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank_of.get(ids[i] * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank_of.get(ids[before[i]] * size + ids[i])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids, as little-endian uint32, of each text."""
        cut: list[list[str | int]] = []
        new: set[str] = set()
        for text in texts:
            parts: list = []
            for k, part in enumerate(self.split(text or "") if self.split else [text or ""]):
                if k % 2:
                    parts.append(self.specials[part])
                elif part:
                    words = self.find(part)
                    new.update(words)
                    parts.append(words)
            cut.append(parts)
        if len(self.words) > self.KEEP_WORDS:
            self.words.clear()
        todo = [w for w in new if w not in self.words]
        for k in range(0, len(todo), 50_000):
            some = todo[k : k + 50_000]
            self.words.update(zip(some, self.encode_words(some), strict=True))
        get = self.words.__getitem__
        return [
            b"".join(b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in parts) for parts in cut
        ]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes that the ids stand for (ids outside the vocabulary stand for nothing)."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        tokens = tokens[tokens < self.size]
        if not len(tokens):
            return b""
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.starts[tokens] - (ends - n), n) + np.arange(ends[-1])].tobytes()


_made: dict[int, SpeculativeBpe] = {}


def _bpe(shared: Broadcast) -> SpeculativeBpe:
    """One encoder for each worker process and tokenizer."""
    key = hash(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = SpeculativeBpe(shared.value)
    return _made[key]


def _shared(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as file:  # the tokenizer's file is the driver's, by its path
        return spark.sparkContext.broadcast(file.read())


def _texts(batch: pa.RecordBatch, at: int, limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about `limit` bytes of text each."""
    sizes = np.array([len(x) if x else 0 for x in batch.column(at).to_pylist()], np.int64)
    first = 0
    ends = np.cumsum(sizes)
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        part = batch.slice(first, last - first)
        yield part, part.column(at).to_pylist()
        first = last


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text, as little-endian uint32 in a last, binary column; called ids_1 and so on if docs has one."""
    names, ids = docs.columns, free_name(docs.columns, ids)
    shared, at = _shared(docs.sparkSession, path), names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, at):
                made = pa.array(_bpe(shared).encode(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*names, ids])

    return map_rows(docs, work, with_field(docs.schema, ids, "binary"))


def decode_documents(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of each ids as last column; invalid UTF-8 becomes U+FFFD. The column is called decoded_1 and so on if docs has one."""
    names, text = docs.columns, free_name(docs.columns, text)
    shared, at = _shared(docs.sparkSession, path), names.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = _bpe(shared)
            made = [bpe.decode(x or b"").decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*names, text])

    return map_rows(docs, work, with_field(docs.schema, text, "string"))


def round_trip_digests(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded again in one pass; the ids too if asked for."""
    shared = _shared(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, 1):
                bpe = _bpe(shared)
                ids = bpe.encode(texts)
                back = [bpe.decode(x).decode("utf-8", "replace").encode() for x in ids]
                made = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                }
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_pydict(made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(tidied(work), schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())
