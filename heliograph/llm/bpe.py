"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern; each distinct match is encoded once per batch (and kept in a bounded
cache of the worker). Within a match, the leaves of a segment tree are its byte positions: leaf i holds the rank of
the pair that begins at i, if i begins a part; an inner node the smallest (rank, position) below it. The root names
the leftmost pair of the smallest rank. A merge joins it with its right neighbour, kept in linked lists, and updates
the leaves of the two pairs that changed and of the one that vanished, each a logarithmic walk.

Matches of at most BATCHED bytes run through the same trees many at a time, as NumPy arrays of one row per match;
longer ones, of any length, through the scalar tree, in O(n log n).

Vocabulary: the file of ranks is read once per Python worker. Decoding joins the bytes of the ids.
Defined cases: null is the empty text: no ids. Lone surrogates can't occur in Spark strings. Rows are independent,
so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import common as C

BATCHED = 64
CACHE = 300_000
_NONE = 1 << 40


class Tree:
    """Leftmost minimum of (rank, position) over one match, by point updates."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.least = [(_NONE, 0)] * self.size + [(r, i) for i, r in enumerate(ranks)] + [(_NONE, 0)] * (self.size - len(ranks))
        for i in range(self.size - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def set(self, i: int, rank: int) -> None:
        least, at = self.least, i + self.size
        least[at] = (rank, i)
        at >>= 1
        while at:
            new = min(least[2 * at], least[2 * at + 1])
            if least[at] == new:
                return
            least[at] = new
            at >>= 1


class Encoder:
    """Ranks of a vocabulary file (a line: base64 of the token's bytes, its rank), and the pattern that splits text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}  # (left id, right id) as one number -> id of both together
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Every pair of tokens whose bytes together are a token.
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        self.bits = max(1, int(len(keys) * 4 - 1)).bit_length()
        self.slot_keys = np.full(1 << self.bits, -1, np.int64)
        self.slot_values = np.full(1 << self.bits, _NONE, np.int64)
        at = self._slot(keys)
        while len(keys):  # open addressing, all keys of a round at once
            free = self.slot_keys[at] < 0
            self.slot_keys[at[free]] = keys[free]
            mine = self.slot_keys[at] == keys
            self.slot_values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or _NONE (also where right is below 0)."""
        keys = left << 20 | np.maximum(right, 0)
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        open_ = np.flatnonzero(right >= 0)
        while len(open_):
            k = self.slot_keys[at[open_]]
            hit = k == keys[open_]
            out[open_[hit]] = self.slot_values[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def one(self, data: bytes) -> list[int]:
        """The ids of one match."""
        if data in self.ranks:
            return [self.ranks[data]]
        n = len(data)
        ids = [int(self.byte_ids[b]) for b in data]
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        rank = lambda i: self.pairs.get(ids[i] << 20 | ids[after[i]], _NONE) if after[i] >= 0 else _NONE
        tree = Tree([rank(i) for i in range(n)])
        while tree.least[1][0] < _NONE:
            r, i = tree.least[1]
            j = after[i]
            ids[i] = r
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            ids[j] = -1
            tree.set(j, _NONE)
            tree.set(i, rank(i))
            if before[i] >= 0:
                tree.set(before[i], rank(before[i]))
        return [x for x in ids if x >= 0]

    def many(self, data: list[bytes]) -> list[bytes]:
        """The ids of each match of 2 to BATCHED bytes, as little-endian 32-bit integers; one tree per row, all at once."""
        lens = np.array([len(x) for x in data])
        n = int(lens.max())
        size = 1 << (n - 1).bit_length()
        m = len(data)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in data), np.uint8).reshape(m, size)
        live = np.arange(size) < lens[:, None]
        ids = np.where(live, self.byte_ids[raw], -1)
        place = np.arange(size, dtype=np.int64)
        after = np.where(place + 1 < lens[:, None], place + 1, -1)
        before = np.where(live, place - 1, -1)
        right = np.full_like(ids, -1)
        right[:, :-1] = ids[:, 1:]
        tree = np.full((m, 2 * size), _NONE << 8, np.int64)  # rank and position as one number
        tree[:, size:] = self.rank_of(np.maximum(ids, 0).ravel(), right.ravel()).reshape(m, size) << 8 | place
        at = size
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2

        def put(rows, i, rank):
            node = i + size
            tree[rows, node] = rank << 8 | i
            while node[0] > 1 if len(node) else False:  # all leaves are on one level
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(m)
        while True:
            root = tree[rows, 1]
            rows = rows[root < (_NONE << 8)]
            if not len(rows):
                break
            root = tree[rows, 1]
            i, r = root & 255, root >> 8
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = r
            ids[rows, j] = -1
            after[rows, i] = k
            has = k >= 0
            before[rows[has], k[has]] = i[has]
            put(rows, j, np.full(len(rows), _NONE, np.int64))
            put(rows, i, self.rank_of(r, np.where(has, ids[rows, np.maximum(k, 0)], -1)))
            b = before[rows, i]
            has = b >= 0
            if has.any():
                rb, bb = rows[has], b[has]
                put(rb, bb, self.rank_of(ids[rb, bb], r[has]))
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, matches: set[str]) -> None:
        """Puts the ids of these matches into the cache."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for x in matches:
            data = x.encode()
            if data in self.ranks:
                self.cache[x] = self.ranks[data].to_bytes(4, "little")
            elif len(data) > BATCHED:
                self.cache[x] = np.array(self.one(data), "<u4").tobytes()
            else:
                short.setdefault((len(data) - 1).bit_length(), []).append((x, data))
        for group in short.values():
            for lo in range(0, len(group), 8192):
                part = group[lo : lo + 8192]
                self.cache.update(zip([x for x, _ in part], self.many([d for _, d in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            matches = self.split(text)
            new = {x for x in matches if x not in self.cache}
            if new:
                out.append((matches, new))
            else:
                out.append((matches, ()))
        missing = set().union(*[n for _, n in out]) if out else set()
        self.learn(missing)
        get = self.cache.__getitem__
        done = [b"".join(map(get, m)) for m, _ in out]
        for x in missing:
            if len(x) > BATCHED:  # the cache is bounded in bytes, too
                del self.cache[x]
        if len(self.cache) > CACHE:
            self.cache.clear()
        return done

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _mapped(path: str, pattern: str, finish):
    def run(batches):
        e = encoder(path, pattern)
        for whole in batches:
            for b in C.chunks(whole, 1 << 20):
                texts = pc.fill_null(b.column(1), "").to_pylist()
                yield finish(e, b, e.encode(texts))

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs(doc_id, text)."""

    def finish(e, b, ids):
        sizes = np.array([0, *[len(x) // 4 for x in ids]])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_mapped(path, pattern, finish), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of (doc_id, ids); null ids are no ids."""

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            out = [e.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes decoded from them."""

    def finish(e, b, ids):
        n = pa.array([len(x) // 4 for x in ids], pa.int64())
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
        back = pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), n, sha, back], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_mapped(path, pattern, finish), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_rows(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and round_trip (whether the ids decode to the text) of every row of docs."""

    def finish(e, b, ids):
        sizes = np.array([0, *[len(x) // 4 for x in ids]])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        same = [e.decode(x) == (t or "").encode() for x, t in zip(ids, b.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sizes[1:], pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return rows.mapInArrow(_mapped(path, pattern, finish), "doc_id long, lang string, source string, n_tokens long, ids array<int>, round_trip boolean")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.documents(spark, sf_dir, "doc_id", "text"), *vocabulary())
